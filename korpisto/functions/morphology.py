"""Gradation, vowel harmony, noun and verb forms as column expressions.

Capitals A, O, U and V stand for archiphonemes in suffixes, and in a base form
too. Every step looks at the word before the step, so neighbours are read by
index from the unchanged characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import VOWELS, characters, let

WEAK, STRONG = "weak", "strong"
# Gradation pairs; V is any vowel on the left, an empty target a deletion.
GRADATION = (
    ("pp", "p"), ("tt", "t"), ("kk", "k"), ("mp", "mm"), ("nt", "nn"), ("nk", "ng"), ("lt", "ll"), ("rt", "rr"),
    ("Vp", "Vv"), ("Vt", "Vd"), ("Vk", "V"),
)
# Cases: Finnish name, English name, singular suffix and grade, plural suffix and grade.
CASES = (
    ("nimento", "nominative", "", STRONG, "t", WEAK),
    ("omanto", "genitive", "n", WEAK, "", STRONG),
    ("osanto", "partitive", "A", STRONG, "", STRONG),
    ("sisaolento", "inessive", "ssA", WEAK, "ssA", WEAK),
    ("sisaeronto", "elative", "stA", WEAK, "stA", WEAK),
    ("sisatulento", "illative", "Vn", STRONG, "n", STRONG),
    ("ulkoolento", "adessive", "llA", WEAK, "llA", WEAK),
    ("ulkoeronto", "ablative", "ltA", WEAK, "ltA", WEAK),
    ("ulkotulento", "allative", "lle", WEAK, "lle", WEAK),
    ("olento", "essive", "nA", STRONG, "nA", STRONG),
    ("tulento", "translative", "ksi", WEAK, "ksi", WEAK),
)
PERSONS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")
PRESENT_ENDINGS = ("n", "t", None, "mme", "tte", "vAt")
PAST_ENDINGS = ("in", "it", "i", "imme", "itte", "ivAt")
CONDITIONAL_ENDINGS = ("isin", "isit", "isi", "isimme", "isitte", "isivAt")
NEGATIVE_VERB = ("en", "et", "ei", "emme", "ette", "eivAt")
TENSES = {"present": "present", "past": "past", "imperfect": "past", "conditional": "conditional"}
POLARITIES = {"affirmative": "affirmative", "aff": "affirmative", "positive": "affirmative", "negative": "negative", "neg": "negative"}
# End of fixed values.


# ------------------------------------------------------------ gradation, harmony
def _graded(focus: Column, left: Column, right: Column, grade: str) -> Column:
    """What a character becomes between its neighbours."""
    out = focus
    clusters = [p for p, _ in GRADATION if p[0] != "V"]
    for source, target in reversed(GRADATION):  # earlier pairs take precedence
        if grade == STRONG:
            source, target = target, source
        if len(source) < 2:
            continue  # a deletion can't be undone
        hit = focus == source[1]
        if source[0] == "V":
            hit &= left.rlike(f"^[{VOWELS}]$")
            starts = [c for c in clusters if c[0] == source[1]] if grade == WEAK else []
            for cluster in starts:  # the first of a pair is the pair's own
                hit &= ~right.eqNullSafe(F.lit(cluster[1]))
        else:
            hit &= left == source[0]
        out = F.when(hit, F.lit(target[1:])).otherwise(out)
    return out


def _touched(grade: str) -> str:
    """What a word holds wherever gradation changes it."""
    return "|".join(t.replace("V", f"[{VOWELS}]") for t in ((p if grade == WEAK else q) for p, q in GRADATION) if len(t) == 2)


def gradate(word: Column, grade: str) -> Column:
    """Gradation at every site of the word."""
    graded = let(characters(word), lambda a: F.array_join(F.transform(a, lambda c, i: _graded(c, F.coalesce(F.get(a, i - 1), F.lit("")), F.get(a, i + 1), grade)), ""))
    return F.when(word.rlike(_touched(grade)), graded).otherwise(word)


_SITE = "(?s)^(.*)((?:" + "|".join(p for p, _ in GRADATION if p[0] != "V") + ")|" + "|".join(f"[{VOWELS}]{c}(?!{c})" for c in "ptk") + ")"


def gradate_stem(word: Column, grade: str) -> Column:
    """Gradation at the last site only; a word without one is graded whole."""
    def at(found: Column) -> Column:  # as far as the last site's two characters
        start = F.length(found) - 2
        single = F.substring(found, start + 1, F.lit(1)).rlike(f"^[{VOWELS}]$")
        keep = F.when(found == "", 0).when(single, start).otherwise(F.greatest(start - 1, F.lit(0)))
        return let(keep, lambda k: F.concat(F.substring(word, F.lit(1), k), let(F.substring(word, k + 1, F.length(word)), lambda tail: gradate(tail, grade))))

    return let(F.regexp_extract(word, _SITE, 0), at)


def harmonize(word: Column) -> Column:
    """A, O, U by the nearest back or front vowel to the left; front without one."""
    def one(c: Column, i: Column) -> Column:
        nearest = F.regexp_extract(F.substring(word, F.lit(1), i), "(?s).*([aouäöy])", 1)
        back = nearest.isin("a", "o", "u")
        pick = lambda b, f: F.when(back, b).otherwise(f)
        return F.when(c == "A", pick("a", "ä")).when(c == "O", pick("o", "ö")).when(c == "U", pick("u", "y")).otherwise(c)

    return F.when(word.rlike("[AOU]"), F.array_join(F.transform(characters(word), one), "")).otherwise(word)


def copy_vowel(word: Column) -> Column:
    """V by the nearest vowel to the left; stays without one."""
    def one(c: Column, i: Column) -> Column:
        nearest = F.regexp_extract(F.substring(word, F.lit(1), i), f"(?s).*([{VOWELS}])", 1)
        return F.when((c == "V") & (nearest != ""), nearest).otherwise(c)

    return F.when(word.contains("V"), F.array_join(F.transform(characters(word), one), "")).otherwise(word)


def morphophonology(word: Column, grade: str) -> Column:
    """Gradation, harmony and vowel copying; a deleted character still counts as a neighbour."""
    marked = let(characters(word), lambda a: F.array_join(F.transform(a, lambda c, i: F.when(_graded(c, F.coalesce(F.get(a, i - 1), F.lit("")), F.get(a, i + 1), grade) == "", "\u0000").otherwise(_graded(c, F.coalesce(F.get(a, i - 1), F.lit("")), F.get(a, i + 1), grade))), ""))
    return F.replace(let(let(marked, harmonize), copy_vowel), F.lit("\u0000"), F.lit(""))


# ------------------------------------------------------------------------- nouns
def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def harmony_marker(word: Column) -> Column:
    """a or ä by the first back or front vowel; a without one."""
    return F.when(F.regexp_extract(word, "([aouäöy])", 1).isin("ä", "ö", "y"), "ä").otherwise("a")


def plural_stem(word: Column) -> Column:
    return F.when(word.rlike("[aä]$"), F.concat(_without(word, 1), F.lit("i"))).when(word.rlike("i$"), F.concat(_without(word, 1), F.lit("ei"))).when(word == "", "").otherwise(F.concat(word, F.lit("i")))


def _singular(word: Column, suffix: str, grade: str) -> Column:
    if not suffix:
        return word
    joined = F.concat(gradate_stem(word, grade), F.lit(suffix))
    return let(let(joined, harmonize), copy_vowel)


def _plural(word: Column, case: str, suffix: str, grade: str) -> Column:
    ends = lambda pattern: word.rlike(pattern)
    strong = gradate_stem(word, STRONG)
    stem_strong = let(plural_stem(word), lambda s: gradate_stem(s, STRONG))
    if case == "nominative":
        return F.concat(gradate_stem(word, WEAK), F.lit("t"))
    if case == "genitive":
        on_vowel = F.when(harmony_marker(word) == "ä", F.concat(strong, F.lit("jän"))).otherwise(F.concat(strong, F.lit("jen")))
        on_i = F.concat(let(_without(word, 1), lambda s: gradate_stem(s, STRONG)), F.lit("ien"))
        return F.when(word == "", "").when(ends("[oöuye]$"), on_vowel).when(ends("i$"), on_i).otherwise(F.concat(stem_strong, F.lit("en")))
    if case == "partitive":
        marker = harmony_marker(word)
        return F.when(word == "", "").when(ends("[aä]$"), F.concat(stem_strong, marker)).when(ends("i$"), F.concat(strong, marker)).otherwise(F.concat(strong, F.lit("j"), marker))
    if case == "illative":
        return F.concat(stem_strong, F.when(ends("[aä]$"), "in").otherwise("hin"))
    hinted = F.concat(let(plural_stem(word), lambda s: gradate_stem(s, grade)), F.lit(suffix), harmony_marker(word))
    return _without(let(hinted, harmonize), 1)


def noun_form(word: Column, case: str, number: str = "singular") -> Column:
    """A noun's form; ``case`` by Finnish or English name. Null for an unknown case."""
    plural = number.lower() in ("plural", "monikko", "pl")
    for finnish, english, suffix, grade, plural_suffix, plural_grade in CASES:
        if case.lower() in (finnish, english):
            return _plural(word, english, plural_suffix, plural_grade) if plural else _singular(word, suffix, grade)
    return F.lit(None).cast("string")


def _nearest(word: Column, vowels: str) -> Column:
    return F.regexp_extract(word, f"(?s).*([{vowels}])", 1)


def noun_paradigm(df: DataFrame, word: str = "word") -> DataFrame:
    """22 rows a word: position, label (``genitive pl``) and form, beside the input's columns.

    The forms are those of ``noun_form``. What a suffix's archiphonemes become depends on what
    stands before them, so each stem of a word is graded and harmonised once for all its forms.
    """
    w, made = F.col(word), {}
    stems = {"_weak": (w, WEAK), "_strong": (w, STRONG), "_plural_weak": (F.col("_plural"), WEAK), "_plural_strong": (F.col("_plural"), STRONG)}
    graded = df.withColumn("_plural", plural_stem(w)).withColumns({name: gradate_stem(*of) for name, of in stems.items()})
    own = graded.withColumns({f"{name}_own": harmonize(F.col(name)) for name in stems})
    own = own.withColumns({f"{name}_low": F.when(_nearest(F.col(name), "aouäöy").isin("a", "o", "u"), "a").otherwise("ä") for name in stems} | {"_marker": harmony_marker(w), "_vowel": _nearest(F.col("_strong_own"), VOWELS)})
    own = own.withColumns({f"{name}_own": copy_vowel(F.col(f"{name}_own")) for name in ("_weak", "_strong")} | {"_vowel": F.when(F.col("_vowel") == "", "V").otherwise(F.col("_vowel"))})

    def joined(stem: str, suffix: str) -> Column:
        tail = [F.col("_vowel"), F.lit(suffix[1:])] if suffix.startswith("V") else [F.lit(suffix[:-1]), F.col(f"{stem}_low")] if suffix.endswith("A") else [F.lit(suffix)]
        return F.concat(F.col(f"{stem}_own"), *tail)

    weak, strong, plural, marker = F.col("_weak"), F.col("_strong"), F.col("_plural_strong"), F.col("_marker")
    on_a, on_i = w.rlike("[aä]$"), w.rlike("i$")
    cut = F.concat(let(_without(w, 1), lambda s: gradate_stem(s, STRONG)), F.lit("ien"))
    made["nominative"] = F.concat(weak, F.lit("t"))
    made["genitive"] = F.when(w == "", "").when(w.rlike("[oöuye]$"), F.concat(strong, F.when(marker == "ä", "jän").otherwise("jen"))).when(on_i, cut).otherwise(F.concat(plural, F.lit("en")))
    made["partitive"] = F.when(w == "", "").when(on_a, F.concat(plural, marker)).when(on_i, F.concat(strong, marker)).otherwise(F.concat(strong, F.lit("j"), marker))
    made["illative"] = F.concat(plural, F.when(on_a, "in").otherwise("hin"))
    forms = [(f"{c[1]} sg", joined(f"_{c[3]}", c[2]) if c[2] else w) for c in CASES]
    forms += [(f"{c[1]} pl", made[c[1]] if c[1] in made else joined(f"_plural_{c[5]}", c[4])) for c in CASES]
    cells = [F.struct(F.lit(label).alias("label"), form.alias("form")) for label, form in forms]
    return own.select(*df.columns, F.posexplode(F.array(*cells)).alias("position", "cell")).select(*df.columns, "position", "cell.label", "cell.form")


# ------------------------------------------------------------------------- verbs
def verb_type(word: Column) -> Column:
    """1 to 4 by the ending, null for none."""
    low = F.lower(word)
    v = f"[{VOWELS}]"
    return (
        F.when(low.rlike("(ll|nn|rr|st)[aä]$"), 3).when(low.rlike(f"{v}d[aä]$"), 2).when(low.rlike(f"{v}t[aä]$"), 4)
        .when(low.rlike(f"{v}[aä]$"), 1)
    )


def undo_weak(stem: Column) -> Column:
    """mm to mp or nn to nt at the last such pair after a vowel or at the start, else a lone p, t, k after a vowel doubled."""
    v = f"[{VOWELS}]"
    pair = f"(?s)^((?:.*{v})?)(mm|nn)"
    lone = f"(?s)^(.*{v})([ptk])(?!\\2)"

    def from_pair(n: Column) -> Column:
        return F.concat(F.substring(stem, F.lit(1), n + 1), F.when(F.substring(stem, n + 1, F.lit(1)) == "m", "p").otherwise("t"), F.substring(stem, n + 3, F.length(stem)))

    def from_lone(n: Column) -> Column:
        return F.concat(F.substring(stem, F.lit(1), n + 1), F.substring(stem, n + 1, F.length(stem)))

    return (
        F.when(stem.rlike(pair), let(F.length(F.regexp_extract(stem, pair, 1)), from_pair))
        .when(stem.rlike(lone), let(F.length(F.regexp_extract(stem, lone, 1)), from_lone)).otherwise(stem)
    )


def verb_stems(df: DataFrame, word: str = "word") -> DataFrame:
    """The input with verb_type, present, connegative, past, participle and conditional stems."""
    w, kind = F.col(word), F.col("verb_type")
    one, two = _without(w, 1), _without(w, 2)
    sta = F.lower(w).rlike("st[aä]$")
    third = F.when(sta, two).otherwise(undo_weak(two))
    present = F.when(kind == 1, one).when(kind == 2, two).when(kind == 3, F.concat(third, F.lit("e"))).when(kind == 4, F.concat(let(two, lambda s: gradate_stem(s, STRONG)), F.substring(w, -1, 1)))
    past = (
        F.when(kind == 1, F.when(one.rlike("[eä]$"), two).when(one.rlike("a$"), F.concat(two, F.lit("o"))).otherwise(one))
        .when(kind == 2, F.when(two.rlike("i$"), _without(w, 3)).otherwise(two)).when(kind == 3, third).when(kind == 4, F.concat(two, F.lit("s")))
    )
    return (
        df.withColumn("verb_type", verb_type(w)).withColumn("present_stem", present)
        .withColumn("connegative_stem", F.when(kind == 1, one).when(kind == 2, two).otherwise(F.col("present_stem")))
        .withColumn("past_stem", past)
        .withColumn("participle_stem", F.when(kind <= 2, F.col("connegative_stem")).otherwise(F.col("past_stem")))
        .withColumn("conditional_stem", F.when(kind == 1, F.when(one.rlike("e$"), two).otherwise(one)).when(kind == 4, two).otherwise(F.col("past_stem")))
    )


def _first_type_graded(stem: str, grade: str) -> Column:
    return F.when(F.col("verb_type") == 1, gradate_stem(F.col(stem), grade)).otherwise(F.col(stem))


def verb_form_of_stems(tense: str, person: str, polarity: str) -> Column:
    """A form from the columns of ``verb_stems``; null for unknown verbs or parameters."""
    tense, polarity, person = TENSES.get(tense.lower()), POLARITIES.get(polarity.lower()), person.lower()
    if tense is None or polarity is None or person not in PERSONS:
        return F.lit(None).cast("string")
    k = PERSONS.index(person)
    if polarity == "negative":
        helper = F.lit(NEGATIVE_VERB[k].replace("A", "ä"))  # its vowels are neutral
        if tense == "present":
            main = _first_type_graded("connegative_stem", WEAK)
        elif tense == "past":
            main = let(F.concat(_first_type_graded("participle_stem", WEAK), F.lit("nUt")), harmonize)
        else:
            main = F.concat(_first_type_graded("conditional_stem", WEAK), F.lit("isi"))
        return F.concat(helper, F.lit(" "), main)
    grade = STRONG if person == "3sg" else WEAK
    if tense == "conditional":
        joined = F.concat(F.col("conditional_stem"), F.lit(CONDITIONAL_ENDINGS[k]))
    elif tense == "past":
        joined = F.concat(_first_type_graded("past_stem", grade), F.lit(PAST_ENDINGS[k]))
    elif person == "3sg":
        joined = let(_first_type_graded("present_stem", grade), lambda s: F.concat(s, F.regexp_extract(s, f"(?s).*([{VOWELS}])", 1)))
    else:
        joined = F.concat(_first_type_graded("present_stem", grade), F.lit(PRESENT_ENDINGS[k]))
    return let(joined, harmonize)


_STEMS = ("verb_type", "present_stem", "connegative_stem", "past_stem", "participle_stem", "conditional_stem")


def verb_form(df: DataFrame, word: str, tense: str, person: str, polarity: str = "affirmative", name: str = "form") -> DataFrame:
    return verb_stems(df, word).withColumn(name, verb_form_of_stems(tense, person, polarity)).drop(*_STEMS)


def verb_paradigm(df: DataFrame, word: str = "word") -> DataFrame:
    """24 rows a verb: position, label (``neg present 1sg``) and form; no rows for unknown verbs."""
    rows = [(t, t, "affirmative") for t in ("present", "past", "conditional")] + [("neg present", "present", "negative")]
    cells = [F.struct(F.lit(f"{label} {p}").alias("label"), verb_form_of_stems(tense, p, polarity).alias("form")) for label, tense, polarity in rows for p in PERSONS]
    stems = verb_stems(df, word).where("verb_type is not null")
    return stems.select(*df.columns, F.posexplode(F.array(*cells)).alias("position", "cell")).select(*df.columns, "position", "cell.label", "cell.form")
