"""Grammar findings: 21 rules over word tokens, as column expressions on whole documents.

Each word carries the word before it and the text between them, from which the
surface rules follow without state: marks between two words are tokens of one
character, so a search in the gap is a search among its tokens. Without readings
no surface rule finds a word that stands behind one space after another one and is
neither the same nor of a rule's words, so only the others get that far. Rules with
memory (quotes, double negation, main verbs) fold over the few tokens concerned.
Places are byte offsets, told from a token's number for what is found alone.
Findings are sorted by start and end; equal ones keep the order of the rules.

``readings`` is an optional array column with one struct (or null) a word token,
holding at least CLASS, NUMBER, SIJAMUOTO, PERSON, POSSESSIVE and COMPARISON.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import SPACE, let
from korpisto.operators.tokens import is_word, running_starts, token_texts

# Words and classes of the rules.
REPEATS_ALLOWED = ("no", "niin", "joo", "ai", "hei", "nyt", "tule")
CONJUNCTIONS = ("kun", "koska", "vaikka", "jos", "että", "jotta", "kunnes", "ellei", "ettei", "mikäli", "vaan")
RELATIVES = (
    "joka", "jotka", "jonka", "joiden", "jota", "joita", "jossa", "joissa", "josta", "joista", "johon", "joihin", "jolla", "joilla",
    "jolta", "joilta", "jolle", "joille", "mikä", "mitkä", "minkä", "mitä", "missä", "mistä", "mihin", "sillä",
)
COMPOUNDS = (
    "jää kaappi", "kahvi kuppi", "auto talli", "posti laatikko", "kirja hylly", "maa pallo", "rautatie asema", "pöytä liina",
    "pyyhe teline", "huone kalu", "pesu kone", "tieto kone", "matka puhelin", "palo auto", "poliisi auto", "koulu kirja",
    "työ paikka", "työ huone", "koti maa", "ulko maa", "vuokra asunto", "asuin paikka", "lämpö mittari", "sade takki",
    "talvi takki", "kesä loma", "joulu pukki", "joulu kuusi", "synnyin päivä", "ruoka kauppa", "koiran ruoka", "kissan ruoka",
    "hammas harja", "hammas lääkäri", "silmä lääkäri", "pää kaupunki", "vesi johto", "sähkö johto",
)
COMPOUND_EXCEPTIONS = {"vuokra asunto": "vuokra-asunto", "synnyin päivä": "syntymäpäivä"}
NUMERALS = (
    "kaksi", "kolme", "neljä", "viisi", "kuusi", "seitsemän", "kahdeksan", "yhdeksän", "kymmenen", "yksitoista", "kaksitoista",
    "kolmetoista", "neljätoista", "viisitoista", "kaksikymmentä", "kolmekymmentä", "sata", "tuhat", "miljoona",
)
PRONOUNS = {
    "minä": ("en", "1st person singular", "1"), "mä": ("en", "1st person singular", "1"), "sinä": ("et", "2nd person singular", "2"),
    "sä": ("et", "2nd person singular", "2"), "hän": ("ei", "3rd person singular", "3"), "se": ("ei", "3rd person singular", "3"),
    "me": ("emme", "1st person plural", "1"), "te": ("ette", "2nd person plural", "2"), "he": ("eivät", "3rd person plural", "3"),
    "ne": ("eivät", "3rd person plural", "3"),
}
NEGATIONS = ("en", "et", "ei", "emme", "ette", "eivät")
POSTPOSITIONS = (
    "jälkeen", "aikana", "kautta", "kanssa", "vuoksi", "takia", "puolesta", "sijaan", "ympäri", "keskellä", "takana", "edessä",
    "vieressä", "alla", "päällä", "sisällä", "lähellä", "luona", "mukaan",
)
POSSESSIVES = ("minun", "sinun", "hänen", "meidän", "teidän", "heidän")
NOUNS = ("nimisana", "etunimi", "sukunimi", "paikannimi", "nimi")
PROPER_NOUNS = ("etunimi", "sukunimi", "paikannimi")
VERBS = ("teonsana", "kieltosana")
# End of fixed values.

#: Case names the rules ask for; analysers may write others, so they are a parameter.
CASE_NAMES = {"partitive": ("ospitkasija", "partitiivi"), "genitive": ("ompitkasija",), "not_partitive": ("npitkasija", "ompitkasija")}
FINDING = "array<struct<start:int,end:int,code:string,message:string,suggestions:array<string>>>"
#: White space of several spaces and nothing else, or all that lies between two of them.
_WIDE = f"(?:[^{SPACE}]++| (?![{SPACE}])|(?! ++(?![{SPACE}]))[{SPACE}]++)++| ++"
_TERMINATOR = "\\.\\.\\.|[.!?]"
_QUOTES = "[\"“”»«]"
#: Words that a rule may find behind a single space, beside pronouns after a negation.
_LOOKED_AT = tuple(dict.fromkeys((*CONJUNCTIONS, *RELATIVES, *NEGATIONS, *(c.split(" ")[1] for c in COMPOUNDS))))


def _finding(start: Column, end: Column, code: str, message: Column, *suggestions: Column) -> Column:
    made = F.array(*suggestions) if suggestions else F.array().cast("array<string>")
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(code).alias("code"), message.alias("message"), made.alias("suggestions"))


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def _none() -> Column:
    return F.array().cast(FINDING)


def _pick(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(_none())


class Places:
    """Byte offsets of tokens by their numbers: sums before every 64th one, and the tokens since then."""

    SHIFT = 6

    def __init__(self, texts: Column, sums: Column) -> None:
        self.texts, self.sums = texts, sums

    @classmethod
    def within(cls, texts: Column, body: Callable[[Places], Column]) -> Column:
        def octets(k: Column) -> Column:
            return F.octet_length(F.array_join(F.slice(texts, F.shiftleft(k, cls.SHIFT) + 1, F.lit(1 << cls.SHIFT)), ""))

        parts = F.sequence(F.lit(0), F.shiftright(F.size(texts), cls.SHIFT))
        return let(running_starts(F.transform(parts, octets)), lambda sums: body(cls(texts, sums)))

    def start(self, k: Column) -> Column:
        """Where token k starts, which is where the one before it ends."""
        since = k.bitwiseAND(F.lit((1 << self.SHIFT) - 1))
        return F.get(self.sums, F.shiftright(k, self.SHIFT)) + F.octet_length(F.array_join(F.slice(self.texts, k - since + 1, since), ""))

    def found(self, condition: Callable[[Column, Column], Column], finding: Callable[[Column, Column], Column]) -> Column:
        """One finding for each token (with its number) for which the condition holds."""
        return F.filter(F.transform(self.texts, lambda t, k: F.when(condition(t, k), finding(t, k))), lambda f: f.isNotNull())


def words_with_context(texts: Column, readings: Column | None) -> Column:
    """Word tokens that a rule may find, of all tokens' texts: text, low, k (the token's number), gap (text since the word before), first, ended (whether a sentence ended in the gap), p and pp (the words before), reading."""
    words = F.filter(F.transform(texts, lambda t, k: F.when(is_word(t), F.struct(t.alias("text"), F.lower(t).alias("low"), k.alias("k")))), lambda w: w.isNotNull())

    def build(ws: Column) -> Column:
        def at(i: Column) -> Column:
            w = F.get(ws, i)
            return w if readings is None else F.struct(w.text.alias("text"), w.low.alias("low"), w.k.alias("k"), F.get(readings, i).alias("reading"))

        def one(w: Column, i: Column) -> Column:
            p = F.get(ws, i - 1)
            from_ = F.coalesce(p.k + 1, F.lit(0))
            gap = F.array_join(F.slice(texts, from_ + 1, w.k - from_), "")
            more = [] if readings is None else [F.get(readings, i).alias("reading"), at(i - 2).alias("pp")]
            made = let(gap, lambda g: F.struct(w.text.alias("text"), w.low.alias("low"), w.k.alias("k"), g.alias("gap"), (i == 0).alias("first"), g.rlike("[.!?]").alias("ended"), at(i - 1).alias("p"), *more))
            if readings is not None:
                return made
            looked_at = w.low.isin(*_LOOKED_AT) | (w.low.isin(*PRONOUNS) & p.low.isin(*NEGATIONS))
            plain = (w.k == p.k + 2) & (F.get(texts, w.k - 1) == " ") & ~looked_at & (w.low != p.low)
            return F.when(plain, F.lit(None)).otherwise(made)

        made = F.transform(ws, one)
        return made if readings is not None else F.filter(made, lambda w: w.isNotNull())

    return let(words, build)


class _At:
    """A word with its place."""

    def __init__(self, w: Column, start: Column) -> None:
        self.text, self.low, self.start, self.end = w["text"], w["low"], start, start + F.octet_length(w["text"])
        self.word = w

    def __getattr__(self, name: str) -> Column:
        return self.word[name]


def _word_rules(words: Column, places: Places, rules: set[str], has_readings: bool, cases: dict[str, tuple[str, ...]]) -> Column:
    """Findings of the rules that look at a word, the one or two before it and the gaps."""

    def one(word: Column) -> Column:
        hits, _ = told(word, F.lit(None).cast("struct<w:int,p:int>"))
        # most words break no rule, and for those nothing is built
        made = lambda: let(F.struct(places.start(word.k).alias("w"), places.start(word.p.k).alias("p")), lambda at: F.concat(*told(word, at)[1]))
        return F.when(reduce(or_, hits), made()).otherwise(_none()) if hits else _none()

    def told(word: Column, at: Column) -> tuple[list[Column], list[Column]]:
        """What the rules ask, and their findings where that holds."""
        w, p, pp = _At(word, at.w), _At(word.p, at.p), word.pp if has_readings else None
        starts_sentence = w.first | w.ended
        upper_first = F.substring(w.text, 1, 1).rlike("^\\p{IsUppercase}")
        out: list[Column] = []
        hits: list[Column] = []

        def add(code: str, condition: Column, finding: Column) -> None:
            if code in rules:
                hits.append(F.coalesce(condition, F.lit(False)))
                out.append(_pick(hits[-1], finding))

        add("REPEATED_WORD", (w.low == p.low) & (F.length(w.text) > 1) & ~w.low.isin(*REPEATS_ALLOWED), _finding(w.start, w.end, "REPEATED_WORD", _say("Repeated word: \"", w.text, "\""), F.lit("")))
        add("CAPITALIZATION_ERROR", starts_sentence & ~upper_first, _finding(w.start, w.end, "CAPITALIZATION_ERROR", _say("Sentence should start with a capital letter: \"", w.text, "\""), _capital(w.text)))
        joined = F.create_map(*[x for c in COMPOUNDS for x in (F.lit(c), F.lit(COMPOUND_EXCEPTIONS.get(c, c.replace(" ", ""))))])
        pair = F.concat(p.low, F.lit(" "), w.low)
        add("COMPOUND_SPACING", pair.isin(*COMPOUNDS), _finding(p.start, w.end, "COMPOUND_SPACING", _say("\"", p.text, " ", w.text, "\" should be written as one word: \"", F.element_at(joined, pair), "\""), F.element_at(joined, pair)))
        for code, list_, what in (("COMMA_BEFORE_CONJUNCTION", CONJUNCTIONS, "subordinating conjunction"), ("COMMA_BEFORE_RELATIVE", RELATIVES, "relative pronoun/conjunction")):
            add(code, w.low.isin(*list_) & ~starts_sentence & ~w.gap.contains(","), _finding(p.end, w.start, code, _say(f"Missing comma before {what} \"", w.text, "\""), _say(", ", w.text)))
        expected = F.create_map(*[x for k, v in PRONOUNS.items() for x in (F.lit(k), F.lit(v[0]))])
        label = F.create_map(*[x for k, v in PRONOUNS.items() for x in (F.lit(k), F.lit(v[1]))])
        for pronoun, negation, order in ((p, w, 0), (w, p, 1)):
            want = F.element_at(expected, pronoun.low)
            fixed = _say(pronoun.text, " ", want) if order == 0 else _say(want, " ", pronoun.text)
            add("NEGATION_AGREEMENT", negation.low.isin(*NEGATIONS) & pronoun.low.isin(*PRONOUNS) & (negation.low != want), _finding(p.start, w.end, "NEGATION_AGREEMENT", _say("Negation verb mismatch: \"", pronoun.text, "\" (", F.element_at(label, pronoun.low), ") requires \"", want, "\" but found \"", negation.text, "\""), fixed))
        add("MISSING_SPACE_AFTER_PUNCT", w.gap.rlike("[.,;:!?]\\z"), _finding(
            w.start - F.when(w.gap.rlike("(?<!\\.)(\\.{3})+\\z"), 3).otherwise(1), w.end, "MISSING_SPACE_AFTER_PUNCT",
            _say("Missing space after '", F.substring(w.gap, -1, 1), "' before \"", w.text, "\""), _say(F.when(w.gap.rlike("(?<!\\.)(\\.{3})+\\z"), "...").otherwise(F.substring(w.gap, -1, 1)), " ", w.text)))
        add("SENTENCE_INITIAL_LOWERCASE", w.gap.rlike("(?s)[:;][^.!?]*\\z") & F.substring(w.text, 1, 1).rlike("^\\p{IsLowercase}"), _finding(w.start, w.end, "SENTENCE_INITIAL_LOWERCASE", _say("Consider capitalizing \"", w.text, "\" after colon/semicolon"), _capital(w.text)))
        if has_readings:
            r, rp = w.reading, p.reading
            add("CAPITALIZATION_ERROR", ~starts_sentence & r.CLASS.isin(*PROPER_NOUNS) & ~upper_first, _finding(w.start, w.end, "CAPITALIZATION_ERROR", _say("Proper noun should be capitalized: \"", w.text, "\""), _capital(w.text)))
            subjects, verbs = (*NOUNS, "asemosana"), VERBS
            match = (rp.CLASS.isin(*subjects) & r.CLASS.isin(*verbs)) | (rp.CLASS.isin(*verbs) & r.CLASS.isin(*subjects))
            add("AGREEMENT_ERROR", match & (rp.NUMBER != r.NUMBER), _finding(p.start, w.end, "AGREEMENT_ERROR", _say("Subject-verb number mismatch: \"", p.text, "\" (", rp.NUMBER, ") + \"", w.text, "\" (", r.NUMBER, ")")))
            add("NUMBER_AGREEMENT", p.low.isin(*NUMERALS) & r.CLASS.isin(*NOUNS) & (F.coalesce(r.NUMBER == "plural", F.lit(False)) | F.coalesce(~r.SIJAMUOTO.isin(*cases["partitive"]), F.lit(False))), _finding(p.start, w.end, "NUMBER_AGREEMENT", _say("After \"", p.text, "\" the noun should be in singular partitive: \"", w.text, "\" may need a different form")))
            add("PARTITIVE_OBJECT", pp.low.isin(*NEGATIONS) & (rp.CLASS == "teonsana") & r.CLASS.isin(*NOUNS) & r.SIJAMUOTO.isin(*cases["not_partitive"]), _finding(w.start, w.end, "PARTITIVE_OBJECT", _say("Object \"", w.text, "\" in negated sentence should be in partitive case")))
            persons = F.create_map(*[x for k, v in PRONOUNS.items() for x in (F.lit(k), F.lit(v[2]))])
            for pronoun, verb in ((p, w), (w, p)):
                want = F.element_at(persons, pronoun.low)
                first, second = (want, verb.reading.PERSON) if pronoun is p else (verb.reading.PERSON, want)
                add("SUBJECT_VERB_PERSON", pronoun.low.isin(*PRONOUNS) & (verb.reading.CLASS == "teonsana") & (want != verb.reading.PERSON), _finding(p.start, w.end, "SUBJECT_VERB_PERSON", _say("Person mismatch: \"", p.text, "\" (person ", first, ") + \"", w.text, "\" (person ", second, ")")))
            add("POSTPOSITION_CASE", w.low.isin(*POSTPOSITIONS) & rp.CLASS.isin(*NOUNS) & ~rp.SIJAMUOTO.isin(*cases["genitive"]), _finding(p.start, w.end, "POSTPOSITION_CASE", _say("Postposition \"", w.text, "\" requires genitive case, but \"", p.text, "\" appears to be in a different case")))
            add("COMPARATIVE_PARTITIVE", (rp.CLASS == "laatusana") & (rp.COMPARISON == "comparative") & r.CLASS.isin(*NOUNS) & r.SIJAMUOTO.isin(*cases["partitive"]), _finding(p.start, w.end, "COMPARATIVE_PARTITIVE", _say("Comparative \"", p.text, "\" followed by partitive \"", w.text, "\"")))
            add("POSSESSIVE_REDUNDANCY", p.low.isin(*POSSESSIVES) & r.CLASS.isin(*NOUNS, "laatusana") & r.POSSESSIVE.isNotNull(), _finding(p.start, w.end, "POSSESSIVE_REDUNDANCY", _say("Possessive pronoun \"", p.text, "\" is redundant when \"", w.text, "\" already has a possessive suffix"), w.text))
        return hits, out

    return F.flatten(F.transform(words, one))


def _double_negation(words: Column, places: Places) -> Column:
    state = F.struct(F.lit(None).cast("struct<text:string,k:int>").alias("held"), _none().alias("out"))

    def step(s: Column, w: Column) -> Column:
        held = F.when(w.first | w.ended, F.lit(None)).otherwise(s.held)
        here = w.low.isin(*NEGATIONS)
        found = _finding(places.start(held.k), places.start(w.k + 1), "DOUBLE_NEGATION", _say("Double negation: \"", held.text, "\" ... \"", w.text, "\" — standard Finnish uses single negation"))
        return F.struct(
            F.when(here & held.isNull(), F.struct(w.text.alias("text"), w.k.alias("k"))).otherwise(held).alias("held"),
            F.when(here & held.isNotNull(), F.array_append(s.out, found)).otherwise(s.out).alias("out"),
        )

    return F.aggregate(words, state, step, lambda s: s.out)


def _quotes(places: Places) -> Column:
    """Pairs of each kind; a close without an open, and opens left at the end."""
    marks = F.flatten(places.found(lambda t, k: t.rlike(_QUOTES), lambda t, k: F.transform(F.regexp_extract_all(t, F.lit(_QUOTES), F.lit(0)), lambda c: F.struct(c.alias("c"), k.alias("k")))))
    state = F.struct(F.array().cast("array<struct<kind:string,k:int>>").alias("open"), _none().alias("out"))

    def step(s: Column, m: Column) -> Column:
        kind = F.when(m.c == "\"", "\"").when(m.c.isin("“", "”"), "“").otherwise("»")
        opens = m.c.isin("“", "»") | ((m.c == "\"") & ~F.exists(s.open, lambda o: o.kind == "\""))
        last = F.array_max(F.transform(s.open, lambda o, i: F.when(o.kind == kind, i).otherwise(-1)))
        known = F.coalesce(last >= 0, F.lit(False))
        return F.struct(
            F.when(opens, F.array_append(s.open, F.struct(kind.alias("kind"), m.k.alias("k")))).when(known, F.filter(s.open, lambda o, i: i != last)).otherwise(s.open).alias("open"),
            F.when(~opens & ~known, F.array_append(s.out, _finding(places.start(m.k), places.start(m.k + 1), "QUOTATION_MARK_ERROR", _say("Closing ", m.c, " without matching opening ", kind)))).otherwise(s.out).alias("out"),
        )

    def close(s: Column) -> Column:
        return F.concat(s.out, F.transform(s.open, lambda o: _finding(places.start(o.k), places.start(o.k) + F.octet_length(o.kind), "QUOTATION_MARK_ERROR", _say("Unmatched opening quotation mark: ", o.kind))))

    return F.aggregate(marks, state, step, close)


def _main_verbs(words: Column, places: Places) -> Column:
    nowhere = F.lit(None).cast("int")
    state = F.struct(nowhere.alias("from"), F.lit(0).alias("n"), F.lit(False).alias("known"), F.lit(False).alias("verb"), nowhere.alias("last"), _none().alias("out"))
    code = "MISSING_MAIN_VERB"

    def told(s: Column, end: Column) -> Column:
        return F.when(s.known & (s.n >= 3) & ~s.verb, F.array_append(s.out, _finding(places.start(s["from"]), end, code, F.lit("Sentence appears to be missing a finite verb")))).otherwise(s.out)

    def stop(gap: Column) -> Column:
        """Bytes from the gap's start to the end of its first sentence end."""
        return F.octet_length(F.regexp_extract(gap, f"(?s)^(.*?(?:{_TERMINATOR}))", 1))

    def step(s: Column, w: Column) -> Column:
        ended = w.ended
        fresh = ended | s["from"].isNull()
        r = w.reading
        return F.struct(
            F.when(fresh, w.k).otherwise(s["from"]).alias("from"), (F.when(ended, 0).otherwise(s.n) + 1).alias("n"),
            ((s.known & ~ended) | r.isNotNull()).alias("known"), ((s.verb & ~ended) | F.coalesce(r.CLASS.isin(*VERBS), F.lit(False))).alias("verb"),
            w.k.alias("last"), F.when(ended, told(s, places.start(s["last"] + 1) + stop(w.gap))).otherwise(s.out).alias("out"),
        )

    def close(s: Column) -> Column:
        end, tail = places.start(s["last"] + 1), F.array_join(F.slice(places.texts, s["last"] + 2, F.size(places.texts)), "")
        return told(s, F.when(tail.rlike("[.!?]"), end + stop(tail)).otherwise(end))

    return F.aggregate(words, state, step, close)


def _double_spaces(text: Column) -> Column:
    """A token of white space is a run of it, so this rule asks for no other token."""

    def of(parts: Column) -> Column:
        def one(t: Column, at: Column) -> Column:
            found = _finding(at, at + F.length(t), "DOUBLE_SPACE", _say("Multiple spaces (", F.length(t).cast("string"), ") between words — use a single space"), F.lit(" "))
            return F.when(t.startswith("  ") & (F.replace(t, F.lit(" "), F.lit("")) == ""), found)

        return F.filter(F.zip_with(parts, running_starts(F.transform(parts, lambda t: F.octet_length(t))), one), lambda f: f.isNotNull())

    return F.when(text.contains("  "), let(F.regexp_extract_all(text, F.lit(_WIDE), F.lit(0)), of)).otherwise(_none())


def _token_rules(text: Column, places: Places, rules: set[str]) -> Column:
    """Rules that look at tokens of any kind, which are walked through only if the text has what they look for."""
    out = []

    def add(pattern: str, found: Column) -> None:
        out.append(F.when(text.rlike(pattern), found).otherwise(_none()))

    if "EXTRA_SPACE_BEFORE_PUNCT" in rules:
        def spaced(t: Column, k: Column) -> Column:
            return F.substring(t, 1, 1).isin(*".,;:!?") & F.get(places.texts, k - 1).rlike(f"^[{SPACE}]") & is_word(F.get(places.texts, k - 2))
        add(f"[{SPACE}][.,;:!?]", places.found(spaced, lambda t, k: _finding(places.start(k - 1), places.start(k + 1), "EXTRA_SPACE_BEFORE_PUNCT", _say("Unexpected space before '", F.substring(t, 1, 1), "'"), t)))
    if "EXCESSIVE_EXCLAMATION" in rules:  # tokens of this tokenizer hold one mark, so this needs tokens of another
        many = lambda t, k: _finding(places.start(k), places.start(k + 1), "EXCESSIVE_EXCLAMATION", _say("Excessive punctuation: \"", t, "\" — use a single mark in formal writing"), F.when(t.contains("?"), "?").otherwise("!"))
        add("[!?]{3}", places.found(lambda t, k: t.rlike("^[!?]{3,}\\z"), many))
    if "QUOTATION_MARK_ERROR" in rules:
        add(_QUOTES, _quotes(places))
    return F.concat(*out) if out else _none()


RULES = (
    "REPEATED_WORD", "CAPITALIZATION_ERROR", "AGREEMENT_ERROR", "DOUBLE_SPACE", "QUOTATION_MARK_ERROR", "COMMA_BEFORE_CONJUNCTION", "COMPOUND_SPACING",
    "NUMBER_AGREEMENT", "NEGATION_AGREEMENT", "DOUBLE_NEGATION", "MISSING_SPACE_AFTER_PUNCT", "EXTRA_SPACE_BEFORE_PUNCT", "PARTITIVE_OBJECT",
    "SUBJECT_VERB_PERSON", "POSTPOSITION_CASE", "COMPARATIVE_PARTITIVE", "MISSING_MAIN_VERB", "SENTENCE_INITIAL_LOWERCASE", "EXCESSIVE_EXCLAMATION",
    "COMMA_BEFORE_RELATIVE", "POSSESSIVE_REDUNDANCY",
)


def grammar_check(
    df: DataFrame,
    text: str = "text",
    name: str = "findings",
    *,
    readings: str | None = None,
    rules: tuple[str, ...] = RULES,
    cases: dict[str, tuple[str, ...]] = CASE_NAMES,
) -> DataFrame:
    """The input with an array of (start, end, code, message, suggestions)."""
    chosen = set(rules)
    body = F.coalesce(F.col(text), F.lit(""))
    known = F.col(readings) if readings else None
    place = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r), F.lit(i))])

    def ordered(*parts: Column) -> Column:
        order = F.transform(F.concat(*parts), lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), F.element_at(place, f.code).alias("rule"), f.alias("finding")))
        return F.transform(F.array_sort(order), lambda o: o.finding)

    def found(body: Column, places: Places, words: Column) -> Column:
        parts = [_word_rules(words, places, chosen, readings is not None, cases), *([_double_spaces(body)] if "DOUBLE_SPACE" in chosen else []), _token_rules(body, places, chosen)]
        if "DOUBLE_NEGATION" in chosen:
            parts.append(_double_negation(words, places))
        if "MISSING_MAIN_VERB" in chosen and readings:
            parts.append(_main_verbs(words, places))
        return ordered(*parts)

    def bound(given: Column) -> Column:
        text_, readings_ = given["text"], given["readings"] if readings else None
        if chosen <= {"DOUBLE_SPACE"}:
            return ordered(_double_spaces(text_) if chosen else _none())
        return let(token_texts(text_), lambda t: Places.within(t, lambda places: let(words_with_context(t, readings_), lambda w: found(text_, places, w))))

    # Text, tokens and words are bound within the expression: columns of their own could be drawn into every use.
    return df.withColumn(name, let(F.struct(body.alias("text"), *([known.alias("readings")] if readings else [])), bound))
