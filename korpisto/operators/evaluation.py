"""Tag and lemma mapping, and the comparison of predictions with gold tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import simple_lower

# Class and word tables of the tag mapping, suffixes of the lemma fallback.
UPOS_OF_CLASS = {
    "nimisana": "NOUN", "lyhenne": "NOUN", "nimisana_laatusana": "ADJ", "teonsana": "VERB", "laatusana": "ADJ", "seikkasana": "ADV", "asemosana": "PRON",
    "lukusana": "NUM", "etunimi": "PROPN", "sukunimi": "PROPN", "paikannimi": "PROPN", "kieltosana": "AUX", "suhdesana": "ADP", "sidesana": "CCONJ", "huudahdussana": "INTJ",
}
PRONOUN_WORDS = ("kaikki", "itse", "sama", "toinen", "moni", "harva", "kumpikin", "molemmat", "ainoa")
SUBORDINATORS = (
    "että", "kun", "jos", "koska", "vaikka", "jotta", "kunnes", "mikäli", "ellei", "ettei", "joskin", "jollei", "jollen", "jollet", "jolloin",
    "kohan", "sillä", "johon", "vaikkei", "vaikkakaan", "kuin",
)
AUXILIARIES = ("olla", "voida", "saattaa", "täytyä", "pitää", "joutua", "mahtaa", "taitaa", "aikoa", "tarvita", "ehtiä", "kannattaa", "kelvata")
NOMINAL_SUFFIXES = ("ssa", "ssä", "sta", "stä", "lle", "lta", "ltä", "lla", "llä", "tta", "ttä", "ksi", "ine", "na", "nä", "aa", "ää", "ia", "iä", "ta", "tä", "a", "ä", "n", "t")
VERBAL_SUFFIXES = ("mme", "tte", "vat", "vät", "an", "ee", "aa", "ää", "n", "t")
# End of fixed values.


def _map(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def upos_category(cls: Column) -> Column:
    """The coarse tag of a class, X for others."""
    return _map(UPOS_OF_CLASS, F.coalesce(cls, F.lit("")), "X")


def upos_of_reading(reading: Column, surface: Column) -> Column:
    """The tag of a reading in its form: names, pronouns, participles, conjunctions and auxiliaries told apart."""
    base, low = reading["BASEFORM"], simple_lower(surface)
    cls = reading["CLASS"]
    return (
        F.when(cls.isNull(), "X").when(reading["POSSIBLE_GEOGRAPHICAL_NAME"] == "true", "PROPN")
        .when((cls == "nimisana") & base.isin(*PRONOUN_WORDS), "PRON")
        .when((cls == "laatusana") & (reading["SIJAMUOTO"] == "kerrontosti"), "ADV")
        .when(((cls == "teonsana") | ((cls == "laatusana") & reading["PARTICIPLE"].isNotNull())) & base.isin(*AUXILIARIES), "AUX")
        .when((cls == "laatusana") & reading["PARTICIPLE"].isNotNull(), "VERB")
        .when((cls == "sidesana") & low.isin(*SUBORDINATORS), "SCONJ").otherwise(upos_category(cls))
    )


def strip_suffix(form: Column, upos: Column) -> Column:
    """The lower-cased form without the first listed suffix that leaves two characters."""
    low = F.lower(form)

    def first(suffixes: tuple[str, ...]) -> Column:
        out = low
        for s in reversed(suffixes):
            out = F.when(low.endswith(s) & (F.length(low) - len(s) >= 2), F.substring(low, F.lit(1), F.length(low) - len(s))).otherwise(out)
        return out

    return F.when(upos.isin("NOUN", "ADJ", "PROPN"), first(NOMINAL_SUFFIXES)).when(upos == "VERB", first(VERBAL_SUFFIXES)).otherwise(low)


def resolve_lemmas(df: DataFrame, lemmas: DataFrame, *, form: str = "form", upos: str = "pred_upos", base: str = "baseform", known: str | None = None, name: str = "pred_lemma") -> DataFrame:
    """The dictionary's lemma, else the base form; lower-cased but for names.

    Where the boolean column ``known`` is false, the fallback is the stripped form, for names the base form.
    """
    table = lemmas.select(F.col("form").alias("_form"), F.col("upos").alias(upos), F.col("lemma").alias("_lemma"))
    joined = df.withColumn("_form", F.lower(form)).join(table, ["_form", upos], "left")
    plain = F.coalesce("_lemma", F.col(base))
    lemma = F.when(F.col(upos) == "PROPN", plain).otherwise(F.lower(plain))
    if known:
        oov = F.coalesce(F.col("_lemma"), F.when(F.col(upos) == "PROPN", F.col(base)).otherwise(strip_suffix(F.col(form), F.col(upos))))
        lemma = F.when(F.col(known), lemma).otherwise(oov)
    return joined.withColumn(name, lemma).select(*df.columns, name)


def _same_lemma() -> Column:
    clean = lambda c: F.replace(F.lower(c), F.lit("#"), F.lit(""))
    return (F.col("gold_lemma") != "") & (F.col("pred_lemma") != "") & (clean("gold_lemma") == clean("pred_lemma"))


def summary(results: DataFrame) -> DataFrame:
    """One row: total, correct tags and lemmas, unknown tokens, and their shares."""
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    lemma = _same_lemma() if {"gold_lemma", "pred_lemma"} <= set(results.columns) else F.lit(False)
    row = results.agg(
        F.count("*").alias("total"), count(F.col("gold_upos") == F.col("pred_upos")).alias("upos_correct"), count(lemma).alias("lemma_correct"),
        count((F.col("pred_upos") == "X") & (F.col("gold_upos") != "X")).alias("unknown"),
    )
    share = lambda c: F.when(F.col("total") > 0, c / F.col("total")).otherwise(0.0)
    return row.withColumn("upos_accuracy", share(F.col("upos_correct"))).withColumn("lemma_accuracy", share(F.col("lemma_correct"))).withColumn("coverage", share(F.col("total") - F.col("unknown")))


def per_tag(results: DataFrame) -> DataFrame:
    """tag, tp, fp, fn, precision, recall, f1 and support of every tag."""
    hit = F.col("gold_upos") == F.col("pred_upos")
    marks = results.select(F.explode(F.when(hit, F.array(F.struct(F.col("gold_upos").alias("tag"), F.lit("tp").alias("k")))).otherwise(F.array(F.struct(F.col("pred_upos").alias("tag"), F.lit("fp").alias("k")), F.struct(F.col("gold_upos").alias("tag"), F.lit("fn").alias("k"))))).alias("m"))
    counts = marks.groupBy(F.col("m.tag").alias("tag")).agg(*[F.sum((F.col("m.k") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda d: F.when(d > 0, F.col("tp") / d).otherwise(0.0)
    out = counts.withColumn("precision", ratio(F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).withColumn("support", F.col("tp") + F.col("fn"))


def confusions(results: DataFrame, n: int | None = None) -> DataFrame:
    """(gold_upos, pred_upos, count) of wrong tags, the n most frequent; ties by tags."""
    out = results.where("gold_upos <> pred_upos").groupBy("gold_upos", "pred_upos").agg(F.count("*").alias("count"))
    return out if n is None else out.orderBy(F.desc("count"), "gold_upos", "pred_upos").limit(n)


def rollup(results: DataFrame, *by: str) -> DataFrame:
    """(by, level, total, hits, rate): how many tags are right, for each group, each group of the columns before, and all.

    ``level`` has a bit for each column that is rolled up, the last one lowest, so a
    null of the data and one of the rollup differ.
    """
    hit = F.coalesce((F.col("gold_upos") == F.col("pred_upos")).cast("long"), F.lit(0))
    out = results.rollup(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("total"), F.sum(hit).alias("hits"))
    return out.withColumn("rate", F.col("hits") / F.col("total"))


def align_greedy(predicted: Column, gold: Column) -> Column:
    """For each gold form the index of the predicted word it takes, null for none.

    Both are arrays of forms. Predicted words are taken from left to right; one
    that differs from the next open gold form (case aside) is passed over.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        match = F.coalesce(F.lower(F.get(gold, F.size(s.out))) == F.lower(w), F.lit(False))
        return F.struct(F.when(match, F.array_append(s.out, s.at)).otherwise(s.out).alias("out"), (s.at + 1).alias("at"))

    taken = F.aggregate(predicted, start, step, lambda s: s.out)
    return F.transform(gold, lambda g, i: F.get(taken, i))


# ---------------------------------------------------------------------- reports
def report(results: DataFrame, most: int = 15) -> DataFrame:
    """(line): accuracies, metrics by tag and the ``most`` frequent confusions as lines of text, in order."""
    share = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0.0)) * 100, 2)
    head = summary(results).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("UPOS accuracy "), share("upos_accuracy"), F.lit(" % of "), F.col("total").cast("string")).alias("line"))
    tags = per_tag(results).select(F.lit(1).alias("part"), F.col("tag").alias("key"), F.concat_ws("\t", "tag", share("precision"), share("recall"), share("f1"), F.col("support").cast("string")).alias("line"))
    wrong = confusions(results, most).select(F.lit(2).alias("part"), F.lpad((F.lit(10**12) - F.col("count")).cast("string"), 13, "0").alias("key"), F.concat_ws("\t", "gold_upos", "pred_upos", F.col("count").cast("string")).alias("line"))
    return head.union(tags).union(wrong).orderBy("part", "key", "line").select("line")


def report_json(results: DataFrame, most: int = 15) -> DataFrame:
    """(json): the same as one JSON object."""
    objects = [summary(results).select(F.struct("*").alias("summary")), per_tag(results).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("tags")), confusions(results, most).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("confusions"))]
    whole = objects[0].withColumn("one", F.lit(1))
    for o in objects[1:]:  # one row each
        whole = whole.join(o.withColumn("one", F.lit(1)), "one")
    return whole.select(F.to_json(F.struct("summary", "tags", "confusions")).alias("json"))
