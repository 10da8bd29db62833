"""Whole evaluations: gold treebanks against predictions, generated forms against analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.morphology import verb_paradigm, verb_type
from korpisto.operators import disambiguation, evaluation, tagger
from korpisto.operators.tokens import token_texts, token_type
from korpisto.sources.codecs import TaggerModel

Analyze = Callable[[Column], Column]


def _analysed(tokens: DataFrame, analyze: Analyze, form: str) -> DataFrame:
    known = tokens.select(form).distinct().withColumn("readings", analyze(F.col(form)))
    return tokens.join(known, form)


def _first_with(readings: Column, upos: Column, form: Column) -> Column:
    """The base form of the first reading of this tag, else of the first reading, else the form."""
    fitting = F.filter(readings, lambda r: evaluation.upos_of_reading(r, form) == upos)
    return F.coalesce(F.get(fitting, 0)["BASEFORM"], F.get(readings, 0)["BASEFORM"], form)


def evaluate_gold(
    gold: DataFrame,
    analyze: Analyze,
    *,
    lemmas: DataFrame | None = None,
    decoder: disambiguation.Tagger | None = None,
    model: TaggerModel | None = None,
    marks: bool = False,
    sentences: int | None = None,
) -> DataFrame:
    """form, gold_upos, pred_upos, gold_lemma, pred_lemma of every gold token of (sentence, id, form, lemma, upos).

    Words without readings get a guess. With a tagger model its class decides the
    tag, else decoding does. ``sentences`` takes the first ones only.
    """
    rows = gold if marks else gold.where("upos not in ('PUNCT', 'SYM')")
    if sentences is not None:
        chosen = rows.select("sentence").distinct().orderBy("sentence").limit(sentences)
        rows = rows.join(chosen, "sentence", "left_semi")
    rows = _analysed(rows.select("sentence", "id", "form", "lemma", "upos"), analyze, "form").withColumn("known", F.coalesce(F.size("readings") > 0, F.lit(False)))
    cell = F.struct("id", "form", "lemma", "upos", "known", "readings")
    whole = rows.groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("id", cell.alias("cell")))).alias("cells"))  # a sentence a row
    whole = whole.select("sentence", F.transform("cells", lambda c: c["cell"]).alias("cells"))
    whole = whole.withColumn("words", F.transform("cells", lambda c: c.form)).withColumn("sets", F.transform("cells", lambda c: c.readings))
    decoder = decoder or disambiguation.Tagger(oov="fallback")
    best = disambiguation.disambiguate(whole, "words", "sets", "best", decoder)
    tags = F.array().cast("array<string>")
    if model is not None:
        best = tagger.tag_sentences(best, model, "words", "tags")
        tags = F.col("tags")
    flat = best.select("sentence", F.explode(F.arrays_zip(F.col("cells").alias("c"), F.col("best").alias("b"), tags.alias("t"))).alias("z"))
    decoded = F.coalesce(evaluation.upos_of_reading(F.col("z.b"), F.col("z.c.form")), F.lit("X"))
    upos = F.coalesce(F.col("z.t"), decoded)
    base = _first_with(F.col("z.c.readings"), F.col("z.t"), F.col("z.c.form")) if model is not None else F.coalesce(F.col("z.b.BASEFORM"), F.lit(""))
    out = flat.select(F.col("z.c.form").alias("form"), F.col("z.c.upos").alias("gold_upos"), upos.alias("pred_upos"), F.col("z.c.lemma").alias("gold_lemma"), base.alias("baseform"), F.col("z.c.known").alias("known"))
    table = lemmas if lemmas is not None else gold.sparkSession.createDataFrame([], "form string, upos string, lemma string")
    return evaluation.resolve_lemmas(out, table, known="known").select("form", "gold_upos", "pred_upos", "gold_lemma", "pred_lemma")


def evaluate_end_to_end(gold: DataFrame, analyze: Analyze, *, lemmas: DataFrame | None = None, decoder: disambiguation.Tagger | None = None) -> DataFrame:
    """As ``evaluate_gold`` with the engine's own tokens of (sentence, text), aligned from left to right; the rest is X."""
    cells = gold.where("upos not in ('PUNCT', 'SYM')")
    order = F.array_sort(F.collect_list(F.struct("id", "form", "lemma", "upos")))
    whole = cells.where("text <> ''").groupBy("sentence").agg(F.first("text").alias("text"), order.alias("gold"))
    words = F.filter(token_texts(F.col("text")), lambda t: token_type(t) == "WORD")
    tagged = disambiguation.tag(whole, analyze, "text", "best", decoder or disambiguation.Tagger())
    placed = tagged.withColumn("at", evaluation.align_greedy(words, F.transform("gold", lambda g: g.form)))
    flat = placed.select("best", "words", F.explode(F.arrays_zip(F.col("gold").alias("g"), F.col("at").alias("a"))).alias("z"))
    reading, form = F.get("best", F.col("z.a")), F.coalesce(F.get("words", F.col("z.a")), F.col("z.g.form"))
    upos = F.when(reading.isNull(), "X").otherwise(evaluation.upos_of_reading(reading, form))
    out = flat.select(form.alias("form"), F.col("z.g.upos").alias("gold_upos"), upos.alias("pred_upos"), F.col("z.g.lemma").alias("gold_lemma"), F.coalesce(reading["BASEFORM"], F.lit("")).alias("baseform"))
    table = lemmas if lemmas is not None else gold.sparkSession.createDataFrame([], "form string, upos string, lemma string")
    return evaluation.resolve_lemmas(out, table).select("form", "gold_upos", "pred_upos", "gold_lemma", "pred_lemma")


def verify_generation(verbs: DataFrame, analyze: Analyze, word: str = "word") -> DataFrame:
    """(word, label, form, outcome): OK, NO_ANALYSIS or WRONG_BASEFORM of each generated form, GENERATOR_REJECT of unknown verbs."""
    forms = verb_paradigm(verbs.select(word), word).withColumn("main", F.element_at(F.split("form", " "), -1))
    checked = _analysed(forms, analyze, "main")
    own = F.exists("readings", lambda r: F.coalesce(r["BASEFORM"] == F.col(word), F.lit(False)))
    outcome = F.when(F.size("readings") == 0, "NO_ANALYSIS").when(own, "OK").otherwise("WRONG_BASEFORM")
    rejected = verbs.where(verb_type(F.col(word)).isNull()).select(word, F.lit("").alias("label"), F.lit("").alias("form"), F.lit("GENERATOR_REJECT").alias("outcome"))
    return checked.select(word, "label", "form", outcome.alias("outcome")).union(rejected)
