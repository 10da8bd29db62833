"""Corpus statistics: frequency lists, tag bigrams, emission priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentence marks of the bigram model.
BOS, EOS = "<BOS>", "<EOS>"
# End of fixed values.


def word_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, count) of lower-cased words."""
    return words.groupBy(F.lower(F.col(word)).alias("word")).agg(F.count("*").alias("count")).where("word is not null")


def treebank_counts(tokens: DataFrame) -> DataFrame:
    """(word, count) of a treebank's forms without marks and symbols."""
    return word_counts(tokens.where(~F.col("upos").isin("PUNCT", "SYM")), "form")


def with_relative_frequency(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("relative", F.col("count") / F.col("_total")).drop("_total")  # one row


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words with their rank; equal counts by word. Only n rows are sorted in one place."""
    best = counts.orderBy(F.desc("count"), F.asc("word")).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("word"))))


def ranked(counts: DataFrame) -> DataFrame:
    """All words with dense ranks by (count desc, word asc), without one task for all.

    Words of one count are ranked among themselves by letter range, and the
    number of words of higher counts and earlier ranges is added.
    """
    bucket = F.substring(F.concat(F.col("word"), F.lit("   ")), 1, 3)
    rows = counts.withColumn("bucket", bucket)
    sizes = rows.groupBy("count", "bucket").agg(F.count("*").alias("n"))
    by_count = sizes.groupBy("count").agg(F.sum("n").alias("total"))
    higher = by_count.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a count
    inner = sizes.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("count").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = inner.join(higher.select("count", "before"), "count").select("count", "bucket", (F.col("before") + F.col("earlier")).alias("base"))
    own = F.row_number().over(Window.partitionBy("count", "bucket").orderBy("word"))
    return rows.withColumn("own", own).join(base, ["count", "bucket"]).select("word", "count", (F.col("base") + F.col("own")).alias("rank"))


def tag_bigrams(tokens: DataFrame, sentence: str = "sentence", order: str = "id", tag: str = "upos") -> DataFrame:
    """(prev, curr, count) of adjacent tags, with sentence marks; ``_`` tags are skipped."""
    rows = tokens.where(F.col(tag) != "_").select(F.col(sentence).alias("s"), F.col(order).alias("o"), F.col(tag).alias("curr"))
    w = Window.partitionBy("s").orderBy("o")
    seen = rows.select("curr", F.coalesce(F.lag("curr").over(w), F.lit(BOS)).alias("prev"), F.lead("curr").over(w).alias("next"))
    ends = seen.where("next is null").select(F.lit(EOS).alias("curr"), F.col("curr").alias("prev"))
    return seen.select("curr", "prev").union(ends).groupBy("prev", "curr").agg(F.count("*").alias("count"))


def bigram_model(counts: DataFrame) -> tuple[DataFrame, Column]:
    """(prev, curr, weight) by add-one smoothing, and the weight of unseen pairs as a column of the table.

    Tag sets are small; totals are broadcast.
    """
    tags = counts.select(F.col("prev").alias("t")).union(counts.select("curr")).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("v"))
    totals = counts.groupBy("prev").agg(F.sum("count").alias("total"))
    mean = totals.agg(F.coalesce(F.avg("total"), F.lit(0.0)).alias("mean"))
    table = counts.join(totals, "prev").join(F.broadcast(tags)).join(F.broadcast(mean))  # single rows
    weight = F.log(F.col("count") + 1.0) - F.log(F.col("total") + F.col("v"))
    table = table.select("prev", "curr", weight.alias("weight"), (-F.log(F.col("mean") + F.col("v"))).alias("default_weight"))
    return table, F.col("default_weight")


def model_from_treebank(gold: DataFrame, classes: dict[str, str] | None = None) -> tuple[DataFrame, Column]:
    """``bigram_model`` of the tags of (sentence, id, upos); ``classes`` maps tags to the names the model's keys shall have."""
    rows = gold
    if classes:
        rows = gold.replace(classes, subset=["upos"])
    return bigram_model(tag_bigrams(rows))


def emission_priors(tokens: DataFrame) -> DataFrame:
    """(form, upos, p): the share of each tag among a lower-cased form's."""
    counts = tokens.where("upos <> '_'").groupBy(F.lower("form").alias("form"), "upos").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("form"))).select("form", "upos", "p")
