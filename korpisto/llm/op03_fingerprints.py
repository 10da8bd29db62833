"""Operator 3: I-Match fingerprints from randomised lexicon subsets.

The lexicon is all terms whose document frequency lies between ``rarest`` and
``commonest`` of all documents, and at least 2. Its size has a bound that does not
grow with the corpus: each term takes ``rarest`` of the documents, so there are at
most (mean distinct terms of a document) / ``rarest`` of them, some hundred
thousand. So it is broadcast to where the terms of the texts are, and only what
a text holds of it is gathered by text, already one list where the text lies.

A document's distinct lexicon terms are sorted; each of ``SEEDS`` random lexicon
subsets, on each of ``LEVELS`` levels, keeps a share of the lexicon (a quarter, a sixteenth, ...),
and the kept terms are hashed together. The fingerprint is all these hashes, a
row of marks for each empty subset. A document without lexicon terms is
fingerprinted by one hash of all its terms, from which the others follow. Likeness is the share of equal hashes on the
sparsest level where at least a third of the subsets hold a term of either
document; two documents without terms are alike, one with and one without not.

Everything is a built-in DataFrame function. For comparisons with the next
document by descending id the rows are dealt out by ranges of ids, and each
range is given the first document of the next one, so no task sees all rows.

Null texts are empty; null ids come last. Rows that share an id are ordered by
the hash of their text. Very long texts are read whole; an empty table gives no
rows; a table of one row is its own next document. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpisto.llm.common import drop, free_shuffles, keyed, materialise, shuffle_partitions

SEEDS, LEVELS = 16, 4  # SEEDS * LEVELS / 2 bits of a term are used
DIGITS = 10  # hexadecimal digits of a subset's hash
NO_TERMS = 42  # the hash of an empty array
_WHITE = "[\\x20\\x09-\\x0D]+"
_NONE = "." * DIGITS


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words, lower-cased."""
    words = F.filter(F.split(F.lower(text), _WHITE), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, rarest: float, commonest: float) -> DataFrame:
    """The terms of the band, written once."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").count()
    return materialise(counts.where((F.col("count") >= max(2, rarest * total)) & (F.col("count") <= max(2, commonest * total))).select("term"))


def _thinned(held: Column, subset: int, level: int) -> Column:
    """A quarter of the terms: those with this subset's value in two bits, others for each group and level.

    Terms are 32 bits of their hashes, so their own bits are the random choice.
    """
    shift = 2 * ((level - 1) * (SEEDS // 4) + subset // 4)
    return F.filter(held, lambda t: F.shiftright(t, shift).bitwiseAND(F.lit(3)) == subset % 4)


def of_all(text: Column) -> Column:
    """One hash of all of a text's terms, NO_TERMS without any; terms are made once, so no condition asks for them again."""
    return F.xxhash64(F.array_sort(terms(text)))


def with_hashes(df: DataFrame, held: str, whole: str, name: str) -> DataFrame:
    """SEEDS * LEVELS hashes, null for empty subsets, of the lexicon terms ``held``, or where there are none of the hash ``whole`` of all terms."""
    keep, mask = df.columns, F.lit((1 << 4 * DIGITS) - 1)
    df = df.withColumn("t_0", F.array_sort(F.coalesce(held, F.array().cast("array<int>"))))
    for level in range(1, LEVELS + 1):
        given = [F.col("t_0") if level == 1 else F.get(f"t_{level - 1}", k) for k in range(SEEDS)]
        df = df.withColumn(f"t_{level}", F.array(*[_thinned(x, k, level) for k, x in enumerate(given)]))
    every = F.concat(*[f"t_{level}" for level in range(1, LEVELS + 1)])
    hashes = F.transform(every, lambda s: F.when(F.size(s) > 0, F.xxhash64(s).bitwiseAND(mask)))
    rest = F.transform(F.sequence(F.lit(1), F.lit(SEEDS * LEVELS)), lambda k: F.when(F.col(whole) != NO_TERMS, F.xxhash64(whole, k).bitwiseAND(mask)))
    return df.select(*keep, F.when(F.size("t_0") > 0, hashes).otherwise(rest).alias(name))


def held_terms(rows: DataFrame, texts: dict[str, Column], words: DataFrame) -> DataFrame:
    """(row, one list ``held_<text>`` for each of ``texts``) of the lexicon terms of the rows that have any."""
    sides = [rows.select("row", F.lit(t).alias("side"), F.explode(terms(text)).alias("term")) for t, text in texts.items()]
    found = reduce(DataFrame.unionByName, sides).join(F.broadcast(words), "term")  # bounded, see above
    short = (F.col("term").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")  # half the bytes to gather
    return found.groupBy("row").agg(*[F.collect_list(F.when(F.col("side") == t, short)).alias(f"held_{t}") for t in texts])


def written(h: str) -> Column:
    """Hashes as a string."""
    return F.array_join(F.transform(h, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), DIGITS, "0")), F.lit(_NONE))), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1, from two arrays of hashes."""
    both = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    result = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))
    for level in range(1, LEVELS + 1):  # sparser levels take precedence
        part = F.slice(both, (level - 1) * SEEDS + 1, SEEDS)
        used = F.size(F.filter(part, lambda z: z.x.isNotNull() | z.y.isNotNull()))
        same = F.size(F.filter(part, lambda z: z.x == z.y))
        result = F.when(used * 3 >= SEEDS, same / used).otherwise(result)
    return result


def fingerprints(docs: DataFrame, *, rarest: float = 0.0005, commonest: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint."""
    base, _ = keyed(docs, id_col, text_col)
    rows = base.select(F.col("key").alias("row"), F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = held_terms(rows, {"text": F.col("text")}, lexicon(rows, "text", rarest, commonest))
    slim = rows.select("row", "doc_id", of_all(F.col("text")).alias("whole"))
    return with_hashes(slim.join(held, "row", "left"), "held_text", "whole", "h").select("doc_id", written("h").alias("fingerprint"))


def edited_neighbours(docs: DataFrame, *, rarest: float = 0.0005, commonest: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next
    document by descending id; after the last comes the first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = lexicon(base, "text", rarest, commonest)
    ranges = 3 * shuffle_partitions(spark)
    cuts = base.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).collect()[0][0] or []  # ``ranges`` values
    cuts = sorted(set(cuts))
    low = F.lit(-(1 << 63))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = base.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(place).cast("int"))
    rows = rows.withColumn("rank", F.struct(F.coalesce("doc_id", low).alias("id"), F.xxhash64("text").alias("h")))
    heads = [tuple(r) for r in rows.groupBy("range").agg(F.max("rank").alias("rank")).select("range", "rank.id", "rank.h").collect()]  # a row per range
    heads.sort(reverse=True)
    after = [(heads[k][0], *heads[(k + 1) % len(heads)][1:]) for k in range(len(heads))]
    guests = spark.createDataFrame(after, "range int, id long, h long")
    given = (
        rows.drop("range").join(F.broadcast(guests.withColumn("rank", F.struct("id", "h")).select("range", "rank")), "rank")
        .dropDuplicates(["range"]).select("doc_id", "text", "range", "rank", F.lit(1).alias("guest"))
    )
    dealt = rows.select("doc_id", "text", "range", "rank", F.lit(0).alias("guest")).unionByName(given)
    order = Window.partitionBy("range").orderBy("guest", F.desc("rank"))
    cut = F.floor(F.length("text") / 3).cast("int")
    tail = F.substring(F.coalesce(F.lead("text").over(order), F.lit("")), F.lit(1), cut)
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.col("tail"))
    number = F.row_number().over(order) + F.col("range").cast("long") * (1 << 40)
    dealt = dealt.select("doc_id", "range", "guest", "text", number.alias("row"), tail.alias("tail"))
    facts = {"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.encode(edited, "UTF-8"), 256), "whole": of_all(F.col("text")), "whole_edited": of_all(edited)}
    # written once: rows are numbered, and what is shuffled after this is no text
    paired = materialise(dealt.withColumns(facts))
    free_shuffles(spark)
    held = held_terms(paired, {"text": F.col("text"), "edited": edited}, words)
    hashed = paired.drop("text", "tail").join(held, "row", "left")
    hashed = with_hashes(with_hashes(hashed, "held_text", "whole", "h"), "held_edited", "whole_edited", "h_edited")
    slim = materialise(hashed.select("doc_id", "range", "row", "guest", "n_chars", "edited_sha256", "h", "h_edited"))
    drop(paired)
    out = slim.withColumn("h_next", F.lead("h").over(Window.partitionBy("range").orderBy("row"))).where("guest = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", written("h").alias("fingerprint"), written("h_edited").alias("edited_fingerprint"),
        likeness("h", "h_edited").alias("near_edited"), likeness("h", "h_next").alias("near_next"),
    )
