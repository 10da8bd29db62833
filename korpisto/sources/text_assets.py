"""Readers and writers of treebanks, word lists, lemma dictionaries and user words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from korpisto.session import ship


# ----------------------------------------------------------------------- CoNLL-U
_FILE_BITS = 42  # of a sentence's number belong to its place in the file, the others to the file


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, k, edge, lines) of each range of a file: sentence k lies behind its k-th blank line.

    Sentences that may go on in a neighbouring range are edges: the lines before the
    first blank line (k = 0) and those behind the last one.
    """
    def rows() -> Iterator[tuple]:
        place, k, lines = None, 0, []
        for b in batches:
            for value, file, start in zip(*(c.to_pylist() for c in b.columns)):
                if (file, start) != place:
                    if place:
                        yield *place, k, True, lines
                    place, k, lines = (file, start), 0, []
                if value.strip(" \t\r"):
                    lines.append(value.rstrip("\r"))
                    continue
                if lines or not k:
                    yield *place, k, not k, lines
                k, lines = k + 1, []
        if place:
            yield *place, k, True, lines

    schema, made = to_arrow_schema(_RANGES), rows()
    while part := list(islice(made, 2048)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_RANGES = T.StructType().add("file", "string").add("start", "long").add("k", "long").add("edge", "boolean").add("lines", T.ArrayType(T.StringType()))


def _location(path: str) -> Column:
    """A file's address with one slash behind its scheme, where Spark writes one or three."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, lines): one row a sentence; blank lines part sentences, with either line end.

    Spark deals byte ranges of the files to tasks, whatever the line ends. Only the
    edges of ranges are shuffled and put together, for which the files are read once
    more. ``block`` orders sentences by file and place and needs no count of what
    lies before: it is the file's number and the range's first byte plus the blank
    lines since, of which each takes a byte.
    """
    ship(spark)
    text = spark.read.text(path)
    ranges = text.select("value", _location("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).mapInArrow(_cut, _RANGES)
    order = Window.partitionBy("file").orderBy("start", "k")  # two rows a range
    edges = ranges.where("edge").withColumn("chain", F.sum((F.col("k") > 0).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.when(F.size("lines") > 0, F.struct("start", "k", "lines"))))
    joined = edges.groupBy("file", "chain").agg(parts.alias("parts")).where("size(parts) > 0")
    joined = joined.select("file", (F.col("parts")[0]["start"] + F.col("parts")[0]["k"]).alias("at"), F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines"))
    whole = ranges.where("not edge").select("file", (F.col("start") + F.col("k")).alias("at"), "lines")
    files = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(set(text.inputFiles())))], "file string, number long").withColumn("file", _location("file"))
    room = F.when(F.col("at") < 1 << _FILE_BITS, F.col("at")).otherwise(F.raise_error(F.lit("a treebank file of four terabytes or more")))
    return whole.union(joined).join(files, "file").select((F.shiftleft("number", _FILE_BITS) + room).alias("block"), "lines")


def _comment(name: str) -> Column:
    found = F.filter("lines", lambda line: line.startswith(f"# {name} = "))
    return F.trim(F.regexp_replace(F.get(found, 0), f"^# {name} = ", ""))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """One row a token: sentence, sent_id, text, id, form, lemma, upos, xpos, feats.

    Rows with fewer than ten columns, ranges and empty nodes are left out.
    """
    rows = _blocks(spark, path).select("block", _comment("sent_id").alias("sent_id"), _comment("text").alias("text"), F.explode("lines").alias("line"))
    rows = rows.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    rows = rows.where((F.size("f") >= 10) & F.get("f", 0).rlike("^[0-9]+$"))
    names = ("form", "lemma", "upos", "xpos", "feats")
    return rows.select(F.col("block").alias("sentence"), "sent_id", "text", F.get("f", 0).cast("int").alias("id"), *[F.get("f", k + 1).alias(n) for k, n in enumerate(names)])


def parse_conllu(df: DataFrame, content: str = "content", key: str = "key") -> DataFrame:
    """As ``read_conllu``, from a column of treebank texts; ``sentence`` counts within each text."""
    blocks = df.select(key, F.posexplode(F.split(F.col(content), "\r?\n[ \t]*\r?\n")).alias("sentence", "value"))
    blocks = blocks.select(key, "sentence", F.filter(F.split("value", "\r?\n"), lambda line: F.trim(line) != "").alias("lines"))
    rows = blocks.select(key, "sentence", _comment("sent_id").alias("sent_id"), _comment("text").alias("text"), F.explode("lines").alias("line"))
    rows = rows.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where((F.size("f") >= 10) & F.get("f", 0).rlike("^[0-9]+$"))
    names = ("form", "lemma", "upos", "xpos", "feats")
    return rows.select(key, "sentence", "sent_id", "text", F.get("f", 0).cast("int").alias("id"), *[F.get("f", k + 1).alias(n) for k, n in enumerate(names)])


# -------------------------------------------------------------------- word lists
def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words: one a line, or columns 1 and 3 if one of the first five lines has a tab; blank and # lines skipped."""
    lines = spark.read.text(path)
    tabbed = any("\t" in r.value for r in lines.limit(5).collect())
    words = F.array(F.get(F.split("value", "\t"), 0), F.get(F.split("value", "\t"), 2)) if tabbed else F.array("value")
    kept = lines.where(~F.trim("value").startswith("#"))
    return kept.select(F.explode(words).alias("word")).select(F.trim("word").alias("word")).where("word <> ''").distinct()


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(form, upos, lemma) of a tab-separated file; the last of equal (form, upos) wins."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("f", F.split(F.trim("value"), "\t", 3)).where("size(f) = 3")
    rows = lines.select(F.get("f", 0).alias("form"), F.get("f", 1).alias("upos"), F.get("f", 2).alias("lemma"), "at")
    return rows.groupBy("form", "upos").agg(F.max_by("lemma", "at").alias("lemma"))


def read_user_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a file, one a line; an absent file holds none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def write_user_words(words: DataFrame, path: str) -> None:
    """Sorted, one a line, in one file: a user's own list is small."""
    words.select("word").distinct().orderBy(F.encode("word", "UTF-8")).coalesce(1).write.mode("overwrite").text(path)


def build_lemmas(sources: list[DataFrame]) -> DataFrame:
    """(form, upos, lemma): the most frequent lemma of each source, ties by first place, earlier sources first.

    Sources have form, upos, lemma and a sortable ``at``. Forms are lower-cased, # is
    taken from lemmas, and lemmas equal to their form are left out.
    """
    rows = None
    for k, source in enumerate(sources):
        part = source.select(F.lower("form").alias("form"), "upos", F.replace("lemma", F.lit("#"), F.lit("")).alias("lemma"), "at").withColumn("source", F.lit(k))
        rows = part if rows is None else rows.union(part)
    counts = rows.groupBy("form", "upos", "source", "lemma").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy("form", "upos").orderBy("source", F.desc("n"), "at")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1 and lemma <> form").select("form", "upos", "lemma").orderBy("form", "upos")


def _sorted(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its structs by name."""
    if isinstance(kind, T.StructType):
        fields = [_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _sorted(x, kind.elementType))
    return column


def to_json_sorted(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """A struct or array column as JSON with sorted keys; keys without a value are left out."""
    return df.withColumn(name, F.to_json(_sorted(F.col(column), df.schema[column].dataType)))
