"""Treebanks cut into ranges, abbreviations from a lexicon, tag bigrams of a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from korpisto.operators import corpus, tokens
from korpisto.sources import text_assets
from korpisto.streaming.corpus import stream_tag_bigrams


def sentence(n, k):
    rows = ["\t".join([str(i + 1), f"w{n}.{i}", "b", "NOUN", *"______"]) for i in range(k)]
    return [f"# sent_id = s{n}", *rows]


@pytest.mark.parametrize("end, size", [("\n", 1 << 20), ("\r\n", 1 << 20), ("\n", 90), ("\r\n", 90), ("\n", 1), ("\r\n", 7)])
def test_treebanks_are_cut_anywhere(spark, tmp_path, end, size):
    many = 320 if size == 90 else 3
    want = [(f"s{n}", [f"w{n}.{i}" for i in range(n % 5 + 1)]) for n in range(2 * many)]
    for half in range(2):
        lines = [""] * half
        for n in range(half * many, (half + 1) * many):
            lines += sentence(n, n % 5 + 1) + [" \t" if n % 7 == 3 else ""] * (1 + n % 3)
        (tmp_path / f"part {half}.conllu").write_bytes((end.join(lines) + end * half).encode())
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = text_assets.read_conllu(spark, str(tmp_path))
        if size == 90:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 500
        got = rows.groupBy("sentence").agg(F.min("sent_id").alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("id", "form"))), lambda x: x["form"]).alias("f")).orderBy("sentence").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.s, r.f) for r in got] == want


def test_empty_treebanks(spark, tmp_path):
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text("\n\n \n")
    assert text_assets.read_conllu(spark, str(tmp_path)).count() == 0


def test_abbreviations_come_from_a_lexicon(spark):
    text = "Tuli esim. Matti. Ja koira. Meni."
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, "Oli koira. Ja", "z"), (None, text, "n"), (3, None, "t"), (4, "", "e")], "k long, text string, word string")
    lexicon = spark.createDataFrame([("esim.",), ("esim.",), ("ym.",)], "word string")
    made = tokens.with_abbreviations(rows, lexicon, ["k"])
    assert made.columns == ["k", "text", "word", "abbreviations"]
    assert {r.word: r.abbreviations for r in made.collect()} == {"x": ["esim."], "y": ["esim."], "z": [], "n": ["esim."], "t": [], "e": []}
    got = tokens.explode_sentences(made.where("word = 'n'"), abbreviations=F.col("abbreviations")).collect()
    assert [(r.sentence, r.sentence_type) for r in got] == [("Tuli esim. ", "POSSIBLE"), ("Matti. ", "PROBABLE"), ("Ja koira. ", "PROBABLE"), ("Meni.", "NONE")]
    assert tokens.with_abbreviations(rows, lexicon.limit(0), ["k"]).where("size(abbreviations) > 0").count() == 0


def test_bigrams_of_a_stream_are_those_of_the_table(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    tags = ["NOUN", "VERB", "_", "ADJ", None]
    rows = [(s, i, tags[(s + i * i) % 5], start + datetime.timedelta(minutes=2 * i + s)) for s in range(4) for i in range(9)]
    # within the lateness rows come in any order; the last rows only move the watermark
    batches = [rows[0::2][:9], rows[1::2], rows[0::2][9:], [(99, 0, "X", start + datetime.timedelta(days=1))], [(99, 1, "X", start + datetime.timedelta(days=2))]]
    schema = "sentence long, id long, upos string, ts timestamp"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(schema).parquet(str(folder))
    q = stream_tag_bigrams(source, "ts", "sentence").writeStream.format("memory").queryName("bigrams").outputMode("append").start()
    for k in range(len(batches)):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(folder / f"{k}.parquet")
        q.processAllAvailable()
    q.stop()
    got = {(r.prev, r.curr): r["n"] for r in spark.table("bigrams").where("prev <> 'X' and curr <> 'X'").groupBy("prev", "curr").agg(F.sum("count").alias("n")).collect()}
    want = corpus.tag_bigrams(spark.createDataFrame(rows, schema))
    assert got == {(r.prev, r.curr): r["count"] for r in want.collect()}
