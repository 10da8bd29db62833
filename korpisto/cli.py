"""Command line: ``python -m korpisto.cli COMMAND ...``; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from korpisto.api import Engine
from korpisto.operators import evaluation
from korpisto.plans.evaluation import evaluate_end_to_end, evaluate_gold
from korpisto.sources.text_assets import read_conllu


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="korpisto")
    p.add_argument("--dictionary")
    p.add_argument("--words")
    p.add_argument("--model")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "spell", "compound", "sentence", "grammar", "hyphenate", "hyphenate-text", "generate"):
        s = c.add_parser(name)
        s.add_argument("text", nargs="+")
        if name == "generate":
            s.add_argument("--case")
            s.add_argument("--number", default="singular")
            s.add_argument("--verb", action="store_true")
    c.add_parser("info")
    c.add_parser("benchmark").add_argument("texts", help="a Parquet table with a column text")
    e = c.add_parser("eval")
    e.add_argument("treebank")
    e.add_argument("--json", action="store_true")
    e.add_argument("--end-to-end", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("korpisto").getOrCreate()
    engine = Engine(spark)
    for path, load in ((a.dictionary, engine.load), (a.words, engine.load_wordlist), (a.model, engine.load_model)):
        if path:
            load(path)
    if a.command == "info":
        print(json.dumps(engine.info()))
        return 0
    if a.command == "benchmark":
        df = spark.read.parquet(a.texts)
        done = engine.analyze_sentence(df).select(F.size("tags").alias("n")) if engine.dictionary else engine.tokenize(df).select(F.size("tokens").alias("n"))
        start = time.time()
        n = done.select(F.sum("n")).first()[0] or 0
        took = time.time() - start
        print(json.dumps({"tokens": n, "seconds": round(took, 3), "tokens_a_second": round(n / took)}))
        return 0
    if a.command == "eval":
        gold = read_conllu(spark, a.treebank)
        results = (evaluate_end_to_end if a.end_to_end else evaluate_gold)(gold, engine.analyze, **({} if a.end_to_end else {"model": engine.model}))
        for r in (evaluation.report_json(results) if a.json else evaluation.report(results)).collect():
            print(r[0])
        return 0
    words = spark.createDataFrame([(t,) for t in a.text], "word string")
    texts = words.withColumnRenamed("word", "text")
    out = {
        "analyze": lambda: words.withColumn("readings", engine.analyze(F.col("word"))), "spell": lambda: engine.spell_with_suggestions(words), "compound": lambda: engine.compound_split(words),
        "sentence": lambda: engine.analyze_sentence(texts), "grammar": lambda: engine.grammar_check(texts), "hyphenate": lambda: words.withColumn("hyphenated", engine.hyphenate(F.col("word"))),
        "hyphenate-text": lambda: texts.withColumn("hyphenated", engine.hyphenate_text(F.col("text"))),
        "generate": lambda: words.withColumn("form", engine.generate_form(F.col("word"), a.case, a.number)) if a.case else (engine.generate_verb_paradigm(words) if a.verb else engine.generate_paradigm(words)),
    }[a.command]()
    for r in out.select(F.to_json(F.struct("*"))).collect():
        print(r[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
