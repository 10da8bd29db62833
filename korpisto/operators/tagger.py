"""The suffix tagger: features of words in context, scoring, training.

Features are strings, so scoring is a sum over a table of weights or, for many
sentences, of rows of a small matrix. A character pair counts as often as it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpisto.sources.codecs import TaggerModel

# Limits, marks and Finnish endings of the features.
SUFFIX, PREFIX, FORM, LONG_FORM, SHORT_CONTEXT = 8, 5, 6, 8, 4
MARKS, MORE_MARKS = ".,;:!?\"'()[]{}", ".,;:!?\"'()[]{}–—"
ENDINGS = (
    ("fi_case_iness", "ss[aä]$"), ("fi_case_elat", "st[aä]$"), ("fi_case_adess", "ll[aä]$"), ("fi_case_ablat", "lt[aä]$"), ("fi_case_allat", "lle$"),
    ("fi_adv_sti", "sti$"), ("fi_adj_inen", "inen$"), ("fi_adj_pattern", "inen$"), ("fi_vend_an", "an$"), ("fi_vend_en", "en$"), ("fi_vend_isi", "isi$"),
    ("fi_vend_aa", "aa$"), ("fi_vend_ää", "ää$"), ("fi_vend_ee", "ee$"), ("fi_vend_uu", "uu$"), ("fi_vend_yy", "yy$"), ("fi_vend_oo", "oo$"), ("fi_vend_öö", "öö$"),
    ("fi_case_transl", "ksi$"), ("fi_case_ess", "n[aä]$"), ("fi_case_part", "..t[aä]$"), ("fi_case_gen_other", ".[^eaiouyäö]n$"), ("fi_ptcp_pass", "tt[uy]$"),
    ("fi_ptcp_act", "(nut|nyt|neet)$"), ("fi_ptcp_agent", "m[aä]$"), ("fi_inf1", ".d[aä]$"), ("fi_inf3", "(maan|mään)$"), ("fi_comp", "mpi$"),
    ("fi_super", "..in$"), ("fi_poss", "(ni|si|nsa|nsä)$"), ("fi_cond", "^(?=....).*isi"), ("fi_neg", "^(en|et|ei|emme|ette|eivät)$"),
)
# End of fixed values.
_ENDINGS = [(name, re.compile(pattern, re.DOTALL)) for name, pattern in ENDINGS]


def shape(word: str) -> str:
    out = ""
    for c in word[:20]:
        c = "X" if c.isupper() else "x" if c.islower() else "d" if "0" <= c <= "9" else c
        if not out.endswith(c):
            out += c
    return out


@lru_cache(20_000)
def _context(side: str, word: str | None, edge: str) -> tuple[str, ...]:
    """The features that a word gives the one beside it."""
    if word is None:
        return (f"{side}_{edge}=True",)
    low = word.lower()
    out = [f"{side}_suf3={low[-3:]}"] if len(low) >= 3 else []
    if not side.endswith("2"):
        out.append(f"{side}_shape={shape(word)}")
        out += [f"{side}_is_upper=True"] * word[:1].isupper() + [f"{side}_is_punct=True"] * (len(word.encode()) == 1 and word in MORE_MARKS)
    return (*out, *[f"{side}_form={low}"] * (len(low) <= SHORT_CONTEXT))


@lru_cache(20_000)
def _own(word: str) -> tuple[str, ...]:
    """The features of a word wherever it stands, repeated pairs included."""
    low, size = word.lower(), len(word.encode())
    letters = [c for c in word if c.isalpha()]
    out = [f"suf{k}={low[-k:]}" for k in range(1, min(SUFFIX, len(low)) + 1)] + [f"pre{k}={low[:k]}" for k in range(1, min(PREFIX, len(low)) + 1)]
    out += [f"len={min(size, 20)}", f"shape={shape(word)}"]
    flags = {
        "is_upper=true": word[:1].isupper(),
        "all_upper=True": all(c.isupper() for c in letters) and any(c.isupper() for c in word),
        "all_lower=True": all(c.islower() for c in letters) and any(c.islower() for c in word),
        "has_digit=True": any("0" <= c <= "9" for c in word), "has_hyphen=True": "-" in word,
        "is_digit=True": bool(word) and all("0" <= c <= "9" for c in word),
    }
    out += [name for name, there in flags.items() if there]
    if size == 1 and word in MARKS:
        out += ["is_punct=True", f"punct_type={word}"]
    out += [f"{name}=True" for name, pattern in _ENDINGS if pattern.search(low)]
    out += [f"bi={low[k : k + 2]}" for k in range(min(len(low), 11) - 1)] if len(low) >= 2 else []
    if len(low) <= FORM:
        out.append(f"word_form={low}")
    elif len(low) <= LONG_FORM:
        out.append(f"word_form_ext={low}")
    return tuple(out)


@lru_cache(20_000)
def _place(i: int, n: int) -> tuple[str, ...]:
    """The features of place i among n words."""
    share = Decimal(str(i / (n - 1) * 100)).quantize(Decimal(1), ROUND_HALF_UP) / 100 if n > 1 else Decimal(0)
    return (*["is_first=True"] * (i == 0), *["is_last=True"] * (i == n - 1), f"rel_pos={share:.2f}")


#: Where the features of a context come from, and their name where the sentence ends first.
SIDES = (("prev", -1, "BOS"), ("next", 1, "EOS"), ("prev2", -2, "BOS"), ("next2", 2, "EOS"))


def features(words: list[str], i: int) -> list[str]:
    """The features of word i in its sentence, repeated pairs included."""
    n = len(words)
    sides = [_context(side, words[i + step] if 0 <= i + step < n else None, edge) for side, step, edge in SIDES]
    return [*_own(words[i]), *_place(i, n), *(f for side in sides for f in side)]


def log_probabilities(model: TaggerModel, words: list[str]) -> np.ndarray:
    """words x classes; unknown features count nothing."""
    weights = model.weights.astype(np.int32)
    rows = []
    for i in range(len(words)):
        ids = [model.features[f] for f in features(words, i) if f in model.features]
        raw = model.intercepts.astype(np.float64) + float(model.scale) * weights[:, ids].sum(1)
        rows.append(raw - raw.max() - np.log(np.exp(raw - raw.max()).sum()))
    return np.array(rows).reshape(len(words), len(model.classes))


def best_classes(model: TaggerModel, words: list[str]) -> list[str]:
    """The likeliest class of each word, the last of equals."""
    p = log_probabilities(model, words)
    return [model.classes[len(model.classes) - 1 - int(np.argmax(row[::-1]))] for row in p]


def tag_sentences(df: DataFrame, model: TaggerModel, words: str = "words", name: str = "tags") -> DataFrame:
    """The input with the tagger's class for each word of an array."""

    @F.pandas_udf("array<string>")
    def run(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: best_classes(model, list(w)) if w is not None else None)

    return df.withColumn(name, run(F.col(words)))


def feature_rows(df: DataFrame, words: str = "words") -> DataFrame:
    """(input columns, position, feature): one row a feature, for counting and training at any size."""

    @F.pandas_udf("array<array<string>>")
    def run(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: [features(list(w), i) for i in range(len(w))] if w is not None else [])

    cells = df.withColumn("_f", run(F.col(words))).select(*df.columns, F.posexplode("_f").alias("position", "_fs"))
    return cells.select(*df.columns, "position", F.explode("_fs").alias("feature"))


def weight_table(spark: SparkSession, model: TaggerModel) -> DataFrame:
    """(feature, weights): one row a feature, its weights in the order of the model's classes."""
    rows = [(f, [int(w) for w in model.weights[:, k]]) for f, k in model.features.items()]
    return spark.createDataFrame(rows, "feature string, weights array<int>")


def classes_by_weights(cells: DataFrame, weights: DataFrame, classes: list[str], intercepts: list[float], scale: float, keys: list[str], name: str = "class") -> DataFrame:
    """(keys, class): the best class of each key, the last of equals, from its features joined to a table of weights.

    ``cells`` is (keys, feature), a feature as often as it counts; ``weights`` is (feature,
    weights). The model is a table and may be of any size; unknown features count nothing. A
    key's weights are summed as whole numbers before the shuffle and after it.
    """
    found = cells.select(*keys, "feature").join(weights, "feature", "left")
    summed = found.groupBy(*keys).agg(*[F.sum(F.coalesce(F.get("weights", F.lit(k)), F.lit(0))).alias(f"_{k}") for k in range(len(classes))])
    scores = F.array(*[F.struct((F.lit(float(b)) + F.lit(float(scale)) * F.col(f"_{k}")).alias("score"), F.lit(k).alias("k"), F.lit(c).alias("class")) for k, (c, b) in enumerate(zip(classes, intercepts))])
    return summed.select(*keys, F.array_max(scores)["class"].alias(name))


def tag_words_by_join(df: DataFrame, model: TaggerModel, keys: list[str], words: str = "words", name: str = "class") -> DataFrame:
    """(keys, position, class): as ``tag_sentences``, a row a word, by joins with the model's table."""
    cells = feature_rows(df.select(*keys, words), words)
    return classes_by_weights(cells, weight_table(df.sparkSession, model), model.classes, list(model.intercepts), model.scale, [*keys, "position"], name)


def surface_features(word: Column) -> Column:
    """The features of a word that need no context: its ends to three letters, and its length in bytes; all built in."""
    low, size = F.lower(word), F.length(word)
    ends = [F.when(size >= k, F.concat(F.lit(f"suf{k}="), F.right(low, F.lit(k)))) for k in (1, 2, 3)] + [F.when(size >= k, F.concat(F.lit(f"pre{k}="), F.left(low, F.lit(k)))) for k in (1, 2, 3)]
    return F.filter(F.array(*ends, F.concat(F.lit("len="), F.least(F.octet_length(word), F.lit(20)))), lambda f: f.isNotNull())


#: Rows of which Python objects are made at a time.
_AT_ONCE = 512


def _added(rows: Iterator[tuple[tuple[str, ...], int]]) -> pa.RecordBatch:
    """(feature, n) of features and what each of them counts."""
    out: dict[str, int] = {}
    for found, count in rows:
        for f in found:
            out[f] = out.get(f, 0) + count
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["feature", "n"])


def _by_row(b: pa.RecordBatch) -> Iterator[zip]:
    for first in range(0, len(b), _AT_ONCE):
        yield zip(*(c.to_pylist() for c in b.slice(first, _AT_ONCE).columns))


def word_feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n) of (word, own, one count a side). Each word comes once, so nothing is remembered."""
    own_of, context_of = _own.__wrapped__, _context.__wrapped__

    def found(rows: zip) -> Iterator[tuple[tuple[str, ...], int]]:
        for word, own, *counts in rows:
            yield own_of(word), own
            for (side, _, edge), count in zip(SIDES, counts):
                if count:
                    yield context_of(side, word, edge), count

    for b in batches:
        yield from map(_added, map(found, _by_row(b)))


def place_feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n) of (place, words of the sentence, count)."""
    place_of = _place.__wrapped__

    def found(rows: zip) -> Iterator[tuple[tuple[str, ...], int]]:
        for i, n, count in rows:
            yield place_of(i, n), count
            for side, step, edge in SIDES:
                if not 0 <= i + step < n:
                    yield _context(side, None, edge), count

    for b in batches:
        yield from map(_added, map(found, _by_row(b)))


def feature_counts(df: DataFrame, words: str = "words") -> DataFrame:
    """(feature, n): how often each feature occurs, as ``feature_rows`` would count it.

    Features depend on one word or on a place alone. So words and places are counted
    first, with the sides on which a word is another's context, and the features of
    each distinct word are made once.
    """
    cells = df.select(F.size(words).alias("n"), F.posexplode(words).alias("i", "word"))
    beside = {side: F.sum(((F.col("i") - step >= 0) & (F.col("i") - step < F.col("n"))).cast("long")).alias(side) for side, step, _ in SIDES}
    each = cells.groupBy("word").agg(F.count("*").alias("own"), *beside.values())
    places = cells.groupBy("i", "n").agg(F.count("*").alias("count"))

    made = each.mapInArrow(word_feature_counts, "feature string, n long").unionByName(places.mapInArrow(place_feature_counts, "feature string, n long"))
    return made.groupBy("feature").agg(F.sum("n").alias("n"))


def train(sentences: DataFrame, *, words: str = "words", tags: str = "tags", least: int = 2, iterations: int = 50, regularisation: float = 1e-4) -> TaggerModel:
    """A multinomial logistic model over one-hot features, quantised to 8 bits.

    Features seen fewer than ``least`` times are left out; fitting is Spark's, so
    sentences stay distributed.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    @F.pandas_udf("array<array<string>>")
    def made(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: [features(list(w), i) for i in range(len(w))] if w is not None else [])

    cells = sentences.select(F.explode(F.arrays_zip(made(F.col(words)).alias("f"), F.col(tags).alias("t"))).alias("z")).select(F.col("z.f").alias("f"), F.col("z.t").alias("tag"))
    index = StringIndexer(inputCol="tag", outputCol="label", stringOrderType="alphabetAsc").fit(cells)
    vectors = CountVectorizer(inputCol="f", outputCol="features", minDF=float(least), binary=True).fit(cells)
    fitted = LogisticRegression(family="multinomial", maxIter=iterations, regParam=regularisation, standardization=False).fit(vectors.transform(index.transform(cells)))
    matrix = fitted.coefficientMatrix.toArray()
    scale = float(np.abs(matrix).max() / 127) or 1.0
    weights = np.clip(np.rint(matrix / scale), -127, 127).astype(np.int8)
    return TaggerModel(list(index.labels), {f: i for i, f in enumerate(vectors.vocabulary)}, fitted.interceptVector.toArray().astype(np.float32), scale, weights)
