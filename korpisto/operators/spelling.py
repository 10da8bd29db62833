"""Spelling verdicts, suggestions and edit candidates as joins and windows.

Distances count UTF-8 bytes. Near words are found by an equi-join on stretches: k edits
leave one of k + 1 stretches of a word untouched, near its place.
Verdicts on distinct words are joined back, so no cache is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpisto.functions.chars import as_bytes, byte_levenshtein, let

# The alphabet of edits.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäö"
# End of fixed values.


def check(words: DataFrame, lexicon: DataFrame, user: DataFrame | None = None, splits: DataFrame | None = None, word: str = "word", name: str = "verdict") -> DataFrame:
    """The input with Ok or Failed: known to the user or the lexicon, or a compound by ``splits`` (word, is_compound)."""
    known = lexicon.select(F.col("word").alias(word))
    if user is not None:
        known = known.union(user.select(F.col("word").alias(word)))
    if splits is not None:
        known = known.union(splits.where("is_compound").select(F.col("word").alias(word)))
    marks = known.distinct().withColumn("_known", F.lit(True))
    return words.join(marks, word, "left").withColumn(name, F.when(F.col("_known"), "Ok").otherwise("Failed")).drop("_known")


def _segments(size: Column, k: int) -> list[tuple[Column, Column]]:
    """(start, length) of the k + 1 stretches of about equal length of a word of ``size`` bytes."""
    cut = lambda n: F.floor(size * n / (k + 1)).cast("int")
    return [(cut(n), cut(n + 1) - cut(n)) for n in range(k + 1)]


def _own_segments(word: Column, k: int) -> Column:
    """A lexicon word's stretches with their number."""
    return F.array(*[F.struct(F.lit(n).alias("n"), F.substring(word, start + 1, size).alias("part")) for n, (start, size) in enumerate(_segments(F.length(word), k))])


def _asked_segments(word: Column, k: int) -> Column:
    """What a query has at the places where a word within k edits may have its stretches: (length of that word, number, part)."""
    size, found = F.length(word), []
    for longer in range(-k, k + 1):  # how many bytes more the other word has
        for n, (start, length) in enumerate(_segments(size + longer, k)):
            for shift in range(-k, k + 1):
                if abs(shift) + abs(-longer - shift) <= k:  # edits before the stretch, and behind it
                    at = start + shift
                    fits = (size + longer >= 0) & (at >= 0) & (at + length <= size)
                    found.append(F.when(fits, F.struct((size + longer).alias("size"), F.lit(n).alias("n"), F.substring(word, at + 1, length).alias("part"))))
    return F.array_distinct(F.filter(F.array(*found), lambda s: s.isNotNull()))


def fuzzy_search(queries: DataFrame, lexicon: DataFrame, k: int, word: str = "word") -> DataFrame:
    """(query, candidate, distance) of all lexicon words within k byte edits of each distinct query.

    k edits leave one of k + 1 stretches of a word as it is, at most k bytes from its
    place. So a word is filed under its stretches with its length, k + 1 rows, and a query
    asks for those that it holds nearby. Only words of at most k bytes have empty stretches,
    and such a word is near every other one of its length.
    """
    q = queries.select(F.col(word).alias("query")).where("query is not null").distinct()
    w = lexicon.select(F.col("word").alias("candidate")).where("candidate is not null").distinct().withColumn("bytes", as_bytes(F.col("candidate")))
    filed = w.select("candidate", F.length("bytes").alias("size"), F.explode(_own_segments(F.col("bytes"), k)).alias("s")).select("candidate", "size", "s.n", "s.part")
    asked = q.withColumn("bytes", as_bytes(F.col("query"))).select("query", F.explode(_asked_segments(F.col("bytes"), k)).alias("s")).select("query", "s.size", "s.n", "s.part")
    pairs = asked.join(filed, ["size", "n", "part"]).select("query", "candidate").distinct()
    return pairs.withColumn("distance", byte_levenshtein(F.col("query"), F.col("candidate"), k)).where("distance >= 0")


def _byte_order(word: str) -> Column:
    return F.encode(word, "UTF-8")


def _top(pairs: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def suggest_unfiltered(queries: DataFrame, lexicon: DataFrame, k: int = 2, n: int = 10, word: str = "word") -> DataFrame:
    """(query, candidate, distance, rank): the n nearest words, ties in byte order."""
    return _top(fuzzy_search(queries, lexicon, k, word), n, F.asc("distance"), _byte_order("candidate"))


def suggest(queries: DataFrame, lexicon: DataFrame, k: int = 2, n: int = 10, *, valid: DataFrame | None = None, user: DataFrame | None = None, word: str = "word") -> DataFrame:
    """As ``suggest_unfiltered``, of words in ``valid`` (or the user's), with the user's own near words behind."""
    found = fuzzy_search(queries, lexicon, k, word).withColumn("own", F.lit(0))
    if valid is not None:
        good = valid.select(F.col("word").alias("candidate"))
        if user is not None:
            good = good.union(user.select(F.col("word").alias("candidate")))
        found = found.join(good.distinct(), "candidate", "left_semi")
    if user is not None:
        mine = fuzzy_search(queries, user, k, word).withColumn("own", F.lit(1))
        found = found.unionByName(mine.join(found.select("query", "candidate"), ["query", "candidate"], "left_anti"))
    return _top(found, n, F.asc("own"), F.asc("distance"), _byte_order("candidate")).drop("own")


def suggest_ranked(queries: DataFrame, lexicon: DataFrame, k: int = 2, n: int = 10, *, scores: DataFrame | None = None, frequencies: DataFrame | None = None, word: str = "word") -> DataFrame:
    """By distance, then score, then word. ``scores`` is (candidate, score); frequencies add ln(1 + a million times the relative frequency)."""
    found = fuzzy_search(queries, lexicon, k, word)
    score = F.lit(0.0)
    if scores is not None:
        found = found.join(scores.select("candidate", "score"), "candidate", "left")
        score += F.coalesce("score", F.lit(0.0))
    if frequencies is not None:
        total = frequencies.agg(F.sum("count").alias("total"))
        found = found.join(frequencies.select(F.col("word").alias("candidate"), "count"), "candidate", "left").join(F.broadcast(total))  # one row
        score += F.log1p(1e6 * F.coalesce(F.col("count") / F.col("total"), F.lit(0.0)))
    return _top(found.withColumn("score_", score), n, F.asc("distance"), F.desc("score_"), _byte_order("candidate")).select("query", "candidate", "distance", F.col("score_").alias("score"), "rank")


def suggest_in_context(candidates: DataFrame, readings: DataFrame, bigrams: DataFrame, default: float, n: int = 5, frequency_weight: float = 0.1) -> DataFrame:
    """Ranks (query, prev_class, candidate, distance[, bonus]) by the best bigram of the class before and a reading's class.

    ``readings`` is (candidate, class), ``bigrams`` (prev, curr, weight).
    """
    pairs = candidates.join(readings, "candidate", "left").join(bigrams.select(F.col("prev").alias("prev_class"), F.col("curr").alias("class"), "weight"), ["prev_class", "class"], "left")
    keys = [c for c in candidates.columns]
    bonus = frequency_weight * F.coalesce("bonus", F.lit(0.0)) if "bonus" in candidates.columns else F.lit(0.0)
    scored = pairs.groupBy(*keys).agg(F.max(F.coalesce("weight", F.lit(default))).alias("fit")).withColumn("score", F.col("fit") + bonus)
    return _top(scored, n, F.asc("distance"), F.desc("score"), _byte_order("candidate"))


def suggest_escalating(queries: DataFrame, lexicon: DataFrame, k: int = 1, n: int = 10, word: str = "word") -> DataFrame:
    """Suggestions for unknown words only: within k, or where there are none within k + 1, up to 3."""
    unknown = queries.select(word).distinct().join(lexicon.select(F.col("word").alias(word)).distinct(), word, "left_anti")
    widest = min(k + 1, 3)
    found = fuzzy_search(unknown, lexicon, max(k, widest), word)
    level = F.greatest(F.min("distance").over(Window.partitionBy("query")), F.lit(k))
    return _top(found.withColumn("level", level).where("distance <= level"), n, F.asc("distance"), _byte_order("candidate")).drop("level")


def suggest_or_guess(queries: DataFrame, lexicon: DataFrame, valid: DataFrame, n: int = 10, word: str = "word") -> DataFrame:
    """For each query the valid words one edit away, or where there are none those two away, or else any words within two."""
    good = valid.select(F.col("word").alias("candidate")).distinct().withColumn("good", F.lit(True))
    found = fuzzy_search(queries, lexicon, 2, word).where("distance > 0").join(good, "candidate", "left")
    level = F.when(F.col("good"), F.col("distance")).otherwise(3)
    best = F.min("level").over(Window.partitionBy("query"))
    chosen = found.withColumn("level", level).withColumn("best", best).where("level = best")
    return _top(chosen, n, F.asc("distance"), _byte_order("candidate")).drop("good", "level", "best")


def edits(word: Column) -> Column:
    """All words one deletion, substitution, insertion or transposition away; repeats included."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    size = F.length(word)
    left = lambda i: F.substring(word, F.lit(1), i)
    right = lambda i: F.substring(word, i + 1, size)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.sequence(F.lit(0), size)
    inner = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        F.transform(places, lambda i: F.concat(left(i), right(i + 1))),
        F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1))))),
        F.flatten(F.transform(gaps, lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i))))),
        F.transform(inner, lambda i: F.concat(left(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), right(i + 2))),
    )


def edit_candidates(queries: DataFrame, k: int = 1, word: str = "word") -> DataFrame:
    """(query, candidate, distance): words within k edits over ALPHABET, least distance kept, the word itself left out."""
    first = queries.select(F.col(word).alias("query")).where("query is not null").distinct()
    found = first.select("query", F.col("query").alias("candidate"), F.lit(0).alias("distance"))
    level = found
    for d in range(1, min(k, 2) + 1):
        level = level.select("query", F.explode(edits(F.col("candidate"))).alias("candidate")).where("candidate <> ''").distinct().withColumn("distance", F.lit(d))
        found = found.unionByName(level)
    return found.groupBy("query", "candidate").agg(F.min("distance").alias("distance")).where("distance > 0")


def suggest_by_edits(queries: DataFrame, lexicon: DataFrame, k: int = 1, n: int = 5, word: str = "word") -> DataFrame:
    """The valid edit candidates, by distance and word."""
    good = edit_candidates(queries, k, word).join(lexicon.select(F.col("word").alias("candidate")).distinct(), "candidate", "left_semi")
    return _top(good, n, F.asc("distance"), _byte_order("candidate"))


def suggest_compound(queries: DataFrame, lexicon: DataFrame, k: int = 2, n: int = 5, per_part: int = 3, word: str = "word") -> DataFrame:
    """Corrections of one part of a compound whose other part is a word."""
    q = queries.select(F.col(word).alias("query")).where(F.octet_length(word) >= 4).distinct()
    cuts = q.select("query", F.explode(F.sequence(F.lit(1), F.length("query") - 1)).alias("at")).select("query", F.expr("substring(query, 1, at)").alias("left"), F.expr("substring(query, at + 1)").alias("right"))
    cuts = cuts.where((F.octet_length("left") >= 2) & (F.octet_length("right") >= 2))
    lex = lexicon.select("word").distinct()
    out = None
    for good, bad in (("left", "right"), ("right", "left")):
        side = cuts.join(lex.withColumnRenamed("word", good), good, "left_semi")
        fixes = suggest_unfiltered(side.select(F.col(bad).alias("word")), lexicon, k, per_part).select(F.col("query").alias(bad), F.col("candidate").alias("fixed"))
        made = side.join(fixes, bad).select("query", F.concat(F.col("left") if good == "left" else F.col("fixed"), F.col("fixed") if good == "left" else F.col("right")).alias("candidate"))
        out = made if out is None else out.union(made)
    pairs = out.distinct().withColumn("distance", byte_levenshtein(F.col("query"), F.col("candidate"), k)).where("distance > 0")
    return _top(pairs, n, F.asc("distance"), _byte_order("candidate"))


# ---------------------------------------------------------------- user dictionary
def user_add(user: DataFrame, words: DataFrame) -> DataFrame:
    return user.select("word").union(words.select("word").where("word <> ''")).distinct()


def user_remove(user: DataFrame, words: DataFrame) -> DataFrame:
    return user.join(words.select("word"), "word", "left_anti")
