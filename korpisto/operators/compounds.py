"""Compound splits over a word table.

A split is a sequence of known parts with optional linking elements. ``split_word``
states it for one word; ``compound_split`` finds the splits of a table of words by joins
with a lexicon of any size and a fold over each word's lattice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import let
from korpisto.session import shuffle_partitions

# Linking elements and penalties.
LINKS = ("en", "n", "s", "i", "o", "u")
PER_PART, PER_LINK, SHORT_PART = 10, 5, 20
# End of fixed values.
PART = "struct<surface:string,start:int,end:int,is_linking:boolean>"
SPLITS = f"array<struct<parts:array<{PART}>,penalty:int>>"


def nen_stem(stem: str, link: str) -> list[str]:
    """``ihmis`` before ``en`` stands for ``ihminen``."""
    return [stem[:-1] + "nen"] if link == "en" and stem.endswith("s") else []


def penalty(parts: list[tuple[str, int, int, bool]]) -> int:
    return sum(PER_LINK if linking else PER_PART + SHORT_PART * (len(surface) < 3) for surface, _, _, linking in parts)


def split_word(word: str, known: Callable[[str], bool], *, min_part: int = 3, max_parts: int = 5, rebuild: Callable[[str, str], list[str]] | None = nen_stem, dedup: bool = False) -> list[tuple[list, int]]:
    """(parts, penalty) of all splits with two word parts or more, by penalty.

    A linking element may follow a part, or end it; where both hold the split
    appears twice, unless ``dedup``.
    """
    if "-" in word:
        pieces = word.split("-")
        if not 2 <= len(pieces) <= max_parts or not all(pieces) or not all(map(known, pieces)):
            return []
        parts, at = [], 0
        for k, piece in enumerate(pieces):
            if k:
                parts.append(("-", at, at + 1, True))
                at += 1
            end = at + len(piece.encode())
            parts.append((piece, at, end, False))
            at = end
        return [(parts, penalty(parts))]
    offsets = [0]
    for c in word:
        offsets.append(offsets[-1] + len(c.encode()))
    n, memo = len(word), {}

    def is_word(i: int, j: int) -> bool:
        if (i, j) not in memo:
            memo[i, j] = known(word[i:j])
        return memo[i, j]

    def part(i: int, j: int, linking: bool) -> tuple[str, int, int, bool]:
        return word[i:j], offsets[i], offsets[j], linking

    def steps(i: int) -> Iterator[tuple[int, list]]:
        """(next position, parts) from i, in order of length."""
        for j in range(i + 1, n + 1):
            if offsets[j] - offsets[i] < min_part:
                continue
            if is_word(i, j):
                yield j, [part(i, j, False)]
                for link in LINKS if j < n else ():
                    if word.startswith(link, j) and offsets[j] + len(link) + min_part <= offsets[n]:
                        yield j + len(link), [part(i, j, False), part(j, j + len(link), True)]
            for link in LINKS if j < n else ():
                k = j - len(link)
                if k > i and word[i:j].endswith(link) and offsets[k] - offsets[i] >= min_part and (is_word(i, k) or (rebuild and any(map(known, rebuild(word[i:k], link))))):
                    yield j, [part(i, k, False), part(k, j, True)]

    out: list[tuple[list, int]] = []

    def walk(i: int, parts: list, words: int) -> None:
        if i == n:
            if words >= 2:
                out.append((parts, penalty(parts)))
        elif words < max_parts:
            for j, more in steps(i):
                walk(j, parts + more, words + 1)

    walk(0, [], 0)
    out.sort(key=lambda s: s[1])
    if dedup:
        seen: set = set()
        out = [s for s in out if not (tuple(s[0]) in seen or seen.add(tuple(s[0])))]
    return out


def _offset(at: Column) -> Column:
    """The byte before which character ``at`` of ``word`` begins."""
    return F.octet_length(F.substring("word", F.lit(1), at)).cast("int")


def _part(start: Column, end: Column, linking: bool) -> Column:
    return F.struct(F.substring("word", start + 1, end - start).alias("surface"), _offset(start).alias("start"), _offset(end).alias("end"), F.lit(linking).alias("is_linking"))


def _hits(words: DataFrame, lexicon: DataFrame, min_part: int, rebuild: bool) -> DataFrame:
    """(word, i, j, own): the stretches of each word that the lexicon holds (own), or whose rebuilt stem it holds, as far as a split of two parts or more has room for them."""
    parts = shuffle_partitions(words.sparkSession)  # words are few bytes and long work, which AQE would put into one task
    size, left, right = F.octet_length("word"), F.octet_length(F.substring("word", F.lit(1), F.col("i"))), F.octet_length(F.substring("word", F.col("j") + 1, F.length("word")))
    starts = words.where(size >= 2 * min_part).repartition(parts, "word").select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    starts = starts.where(((F.col("i") == 0) | (left >= min_part)) & (size - left >= min_part))  # another part fits before it, or none is needed
    cuts = starts.select("word", "i", F.explode(F.sequence(F.col("i") + 1, F.length("word"))).alias("j")).where((F.col("j") == F.length("word")) & (F.col("i") > 0) | (right >= min_part))
    cuts = cuts.withColumn("piece", F.substring("word", F.col("i") + 1, F.col("j") - F.col("i"))).where(F.octet_length("piece") >= min_part)
    asked = cuts.withColumn("own", F.lit(1))
    if rebuild:  # as ``nen_stem``
        stems = cuts.where(F.endswith("piece", F.lit("s")) & (F.substring("word", F.col("j") + 1, F.lit(2)) == "en"))
        asked = asked.unionByName(stems.withColumn("piece", F.concat(F.substring("piece", F.lit(1), F.length("piece") - 1), F.lit("nen"))).withColumn("own", F.lit(0)))
    found = asked.join(lexicon, "piece", "left_semi").repartition(parts, "word")
    return found.groupBy("word", "i", "j").agg(F.max("own").alias("own"))


def _steps(hits: DataFrame, min_part: int) -> DataFrame:
    """(word, i, order, next, parts): from place i a part, or a part and a linking element, behind it or at its own end."""
    i, j, own = F.col("i"), F.col("j"), F.col("own") == 1
    links = F.array(*[F.struct(F.lit(link).alias("link"), F.lit(k).alias("rank")) for k, link in enumerate(LINKS)])
    step = lambda order, end, *parts: F.struct(order.cast("int").alias("order"), end.cast("int").alias("next"), F.array(*parts).alias("parts"))
    follows = F.filter(links, lambda x: F.substring("word", j + 1, F.length(x["link"])) == x["link"])
    behind = F.filter(follows, lambda x: own & (_offset(j + F.length(x["link"])) + min_part <= F.octet_length("word")))
    inside = F.filter(follows, lambda x: (own | (x["link"] == "en")) & (j + F.length(x["link"]) < F.length("word")))

    def linked(first: Column, found: Column) -> Column:
        return F.transform(found, lambda x: let(j + F.length(x["link"]), lambda end: step(first(end) + x["rank"], end, _part(i, j, False), _part(j, end, True))))

    alone = F.when(own, F.array(step(j * 100, j, _part(i, j, False))))
    all_steps = F.concat(F.coalesce(alone, F.slice(F.array(step(j, j, _part(i, j, False))), 1, 0)), linked(lambda end: j * 100 + 1, behind), linked(lambda end: end * 100 + 10, inside))
    return hits.select("word", "i", F.explode(all_steps).alias("s")).select("word", "i", "s.order", "s.next", "s.parts")


def _paths(lattice: Column, most: int) -> Column:
    """All ways through a word's lattice with two to ``most`` words, in the order of their steps and then by penalty."""
    path = f"array<struct<at:int,parts:array<{PART}>,order:array<int>>>"
    start = F.struct(F.array(F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PART}>").alias("parts"), F.array().cast("array<int>").alias("order"))).cast(path).alias("open"), F.array().cast(path).alias("done"))

    def grow(acc: Column, k: Column) -> Column:
        def along(p: Column) -> Column:
            here = F.filter(lattice, lambda s: s["i"] == p["at"])
            return F.transform(here, lambda s: F.struct(s["next"].alias("at"), F.concat(p["parts"], s["parts"]).alias("parts"), F.array_append(p["order"], s["order"]).alias("order")))

        ended = lambda p: p["at"] == F.length("word")
        grown = F.flatten(F.transform(acc["open"], along)).cast(path)
        return let(grown, lambda g: F.struct(F.filter(g, lambda p: ~ended(p)).alias("open"), F.when(k > 1, F.concat(acc["done"], F.filter(g, ended))).otherwise(acc["done"]).alias("done")))

    def cost(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p["is_linking"], PER_LINK).when(F.length(p["surface"]) < 3, PER_PART + SHORT_PART).otherwise(PER_PART))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, grow, lambda acc: acc["done"])
    ranked = F.array_sort(F.transform(done, lambda p: F.struct(cost(p["parts"]).alias("penalty"), p["order"].alias("order"), p["parts"].alias("parts"))))
    return F.transform(ranked, lambda r: F.struct(r["parts"].alias("parts"), r["penalty"].alias("penalty"))).cast(SPLITS)


def _hyphenated(words: DataFrame, lexicon: DataFrame, max_parts: int) -> DataFrame:
    """(word, splits) of words whose parts between hyphens are all known."""
    pieces = words.withColumn("ps", F.split("word", "-")).where(F.size("ps").between(2, max_parts))
    unknown = pieces.select("word", F.explode("ps").alias("piece")).join(lexicon, "piece", "left_anti").select("word").distinct()
    whole = pieces.join(unknown, "word", "left_anti")
    ends = F.transform("ps", lambda p, k: F.octet_length(F.array_join(F.slice("ps", F.lit(1), k + 1), "-")))
    part = lambda text, start, end, linking: F.struct(text.alias("surface"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(linking).alias("is_linking"))
    cells = F.transform("ps", lambda p, k: F.array(part(F.lit("-"), F.get("ends", k - 1), F.get("ends", k - 1) + 1, True), part(p, F.get("ends", k) - F.octet_length(p), F.get("ends", k), False)))
    listed = whole.withColumn("ends", ends).withColumn("parts", F.flatten(cells)).withColumn("parts", F.slice("parts", F.lit(2), F.size("parts") - 1))
    penalty = (F.size("ps") - 1) * PER_LINK + F.aggregate("ps", F.lit(0), lambda n, p: n + F.when(F.length(p) < 3, PER_PART + SHORT_PART).otherwise(PER_PART))
    return listed.select("word", F.array(F.struct("parts", penalty.alias("penalty"))).cast(SPLITS).alias("splits"))


def compound_split(df: DataFrame, lexicon: DataFrame, word: str = "word", name: str = "splits", *, rebuild: bool = True, dedup: bool = False, min_part: int = 3, max_parts: int = 5) -> DataFrame:
    """The input with all splits of each word over a lexicon of any size with a column ``word``.

    The stretches of the distinct words meet the lexicon in a join; what it holds is a
    word's lattice, whose paths a fold lists. A word's lattice is bounded by the
    square of its length. Results are those of ``split_word``, in its order; null words have none.
    """
    known = lexicon.select(F.col("word").alias("piece")).where("piece is not null").distinct()
    asked = df.select(F.col(word).alias("word")).where("word is not null and word <> ''").distinct()
    plain = asked.where(~F.contains("word", F.lit("-")))
    steps = _steps(_hits(plain, known, min_part, rebuild), min_part)
    lattices = steps.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", "order", "next", "parts"))).alias("lattice"))
    splits = lattices.select("word", _paths(F.col("lattice"), max_parts).alias("splits"))
    if dedup:
        splits = splits.withColumn("splits", F.array_distinct("splits"))
    found = splits.unionByName(_hyphenated(asked.where(F.contains("word", F.lit("-"))), known, max_parts)).select(F.col("word").alias(word), F.col("splits").alias(name))
    return df.join(found, word, "left").withColumn(name, F.coalesce(name, F.array().cast(SPLITS)))


def is_compound(splits: Column) -> Column:
    return F.exists(splits, lambda s: F.size(F.filter(s.parts, lambda p: ~p.is_linking)) >= 2)


def two_part_compounds(words: DataFrame, lexicon: DataFrame, *, min_part: int = 3) -> DataFrame:
    """(word, first, second) of all divisions into two known words, by joins alone; any lexicon size."""
    lex = lexicon.select("word").distinct()
    cuts = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).where("length(word) > 1")
    parts = cuts.select("word", F.expr("substring(word, 1, at)").alias("first"), F.expr("substring(word, at + 1)").alias("second"))
    parts = parts.where((F.octet_length("first") >= min_part) & (F.octet_length("second") >= min_part))
    return parts.join(lex.withColumnRenamed("word", "first"), "first", "left_semi").join(lex.withColumnRenamed("word", "second"), "second", "left_semi").select("word", "first", "second")
