"""Operators on streams: row-local ones run unchanged, counts keep state by window, bigrams by sentence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from korpisto.operators.corpus import BOS, EOS
from korpisto.operators.tokens import explode_tokens
from korpisto.session import ship


def stream_word_counts(stream: DataFrame, time: str, text: str, *, window: str = "10 minutes", lateness: str = "20 minutes") -> DataFrame:
    """(window, word, count) of a stream of texts with event time; late rows within ``lateness`` count."""
    rows = explode_tokens(stream.withWatermark(time, lateness), text).where("token_type = 'WORD'")
    return rows.groupBy(F.window(time, window), F.lower("token").alias("word")).agg(F.count("*").alias("count"))


def stream_tag_bigrams(stream: DataFrame, time: str, sentence: str, order: str = "id", tag: str = "upos", *, lateness: str = "20 minutes", idle: str = "1 hour") -> DataFrame:
    """(prev, curr, count) of adjacent tags as they become certain; their sums are those of ``tag_bigrams``.

    A sentence's tags follow each other by (time, order), ``_`` and null tags left out.
    A tag is counted once the watermark has passed it, so rows may come in any order
    within ``lateness``; later ones are left out, as in windowed counts. A sentence
    ends when the watermark is ``idle`` beyond its last row; state holds the last
    counted tag and the rows that the watermark has yet to pass. Rows without a
    sentence or time are left out.
    """
    ship(stream.sparkSession)
    wait = int(stream.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {idle}) as ms").first()["ms"])
    rows = stream.withWatermark(time, lateness).select(F.col(time), F.col(sentence).cast("string").alias("_sentence"), F.unix_millis(time).alias("_at"), F.col(order).cast("long").alias("_order"), F.col(tag).alias("_tag"))
    rows = rows.where("_sentence is not null and _at is not null and _tag <> '_'")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        last, latest, *waiting = state.get if state.exists else (BOS, 0, [], [], [])
        kept = list(zip(*waiting))
        for f in () if state.hasTimedOut else frames:
            kept += [r for r in zip(f["_at"].tolist(), f["_order"].tolist(), f["_tag"].tolist()) if r[0] >= passed]
        kept.sort()
        latest = max(latest, kept[-1][0]) if kept else latest
        counts: Counter = Counter()
        done = sum(at < passed for at, _, _ in kept)
        for _, _, t in kept[:done]:
            counts[last, t] += 1
            last = t
        kept = kept[done:]
        if kept or latest + wait > passed:
            if kept or last != BOS:
                state.update((last, latest, *([list(c) for c in zip(*kept)] or [[], [], []])))
                state.setTimeoutTimestamp(max(passed + 1, kept[0][0] + 1 if kept else latest + wait))
        else:
            if last != BOS:
                counts[last, EOS] += 1
            if state.exists:
                state.remove()
        if counts:
            yield pd.DataFrame([(p, c, n) for (p, c), n in counts.items()], columns=["prev", "curr", "count"])

    return rows.groupBy("_sentence").applyInPandasWithState(
        step, "prev string, curr string, count long", "last string, latest long, at array<long>, place array<long>, tag array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
