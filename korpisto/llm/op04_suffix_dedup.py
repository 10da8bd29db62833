"""Operator 4: removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in
the input goes, both occurrences included. Suffixes are sorted into buckets by their
first bytes, and buckets are refined by the bucket identifiers of suffixes at later
offsets until they hold ``length`` bytes (``korpisto.llm.repeats``); suffixes alone in
their bucket leave at once. Only the suffixes that anchors can't part from others
are refined, one for each group of equal stretches of text.

Strings don't cross texts. Null texts are empty; texts shorter than ``length`` stay;
very long texts are read whole. Rows that share an id, or have none, are different
texts, so repeated rows remove each other. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from korpisto.llm.repeats import covered, rewrite


def suffix_dedup(docs: DataFrame, *, length: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        if not len(first):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        gone = covered(len(text), first, count, length)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    rows = rewrite(docs, length, min(gram, length), finish, "n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string", id_col=id_col, text_col=text_col)
    return rows.selectExpr("id as doc_id", "done.*")
