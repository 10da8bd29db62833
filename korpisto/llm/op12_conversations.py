"""Operator 12: conversation structure repair.

A conversation's roles shall read ``(s?(ua)+)?`` by their initials. A finite
grammar of four states accepts that: nothing yet, after a system turn, after a
user turn, after an assistant turn. Rows that are blank, or that repeat a role and
text seen earlier, must go. The cheapest edits are a shortest path through (turn,
state), and ties go to the audit that is least in ASCII.

Turns are dealt by a hash of their conversation and sorted. In a task, batches of
turns are cut into segments of at most ``SEGMENT`` turns of one conversation, and one
recursive DuckDB query advances all segments of the batch turn by turn: per grammar
state it keeps the least (cost, audit). A segment that continues a conversation starts
from all four states, and its result is joined to what the states cost before; the
digest of the repaired text is carried per state too. So a conversation of any length,
a third of all rows included, streams through with one segment in memory (and its
audit, which is part of the result); that stream is sequential, because the digest of
the whole repaired conversation is. Equal rows are counted per batch before the first
shuffle, so a row that is repeated without end is sent once a batch.

Defined results: nulls in role and text are one space; null turns come first; rows of
the same turn are ordered by role and text. Null conversation ids form one
conversation. A role of no letters has an empty initial, which no grammar state takes.
A conversation that has no rows left, by damage or otherwise, gives zeros, no audit and
the digest of the empty string. Very long texts are read whole; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korpisto.llm.common import shuffle_partitions

SEGMENT, BATCH = 256, 8192
WHITE = " \t\n\x0b\x0c\r"
#: Costs: rerole, delete, insert, an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. An edit leads from s to t, for rows of one initial or of any.
_GRAMMAR = """
edit(s, letter, initial, t) as (values (0, 'D', null, 0), (1, 'D', null, 1), (2, 'D', null, 2), (3, 'D', null, 3),
    (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
    (0, 'R', null, 2), (1, 'R', null, 2), (2, 'R', null, 3), (3, 'R', null, 2)),
inserted(s, k, t) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2))"""
#: One recursion advances one turn of all segments: the edit of the turn, its copies' removal, then up to two insertions.
_REPAIR = f"""
with recursive {_GRAMMAR},
best as (
    select c, o, 0 as p, s, {{'cost': cost, 'audit': audit}} as b from starts
    union all
    select d.c, d.o, d.p + 1, i.t, min({{
        'cost': d.b.cost + {INSERT} * i.k + case e.letter when 'D' then {DELETE} * r.copies
            else {DELETE} * (r.copies - 1) + {TRUNCATED} * r.truncated + case e.letter when 'R' then {REROLE} else 0 end end,
        'audit': d.b.audit || case e.letter when 'D' then repeat('D', r.copies) else e.letter || repeat('D', r.copies - 1) end || repeat('I', i.k)}})
    from best d join turns r on r.c = d.c and r.p = d.p
    join edit e on e.s = d.s and (e.initial is null or e.initial = r.initial) and (e.letter = 'D' or not r.must)
    join inserted i on i.s = e.t
    group by d.c, d.o, d.p, i.t)
select b.c, b.o, b.s, b.b.cost as cost, b.b.audit as audit from best b join ends n on n.c = b.c and n.p = b.p"""


class _Conversation:
    """What is known of a conversation after some of its turns."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        # by state: cost, parts of the audit, digest so far, whether a turn is in the digest
        self.states: dict[int, tuple[int, list[str], object, bool]] = {}

    def count(self, turn: int | None, role: str, text_blank: bool, again: bool, cut: bool, copies: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.initial = role[:1]
        self.blank += copies if text_blank else 0
        self.duplicate += 0 if text_blank else copies - (not again)
        self.truncated += cut

    def advance(self, found: dict[int, list[tuple[int, int, str]]], rows: list[tuple]) -> None:
        """``found``: by state before the segment, its (state after, cost, audit)."""
        before = self.states or {0: (0, [], hashlib.sha256(), False)}
        best: dict[int, tuple[int, str, int, str]] = {}
        whole = {o: "".join(parts) for o, (_, parts, _, _) in before.items()} if len(before) > 1 else {o: "" for o in before}
        for o, ways in found.items():
            for s, cost, audit in ways if o in before else ():
                way = (before[o][0] + cost, whole[o] + audit, o, audit)
                if s not in best or way[:2] < best[s][:2]:
                    best[s] = way
        self.states = {}
        for s, (cost, _, o, audit) in best.items():
            digest, any_yet = self._repaired(before[o][2].copy(), before[o][3], o, audit, rows)
            self.states[s] = (cost, [*before[o][1], audit], digest, any_yet)

    @staticmethod
    def _repaired(digest, any_yet: bool, state: int, audit: str, rows: list[tuple]):
        """The digest after the segment's turns as the audit keeps, changes and adds them."""
        copies = [row for row in rows for _ in range(row[2])]
        k = 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else copies[k][:2]
            k += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            digest.update((("\n" if any_yet else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            any_yet = True
        return digest, any_yet

    def row(self) -> dict:
        ways = [(cost, "".join(parts), digest) for s, (cost, parts, digest, _) in self.states.items() if s in (0, 3)]
        cost, audit, digest = min(ways, key=lambda w: w[:2]) if ways else (0, "", hashlib.sha256())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv_id": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(),
        }


def _segments(rows: dict[str, list], size: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of one conversation, of at most ``size`` rows."""
    conv, first = rows["conv"], 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or conv[k] != conv[first] or k - first == size:
            yield first, k
            first = k


def _repair(segment: int, batch: int):
    schema = pa.schema([pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in RESULT.split(", "))])

    def solved(con: duckdb.DuckDBPyConnection, rows: dict[str, list], parts: list[tuple[int, int]], fresh: list[bool]) -> dict[int, dict[int, list]]:
        """Per segment and state before it, the least (state after, cost, audit)."""
        c, p, ends = [], [], []
        for n, (first, end) in enumerate(parts):
            at = [k for k in range(first, end) if rows["copies"][k]]
            c += [n] * len(at)
            p += range(len(at))
            ends.append(len(at))
        at = [k for k, copies in enumerate(rows["copies"]) if copies]
        turns = pa.table({
            "c": pa.array(c, pa.int64()), "p": pa.array(p, pa.int64()), "initial": pa.array([rows["role"][k][:1] for k in at], pa.string()),
            "must": pa.array([rows["blank"][k] or rows["again"][k] for k in at], pa.bool_()), "truncated": pa.array([int(rows["cut"][k]) for k in at], pa.int64()),
            "copies": pa.array([rows["copies"][k] for k in at], pa.int64()),
        })
        first_ways = [(0, 0, 0, ""), (0, 2, INSERT, "I"), (0, 3, 2 * INSERT, "II")]
        ways = [(n, *w) for n, new in enumerate(fresh) for w in (first_ways if new else [(o, o, 0, "") for o in range(4)])]
        starts = pa.table([pa.array(list(x), t) for x, t in zip(zip(*ways), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["c", "o", "s", "cost", "audit"])
        for name, table in (("turns", turns), ("starts", starts), ("ends", pa.table({"c": pa.array(range(len(ends)), pa.int64()), "p": pa.array(ends, pa.int64())}))):
            con.register(name, table)
        found: dict[int, dict[int, list]] = {}
        for n, o, s, cost, audit in con.execute(_REPAIR).fetchall():
            found.setdefault(n, {}).setdefault(o, []).append((s, cost, audit))
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        con.execute("set temp_directory = ''")
        now: _Conversation | None = None
        for b in batches:
            for k in range(0, len(b), batch):
                rows, done = b.slice(k, batch).to_pydict(), []
                parts = list(_segments(rows, segment))
                fresh = [n == 0 and (now is None or not now.states or now.conv != rows["conv"][first]) or n > 0 and rows["conv"][first] != rows["conv"][first - 1] for n, (first, _) in enumerate(parts)]
                found = solved(con, rows, parts, fresh)
                for n, (first, end) in enumerate(parts):
                    if now is None or now.conv != rows["conv"][first]:
                        if now is not None:
                            done.append(now.row())
                        now = _Conversation(rows["conv"][first])
                    at = [i for i in range(first, end) if rows["copies"][i]]
                    for i in at:
                        now.count(*(rows[x][i] for x in ("turn", "role", "blank", "again", "cut", "copies")))
                    now.advance(found[n], [(rows["role"][i], rows["text"][i], rows["copies"][i]) for i in at])
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return scan


def damaged(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after the damage that crc32 of ``conv:turn`` deals; a dropped row stays as its conversation's mark of no copies."""
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    body = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), body.alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return rows.select(
        "conv",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one with the sum of their copies."""
    for b in batches:
        if len(b):
            t = pa.Table.from_batches([b]).group_by(["conv", "turn", "role", "text"]).aggregate([("copies", "sum")]).combine_chunks()
            yield from t.rename_columns(["conv", "turn", "role", "text", "copies"]).to_batches()


def repair(rows: DataFrame, *, segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies): its faults, the cheapest edits and the digest of the repaired text."""
    counted = rows.mapInArrow(_counted, "conv long, turn long, role string, text string, copies long")
    seen = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first(), F.col("copies").desc())
    white = F.lit(WHITE)
    blank = F.btrim("text", white) == ""
    last = F.right(F.rtrim("text", white), F.lit(1))
    marked = counted.withColumn("again", F.row_number().over(seen) > 1).withColumn("blank", blank)
    marked = marked.withColumn("cut", ~F.col("blank") & ~F.col("again") & ~last.isin(".", "!", "?"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "again"]
    dealt = marked.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions(*order)
    return dealt.select("conv", "turn", "role", "text", "copies", "again", "blank", "cut").mapInArrow(_repair(segment, batch), RESULT)


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair(damaged(turns))
