"""Operator 12 against a uniform-cost search over edit scripts."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from korpisto.llm import op12_conversations as op12
from korpisto.llm import queries
from korpisto.session import ship

LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """(conv, turn, role, text) after damage; conversations without rows stay as keys."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        got = out.setdefault(conv, [])
        if kind:
            role, text = ("user" if kind == 4 else role), {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            got += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain(conv, rows):
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if k == len(rows) and state in (0, 3):
            break
        if (k, state) in done:
            continue
        done.add((k, state))
        speak = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", k, speak))
        if k < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state))
            if faults[k] not in ("b", "d"):
                more = 3 * (faults[k] == "t")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, speak))
                if (state, rows[k][1][:1]) in LEGAL:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, LEGAL[state, rows[k][1][:1]]))
    lines, k, state = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[k][1:]
        k += letter != "I"
        if letter == "D":
            continue
        role = role if letter == "K" else "assistant" if state == 2 else "user"
        state = LEGAL[state, role[:1]]
        lines.append(f"{role}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "ä?", "Same. ", "long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, 0]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho")]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"turn {k % 37}" + "."[: k % 3]) for k in range(700)]  # one long conversation
    rows += [(1001, 5, "user", "again and again.")] * 300
    rows.append((3, 4, "user", "dropped alone?"))
    return rows


@pytest.mark.parametrize("segment,batch", [(256, 8192), (3, 16), (1, 1)])
def test_repair_matches_a_search(spark, segment, batch):
    ship(spark)
    rows = made(segment)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, copies string, conv long").repartition(5)
    got = op12.repair(op12.damaged(df), segment=segment, batch=batch).collect()
    assert {r.conv_id: tuple(r) for r in got} == {c: plain(c, r) for c, r in damage(rows).items()} and len(got) == 63


def test_ties_take_the_least_audit_and_empty_tables_give_no_rows(spark):
    schema = "conv long, turn long, role string, text string, copies long"
    rows = [(1, 1, "assistant", "Yes.", 1), (2, 1, "user", "Yes.", 3), (3, 1, "system", "Yes.", 0)]
    got = {r.conv_id: (r.cost, r.audit, r.duplicate) for r in op12.repair(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (3, "IK", 0), 2: (11, "KDDI", 2), 3: (0, "", 0)}
    assert op12.repair(spark.createDataFrame([], schema)).collect() == []


def test_sql_counts_the_same(spark, tmp_path):
    import duckdb

    rows = made(9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), zip(*[r for r in rows if r[0] != 1000]), (pa.int64(), pa.int64(), pa.string(), pa.string()))}))
    want = {r[0]: r for r in con.execute("select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from (" + queries.ORACLES["op12_conversation_repair"] + ")").fetchall()}
    got = {r.conv_id: tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect() if r.conv_id != 1000}
    assert got == want
