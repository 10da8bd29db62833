"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pytest

from korpisto.llm import common
from korpisto.llm import op01_packing as op1
from korpisto.llm import op02_sentencepiece as op2
from korpisto.llm import op03_fingerprints as op3
from korpisto.llm import op04_suffix_dedup as op4
from korpisto.llm import op05_lm_scoring as op5
from korpisto.llm import op06_near_dedup as op6
from korpisto.llm import op07_substring_dedup as op7
from korpisto.llm import op08_pii as op8
from korpisto.llm import op09_token_counts as op9
from korpisto.llm import op10_quality as op10
from korpisto.session import ship

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefgéñ"), RNG.integers(1, 7))) for _ in range(400)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(VOCABULARY, n))


def texts():
    base = prose(300, 1)
    near = base.split()
    near[100] = "changed"
    passage = prose(80, 2)
    return [
        base, base, " ".join(near), None, "", "   \n ", "one two", "One TWO", prose(40, 3) + "\n" + passage + "\n" + prose(40, 4), passage + " tail " + prose(9, 6),
        "ab" * 500, "line here\nline here\n" * 20, prose(6000, 7), "Mail me.you+x@ex-a.co.uk or +1 (988) 555-2485, 4041 8949 7460 8795 at 192.168.1.254 password=hunter22 http://a.b/c?d, ö@ä",
        "x <|endoftext|> y <s> ▁ ź Σ İ", "a" * 199, "b" * 200 + "c" + "b" * 200, "### $$$ %%% &&& *** ### $$$ %%% " * 30,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i * 3, t, "clash", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, key long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_tokens string, key long")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    t = prose(120, 11)
    return spark.createDataFrame([(None, t), (1, t), (1, t), (2, prose(30, 12)), (None, None)], "doc_id long, text string")


def plain():
    return {i * 3: t or "" for i, t in enumerate(texts())}


# ------------------------------------------------------------------ plain versions
def plain_windows(rows, size, first_stays):
    """Which symbols go. rows: list of (order, sequence)."""
    seen = collections.defaultdict(list)
    for k, (order, s) in enumerate(rows):
        for p in range(len(s) - size + 1):
            seen[tuple(s[p : p + size])].append(order)
    out = []
    for order, s in rows:
        gone = [False] * len(s)
        for p in range(len(s) - size + 1):
            here = seen[tuple(s[p : p + size])]
            if min(here) < order if first_stays else len(here) > 1:
                gone[p : p + size] = [True] * size
        out.append(gone)
    return out


def plain_components(rows):
    """id -> (set size, lowest id)."""
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows.items():
        w = WORD.findall(t.translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in rows}
    ids = list(rows)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


# -------------------------------------------------------------------------- tests
def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = op1.pack(docs, path, size=512).collect()
    by_doc, by_pack = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_pack[r.sequence_id].append(r)
    for i, t in plain().items():
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pack in by_pack.values():
        at = 0
        for r in sorted(pack, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert op1.pack(empty, path).count() == 0


def test_packing_of_repeated_ids(spark, odd):
    """Null and repeated ids: every row is packed whole, no two pieces overlap."""
    ship(spark)
    rows = op1.pack(odd, P.path("word_bpe_49k.json"), size=64).collect()
    assert sum(r.start == 0 for r in rows) == 5 and sum(r.length for r in rows if r.doc_id == 1) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 1)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(a[0] != b[0] and b[1] == 0 or a[0] == b[0] and a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_words_are_parted_by_the_vocabulary_itself():
    import json

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, fast = Tokenizer.from_file(path), op1.WordEncoder(path)
    assert fast.by_word
    rng, parts = np.random.default_rng(3), [*"aB  .,'\n\té中1-", "'s", "\u3000", "\u0301", "Σ", "İ", "ß", "<|endoftext|>", "\xa0", "don't"]
    every = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in fast(every)] == [whole.encode(t, add_special_tokens=False).ids for t in every]
    other = json.loads(whole.to_str())
    other["pre_tokenizer"] = {"type": "Whitespace"}
    assert not op1._splits(other)


@pytest.mark.parametrize("run", [
    lambda f: op2.encode_decode(f, P.path("piece_bpe_32k.model")), lambda f: op5.cross_entropy_difference(f, f.where("doc_id = 1").select("doc_id")),
    lambda f: op8.detect(f), lambda f: op9.token_counts(f, P.path("piece_bpe_32k.model")), lambda f: op10.judge(f, f.selectExpr("doc_id", "1 as quality")),
], ids=["op2", "op5", "op8", "op9", "op10"])
def test_repeated_and_null_ids(spark, odd, run):
    """A row a row, equal rows alike."""
    ship(spark)
    rows = run(odd).collect()
    ids = collections.Counter(r.doc_id for r in rows)
    assert ids == {None: 2, 1: 2, 2: 1}
    one, two = (tuple(r) for r in rows if r.doc_id == 1)
    assert one == two


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(0)
    histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40))}
    packs = op1.patterns(histogram, 100)
    held = collections.Counter()
    for pattern, count in packs:
        assert sum(pattern) <= 100
        for length in pattern:
            held[length] += count
    assert held == histogram
    ends = collections.defaultdict(int)
    for length, first, last, *_ in op1.slots(packs):
        assert first == ends[length]
        ends[length] = last
    assert ends == histogram


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in op2.encode_decode(docs, path, with_ids=True).collect():
        want = sp.encode(plain()[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert op2.encode_decode(empty, path).count() == 0


def plain_hashes(text, band):
    """The fingerprint's hashes of a text, by the plain algorithm."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text.lower())}
    fold = lambda values, h=42: functools.reduce(lambda h, t: xxhash.xxh64_intdigest(struct.pack("<q", t), h), values, h)
    limit, held, out = 1 << 4 * op3.DIGITS, sorted(w % (1 << 32) - (1 << 31) for w in words & band), []
    short = lambda values: functools.reduce(lambda h, t: xxhash.xxh64_intdigest(struct.pack("<i", t), h), values, 42)
    if not held:
        whole = signed(fold(sorted(words)))
        of = lambda k: xxhash.xxh64_intdigest(struct.pack("<i", k), fold([whole]))
        return [of(k) % limit if words else None for k in range(1, op3.SEEDS * op3.LEVELS + 1)]
    for level in range(1, op3.LEVELS + 1):
        for k in range(op3.SEEDS):
            kept = held
            for step in range(level):
                shift = 2 * (step * (op3.SEEDS // 4) + k // 4)
                kept = [t for t in kept if t >> shift & 3 == k % 4]
            out.append(short(kept) % limit if kept else None)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    for level in reversed(range(op3.LEVELS)):
        pairs = list(zip(a, b))[level * op3.SEEDS : (level + 1) * op3.SEEDS]
        used = sum(x is not None or y is not None for x, y in pairs)
        if used * 3 >= op3.SEEDS:
            return sum(x == y is not None for x, y in pairs) / used
    return 0.0


def plain_band(every, rarest=0.0005, commonest=0.05):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = collections.Counter(w for t in every for w in set(WORD.findall(t.lower())))
    low, high = max(2, rarest * len(every)), max(2, commonest * len(every))
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w, n in df.items() if low <= n <= high}


def plain_written(h):
    return "".join("." * op3.DIGITS if x is None else f"{x:0{op3.DIGITS}x}" for x in h)


def test_fingerprints(spark, docs, empty, odd):
    rows = {r.doc_id: r for r in op3.edited_neighbours(docs).collect()}
    ids, band = sorted(rows, reverse=True), plain_band([t or "" for t in texts()])
    assert band
    for k, i in enumerate(ids):
        t, after = plain()[i], plain()[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        own, changed, other = (plain_hashes(x, band) for x in (t, edited, after))
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (plain_written(own), plain_written(changed))
        assert (rows[i].near_edited, rows[i].near_next) == (pytest.approx(plain_likeness(own, changed)), pytest.approx(plain_likeness(own, other)))
    assert {r.doc_id: r.fingerprint for r in op3.fingerprints(docs).collect()} == {i: rows[i].fingerprint for i in rows}
    assert rows[0].fingerprint == rows[3].fingerprint != rows[36].fingerprint
    assert op3.edited_neighbours(empty).count() == 0 == op3.fingerprints(empty).count()
    assert op3.edited_neighbours(odd).count() == 5 == op3.fingerprints(odd).count()


def test_fingerprints_use_the_whole_band(spark):
    """More terms in the band than the 65,536 that once were kept: all of them are in the lexicon."""
    ship(spark)
    rows = [(i, " ".join(f"w{k}" for k in range((i // 2) * 1000, (i // 2) * 1000 + 1000))) for i in range(140)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert op3.lexicon(frame, "text", 0.0005, 0.05).count() == 70_000
    got = {r.doc_id: r.fingerprint for r in op3.fingerprints(frame).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, 140, 2)) and len(set(got.values())) == 70


def test_suffix_dedup(spark, docs, empty, odd):
    rows = [(i, t.encode()) for i, t in plain().items()]
    gone = plain_windows(rows, 200, False)
    got = {r.doc_id: r for r in op4.suffix_dedup(docs).collect()}
    for (i, t), g in zip(rows, gone):
        kept = bytes(c for c, x in zip(t, g) if not x)
        spans = sum(x and not y for x, y in zip(g, [False, *g]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(g), spans, hashlib.sha256(kept).hexdigest())
    assert op4.suffix_dedup(empty).count() == 0
    removed = sorted((r.n_bytes, r.n_removed) for r in op4.suffix_dedup(odd).collect())
    assert sum(b == r for b, r in removed if b) == 3


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_on_random_copies(spark, seed):
    rng = np.random.default_rng(seed)
    source = "".join(rng.choice(list("abc "), 4000))
    rows = []
    for i in range(40):
        a, n = rng.integers(0, 3000), rng.integers(1, 900)
        rows.append((i, "".join(rng.choice(list("xyz"), rng.integers(0, 60))) + source[a : a + n]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    data = [(i, t.encode()) for i, t in rows]
    want = {i: sum(g) for (i, _), g in zip(data, plain_windows(data, 200, False))}
    assert {r.doc_id: r.n_removed for r in op4.suffix_dedup(frame).collect()} == want
    words = [(i, list(t.encode().split())) for i, t in rows]
    want = {i: sum(g) for (i, _), g in zip(words, plain_windows(words, 50, True))}
    assert {r.doc_id: r.n_removed for r in op7.substring_dedup(frame).collect()} == want


def test_lm_scoring(spark, docs, empty):
    good = spark.createDataFrame([(0,), (3,), (36,), (None,)], "doc_id long")
    rows = {r.doc_id: r for r in op5.cross_entropy_difference(docs, good).collect()}
    assert len(rows) == len(texts()) and rows[9].n_words == 0 and rows[9].score == 0
    assert rows[0].score == rows[3].score  # equal texts, each scored by the other
    assert op5.cross_entropy_difference(empty, good).count() == 0
    assert all(r.score == 0 for r in op5.cross_entropy_difference(docs, good.where("false")).collect())


def test_lm_scoring_counts_every_target(spark):
    """More targets than the 65,536 that once were counted: nothing is left for the background, which is the target's model then."""
    ship(spark)
    frame = spark.range(70_000).selectExpr("id as doc_id", "concat('a b w', id % 7) as text")
    assert {r.score for r in op5.cross_entropy_difference(frame, frame.select("doc_id")).collect()} == {0.0}


def test_lm_scoring_leaves_held_out_texts_out(spark):
    """A held-out text changes no other text's score."""
    ship(spark)
    rows = [(i, prose(40, i)) for i in range(20)]
    good, held = (spark.createDataFrame([(i,) for i in ids], "doc_id long") for ids in (range(5), [20]))
    without = op5.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), good)
    held_out = op5.cross_entropy_difference(spark.createDataFrame([*rows, (20, rows[3][1] + " " + rows[12][1]), (None, "")], "doc_id long, text string"), good, held)
    got = {r.doc_id: r.score for r in held_out.collect()}
    assert len(got) == 22
    for r in without.collect():
        assert got[r.doc_id] == pytest.approx(r.score, abs=1e-9)


def plain_losses(rows, ids, others):
    """Mean losses by a model of the texts ``ids``, without a text's own counts, matched with one of ``others``."""
    pairs = lambda t: list(zip(["", *t.split()], t.split()))
    tokens = lambda t: [*t.split(), *[""] * bool(t.split())]
    every = collections.Counter(w for i in [*ids, *others] for w in rows[i].split())
    every_pair = collections.Counter(p for i in [*ids, *others] for p in pairs(rows[i]))
    known = {w for w in every if every[w] > 1}
    n, pair = (collections.Counter(x for i in ids for x in f(rows[i])) for f in (tokens, pairs))
    size, other = (sum(len(rows[i].split()) for i in x) for x in (ids, others))
    weight = min(size, other) / size
    unknown = sum(n[w] for w in every if w not in known)
    out = {}
    for i, t in rows.items():
        own, own_pair = (collections.Counter(f(t) if i in ids else []) for f in (tokens, pairs))
        total = size - (len(t.split()) if i in ids else 0)

        def loss(a, w):
            unigram = (((n[w] - own[w]) if w in known else unknown) * weight + 0.5) / (total * weight + 0.5 * (len(known) + 1))
            seen = (n[a] - own[a]) * weight if a in known or a == "" else 0
            both = (pair[a, w] - own_pair[a, w]) * weight if every_pair[a, w] > 1 else 0
            return -np.log((both + 32 * unigram) / (seen + 32))

        out[i] = np.mean([loss(*p) for p in pairs(t)] or [0.0])
    return out


def test_lm_scoring_keeps_all_words_and_bigrams(spark):
    """More words than the 32,768 that once were kept, in chunks that share them: all scores are the plain models'."""
    ship(spark)
    rng = np.random.default_rng(9)
    rows = {i: " ".join(f"w{k}" for k in rng.permutation(np.r_[i * 900 : i * 900 + 1800, :20])) for i in range(40)}
    rows |= {i + 40: rows[i] + f" only{i}" for i in range(0, 40, 3)} | {99: " "}
    assert len({w for t in rows.values() for w in t.split()}) > 32_768
    good = spark.createDataFrame([(i,) for i in range(0, 10)], "doc_id long")
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    rest = [i for i in rows if i >= 10 and i != 39]
    held_out = spark.createDataFrame([(39,)], "doc_id long")
    target, background = plain_losses(rows, range(10), rest), plain_losses(rows, rest, range(10))
    got = op5.cross_entropy_difference(frame, good, held_out, chunk=50_000).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert (r.n_words, r.target_loss, r.background_loss) == (len(rows[r.doc_id].split()), pytest.approx(target[r.doc_id]), pytest.approx(background[r.doc_id]))


def test_lm_scoring_where_every_count_is_high(spark):
    """All words and bigrams above 65,536, where counts were once clamped into one step that was kept or dropped whole."""
    ship(spark)
    texts = ["a b " * 70_000, "c d " * 70_000, "a b a b", "c d c d", "a d", "a b " * 70_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in op5.cross_entropy_difference(frame, spark.createDataFrame([(0,), (5,)], "doc_id long")).collect()}
    assert got[0] > 1 and got[2] > 1 and got[3] < -1 and got[3] < got[4] < got[2]
    assert got[1] < 0  # without its own counts little of the background is left


def test_lm_scoring_parts_good_from_bad(spark):
    """Held-out accuracy: no text's own counts are in the models, so labelled rows measure it."""
    ship(spark)
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op5.cross_entropy_difference(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), marks.where("quality = 1")).where("n_words >= 20")
    rows = got.join(marks, "doc_id").toPandas()
    good, bad = (rows[rows.quality == q].score.to_numpy() for q in (1, 0))
    area = np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2
    print("area under the curve", area)
    assert area > 0.8


def test_near_dedup(spark, docs, empty, odd):
    want = plain_components(plain())
    for r in op6.near_dedup(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert op6.near_dedup(empty).count() == 0
    assert sorted((r.doc_id, r.component_id) for r in op6.near_dedup(odd).collect() if r.doc_id) == [(1, 1), (1, 1), (2, 2)]
    assert op6.one_of_each(odd).count() == 3
    assert op6.one_of_each(docs).columns == docs.columns


def test_near_dedup_of_edited_copies(spark):
    rng = np.random.default_rng(3)
    base = prose(150, 20).split()
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 14), replace=False):
            w[p] = str(rng.choice(VOCABULARY[:20]))
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_components(dict(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op6.near_dedup(frame).collect()} == want


def test_substring_dedup(spark, docs, empty, odd):
    rows = [(i, t.encode().split()) for i, t in plain().items()]
    got = {r.doc_id: r for r in op7.substring_dedup(docs).collect()}
    for (i, w), g in zip(rows, plain_windows(rows, 50, True)):
        kept = b" ".join(x for x, y in zip(w, g) if not y)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(g), hashlib.sha256(kept).hexdigest())
    assert op7.substring_dedup(empty).count() == 0
    assert sorted(r.n_removed for r in op7.substring_dedup(odd).collect()) == [0, 0, 0, 0, 120]
    cut = {r.doc_id: r for r in op7.without_repeats(docs).collect()}
    assert op7.without_repeats(docs).columns == docs.columns and cut[9].text is None and cut[0].text == plain()[0] and cut[3].text == ""


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            d = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and op8.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_pii(spark, docs, empty):
    for r in op8.detect(docs).collect():
        want = plain_pii(plain()[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
    assert op8.detect(empty).count() == 0
    masked = {r.doc_id: r.text for r in op8.masked(docs).collect()}
    assert masked[9] is None and "[EMAIL]" in masked[39] and "[SECRET]" in masked[39] and "hunter22" not in masked[39]


def test_pii_on_random_strings():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        t = "".join(rng.choice(list("a.@-+_ 0123456789()é"), rng.integers(0, 40)))
        got = [f"{kind}:{a}:{b}" for a, k, kind, b in op8.find(t) if k < 4]
        assert got == [x[2] for x in plain_pii(t)], t


@pytest.mark.parametrize("n", [6, 200, 201, 5000])
@pytest.mark.parametrize("quote", ["", '"', "'"])
def test_pii_secrets_of_any_length(n, quote):
    value = quote + "aZ3._-" * (n // 6) + "x" * (n % 6) + quote
    text = f"token={value} then more"
    assert op8.find(text) == [(6, 6, "secret", 6 + len(value))]
    assert op8.mask(text, op8.find(text)) == "token=[SECRET] then more"


IBANS = ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FI21 1234 5600 0007 85", "CH93 0076 2011 6238 5295 7", "fr14 2004 1010 0505 0001 3m02 606")


@pytest.mark.parametrize("value", IBANS)
@pytest.mark.parametrize("behind", ["", ".", "\n", " is the account", " and pay 20 EUR to me", " a", " ok?"])
def test_pii_ibans_in_running_prose(value, behind):
    text = f"Our IBAN: {value}{behind}"
    assert [s for s in op8.find(text) if s[2] == "account"] == [(10, 5, "account", 10 + len(value))]
    wrong = value[:-1] + str((int(value[-1]) + 1) % 10)
    assert not [s for s in op8.find(f"Our IBAN: {wrong}.") if s[2] == "account"]


def test_pii_ibans_of_other_countries():
    body = "0001 0002 0003 0004"
    check = next(n for n in range(2, 99) if op8.iban(f"ZZ{n:02d} {body}"))
    text = f"iban ZZ{check:02d} {body}, and so on"
    assert op8.find(text)[0] == (5, 5, "account", text.index(","))


@pytest.mark.parametrize("text", ["The secret: everything changes here.", "my account 2024 05 01 was", "account: 2024-05-01", "account 12 34 56 78 90", "passport 123", "ssn 000-12-3456", "Token: \"all the same\"", "Password: required", "token:\"all the same\"", "account 123456789.55", "my account 12345678x"])
def test_pii_leaves_prose_alone(text):
    assert not [s for s in op8.find(text) if s[1] > 3]


@pytest.mark.parametrize("cue, value", [("ssn ", "123-45-6789"), ("account no. ", "1234 5678 9012"), ("acct ", "0012345678"), ("passport: ", "C1234567"[1:]), ("password=", "hunter"), ("secret: ", "h4nter-two"), ("password:", "correcthorse"), ("api_key:", "'abcdefgh'"), ("token : ", '"a1b2c3d4"')])
def test_pii_added_kinds(cue, value):
    found = [s for s in op8.find(f"x {cue}{value} y") if s[1] > 3]
    assert [(s[0], s[3]) for s in found] == [(2 + len(cue), 2 + len(cue) + len(value))]


def test_pii_masks_from_offsets(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "to a@b.co, now", "c"), (2, "é" * 70_000 + " a@b.co", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.spans: r.text for r in op8.masked(frame).collect()}
    assert got == {"a": None, "b": "", "c": "to [EMAIL], now", "d": "é" * 70_000 + " [EMAIL]"}
    assert [r.spans for r in op8.detect(frame.where("doc_id = 2")).collect()] == ["email:70001:70007"]


def test_token_counts_at_every_cut():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng, parts = np.random.default_rng(4), [*"ab   .\n\t▁é中1<", "\u3000", "\u200b", "\u0301", "<s>", "\xa0"]
    every = ["".join(rng.choice(parts, rng.integers(0, 90))) for _ in range(10_000)]
    for split in (7, 16, 40):
        assert op9.lengths([t.encode() for t in every], path, 1 << 12, split) == [len(x) for x in sp.encode(every)]
    ends = ["w" * 2 + " " + "word " * 13107, "word " * 40_000, " " * 70_000, "é" * 70_000]
    assert op9.lengths([t.encode() for t in ends], path, 1 << 20, 1 << 16) == [len(x) for x in sp.encode(ends)]


def test_hashes_part_texts_that_agree_modulo_powers_of_two():
    """Thue-Morse words of 1,024 letters collide for every base where the modulus is 2**64."""
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    one, other = ("".join("ab"[x ^ k] for x in word) for k in (0, 1))
    data = np.frombuffer((one + other).encode(), np.uint8)
    at = np.array([0, 1024])
    hashes = common.spans(common.prefix(common.BYTE_CODE[data]), at, at + 1024)
    assert hashes[0] != hashes[1]
    text = f"{one}\n{other}\n".encode()
    assert op10.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[3][0] == 0


def test_hash_arithmetic():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, common.PRIME, 500, dtype=np.uint64) for _ in range(2))
    assert [int(a) * int(b) % common.PRIME for a, b in zip(x, y)] == common.product(x, y).tolist()
    codes = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    codes[30_000:30_300] = codes[7:307]
    p = common.prefix(codes)
    h = common.spans(p, np.array([7, 30_000, 8]), np.array([307, 30_300, 308]))
    assert h[0] == h[1] != h[2]


def test_token_counts(spark, docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in op9.token_counts(docs, path, split_bytes=64).collect():
        assert (r.n_bytes, r.n_tokens) == (len(plain()[r.doc_id].encode()), len(sp.encode(plain()[r.doc_id])))
    assert op9.token_counts(empty, path).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i * 3, 1) for i in range(13)], "doc_id long, quality int")
    for r in op10.judge(docs, labels).collect():
        t = plain()[r.doc_id]
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert op10.judge(empty, labels).count() == 0
    assert op10.judge(docs, labels.where("false")).where("kept = base_failed").count() == 0
    assert op10.keep(docs, labels).columns == docs.columns


def plain_path(forest, root, row):
    """Path length of a row by walking one tree."""
    node = root
    while forest["feature"][node] >= 0:
        node = forest["left"][node] + int(row[forest["feature"][node]] > forest["split"][node])
    return forest["path"][node]


def test_isolation_forest_paths():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(0, 1, (300, op10.FEATURES)), rng.normal(6, 1, (40, op10.FEATURES))
    both = np.concatenate([good, bad])
    forest = op10.grow(good, (both.min(0), both.max(0)), 40, 64, 3)
    norm = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    want = [2 ** (-np.mean([plain_path(forest, r, row) for r in forest["roots"]]) / norm) for row in both]
    got = op10.anomaly(forest, both)
    assert got == pytest.approx(want) and got.min() > 0 and got.max() <= 1
    for root in forest["roots"]:  # every split lies in its node's box, leaves hold what their depth says
        stack = [(root, 0, both.min(0), both.max(0))]
        while stack:
            node, depth, low, high = stack.pop()
            f, at = forest["feature"][node], forest["split"][node]
            if f < 0:
                assert forest["path"][node] >= depth
                continue
            assert low[f] <= at <= high[f]
            cut_high, cut_low = high.copy(), low.copy()
            cut_high[f] = cut_low[f] = at
            stack += [(forest["left"][node], depth + 1, low, cut_high), (forest["left"][node] + 1, depth + 1, cut_low, high)]
    limit = op10.threshold_of(got[:300], got[300:], 0.01)
    assert (got[:300] > limit).mean() <= 0.01 and (got[300:] > limit).mean() > 0.9


def test_quality_verdicts_come_from_the_forest(spark):
    """Bad rows that pass the base rules go, good ones stay, held-out ones too; kept is the forest's verdict."""
    ship(spark)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(w + ("###" if i % 10 == 0 else "") for w in rng.choice(VOCABULARY, rng.integers(40, 200)))) for i in range(1200)]
    rows += [(5000, None), (5001, ""), (None, rows[1][1]), (1, rows[1][1]), (7000, prose(60_000, 5))]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(800)], "doc_id long, quality int")
    got = op10.judge(frame, marks).collect()
    assert len(got) == len(rows)
    forest, limit = op10.fit(frame, marks, sample=8192, trees=128, points=256, spare=0.005, seed=7)
    for r in got:
        assert r.kept == (not r.base_failed and r.anomaly <= limit)
    held_out = [r for r in got if r.doc_id and 800 <= r.doc_id < 1200]
    assert all(r.kept != (r.doc_id % 10 == 0) for r in held_out if r.doc_id % 10 == 0)
    assert sum(r.kept for r in held_out if r.doc_id % 10) >= 0.97 * sum(r.doc_id % 10 > 0 for r in held_out)
    kept = op10.keep(frame, marks)
    assert kept.count() == sum(r.kept for r in got) and kept.columns == frame.columns
    assert [r.kept for r in got if r.doc_id in (5000, 5001)] == [False, False]


@pytest.fixture(scope="module")
def stage_rows():
    t = prose(120, 11)
    near = t.split()
    near[5] = "changed"
    shared = prose(70, 30)
    return [
        (0, t, "a", "s", 9), (1, " ".join(near), "a", "s", 9), (2, t, None, "s", None), (3, None, "a", None, 0), (4, "", "a", "s", 0), (5, "few words", "a", "s", 9),
        (6, prose(90, 31) + "\n" + shared + "\n" + prose(60, 32), "a", "s", 9), (7, shared + "\n" + prose(90, 33) + " mail a.b@c.org", "a", "s", 9), (8, prose(30_000, 34), "a", "s", 9),
        (None, prose(50, 35), "a", "s", 9), (9, prose(60, 36), "a", "s", 9), (9, prose(60, 37), "a", "s", 9), (10, "### *** %%% " * 40, "a", "s", 9),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, stage_rows, tmp_path):
    """Every stage against the plain version of its operator, on nulls, empty, long and repeated rows, with columns that clash."""
    import corpus_pipeline

    schema = SCHEMA + ", kept boolean, key long, n_tokens string"
    rows = [(*r, True, 7, "x") for r in stage_rows]
    spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, frame: op1.materialise(stages[name](spark, frame, str(tmp_path)))

    kept = run("quality rules", docs)
    verdicts = {(r.doc_id, r.n_words): r.kept for r in op10.judge(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    want = [r for r in rows if verdicts[r[0], len(WORD.findall(r[1] or ""))]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in kept.collect()) and kept.columns == docs.columns
    assert not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()} and {6, 7, 8} <= {r.doc_id for r in kept.collect()}

    single = run("near duplicates", docs)
    got = collections.Counter(r.doc_id for r in single.collect())
    assert single.columns == docs.columns and got == {0: 1, **{i: 1 for i in range(3, 9)}, None: 1, 9: 2, 10: 1}

    cut = {(r.doc_id, r.n_chars): r for r in run("repeated passages", docs).collect()}
    words = [(r[0] if r[0] is not None else 1 << 62, (r[1] or "").split()) for r in rows]
    gone = {(order, len(w), k): sum(g) for k, ((order, w), g) in enumerate(zip(words, plain_windows(words, 50, True)))}
    assert len(cut) == len({(r.doc_id, r.n_chars) for r in cut.values()}) and all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in cut.values())
    left = collections.Counter((r.doc_id, len((r.text or "").split())) for r in run("repeated passages", docs).collect())
    assert left == collections.Counter((rows[k][0], n - g) for (_, n, k), g in gone.items())

    masked = {r.doc_id: r for r in run("personal data", docs).collect() if r.doc_id in (3, 4, 7)}
    assert masked[3].text is None and masked[4].text == "" and masked[7].text.endswith("mail [EMAIL]") and masked[7].n_chars == len(masked[7].text)

    packed = run("packing", docs).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(r[0] for r in rows)

    nothing = spark.createDataFrame([], schema)
    for name in stages:
        out = run(name, nothing)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = op1.materialise(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before
