"""Tokens, grammar, dictionaries, disambiguation, spelling and evaluation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpisto.api import Engine
from korpisto.operators import compounds, corpus, disambiguation, evaluation, grammar, readings, spelling, tagger, tokens
from korpisto.sources import codecs, text_assets
from korpisto.sources.vfst import Dictionary, VfstError, build

CASES = {
    "1.2.3 abc.1 -foo ...": ["1.2.3", " ", "abc", ".", "1", " ", "-foo", " ", "..."],
    "http://a.fi/x?y=1. me.you@ex.fi, koira-": ["http://a.fi/x?y=1", ".", " ", "me.you@ex.fi", ",", " ", "koira-"],
    "it's 3,5 a,b": ["it's", " ", "3,5", " ", "a", ",", "b"], "- –": ["-", " ", "–"], "": [],
}


def test_tokens(spark):
    rows = spark.createDataFrame(list(CASES.items()), "text string, want array<string>")
    for r in rows.withColumn("got", tokens.token_texts(F.col("text"))).collect():
        assert r.got == r.want
    typed = tokens.tokenize(rows.limit(1), whitespace=True).first().tokens
    assert [(t["type"], t["pos"], t["byte_start"]) for t in typed][:3] == [("WORD", 0, 0), ("WHITESPACE", 5, 5), ("WORD", 6, 6)]


def test_sentences(spark):
    text = "Hei! K. Virtanen tuli 24. päivä. \"Niin.\" Ja."
    r = spark.createDataFrame([(text,)], "text string").select(tokens.sentences(F.col("text")).alias("s")).first()
    assert [(s["type"], s["len"]) for s in r.s] == [("PROBABLE", 5), ("POSSIBLE", 3), ("POSSIBLE", 18), ("PROBABLE", 7), ("PROBABLE", 8), ("NONE", 3)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÄ1 .,:-!?\"'»@\n­", max_size=30), min_size=20, max_size=20))
def test_tokens_and_sentences_cover_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    total = F.aggregate(tokens.sentences(F.col("text")), F.lit(0), lambda a, s: a + s.len)
    for r in rows.select("text", F.array_join(tokens.token_texts(F.col("text")), "").alias("joined"), total.alias("n")).collect():
        assert r.joined == r.text and r.n == len(r.text)


def findings(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [[(f.start, f.end, f.code) for f in r.findings] for r in grammar.grammar_check(rows, **options).orderBy("i").collect()]


def test_grammar(spark):
    got = findings(spark, "Koira koira juoksee pihalla.", "koira  juoksee .Kissa tuli kun satoi.", "Minä ei tule. En tule ei ikinä. Tieto kone on \"hyvä", "Hän sanoi: tule joka.")
    assert got == [
        [(6, 11, "REPEATED_WORD")],
        [(0, 5, "CAPITALIZATION_ERROR"), (5, 7, "DOUBLE_SPACE"), (14, 16, "EXTRA_SPACE_BEFORE_PUNCT"), (15, 21, "MISSING_SPACE_AFTER_PUNCT"), (26, 27, "COMMA_BEFORE_CONJUNCTION")],
        [(0, 8, "NEGATION_AGREEMENT"), (15, 25, "DOUBLE_NEGATION"), (34, 44, "COMPOUND_SPACING"), (48, 49, "QUOTATION_MARK_ERROR")],
        [(12, 16, "SENTENCE_INITIAL_LOWERCASE"), (16, 17, "COMMA_BEFORE_RELATIVE")],
    ]


def toy(weighted=False):
    return build(["@P.X.a@", "@R.X.a@", "k", "i", "s", "a", "n", "[Ln]", "[Sg]"], [
        [("@P.X.a@", "", 1, 1)], [("k", "[Ln]", 2, 1)], [("i", "", 3, 0)], [("s", "", 4, 0)], [("s", "", 5, 0)], [("a", "", 6, 0)],
        [(None, "", 0, 2), ("n", "[Sg]", 7, 0)], [("@R.X.a@", "", 8, 0)], [(None, "", 0, 3)],
    ], weighted)


def test_dictionary():
    d = Dictionary(toy())
    assert [o[0] for o in d.outputs("kissa")] == ["[Ln]"] and [o[0] for o in d.outputs("kissan")] == ["[Ln][Sg]"] and not list(d.outputs("kisxa"))
    assert [(o, n) for o, _, n in d.outputs("kissan", prefixes=True)] == [("[Ln]", 5), ("[Ln][Sg]", 6)]
    assert [(o, w) for o, w, _ in Dictionary(toy(True)).outputs("kissan")] == [("[Ln][Sg]", 5)]
    for bad in (b"", toy()[:12], b"x" * 40, toy()[:40]):
        with pytest.raises(VfstError):
            Dictionary(bad)
    wide = build(list("abc"), [[("a", "b", 1, 0)] * 300 + [("c", "a", 1, 0)], [(None, "", 0, 0)]])
    assert [o[0] for o in Dictionary(wide).outputs("c")] == ["a"]


def test_readings():
    out = "[Ln][Xp]koira[X]koira[Bh][Bc][Ln][Xp]talo[X]talo[Sg][Ny]"
    parts = readings.items(out)
    assert readings.valid(parts)
    assert readings.attributes(parts, out) == {"NUMBER": "singular", "SIJAMUOTO": "omanto", "CLASS": "nimisana"}
    shape = readings.structure(parts, 9, len(out))
    assert shape == "=ppppp=pppp" and readings.base_form(parts, shape) == "koiratalo"
    assert readings.word_bases(parts)[0] == "+koira(koira)+talo(talo)"
    assert readings.settle({"CLASS": "laatusana"})["COMPARISON"] == "positive"
    assert readings.items("[Ln") is None


@pytest.mark.parametrize("output, sound", [
    ("[Ln]koira[Bh][Ln]talo", True), ("[Ln]koira[Bh][Ln]auto", False), ("[Ln]koira-[Bh][Ln]auto", True), ("[Ln]koira-[Bh][Ln]talo", False),  # equal vowels need a hyphen, others refuse it
    ("[Lu]5[Bh][Ln]vuotias", False), ("[Lu]5-[Bh][Ln]vuotias", True), ("[Ln]kis[Bh][Ln]talo", True), ("[Ln]kis-[Bh][Ln]talo", True), ("[Isf][Ln]koe-[Bh][Ln]talo", True),
    ("[Ln]a[Icu]b[Bh][Ln]talo", False), ("[Ln]a[Icu]b[Bh][Ln]talo[Ica]", True), ("[Ln]a[Icu]b-[Bh][Ln]talo", True), ("[Ln]a[Icu]b[Bh][Ln]o[Bh][Ica][Ln]t", False),
    ("[Lep]turku[Bh][Ln]talo", False), ("[Lep]turku-[Bh][Ln]talo", False), ("[Lep]turku[Dg]lainen", True), ("[Lep]turku[Bh][Ln]talo[Ica]", True), ("[Lep]turku[Bh][Dg][Ln]talo", True),
])
def test_hyphens_of_compounds(output, sound):
    assert readings.valid(readings.items(output)) is sound


@pytest.mark.parametrize("output, size, shape, base, bases", [
    ("[Lep][Xp]Turku[X]turu[Sn][Ny]", 4, "=ippp", "Turku", "+Turku(Turku)"),
    ("[La]eu[Bc]:n", 4, "=qq=:p", "eu:n", "+eu:n"),
    ("[Ln][Xp]tie[X]tie[Bh][Ln][Xp]talo[X]talo", 7, "=ppppppp", "tietalo", "+tie(tie)+talo(talo)"),
    ("[Ln]koira[Bc][Ln][Xp]talo[X]talo", 9, "=ppppp=pppp", "koiratalo", "+koira+talo(talo)"),
    ("[Xr]=ipp-pp[X][Ln]ab-cd", 5, "==ipp-pp", "Ab-cd", "+ab-cd"),
    ("[Lu][Xp]kaksi[X]kahde[Bc][Xp]sata[X]sada", 9, "=ppppp=pppp", "kaksisata", "+sata(sata)"),
    ("", 0, "=", None, ""),
])
def test_structures_and_bases(output, size, shape, base, bases):
    parts = readings.items(output)
    assert readings.structure(parts, size, len(output)) == shape
    assert readings.base_form(parts, shape) == base
    assert readings.word_bases(parts)[0] == bases


def test_context_rules_and_viterbi():
    noun, verb = {"CLASS": "nimisana"}, {"CLASS": "teonsana"}
    assert disambiguation.prune([[{"CLASS": "kieltosana", "BASEFORM": "ei"}], [noun, verb]])[1] == [verb]
    assert disambiguation.prune([[noun, {**noun, "BASEFORM": "x"}]], (("remove_first", "nimisana"),)) == [[noun, {**noun, "BASEFORM": "x"}]]
    assert len(disambiguation.RULES) == 62 and len(disambiguation.BIGRAMS) == 58
    assert disambiguation.viterbi([[0.0, 0.0], [0.0, 1.0]], lambda i, a, b: 0.0) == [0, 1]
    assert disambiguation.viterbi([[0.0], []], lambda i, a, b: 0.0) == []
    t = disambiguation.Tagger(rules=())
    assert t.decode(["a", "b"], [[noun, verb], [noun, verb]])[0] == noun
    assert t.decode(["a", "b"], [[noun], []]) == [None, None]


def test_feature_counts_are_those_of_all_rows(spark):
    rows = [(["Koira", "juoksee", "."],), (["ei"],), ([],), (["Koira", "Koira", "3-osainen", "Koira", "!"],), (None,)]
    frame = spark.createDataFrame(rows, "words array<string>")
    want = {r.feature: r.n for r in tagger.feature_rows(frame).groupBy("feature").agg(F.count("*").alias("n")).collect()}
    assert {r.feature: r.n for r in tagger.feature_counts(frame).collect()} == want


def test_tagger(spark):
    rows = [(["koira", "juoksee"], ["NOUN", "VERB"]), (["kissa", "nukkuu"], ["NOUN", "VERB"]), (["talo", "seisoo"], ["NOUN", "VERB"])]
    frame = spark.createDataFrame(rows, "words array<string>, tags array<string>")
    model = tagger.train(frame, least=1, iterations=20)
    again = codecs.TaggerModel.from_bytes(model.to_bytes())
    assert again.classes == ["NOUN", "VERB"] and (again.weights == model.weights).all()
    assert [r.t for r in tagger.tag_sentences(frame, again, "words", "t").collect()] == [["NOUN", "VERB"]] * 3
    for broken in (b"XXXX", model.to_bytes()[:-1], b"MCET\x09\0\0\0"):
        with pytest.raises(codecs.ModelError):
            codecs.TaggerModel.from_bytes(broken)
    assert {"suf1=a", "len=5", "shape=x", "prev_BOS=True", "is_first=True", "rel_pos=0.00", "word_form=koira"} <= set(tagger.features(["koira", "on"], 0))


def test_compounds():
    lexicon = {"rauta", "tie", "asema", "kissa", "pentu", "ihminen", "luonto", "rautatie"}
    splits = compounds.split_word("rautatieasema", lexicon.__contains__)
    assert [[p[0] for p in parts] for parts, _ in splits] == [["rautatie", "asema"], ["rauta", "tie", "asema"]] and [c for _, c in splits] == [20, 30]
    assert len(compounds.split_word("kissanpentu", lexicon.__contains__)) == 2 and len(compounds.split_word("kissanpentu", lexicon.__contains__, dedup=True)) == 1
    assert compounds.split_word("ihmisenluonto", lexicon.__contains__) and not compounds.split_word("ihmisenluonto", lexicon.__contains__, rebuild=None)
    assert compounds.split_word("tie-asema", lexicon.__contains__)[0][1] == 25


def test_spelling(spark):
    lex = spark.createDataFrame([(w,) for w in ("talo", "tallo", "kala", "talvi")], "word string")
    asked = spark.createDataFrame([("tolo",), ("talo",)], "word string")
    near = {(r.query, r.candidate): r.distance for r in spelling.fuzzy_search(asked, lex, 2).collect()}
    assert near == {("tolo", "talo"): 1, ("tolo", "tallo"): 2, ("talo", "talo"): 0, ("talo", "tallo"): 1, ("talo", "kala"): 2, ("talo", "talvi"): 2}
    assert [r.candidate for r in spelling.suggest_by_edits(asked.limit(1), lex).collect()] == ["talo"]
    assert {r.query for r in spelling.suggest_escalating(asked, lex).collect()} == {"tolo"}
    assert {r.word: r.verdict for r in spelling.check(asked, lex).collect()} == {"tolo": "Failed", "talo": "Ok"}


TREEBANK = "# sent_id = a\n# text = Koira juoksee .\n" + "\n".join("\t".join([i, f, b, u, *"______"]) for i, f, b, u in (("1", "Koira", "koira", "NOUN"), ("2-3", "x", "x", "X"), ("2", "juoksee", "juosta", "VERB"), ("3", ".", ".", "PUNCT"))) + "\n"


def test_treebank(spark, tmp_path):
    path = tmp_path / "a.conllu"
    path.write_text(TREEBANK + "\n" + TREEBANK)
    rows = text_assets.read_conllu(spark, str(path))
    assert rows.count() == 6 and rows.first().text == "Koira juoksee ."
    assert {(r.prev, r.curr): r["count"] for r in corpus.tag_bigrams(rows).collect()}["<BOS>", "NOUN"] == 2
    assert corpus.treebank_counts(rows).count() == 2
    assert {r.p for r in corpus.emission_priors(rows).collect()} == {1.0}


def test_metrics(spark):
    rows = [("NOUN", "NOUN", "a#b", "ab"), ("VERB", "NOUN", "c", "c"), ("VERB", "VERB", "d", ""), ("ADJ", "X", "e", "E"), ("ADV", "ADV", "f", "g"), ("NOUN", "NOUN", "h", "h")]
    results = spark.createDataFrame(rows, "gold_upos string, pred_upos string, gold_lemma string, pred_lemma string")
    s = evaluation.summary(results).first()
    assert (s.total, s.upos_correct, s.lemma_correct, s.unknown) == (6, 4, 4, 1)
    assert {r.tag: r.f1 for r in evaluation.per_tag(results).collect()}["NOUN"] == 0.8


def test_engine_and_stream(spark, tmp_path):
    (tmp_path / "d.vfst").write_bytes(toy())
    (tmp_path / "words.txt").write_text("talo\nkala\n# no\n")
    e = Engine(spark).load(str(tmp_path / "d.vfst")).load_wordlist(str(tmp_path / "words.txt"))
    got = spark.createDataFrame([("kissa",), ("xyz",)], "word string").select("word", e.is_valid_word(F.col("word")).alias("v")).collect()
    assert {r.word: r.v for r in got} == {"kissa": True, "xyz": False}
    assert e.words.count() == 2 and not e.has_model()
    assert spark.createDataFrame([("Tietokone on.",)], "t string").select(e.hyphenate_text(F.col("t")).alias("h")).first().h == "Tie-to-ko-ne on."
    from korpisto.streaming.corpus import stream_word_counts

    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 'koira ja koira' as text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = stream_word_counts(stream, "ts", "text").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.word: r["count"] for r in spark.sql("select * from counts").collect()} == {"koira": 2, "ja": 1}


def test_engine_with_dictionary(spark, tmp_path):
    (tmp_path / "d.vfst").write_bytes(toy())
    e = Engine(spark).load(str(tmp_path / "d.vfst"))
    texts = spark.createDataFrame([("Kissa, xyz kissa kissa.",), (None,)], "text string")
    rows = {r.text: r.tokens for r in e.disambiguate_sentence(texts, oov="fallback").collect()}
    assert [(t.text, t.type, t.upos) for t in rows["Kissa, xyz kissa kissa."]][1::4] == [(",", "PUNCTUATION", "PUNCT"), (".", "PUNCTUATION", "PUNCT")]
    assert [t.text for t in rows["Kissa, xyz kissa kissa."]] == ["Kissa", ",", "xyz", "kissa", "kissa", "."] and rows[None] == []
    assert all(t.reading is not None and t.baseform for t in rows["Kissa, xyz kissa kissa."] if t.type == "WORD")
    found = {r.text: [f.code for f in r.findings] for r in e.grammar_check(texts).collect()}
    assert "REPEATED_WORD" in found["Kissa, xyz kissa kissa."] and found[None] == []
    assert {r.candidate for r in e.suggest(spark.createDataFrame([("kisa",), ("kissa",)], "word string")).collect()} == {"kissa"}


def test_treebanks_with_either_line_end(spark, tmp_path):
    path = tmp_path / "crlf.conllu"
    path.write_bytes(TREEBANK.replace("\n", "\r\n").encode())
    plain = tmp_path / "lf.conllu"
    plain.write_text(TREEBANK)
    a, b = (text_assets.read_conllu(spark, str(x)) for x in (path, plain))
    assert a.select("sentence").distinct().count() == b.select("sentence").distinct().count()
    rows = [[tuple(r)[1:] for r in x.orderBy("sentence", "id").collect()] for x in (a, b)]
    assert rows[0] == rows[1]


def test_verdicts_with_suggestions(spark, tmp_path):
    (tmp_path / "words.txt").write_text("talo\nkala\nkalat\n")
    e = Engine(spark).load_wordlist(str(tmp_path / "words.txt"))
    got = {r.word: r.suggestions for r in e.spell_with_suggestions(spark.createDataFrame([("talo",), ("kalaa",), ("xyzzyxx",)], "word string")).collect()}
    assert got == {"talo": None, "kalaa": ["kala", "kalat"], "xyzzyxx": None}
    lexicon = spark.createDataFrame([("talo",), ("kalat",)], "word string")
    asked = spark.createDataFrame([("tal",), ("kalatt",)], "word string")
    found = spelling.suggest_or_guess(asked, lexicon, lexicon.where("word = 'talo'")).collect()
    assert {(r["query"], r.candidate) for r in found} >= {("tal", "talo"), ("kalatt", "kalat")}


def test_json_keys_are_sorted(spark):
    frame = spark.sql("select array(named_struct('b', 1, 'a', named_struct('d', 'x\"y', 'c', cast(null as string)))) as v")
    assert text_assets.to_json_sorted(frame, "v").first().json == '[{"a":{"d":"x\\"y"},"b":1}]'


def test_model_from_treebank(spark):
    gold = spark.createDataFrame([(1, 1, "NOUN"), (1, 2, "VERB")], "sentence int, id int, upos string")
    table, _ = corpus.model_from_treebank(gold, {"NOUN": "nimisana"})
    assert {(r.prev, r.curr) for r in table.collect()} == {("<BOS>", "nimisana"), ("nimisana", "VERB"), ("VERB", "<EOS>")}


def test_reports(spark):
    rows = [("NOUN", "NOUN", "a", "a"), ("VERB", "NOUN", "c", "c"), ("VERB", "NOUN", "c", "c")]
    results = spark.createDataFrame(rows, "gold_upos string, pred_upos string, gold_lemma string, pred_lemma string")
    lines = [r.line for r in evaluation.report(results).collect()]
    assert lines[0] == "UPOS accuracy 33.33 % of 3" and lines[-1] == "VERB\tNOUN\t2" and len(lines) == 4
    assert '"total":3' in evaluation.report_json(results).first().json


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_codecs(spark):
    words = ["talo", "tallo", "kala", "", "öljy", "tal"]
    assert sorted(r.word for r in codecs.read_trie(spark, codecs.trie_bytes(words)).collect()) == sorted(words)
    assert codecs.read_trie(spark, b"MCT1") is None and codecs.read_trie(spark, codecs.trie_bytes(words)[:30]) is None
    assert codecs.read_trie(spark, codecs.trie_bytes([])).count() == 0
    counts = spark.createDataFrame([("talo", 3), ("öljy", 1)], "word string, count long")
    data = codecs.frequency_bytes(counts)
    assert {tuple(r) for r in codecs.read_frequency(spark, data).collect()} == {("talo", 3), ("öljy", 1)} and codecs.read_frequency(spark, data[:-1]) is None


def test_sparse_scores():
    from korpisto.operators import sparse

    code = sparse.encode({"CLASS": "nimisana", "SIJAMUOTO": "omanto", "STRUCTURE": "=pppp", "BASEFORM": "talo"})
    assert sparse.DIMENSIONS == 159 and code.sum() == 3.25
    r = sparse.Recovery()
    assert -4 < r.score({"CLASS": "nimisana", "BASEFORM": "talo"}) <= 0


def test_whole_evaluations(spark, tmp_path):
    from korpisto.operators.readings import READING
    from korpisto.plans import evaluation as whole

    path = tmp_path / "a.conllu"
    path.write_text(TREEBANK)
    gold = text_assets.read_conllu(spark, str(path))
    reading = lambda **v: F.array(F.from_json(F.lit("{%s}" % ",".join(f'"{k}":"{x}"' for k, x in v.items())), READING))
    none = F.array().cast(f"array<{READING}>")
    analyze = lambda w: F.when(w == "Koira", reading(CLASS="nimisana", BASEFORM="koira")).when(w == "juoksee", reading(CLASS="teonsana", BASEFORM="juosta")).otherwise(none)
    for results in (whole.evaluate_gold(gold, analyze), whole.evaluate_end_to_end(gold, analyze)):
        assert sorted((r.gold_upos, r.pred_upos, r.pred_lemma) for r in results.collect()) == [("NOUN", "NOUN", "koira"), ("VERB", "VERB", "juosta")]
    assert evaluation.summary(whole.evaluate_gold(gold, lambda w: none)).first().unknown == 0
    assert evaluation.summary(whole.evaluate_end_to_end(gold, lambda w: none)).first().unknown == 2
    verbs = spark.createDataFrame([("puhua",), ("xyz",)], "word string")
    outcome = {r.outcome: r.n for r in whole.verify_generation(verbs, lambda w: F.when(w == "puhun", reading(BASEFORM="puhua")).when(w == "puhut", reading(BASEFORM="x")).otherwise(none)).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert outcome == {"OK": 1, "WRONG_BASEFORM": 1, "NO_ANALYSIS": 22, "GENERATOR_REJECT": 1}
