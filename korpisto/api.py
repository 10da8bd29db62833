"""One engine object over the operators: the methods a user calls on columns and frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import korpisto
from korpisto.functions import hyphenation, morphology
from korpisto.operators import compounds, disambiguation, evaluation, grammar, readings, spelling, tagger, tokens
from korpisto.session import ship
from korpisto.sources.codecs import TaggerModel
from korpisto.sources.text_assets import read_words
from korpisto.sources.vfst import Dictionary


@dataclass
class Engine:
    """Assets and the operators that need them. All assets are the user's own files."""

    spark: SparkSession
    dictionary: bytes | None = None
    model: TaggerModel | None = None
    words: DataFrame | None = None
    user: DataFrame | None = None
    rules: tuple = field(default_factory=lambda: disambiguation.RULES)

    def __post_init__(self) -> None:
        ship(self.spark)

    # ---------------------------------------------------------------- assets
    def _bytes(self, path: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0])

    def load(self, path: str) -> Engine:
        data = self._bytes(path)
        Dictionary(data, weighted=False)  # fails here rather than on a worker
        self.dictionary = data
        return self

    def load_model(self, path: str) -> Engine:
        self.model = TaggerModel.from_bytes(self._bytes(path))
        return self

    def load_wordlist(self, path: str) -> Engine:
        self.words = read_words(self.spark, path)
        return self

    def has_model(self) -> bool:
        return self.model is not None

    def has_wordlist(self) -> bool:
        return self.words is not None

    @staticmethod
    def version() -> str:
        return korpisto.__version__

    def info(self) -> dict[str, object]:
        return Dictionary(self._need()).info()

    def _need(self) -> bytes:
        if self.dictionary is None:
            raise ValueError("load a dictionary first")
        return self.dictionary

    # ------------------------------------------------------------- dictionary
    def analyze(self, word: Column) -> Column:
        return readings.analyzer(self._need())(word)

    def is_valid_word(self, word: Column) -> Column:
        return readings.is_valid_word(self.analyze(word))

    def get_baseform(self, word: Column) -> Column:
        return readings.first_base_form(self.analyze(word), word)

    def analyze_sentence(self, df: DataFrame, text: str = "text", name: str = "tags", *, oov: str = "null_all") -> DataFrame:
        """Words of each text with their best readings; with a tagger its probabilities join the scores."""
        extra = None
        if self.model is not None:
            model = self.model

            def extra(ws: list[str]) -> list[dict[str, float]]:
                return [dict(zip(model.classes, row)) for row in tagger.log_probabilities(model, ws).tolist()]

        return disambiguation.tag(df, readings.analyzer(self._need()), text, name, disambiguation.Tagger(rules=self.rules, extra=extra, oov=oov))

    def disambiguate_sentence(self, df: DataFrame, text: str = "text", name: str = "tokens", *, oov: str = "null_all") -> DataFrame:
        """All tokens of each text but white space: (text, type, upos, baseform, reading); other tokens than words have no reading."""
        known = self.analyze_sentence(df.withColumn("_tokens", tokens.token_texts(F.coalesce(F.col(text), F.lit("")))), text, "_best", oov=oov)
        typed = F.transform("_tokens", lambda t: F.struct(t.alias("text"), tokens.token_type(t).alias("type")))
        typed = F.filter(typed, lambda t: t["type"] != "WHITESPACE")
        empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<text:string,type:string,at:int>>").alias("out"))

        def number(s: Column, t: Column) -> Column:
            word = t["type"] == "WORD"
            return F.struct((s.n + word.cast("int")).alias("n"), F.array_append(s.out, F.struct(t["text"].alias("text"), t["type"].alias("type"), F.when(word, s.n).alias("at"))).alias("out"))

        def cell(t: Column) -> Column:
            best = F.get("_best", t["at"])
            upos = F.when(t["type"] == "PUNCTUATION", "PUNCT").when(best.isNotNull(), evaluation.upos_of_reading(best, t["text"]))
            return F.struct(t["text"].alias("text"), t["type"].alias("type"), upos.alias("upos"), F.when(t["type"] == "WORD", F.coalesce(best["BASEFORM"], t["text"])).alias("baseform"), best.alias("reading"))

        numbered = known.withColumn("_numbered", F.aggregate(typed, empty, number, lambda s: s.out))
        return numbered.withColumn(name, F.transform("_numbered", cell)).drop("_tokens", "_best", "_numbered", "words")

    # --------------------------------------------------------------- spelling
    def _lexicon(self) -> DataFrame:
        if self.words is None:
            raise ValueError("load a word list first")
        return self.words

    def spell_check(self, df: DataFrame, word: str = "word", name: str = "verdict") -> DataFrame:
        """Only what neither the word list nor the user's words hold is split into compound parts."""
        known = self._lexicon().select("word") if self.user is None else self._lexicon().select("word").union(self.user.select("word"))
        unknown = df.select(F.col(word).alias("word")).distinct().join(known.distinct(), "word", "left_anti")
        splits = compounds.compound_split(unknown, self._lexicon(), rebuild=False)
        marks = splits.select("word", F.coalesce(compounds.is_compound(F.col("splits")), F.lit(False)).alias("is_compound")).distinct()
        return spelling.check(df, self._lexicon(), self.user, marks, word, name)

    def suggest(self, df: DataFrame, word: str = "word", k: int = 1, n: int = 10) -> DataFrame:
        """Near words of the word list for words that the dictionary, where one is loaded, doesn't know; without a word list edit candidates that it knows."""
        if self.words is None:
            found = spelling.edit_candidates(self._unknown(df, word), k, word)
            known = found.select("candidate").distinct().where(readings.is_valid_word(self.analyze(F.col("candidate"))))
            return spelling.suggest_by_edits(self._unknown(df, word), known.withColumnRenamed("candidate", "word"), k, n, word)
        return spelling.suggest_escalating(df if self.dictionary is None else self._unknown(df, word), self._lexicon(), k, n, word)

    def spell_with_suggestions(self, df: DataFrame, word: str = "word", n: int = 10) -> DataFrame:
        """The verdict of each word, with suggestions for those that fail: valid near words, or else any near words."""
        checked = self.spell_check(df, word)
        failed = checked.where("verdict not in ('Ok', 'CapitalizeFirst')").select(F.col(word).alias("word")).distinct()
        valid = self._lexicon() if self.dictionary is None else self._lexicon().where(readings.is_valid_word(self.analyze(F.col("word"))))
        found = spelling.suggest_or_guess(failed, self._lexicon(), valid, n)
        listed = found.groupBy(F.col("query").alias(word)).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda s: s["candidate"]).alias("suggestions"))
        return checked.join(listed, word, "left")

    def _unknown(self, df: DataFrame, word: str) -> DataFrame:
        """The distinct words without a reading."""
        return df.select(word).distinct().where(~readings.is_valid_word(self.analyze(F.col(word))))

    def suggest_ranked(self, df: DataFrame, frequencies: DataFrame, word: str = "word", k: int = 2, n: int = 5) -> DataFrame:
        """Near words of the word list by distance and frequency; ``frequencies`` has word and count."""
        return spelling.suggest_ranked(df, self._lexicon(), k, n, frequencies=frequencies, word=word)

    def suggest_with_context(self, df: DataFrame, word: str = "word", previous_class: str = "prev_class", k: int = 1, n: int = 5) -> DataFrame:
        """Edit candidates that the dictionary knows, by distance and the bigram with the class before."""
        found = spelling.edit_candidates(df, k, word)
        known = found.select("candidate").distinct().withColumn("r", self.analyze(F.col("candidate"))).where("size(r) > 0")
        classes = known.select("candidate", F.explode("r.CLASS").alias("class"))
        rows = found.join(known.select("candidate"), "candidate", "left_semi").join(df.select(F.col(word).alias("query"), F.col(previous_class).alias("prev_class")).distinct(), "query")
        table = self.spark.createDataFrame([(a, b, w) for (a, b), w in disambiguation.BIGRAMS.items()], "prev string, curr string, weight double")
        return spelling.suggest_in_context(rows, classes, table, disambiguation.UNSEEN, n)

    def compound_split(self, df: DataFrame, word: str = "word", name: str = "splits") -> DataFrame:
        return compounds.compound_split(df, self._lexicon(), word, name, rebuild=False)

    def grammar_check(self, df: DataFrame, text: str = "text", name: str = "findings", **options) -> DataFrame:
        """Findings of all rules; with a dictionary the words are analysed first, without one the surface rules remain.

        Readings are chosen by default bigrams and emission alone: no context rules, no
        tagger, and if a word is unknown no word of the text has a reading.
        """
        if self.dictionary is None or "readings" in options:
            return grammar.grammar_check(df, text, name, **options)
        tagged = disambiguation.tag(df, readings.analyzer(self._need()), text, "_best", disambiguation.Tagger(rules=()))
        return grammar.grammar_check(tagged, text, name, readings="_best", **options).drop("_best", "words")

    # -------------------------------------------------- without any asset
    @staticmethod
    def hyphenate(word: Column) -> Column:
        return hyphenation.hyphenate(word)

    @staticmethod
    def hyphenate_text(text: Column) -> Column:
        """Word tokens hyphenated, all else as it is."""
        return F.array_join(F.transform(tokens.token_texts(text), lambda t: F.when(tokens.token_type(t) == "WORD", hyphenation.hyphenate(t)).otherwise(t)), "")

    @staticmethod
    def tokenize(df: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
        return tokens.tokenize(df, text, name)

    @staticmethod
    def generate_form(word: Column, case: str, number: str = "singular") -> Column:
        """The form, or the base form for an unknown case."""
        return F.coalesce(morphology.noun_form(word, case, number), word)

    @staticmethod
    def generate_paradigm(df: DataFrame, word: str = "word") -> DataFrame:
        return morphology.noun_paradigm(df, word)

    @staticmethod
    def generate_verb_form(df: DataFrame, word: str, tense: str, person: str, polarity: str = "affirmative") -> DataFrame:
        return morphology.verb_form(df, word, tense, person, polarity)

    @staticmethod
    def generate_verb_paradigm(df: DataFrame, word: str = "word") -> DataFrame:
        return morphology.verb_paradigm(df, word)
