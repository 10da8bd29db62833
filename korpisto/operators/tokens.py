"""Tokens and sentences of texts, as column expressions over whole documents.

One regular expression finds every token; the matches joined give the text, so
places are running sums of lengths. Nothing is shuffled: a document's tokens are
an array in its row, and ``explode_tokens`` makes rows of them where wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpisto.functions.chars import DIGIT, LETTER, PUNCTUATION, SPACE, let, simple_lower

# Characters inside web addresses, mail addresses, and around hyphens.
HYPHEN = "\\-­‐‑"
URL_UNKNOWN = "=#%"
MAIL_UNKNOWN = "#$%*+=\\^_`|~"
MAIL_PUNCTUATION = "!&'\\-/?{}"
OPENING_QUOTE = "“"
CLOSING_QUOTES = "\"»”"
# End of fixed values.

_NOT_DOT = PUNCTUATION.replace(".", "", 1)
_BLOCK = PUNCTUATION.replace("\"", "").replace("»", "").replace("”", "").replace(",", "", 1)
_ENDS = f"(?=[.,;:!?\"')]?(?:[ \\n]|[{SPACE}]|\\z))"


def token_pattern() -> str:
    """Java regular expression whose matches are the tokens of a text.

    url and mail need at least 12 and 6 characters up to the text's end. A
    number takes dots and commas until its first letter; words take inner
    apostrophes, colons and dots before letters, and a hyphen at the end unless
    a blocking mark follows. A hyphen in front belongs to the word behind it.
    Most words are told by what follows, white space with at most one mark before:
    no address, number or hyphen goes on there, so they need no other alternative.
    """
    after_dot = f"\\.(?![{SPACE}]|\\z)"
    url = f"(?=[\\s\\S]{{12}})https?://(?:[{LETTER}{DIGIT}{URL_UNKNOWN}{_NOT_DOT}]|{after_dot})*+"
    mail_char = f"[{LETTER}{DIGIT}{MAIL_UNKNOWN}{MAIL_PUNCTUATION}]"
    mail = f"(?=[\\s\\S]{{6}})(?:{mail_char}|\\.)*+@{mail_char}*+(?:{after_dot}{mail_char}*+)++(?!@)"
    comma = f"(?<=[{DIGIT}]),(?=[{DIGIT}])"
    inner_hyphen = f"[{HYPHEN}](?=[{LETTER}{DIGIT}])"
    number = f"(?:[{DIGIT}]|{comma}|\\.(?=[{LETTER}{DIGIT}])|{inner_hyphen})*+"
    rest = f"(?:[{LETTER}{DIGIT}]|['’:](?=[{LETTER}])|{inner_hyphen}|{comma}|\\.(?=[{LETTER}]))*+"
    body = f"(?:{url}|{mail}|{number}{rest}(?:[{HYPHEN}](?![{_BLOCK}]))?+)"
    plain = f"[a-zA-Z0-9]++{_ENDS}|[{SPACE}]++|[{LETTER}{DIGIT}]++{_ENDS}"
    return f"{plain}|[\\-‐‑](?=[\\s\\S]){body}|(?=[{LETTER}{DIGIT}]){body}|\\.\\.\\.|[\\s\\S]"


TOKEN = token_pattern()
#: The same, with words that white space parts, commas and semicolons behind them included, as one match.
STRETCH = f"(?:[{LETTER}{DIGIT}]++[,;]?[{SPACE}]++)++|{TOKEN}"


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_type(token: Column) -> Column:
    """WORD, WHITESPACE, PUNCTUATION or UNKNOWN by the first character."""
    plain = token.between("a", "zz") | token.between("A", "ZZ") | token.between("0", "99")  # by bytes, so the first one is a letter or digit
    return (
        F.when(token == " ", "WHITESPACE").when(plain, "WORD").when(token.rlike(f"^[{LETTER}{DIGIT}]"), "WORD").when(token.rlike(f"^[{SPACE}]"), "WHITESPACE")
        .when(token.rlike("^[\\-‐‑]") & (F.length(token) > 1), "WORD").when(token.rlike(f"^[{PUNCTUATION}]"), "PUNCTUATION").otherwise("UNKNOWN")
    )


def is_word(token: Column) -> Column:
    """Whether ``token_type`` gives WORD, with the commonest of the others told first."""
    plain = token.between("a", "zz") | token.between("A", "ZZ") | token.between("0", "99")
    return ~token.isin(" ", ",", ".", "\n") & (plain | token.rlike(f"^[{LETTER}{DIGIT}]") | (token.rlike("^[\\-‐‑]") & (F.length(token) > 1)))


def running_starts(lengths: Column, chunk: int = 128) -> Column:
    """The sum of all lengths before each, in chunks so that long arrays stay cheap."""
    def add(a: Column, n: Column) -> Column:
        return F.array_append(a, F.element_at(a, -1) + n)

    def of(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, n: s + n))
        bases = F.aggregate(sums, F.array(F.lit(0)), add)
        return let(bases, lambda b: F.flatten(F.transform(chunks, lambda c, i: F.slice(F.aggregate(c, F.array(F.get(b, i)), add), F.lit(1), F.size(c)))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int")), lambda k: F.slice(lengths, k * chunk + 1, F.lit(chunk)))
    return F.when(F.size(lengths) > 0, let(parts, of)).otherwise(F.array().cast("array<int>"))


def tokens(text: Column) -> Column:
    """All tokens: array of (type, text, len, pos, byte_start, byte_end); positions count characters."""
    def build(texts: Column) -> Column:
        chars = running_starts(F.transform(texts, lambda t: F.length(t)))
        octets = running_starts(F.transform(texts, lambda t: F.octet_length(t)))
        return F.transform(
            F.arrays_zip(texts.alias("t"), chars.alias("c"), octets.alias("b")),
            lambda z: F.struct(token_type(z.t).alias("type"), z.t.alias("text"), F.length(z.t).alias("len"), z.c.alias("pos"), z.b.alias("byte_start"), (z.b + F.octet_length(z.t)).alias("byte_end")),
        )

    return let(token_texts(F.coalesce(text, F.lit(""))), build)


def end_of_tokens(text: Column) -> Column:
    """(characters, bytes): the end of the last token, without the places of those before."""
    start = F.struct(F.lit(0).alias("characters"), F.lit(0).alias("bytes"))
    return F.aggregate(token_texts(F.coalesce(text, F.lit(""))), start, lambda s, t: F.struct((s.characters + F.length(t)).alias("characters"), (s["bytes"] + F.octet_length(t)).alias("bytes")))


def without_whitespace(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: t["type"] != "WHITESPACE")


def tokenize(df: DataFrame, text: str = "text", name: str = "tokens", *, whitespace: bool = False) -> DataFrame:
    """The input with an array column of tokens."""
    made = tokens(F.col(text))
    return df.withColumn(name, made if whitespace else without_whitespace(made))


def explode_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a token of (type, text), by the light way without places."""
    return df.withColumn("token", F.explode(token_texts(F.coalesce(F.col(text), F.lit(""))))).withColumn("token_type", token_type(F.col("token")))


# --------------------------------------------------------------------- sentences
def _dot_word(previous: Column, known: Column | None) -> Column:
    """Whether a dot belongs to the word before it: an initial, a number or date, or a known abbreviation."""
    initial = (F.length(previous) == 1) & (previous != simple_lower(previous))
    number = previous.rlike(f"^[{DIGIT}.\\-]+$")
    found = initial | number
    return found if known is None else found | F.array_contains(known, F.concat(previous, F.lit(".")))


def sentences(text: Column, abbreviations: Column | None = None) -> Column:
    """Array of (type, len): PROBABLE or POSSIBLE by the boundary at its end, NONE at the text's end.

    Lengths are characters and include white space behind the sentence; they add
    up to the text. ``abbreviations`` is an array of words with their dots.
    """

    def typed(texts: Column) -> Column:
        nexts = F.concat(F.slice(texts, F.lit(2), F.size(texts)), F.array(F.lit("")))
        return F.zip_with(texts, nexts, lambda t, n: F.struct(t.alias("t"), F.substring(n, 1, 1).alias("n"), token_type(t).alias("k"), t.rlike(f"[{LETTER}{DIGIT}][,;]?[{SPACE}]").alias("stretch")))

    no = F.lit(False)
    start = F.struct(
        F.array().cast("array<struct<type:string,len:int>>").alias("out"), F.lit(0).alias("len"), F.lit("").alias("prev"), F.lit("NONE").alias("prev_type"),
        no.alias("end"), no.alias("quoted"), no.alias("dotword"), no.alias("possible"),
    )

    def step(s: Column, z: Column) -> Column:
        boundary = s.end & ~s.quoted & (z.k != "WHITESPACE")
        kind = F.when(s.dotword | s.possible | ((s.prev_type != "WHITESPACE") & (z.k == "WORD")), "POSSIBLE").otherwise("PROBABLE")
        # a boundary starts anew, and this token is looked at as the first of the next sentence
        end0, quoted0 = s.end & ~boundary, s.quoted & ~boundary
        dot0, possible0 = s.dotword & ~boundary, s.possible & ~boundary
        prev_type = F.when(boundary, "NONE").otherwise(s.prev_type)
        seen = (z.k == "PUNCTUATION") & ~(end0 & ~quoted0)
        shout = seen & z.t.isin("!", "?")
        ellipsis = seen & z.t.isin("...", "…")
        dot = seen & (z.t == ".")
        colon = seen & (z.t == ":")
        quote = seen & F.substring(z.t, 1, 1).isin(*CLOSING_QUOTES, OPENING_QUOTE)
        quoted = F.when(quote, ~quoted0).otherwise(quoted0)
        cancel = quote & ~quoted & (z.n == ",")
        return F.struct(
            F.when(boundary, F.array_append(s.out, F.struct(kind.alias("type"), s.len.alias("len")))).otherwise(s.out).alias("out"),
            (F.when(boundary, 0).otherwise(s.len) + F.length(z.t)).alias("len"), z.t.alias("prev"), F.when(z.stretch, "WHITESPACE").otherwise(z.k).alias("prev_type"),
            ((end0 | shout | ellipsis | dot | colon) & ~cancel).alias("end"), quoted.alias("quoted"),
            (dot0 | (dot & (prev_type == "WORD") & _dot_word(s.prev, abbreviations))).alias("dotword"),
            ((possible0 | (shout & quoted0) | ellipsis | colon) & ~cancel).alias("possible"),
        )

    def close(s: Column) -> Column:
        return F.when(s.len > 0, F.array_append(s.out, F.struct(F.lit("NONE").alias("type"), s.len.alias("len")))).otherwise(s.out)

    stretches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STRETCH), F.lit(0))  # nothing begins or ends inside one
    return let(stretches, lambda ts: F.aggregate(typed(ts), start, step, close))


def dotted_words(text: Column) -> Column:
    """The distinct words of a text that a dot follows, with it."""
    def of(ts: Column) -> Column:
        pairs = F.zip_with(ts, F.slice(ts, F.lit(2), F.size(ts)), lambda t, n: F.when((n == ".") & (token_type(t) == "WORD"), F.concat(t, n)))
        return F.array_distinct(F.filter(pairs, lambda w: w.isNotNull()))

    return let(token_texts(F.coalesce(text, F.lit(""))), of)


def with_abbreviations(df: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text", name: str = "abbreviations", shares: int = 16) -> DataFrame:
    """The input with the array of its text's words that ``lexicon`` (column ``word``, with the dot) holds, for ``sentences``.

    The lexicon may be of any size. A word that many texts have is met in ``shares``
    places, dealt by the key. Rows that share a key share their words, which changes
    nothing: a sentence asks only for words of its own text. Null texts have none.
    """
    keys = [F.col(k).alias(f"_{i}") for i, k in enumerate(key)]
    asked = df.select(*keys, F.explode(dotted_words(F.col(text))).alias("word")).withColumn("share", F.pmod(F.xxhash64(*(f"_{i}" for i in range(len(key)))), F.lit(shares)))
    known = lexicon.select("word").distinct().withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    found = asked.join(known, ["word", "share"], "left_semi").groupBy(*(f"_{i}" for i in range(len(key)))).agg(F.collect_set("word").alias("_found"))
    same = [F.col(f"_.{k}").eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
    return df.alias("_").join(found, same, "left").select("_.*", F.coalesce("_found", F.array().cast("array<string>")).alias(name))


def explode_sentences(df: DataFrame, text: str = "text", abbreviations: Column | None = None) -> DataFrame:
    """One row a sentence: the input's columns with sentence_index, sentence_type and sentence."""
    parts = sentences(F.col(text), abbreviations)

    def cut(ss: Column) -> Column:
        starts = running_starts(F.transform(ss, lambda s: s.len))
        return F.zip_with(ss, starts, lambda s, at: F.struct(s["type"].alias("sentence_type"), F.substring(F.col(text), at + 1, s.len).alias("sentence")))

    return df.select("*", F.posexplode(let(parts, cut)).alias("sentence_index", "cell")).select(*df.columns, "sentence_index", "cell.sentence_type", "cell.sentence")
