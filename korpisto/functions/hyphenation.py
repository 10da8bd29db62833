"""Syllables and hyphenation points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korpisto.functions.chars import VOWELS, let, simple_lower

# Long vowels and diphthongs that form one nucleus.
LONG = ("aa", "ee", "ii", "oo", "uu", "yy", "ää", "öö")
DIPHTHONGS = ("ai", "ei", "oi", "ui", "yi", "äi", "öi", "au", "eu", "iu", "ou", "äy", "öy", "ie", "uo", "yö")
# End of fixed values.

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"


def syllable_pattern() -> str:
    """A syllable: onset, nucleus, and the consonants that don't start the next one.

    Of consonants between two nuclei the last belongs to the second; those at
    the word's end stay with the last nucleus. A word without vowels is whole.
    """
    nucleus = f"(?>{'|'.join((*LONG, *DIPHTHONGS))}|{_V})"
    return f"(?s){_C}*+{nucleus}(?:{_C}*(?={_C}{_V})|{_C}*\\z|)|{_C}++\\z"


def syllables(word: Column) -> Column:
    """Lengths-preserving pieces of the word in its own case."""
    parts = F.regexp_extract_all(simple_lower(word), F.lit(syllable_pattern()), F.lit(0))
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return let(ends, lambda e: F.transform(F.slice(e, 1, F.size(e) - 1), lambda start, i: F.substring(word, start + 1, F.get(e, i + 1) - start)))


def hyphenation_points(word: Column, min_fragment: int = 2) -> Column:
    """Character offsets before which a hyphen may stand, both sides at least ``min_fragment`` long."""
    least = max(1, min_fragment)
    starts = F.aggregate(
        syllables(word), F.struct(F.array().cast("array<int>").alias("points"), F.lit(0).alias("at")),
        lambda s, p: F.struct(F.when(s.at >= least, F.array_append(s.points, s.at)).otherwise(s.points).alias("points"), (s.at + F.length(p)).alias("at")),
        lambda s: s.points,
    )
    return F.filter(starts, lambda k: F.length(word) - k >= least)


def hyphenate(word: Column, min_fragment: int = 2) -> Column:
    """The word with a hyphen at each point."""
    def cut(points: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), points, F.array(F.length(word)))
        return let(bounds, lambda b: F.array_join(F.transform(F.slice(b, 1, F.size(b) - 1), lambda start, i: F.substring(word, start + 1, F.get(b, i + 1) - start)), "-"))

    return let(hyphenation_points(word, min_fragment), cut)
