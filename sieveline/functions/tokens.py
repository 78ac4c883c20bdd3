"""Tokens, n-grams and their counts, all inside the row.

A document's terms are counted by sorting its own array and measuring runs, so that counting needs
no shuffle: (document, term) pairs leave the row already combined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import patterns
from sieveline.functions.text import bind


def word_tokens(c: Column, stop_words=fixed.STOP_WORDS) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(patterns.TOKEN), F.lit(0))
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of ``low``..``high`` neighbouring tokens, joined by a blank."""

    def of_length(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bind(tokens, lambda t: F.concat(*[of_length(t, n) for n in range(low, high + 1)]))


def blank_separated_words(c: Column) -> Column:
    return F.filter(
        F.split(F.lower(c), patterns.WORD_GAP), lambda w: w != ""
    )


def word_char_ngrams(word: Column, low: int, high: int) -> Column:
    """Character n-grams of one word padded by a blank on both sides.

    A padded word no longer than ``n`` is taken whole, once; longer ``n`` then add nothing more.
    """

    def of_length(padded: Column, n: int) -> Column:
        # look ahead n characters, step one: a single linear pass however long the word is
        grams = F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
        ended = F.array(padded) if n == low else F.array().cast("array<string>")
        return F.when(F.char_length(padded) >= n, grams).otherwise(ended)

    return bind(
        F.concat(F.lit(" "), word, F.lit(" ")),
        lambda padded: F.concat(*[of_length(padded, n) for n in range(low, high + 1)]),
    )


def count_terms(terms: Column, kind: str = "string") -> Column:
    """``array<struct(term, tf)>`` of the distinct terms of an array of ``kind``."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda start, j: F.struct(
                    F.get(ordered, start - 1).alias("term"),
                    (F.coalesce(F.get(s, j + 1), F.size(ordered) + 1) - start).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast(f"array<struct<term:{kind},tf:int>>")
    return bind(F.sort_array(terms), lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(empty))
