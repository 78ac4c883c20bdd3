"""Text cleaning as Column expressions.

Only entity unescaping and Unicode folding leave the JVM, as one Arrow batch function, and only
for the rows that hold an ampersand or a non-ASCII character.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import fixed
from sieveline.functions import patterns


@dataclass(frozen=True)
class CleanConfig:
    """One switch per step; ``custom_steps`` are Column -> Column functions run after the others."""

    unescape_html: bool = True
    normalize_unicode: bool = True
    detect_caps: bool = True
    strip_wiki: bool = True
    strip_urls: bool = True
    expand_contractions: bool = True
    deobfuscate: bool = True
    collapse_punct: bool = True
    strip_non_alnum: bool = True
    custom_steps: tuple[Callable[[Column], Column], ...] = field(default_factory=tuple)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- Arrow batch functions


@lru_cache(maxsize=4)
def _marks(by_class: bool, high: bool) -> re.Pattern:
    """All nonspacing marks (or all characters with a combining class), as runs of code points.

    The basic plane and the rest are apart: the first then compiles to a table lookup.
    """

    def is_mark(char: str) -> bool:
        return unicodedata.combining(char) != 0 if by_class else unicodedata.category(char) == "Mn"

    low, top = (0x10000, sys.maxunicode) if high else (0, 0xFFFF)
    runs, start = [], None
    for code in range(low, top + 2):
        mark = code <= top and is_mark(chr(code))
        if mark and start is None:
            start = code
        elif not mark and start is not None:
            runs.append(f"{chr(start)}-{chr(code - 1)}")
            start = None
    return re.compile("[" + "".join(runs) + "]+")


_KEPT = re.compile(f"([{fixed.KEPT_LETTERS}])")


def _fold_all(text: str, by_class: bool = False) -> str:
    text = _marks(by_class, False).sub("", unicodedata.normalize("NFKD", text))
    return _marks(by_class, True).sub("", text) if text and max(text) > "\uffff" else text


def fold_string(text: str) -> str:
    """Compatibility-decompose and drop marks, leaving the kept letters as they are."""
    pieces = _KEPT.split(text)
    pieces[::2] = [_fold_all(piece) for piece in pieces[::2]]
    return "".join(pieces)


SLICE = 512  # texts that are Python objects at once


def _batch(function: Callable[[str], str]):
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        pieces = [pa.array([None if t is None else function(t) for t in texts.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())

    return run


_unescape_batch = _batch(html.unescape)
_fold_batch = _batch(fold_string)
_strip_accents_batch = _batch(lambda text: _fold_all(text, by_class=True))
_unescape_fold_batch = _batch(lambda text: fold_string(html.unescape(text)))


def _has_entity(c: Column) -> Column:
    return F.contains(c, F.lit("&"))


def _not_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def html_unescape(c: Column) -> Column:
    return F.coalesce(_unescape_batch(F.when(_has_entity(c), c)), c)


def unicode_fold(c: Column) -> Column:
    return F.coalesce(_fold_batch(F.when(_not_ascii(c), c)), c)


def strip_accents(c: Column) -> Column:
    """Fold without exceptions, as the accent-stripping vectoriser does."""
    return F.coalesce(_strip_accents_batch(F.when(_not_ascii(c), c)), c)


def _decoded(c: Column, config: CleanConfig) -> Column:
    if config.unescape_html and config.normalize_unicode:
        return F.coalesce(_unescape_fold_batch(F.when(_has_entity(c) | _not_ascii(c), c)), c)
    if config.unescape_html:
        return html_unescape(c)
    return unicode_fold(c) if config.normalize_unicode else c


# ---------------------------------------------------------------- single steps


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(patterns.BLANK_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_blanks(c) == "")


def blank_to_empty(c: Column) -> Column:
    return F.when(is_blank(c), F.lit("")).otherwise(c)


def mostly_caps(c: Column) -> Column:
    """More than half of the letters are capitals. Counted from the lengths of what remains after
    removing whole runs, which needs far fewer regex matches than counting letter by letter."""
    letters = F.char_length(c) - F.char_length(F.regexp_replace(c, r"\p{L}+", ""))
    capitals = F.char_length(F.regexp_replace(c, r"\P{Lu}+", ""))
    return F.coalesce(capitals * 2 > letters, F.lit(False))


def strip_wiki(c: Column) -> Column:
    return F.regexp_replace(c, patterns.WIKI_MARKS, " ")


def strip_urls_ips(c: Column) -> Column:
    return F.regexp_replace(c, patterns.URLS_AND_IPS, " ")


def replace_found(text: Column, pattern: str, hits: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace the matches of a pattern that were already found, all of them and in order."""
    pieces = F.zip_with(
        F.split(text, pattern),
        hits,
        lambda piece, hit: F.concat(piece, F.coalesce(replacement(hit), F.lit(""))),
    )
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(pieces, ""))


def cut_at(c: Column, pattern: str) -> Column:
    """The text between the matches of a pattern: one piece more than there are matches. Joined by a blank it is the text with each match
    replaced by one, so that one search serves for counting and for replacing."""
    return F.split(c, pattern, -1)


def may_repeat_punct(c: Column) -> Column:
    return F.contains(c, F.lit("!!")) | F.contains(c, F.lit("??")) | F.contains(c, F.lit("..")) | F.contains(c, F.lit(",,"))


def replace_matches(
    c: Column, pattern: str, replacement: Callable[[Column], Column], hint: Callable[[Column], Column] | None = None
) -> Column:
    """Replace each match of one pattern by a function of the matched text, in one pass.

    The text is split at the matches and the pieces are joined again around the replacements, so
    an earlier replacement can never create or destroy a later match. ``hint`` is a cheap test
    without which a match is impossible.
    """

    def body(text: Column) -> Column:
        replaced = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: replace_found(text, pattern, hits, replacement))
        return replaced if hint is None else F.when(hint(text), replaced).otherwise(text)

    return bind(c, body)


def _lookup(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry])


def may_hold_contraction(c: Column) -> Column:
    return F.contains(c, F.lit("'")) | F.contains(c, F.lit("cannot"))


def long_form(hit: Column) -> Column:
    """What a contraction stands for."""
    return F.element_at(_lookup(fixed.CONTRACTIONS), hit)


def expand_contractions(c: Column) -> Column:
    return replace_matches(c, patterns.CONTRACTIONS, long_form, hint=may_hold_contraction)


def profanity_stem(hit: Column) -> Column:
    """The stem a disguised match stands for: its first letter decides, and for ``b`` the second."""
    by_letter = {stem[0]: stem for stem in fixed.PROFANITY_STEMS if stem[0] != "b"}
    first = F.substring(hit, 1, 1)
    return F.when(
        first == "b",
        F.when(F.regexp_like(hit, F.lit(rf"^b+{fixed.PROFANITY_SEPARATORS}*i")), F.lit("bitch")).otherwise(
            F.lit("bastard")
        ),
    ).otherwise(F.element_at(_lookup(by_letter), first))


def deobfuscate_profanity(c: Column) -> Column:
    return replace_matches(c, patterns.PROFANITY, profanity_stem)


def collapse_punct(c: Column) -> Column:
    return F.regexp_replace(c, patterns.REPEATED_PUNCTUATION, "$1")


def strip_non_alnum(c: Column) -> Column:
    return F.regexp_replace(c, patterns.NOT_ALPHANUMERIC, " ")


def keep_alnum_words(c: Column) -> Column:
    """What ``collapse_punct``, ``strip_non_alnum`` and ``squeeze_whitespace`` make together: every
    run of anything else becomes one blank. One pass instead of three."""
    return F.btrim(F.regexp_replace(c, patterns.NOT_ALPHANUMERIC_RUN, " "))


def squeeze_whitespace(c: Column) -> Column:
    return trim_blanks(F.regexp_replace(c, patterns.BLANK_RUN, " "))


def apply_steps(c: Column, steps) -> Column:
    return reduce(lambda text, step: step(text), steps, c)


def capslock_prefix(c: Column, flag: Column) -> Column:
    return F.concat(F.when(flag, F.lit(fixed.CAPS_TOKEN + " ")).otherwise(F.lit("")), c)


def normalize_message(c: Column) -> Column:
    """The live path: trimmed and lower-cased, nothing else."""
    return F.lower(trim_blanks(F.coalesce(c, F.lit(""))))


# ---------------------------------------------------------------- the composed cleaner


def body_steps(config: CleanConfig) -> list[Callable[[Column], Column]]:
    """The steps between caps detection and the caps prefix, in order."""
    ending = (
        [(True, keep_alnum_words)]
        if config.strip_non_alnum
        else [(config.collapse_punct, collapse_punct), (True, squeeze_whitespace)]
    )
    switched = [
        (config.strip_wiki, strip_wiki),
        (config.strip_urls, strip_urls_ips),
        (True, F.lower),
        (config.expand_contractions, expand_contractions),
        (config.deobfuscate, deobfuscate_profanity),
        *ending,
    ]
    return [step for on, step in switched if on] + list(config.custom_steps)


def clean_text(c: Column, config: CleanConfig = CleanConfig()) -> Column:
    """All steps as one expression: one narrow projection over the table."""
    decoded = _decoded(c, config)
    body = apply_steps(decoded, body_steps(config))
    if config.detect_caps:
        body = capslock_prefix(body, mostly_caps(decoded))
    return F.when(is_blank(c), F.lit("")).otherwise(body)
