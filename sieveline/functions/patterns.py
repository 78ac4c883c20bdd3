"""Regular expressions in the Java dialect, with word edges and blanks that do not depend on the JDK.

``\\b`` of the JVM counts marks as word characters and changed between releases, so edges are
written as look-arounds over letters, digits and underscore. Blanks include U+001C..U+001F.
"""

from __future__ import annotations

import re

from sieveline import fixed

WORD = r"[\p{L}\p{N}_]"
BLANKS = r"\s\x1c-\x1f"
BEFORE_WORD = rf"(?<!{WORD})"
AFTER_WORD = rf"(?!{WORD})"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# every character that str.isspace() accepts; used to trim both ends
BLANK_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def to_java(pattern: str, starts: str | None = None) -> str:
    """A rule's regex with Unicode classes and portable word edges.

    ``starts`` is a class of the characters that a match can begin with. It changes no result; it
    lets the engine pass over most positions with one comparison.
    """
    body = pattern.replace(r"\b", EDGE)
    return f"(?U)(?=[{starts}])(?:{body})" if starts else "(?U)" + body


def escape(word: str) -> str:
    return re.sub(r"([^\w\s'])", r"\\\1", word)


def literal_alternation(words) -> str:
    """Longest first, so that a word never hides a longer one that starts alike."""
    return "|".join(escape(w) for w in sorted(words, key=len, reverse=True))


def _by_first(words) -> dict[str, set[str]]:
    heads: dict[str, set[str]] = {}
    for word in words:
        if word:
            heads.setdefault(word[0], set()).add(word[1:])
    return dict(sorted(heads.items()))


def prefix_tree(words: set[str]) -> str:
    """The same choice as the alternation of all words, longest first, with shared beginnings
    written once: far fewer comparisons per position."""
    branches = [
        escape(head) + (prefix_tree(tails) if tails != {""} else "") for head, tails in _by_first(words).items()
    ]
    body = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
    return body + "?" if "" in words else body


def _from_word_start(tails: dict[str, str], then: str = "") -> str:
    """``(head)(tail)`` for any of the heads, where a word starts.

    The head character is taken first and the edge in front of it is looked at afterwards: one
    comparison sends most positions away before the costlier look-behind.
    """
    heads = "[" + "".join(escape(h) for h in tails) + "]"
    branches = "|".join(f"(?<={escape(h)}){tail}" for h, tail in tails.items())
    return f"{heads}(?<!{WORD}{heads}){then}(?:{branches})"


def whole_words(words, then: str = "") -> str:
    """Any of the words between word edges. ``then`` is a cheap look-ahead behind the first letter."""
    tails = {h: prefix_tree(t) if t != {""} else "" for h, t in _by_first(set(words)).items()}
    return _from_word_start(tails, then) + AFTER_WORD


def _stem_tail(letters: str, ending: str) -> str:
    first, *rest = letters
    gap = fixed.PROFANITY_SEPARATORS + "*"
    return f"{first}*" + "".join(f"{gap}{letter}+" for letter in rest) + ending


def _stems() -> str:
    tails: dict[str, list[str]] = {}
    for stem, ending in fixed.PROFANITY_STEMS.items():
        tails.setdefault(stem[0], []).append(_stem_tail(fixed.SHORT_STEMS.get(stem, stem), ending))
    return _from_word_start({h: f"(?:{'|'.join(t)})" for h, t in tails.items()}) + EDGE


# each pattern first looks whether the next character can begin a match at all
WIKI_MARKS = (
    r"(?U)(?=[\[(\d])(?i:\[\[User:[^\]]*\]\]"
    rf"|\([{BLANKS}]*(?:talk|UTC)[{BLANKS}]*\)"
    rf"|{BEFORE_WORD}\d{{1,2}}:\d{{2}},[{BLANKS}]*(?:{'|'.join(fixed.MONTHS)})"
    rf"[{BLANKS}]+\d{{1,2}},[{BLANKS}]*\d{{4}}{AFTER_WORD})"
)
URLS_AND_IPS = (
    rf"(?U)(?=[hHwW\d])(?i:https?://[^{BLANKS}]+|www\.[^{BLANKS}]+"
    rf"|{BEFORE_WORD}(?:{fixed.IP_OCTET}\.){{3}}{fixed.IP_OCTET}{AFTER_WORD})"
)
CONTRACTIONS = whole_words(fixed.CONTRACTIONS, then="(?=[a-z]*'|annot)")
PROFANITY = _stems()
REPEATED_PUNCTUATION = rf"([{fixed.REPEATABLE_PUNCTUATION}])\1+"
NOT_ALPHANUMERIC = rf"(?U)[^a-z0-9{BLANKS}]+"
# a single blank in front of other text is already what a run becomes, so it is passed over
BLANK_RUN = rf"(?U)(?! [^{BLANKS}])[{BLANKS}]+"
NOT_ALPHANUMERIC_RUN = "(?! [a-z0-9])[^a-z0-9]+"
WORD_GAP = rf"(?U)[{BLANKS}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
