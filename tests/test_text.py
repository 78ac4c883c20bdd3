"""Cleaning steps against straightforward one-pass Python, on generated and on chosen strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text
from sieveline.operators import profile as P

PIECES = (
    list(fixed.CONTRACTIONS)
    + ["b-a-s-t-a-r-d", "d-a-m-n", "n-i-g-g", "f@@u*ck", "fuuucking", "shitty", "bi.tches", "asshole", "cunts", "damned"]
    + ["'ve", "'d", "'s", "'ll", "-", "*", "@", "#", ".", "!", "??", ",,", " ", "  ", "\t", "\n", " ", "\x1c"]
    + ["é", "ñ", "Ü", "ß", "x", "i", "the", "CAPS", "12:34, January 5, 2010", "(talk)", "( UTC )", "[[User:A b]]"]
    + ["http://a.b/c", "www.x", "1.2.3.4", "999.999.999.999", "2001", "hTTp://Q", "&amp;", "&lt;", "_"]
)


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(6000)]


def one_pass(pattern, replacement, texts, flags=0):
    compiled = re.compile(pattern, flags)
    return [compiled.sub(replacement, t) for t in texts]


def test_contractions_equal_one_pass(column, strings):
    low = [s.lower() for s in strings]
    keys = sorted(fixed.CONTRACTIONS, key=len, reverse=True)
    want = one_pass(r"\b(?:" + "|".join(map(re.escape, keys)) + r")\b", lambda m: fixed.CONTRACTIONS[m.group()], low)
    assert column(text.expand_contractions, low) == want


def test_profanity_equals_one_pass(column, strings):
    low = [s.lower() for s in strings]
    gap = fixed.PROFANITY_SEPARATORS + "*"
    groups = [
        rf"(?P<{stem}>\b{gap.join(c + '+' for c in fixed.SHORT_STEMS.get(stem, stem))}{ending}\b)"
        for stem, ending in fixed.PROFANITY_STEMS.items()
    ]
    want = one_pass("|".join(groups), lambda m: m.lastgroup, low)
    assert column(text.deobfuscate_profanity, low) == want


def test_wiki_and_urls_equal_python(column, strings):
    wiki = (
        r"\[\[User:[^\]]*\]\]|\(\s*(?:talk|UTC)\s*\)|\b\d{1,2}:\d{2},\s*(?:"
        + "|".join(fixed.MONTHS) + r")\s+\d{1,2},\s*\d{4}\b"
    )
    octet = fixed.IP_OCTET
    url = rf"https?://\S+|www\.\S+|\b(?:{octet}\.){{3}}{octet}\b"
    assert column(text.strip_wiki, strings) == one_pass(wiki, " ", strings, re.I)
    assert column(text.strip_urls_ips, strings) == one_pass(url, " ", strings, re.I)


def test_endings_equal_python(column, strings):
    low = [s.lower() for s in strings]
    single = one_pass(r"([!?.,])\1+", r"\1", low)
    alnum = one_pass(r"[^a-z0-9\s]+", " ", single)
    want = [s.strip() for s in one_pass(r"\s+", " ", alnum)]
    assert column(text.collapse_punct, low) == single
    assert column(text.strip_non_alnum, single) == alnum
    assert column(text.squeeze_whitespace, alnum) == want
    assert column(text.keep_alnum_words, low) == want
    assert column(text.normalize_message, strings) == [s.strip().lower() for s in strings]


def test_caps_and_fold(column, strings):
    def caps(s):
        letters = [c for c in s if c.isalpha()]
        return bool(letters) and sum(c.isupper() for c in letters) / len(letters) > 0.5

    assert column(text.mostly_caps, strings) == [caps(s) for s in strings]
    samples = ["año Ñ ü Ü", "ﬁne Ⅷ ①", "é́x", "q̣̇", "ｆｕｌｌ", "한국", "a\U00010a01b", "plain"]
    want = ["año Ñ ü Ü", "fine VIII 1", "ex", "q", "full", "한국", "ab", "plain"]
    assert column(text.unicode_fold, samples) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""), ("", ""), (" \t\n ", ""),
        ("HTTP://EXAMPLE.COM/X", "CAPSLOCKFLAG "),
        ("año", "a o"),
        ("don’t", "don t"),
        ("don't", "do not"),
        ("b-a-s-t-a-r-d-a-m-n", "bastard a m n"),
        ("you'd've", "you would ve"),
        ("from 999.999.999.999 now", "from now"),
        ("&amp;lt; ok", "lt ok"),
        ("WHAT THE F@CK", "CAPSLOCKFLAG what the f ck"),
    ],
)
def test_clean_text_cases(column, raw, want):
    assert column(text.clean_text, [raw]) == [want]


def test_switches_and_custom_steps(column):
    off = text.CleanConfig(
        unescape_html=False, normalize_unicode=False, detect_caps=False, strip_wiki=False, strip_urls=False,
        expand_contractions=False, deobfuscate=False, collapse_punct=False, strip_non_alnum=False,
        custom_steps=(lambda c: F.concat(c, F.lit("!")), F.upper),
    )
    assert column(lambda c: text.clean_text(c, off), ["  Don't   É&amp; "]) == ["DON'T É&AMP;!"]


def test_counters_on_worked_examples(spark):
    rows = [
        (0, "I don't think you've READ it!!! ok??"), (1, "f@ck, fuck & sh.i.t"), (2, None), (3, "  "),
        (4, "café &amp; 1.2.3.4 http://x.y"), (5, "SHOUTING (talk) [[User:A]]"), (6, "plain"),
    ]
    df = spark.createDataFrame(rows, "id int, comment_text string")
    got = {r["step"]: (r["rows_affected"], r["total_matches"]) for r in P.step_counters(df).collect()}
    assert got == {
        "html_unescape": (1, 1), "unicode_normalization": (1, 1), "capslock_detection": (1, 1),
        "wiki_noise_removal": (1, 2), "url_ip_removal": (1, 2), "contraction_expansion": (1, 2),
        "profanity_deobfuscation": (1, 2), "repeated_punct_collapse": (1, 2), "non_alnum_strip": (3, 6),
        "empty_or_nan": (2, 2),
    }
    top = {r["contraction"]: r["n"] for r in P.contraction_top(df).collect()}
    assert top == {"don't": 1, "you've": 1}
    assert {r["word"]: r["n"] for r in P.profanity_by_word(df).collect()} == {"fuck": 1, "shit": 1}
    tracked = P.tracked_stages(df, "comment_text", text.CleanConfig()).select("id", "_clean")
    plain = P.clean_messages(df).select("id", "comment_text")
    assert sorted(map(tuple, tracked.collect())) == sorted(map(tuple, plain.collect()))
