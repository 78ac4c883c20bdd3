"""Phrase mining against plain counting, and the bound of the summaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import phrases

S = "doc_id long, text string, lang string"


def truth(rows, least, top):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    frequent = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in frequent.items():
        inside = any(lang == other and len(v) > len(w) and 100 * n >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), n in frequent.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], total[lang]))
    return sorted((lang, n + 1, p.decode(), -a, l, r, t, -s) for lang, found in out.items() for n, (s, a, p, l, r, t) in enumerate(sorted(found)[:top]))


def corpus(seed, n):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["é", "ß", "Ü", "x\x0b", "\x1f", "a.b", "!"]
    fixed = ["red fish swims", "new York City hall", "one two three four five six", "a\tb  a b a b"]
    rows = []
    for i in range(n):
        words = [r.choice(pool) if r.random() < 0.7 else r.choice(fixed) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", " ", "\t", ", "]).join(words), r.choice(["en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("capacity", [8, 1 << 20])
def test_equals_plain_counting(spark, capacity):
    """With few counters summaries are pruned all the time; the result is the same."""
    rows = corpus(1, 160)
    df = spark.createDataFrame(rows, S).repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, min_count=12, top=30, capacity=capacity).collect()))
    assert got == truth(rows, 12, 30) and len({r[0] for r in got}) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), max_size=200), st.integers(1, 12), st.integers(2, 60))
def test_summaries_keep_every_frequent_key(stream, capacity, threshold):
    whole, parts = Counter(), [phrases.Summary(capacity, threshold) for _ in range(3)]
    for n, (key, count) in enumerate(stream):
        whole[key] += count
        parts[n % 3].merge(np.array([key], np.uint32), np.array([count]))
    mass = sum(whole.values())
    merged = phrases.Summary(capacity, threshold)
    for one in parts:
        merged.merge(one.keys, one.counts, one.lost)
    if merged.lost < threshold:
        assert {k for k, n in whole.items() if n >= threshold} <= set(merged.survivors().tolist())
    assert merged.lost * (capacity + 1) <= mass + 2 * threshold * (capacity + 1)
    one = phrases.Summary(capacity, threshold)
    for key, count in stream:
        one.merge(np.array([key], np.uint32), np.array([count]))
    assert one.lost < threshold and {k for k, n in whole.items() if n >= threshold} <= set(one.survivors().tolist())
    if capacity > mass / threshold:
        assert len(one.keys) <= capacity


def test_edges(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "x " * 30_000, "en"), (3, "x " * 30_000, "en"), (None, "a b", None), (4, "...", "en")]
    df = spark.createDataFrame([(*r, 7, 9) for r in rows], S + ", score long, phrase long")
    got = sorted(map(tuple, phrases.collocations(df, min_count=2).collect()))
    assert got == truth(rows, 2, 2000) and got[0][:4] == ("en", 1, "x x", 59_998)
    assert phrases.collocations(df.limit(0), min_count=2).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**13, 10**14, 10**13, 10**13)], "a long, n long, l long, r long")
    score = phrases.score_of(1000)
    assert big.select(score.alias("s")).first()["s"] == 1000 * 10**13 * 10**14 // 10**26
    assert big.withColumn("l", F.lit(3)).withColumn("r", F.lit(10**13 + 1)).select(score.alias("s")).first()["s"] == 1000 * 10**27 // (3 * (10**13 + 1))
