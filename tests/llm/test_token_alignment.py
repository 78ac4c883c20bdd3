"""Alignment of two tokenizers against whole-text encodings, byte sets and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm import token_alignment as ta
from sieveline.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
S = "doc_id long, text string, n_a string"


def encode(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {letter: n for n, letter in enumerate(byte_letters())}
    for text in texts:
        if not text:
            yield None
            continue
        x = [(i, t.encode() if t == "<|endoftext|>" else bytes(byte_of[c] for c in t)) for i, t in ((i, a.id_to_token(i)) for i in a.encode(" " + text, add_special_tokens=False).ids)]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        yield (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else None


def truth(texts):
    rows, corpus = [], Counter()
    for found in encode(texts):
        if found is None:
            rows.append((0, 0, [], []))
            continue
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in found]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(side, es) if start < e <= end) for side, es in zip(found, ends)))
            start = end
        links = [(i, j) for (i, _), e in zip(found[0], ends[0]) for (j, _), f in zip(found[1], ends[1]) if e == f] if len(ends[0]) < 400 else [
            (dict(zip(ends[0], [i for i, _ in found[0]]))[e], dict(zip(ends[1], [j for j, _ in found[1]]))[e]) for e in shared
        ]
        corpus.update(links)
        rows.append((len(found[0]), len(found[1]), groups, links))
    highest = {}
    for (_, j), n in corpus.items():
        highest[j] = max(highest.get(j, 0), n)
    return [
        (a, b, len(g), len(x), sum(corpus[p] == highest[p[1]] for p in x), sum(corpus[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, x in rows
    ]


def corpus(seed, n):
    r = random.Random(seed)
    pool = ["the", "tokenizer", "straße", "don't", "x'll", "日本語", "🙂", "é", "1234567", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "a▁b", " ", "\n\n", "\t", "", "", "...", "—", "naïveté", "\x1c", " ", "ab\x00c"]
    gaps = [" ", " ", " ", " ", "  ", "\n", " \n"]
    return [r.choice(gaps).join(r.choice(pool) + r.choice(["", "", "s", "!"]) + r.choice(gaps[:5]) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("max_frequent", [0, 40, 1 << 20])
def test_equals_whole_texts(spark, max_frequent):
    """With few or no pairs in the broadcast, the others are joined."""
    texts = [t for t in corpus(3, 250) if "▁" not in t] + corpus(4, 60) + [None, "", " ", "  ", "\n", "word", "word " * 400, "x" * 3000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], S).repartition(4)
    rows = sorted(map(tuple, ta.align_documents(df, A, B, max_frequent=max_frequent).collect()))
    want = truth(texts)
    assert [r[0] for r in rows] == list(range(len(texts)))
    for row, expected in zip(rows, want):
        assert row[1:] == expected, texts[row[0]]


def test_groups_and_repeated_ids(spark):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (None, "other text", "x"), (2, "a▁b", "x")]
    out = ta.align_documents(spark.createDataFrame(rows, S), A, B, with_groups=True).collect()
    assert len(out) == 4 and [r["n_groups"] for r in out if r["doc_id"] == 2] == [0]
    for r in out:
        assert r["n_groups"] == len(r["groups"]) and sum(len(g["a"]) for g in r["groups"]) == r["n_a"]
        assert [g["first_byte"] for g in r["groups"]][1:] == [g["end_byte"] for g in r["groups"]][:-1]
    assert [r["groups"][-1]["end_byte"] for r in out if r["doc_id"] == 1] == [len(" Hello wörld".encode())] * 2
    assert ta.align_documents(spark.createDataFrame([], S), A, B).count() == 0


tiling = st.lists(st.integers(1, 4), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(tiling, tiling)
def test_coalescing_equals_shared_ends(a, b):
    a, b = list(a), list(b)
    (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)) or 1)
    if sum(a) != sum(b):
        (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)))
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    starts, ends = np.concatenate([a_ends - a, b_ends - b]), np.concatenate([a_ends, b_ends])
    order, group = ta.coalesce(starts, ends)
    got = sorted({int(ends[order][group == g].max()) for g in set(group.tolist())})
    assert got == sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
    x, y = ta.overlaps(a_ends - a, a_ends, b_ends - b, b_ends)
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(a_ends[i] - a[i], b_ends[j] - b[j]) < min(a_ends[i], b_ends[j])}
    assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)
