"""Encodings and counts against the libraries that define them."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
import tokenizers  # noqa: E402

from sieveline.llm import piece_codec, token_counts  # noqa: E402
from sieveline.llm.merges import Merger  # noqa: E402

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
EDGES = [
    "", "a", " ", "  ", "   a", "a  b", "a   \n  b", "\n", "\n\n", "a\n", "\na", "▁", "▁▁x ▁", " " * 100, " " * 17 + "x", "日本語 テキスト 😀😀 a😀b",
    "Hello  world\n\tfoo\x00 　 é <s> </s> <0x41> <unk>", "=-=-=-======----" * 30, "<|endoftext|>", "a<|endoftext|>b !<|endoftext|", "don't we're I'll 're''ll",
    "x" * 3000, "ab" * 2000 + " " * 500,
]


def noise(alphabet, n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, most))) for _ in range(n)]


def test_pieces_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.Codec(piece_codec.load_pieces(PIECES))
    for text in EDGES + noise("abeinstr  ▁\n.,!é日😀\t0123ABTH", 2000, 60, 1):
        ids = library.encode(text, num_threads=1)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids) == own.run(text)[1], text


def test_backtracking_equals_merging():
    codec = piece_codec.Codec(piece_codec.load_pieces(PIECES))
    for text in noise("thenadrsiongéè", 1000, 25, 3):
        if codec.chars.issuperset(text):
            assert codec.merger.encode(text) == codec._merge_long(text) == codec.merger.merge(list(text))


def test_backtracking_goes_back():
    """A vocabulary in which the longest match is wrong."""
    ranks = {"a": 0, "b": 0, "c": 0, "bc": 1, "ab": 2, "abc": 9}
    merger = Merger(ranks, lambda x, y: ranks.get(x + y))
    assert merger.encode("ab") == ["ab"] and merger.encode("abc") == ["abc"] and merger.encode("abbc") == ["ab", "bc"]
    assert not merger.fits("ab", "c") and merger.fits("a", "b") is False and merger.encode("abd"[:2]) == ["ab"]
    assert merger.prefixes("abbc") == [0, 1, 1, 2, 2]


def test_counts_and_prefixes_equal_the_library():
    library, own = tokenizers.Tokenizer.from_file(BYTES), token_counts.Counter(token_counts.load_merges(BYTES))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in EDGES:
        assert own.count(text) == count(text), text
    for text in EDGES[:20] + noise("abeinstr   \n\n\t.,!é日😀ABTH'''sreveld0123", 300, 40, 2):
        stored = own.prefix_counts(text)
        assert stored == [count(text[:k]) for k in range(len(text) + 1)], text
        cut = own.longest_prefix(stored, 5)
        assert stored[cut] <= 5 and all(n > 5 for n in stored[cut + 1 :])


def test_tables(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, None, None), (3, "", "y"), (None, "three", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = piece_codec.encode_documents(df, PIECES).collect()
    assert len(out) == 5 and sorted(r["n_tokens"] for r in out)[:2] == [0, 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["ids_sha256"], r["decoded_sha256"]) for r in out if r["doc_id"] in (2, 3)} == {(empty, empty)}
    assert {r["decoded"] for r in out if r["doc_id"] == 1} == {"one two"}
    counted = {r["doc_id"]: r for r in token_counts.count_tokens(df, BYTES, 1, with_prefixes=True).collect()}
    assert counted[1]["n_tokens"] == 2 and counted[1]["over_limit"] and counted[1]["cut_at"] == 3 and counted[2]["n_bytes"] == 0
    assert piece_codec.encode_documents(df.limit(0), PIECES).count() == 0 and token_counts.count_tokens(df.limit(0), BYTES, 9).count() == 0
