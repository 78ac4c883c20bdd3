"""Exact token counts of byte-level merge vocabularies, kept for every prefix of a text.

A text is cut at special strings and into words as the vocabulary's own pattern cuts it. Within a word, dynamic
programming over its bytes finds the last token of each prefix: the one that ends there and fits the last token of the
prefix before it (`merges.Merger.prefixes`). The number of tokens at every prefix is a by-product, so a budget or a
truncation is answered from the stored counts without encoding anything again.

Words are remembered per worker. The vocabulary is read on the driver and broadcast (a few MB). One projection, no
shuffle: lost tasks are run again. Null and empty texts have no tokens. Rows are kept as they are, repeated ids too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import ship_package, texts
from sieveline.llm.merges import MEMO, Merger
from sieveline.llm.piece_codec import shared

# fixed values: how the vocabulary's pattern cuts a text, and its contractions of two letters
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def load_merges(path: str) -> dict:
    """Tokens, merges and special strings of a byte-level merge vocabulary (a .json file of the tokenizers library)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = spec["normalizer"] is None and not model.get("ignore_merges") and not model.get("byte_fallback")
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or not plain:
        raise ValueError("not a byte-level merge vocabulary of the plain kind")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"pieces": list(model["vocab"]), "merges": merges, "special": [t["content"] for t in spec["added_tokens"]]}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable bytes for themselves, the others from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in keep else next(others)) for b in range(256)]


class Counter:
    def __init__(self, table: dict):
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        ranks = {pair: r for r, pair in enumerate(table["merges"])}
        self.merger = Merger([*letters, *(a + b for a, b in table["merges"])], lambda a, b: ranks.get((a, b)))
        self.find = regex.compile(PATTERN).findall
        self.special = sorted(table["special"], key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memo: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def word(self, word: str) -> list[int]:
        """Token counts of every character prefix of one word of the pattern, from the empty one on."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.merger.prefixes(raw.decode("latin-1").translate(self.letters))
        if len(raw) == len(word):
            return counts
        out, at = [0], 0
        for char in word:
            at += len(char.encode("utf-8", "surrogatepass"))
            out.append(counts[at])
        return out

    def _word_count(self, word: str) -> int:
        count = self.memo.get(word)
        if count is None:
            raw = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            count = self.memo[word] = self.merger.prefixes(raw)[-1]
        return count

    def _spaced(self, word: str) -> int:
        """Tokens of a blank and what follows up to the next blank; -1 if white space at an end may belong to a longer run."""
        if not word or word[0].isspace() or word[-1].isspace():
            count = -1
        else:
            count = sum([self._word_count(w) for w in self.find(" " + word)])
        if len(self.spaced) >= MEMO:
            self.spaced.clear()
        self.spaced[word] = count
        return count

    def _plain_count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            get, count = self.spaced.get, self._spaced
            counts = [get(w) or count(w) for w in rest]
            if -1 not in counts:
                return sum(counts) + sum(map(self._word_count, self.find(first)))
        return sum(map(self._word_count, self.find(text)))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string is one."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain_count(text)
        parts = self.cut.split(text)
        return sum(map(self._plain_count, parts)) + len(parts) - 1

    def _plain_prefixes(self, text: str) -> list[int]:
        found, out, base = self.find(text), [0], 0
        for k, word in enumerate(found):
            counts = self.word(word)
            if word in LONG_CONTRACTIONS:
                counts[2] = 2  # the apostrophe and one letter are not a contraction yet
            run = word.isspace() and k + 1 < len(found) and found[k + 1][0].isspace()
            out += [base + c for c in counts[1:]]
            base += counts[-1]
            if run:  # cut right after the next blank, the run would be one word
                found_next = self.word(word + found[k + 1][0])[-1]
                lead = base - counts[-1] + found_next
                following = self.word(found[k + 1])
                out += [lead] + [base + c for c in following[2:]]
                base += following[-1]
                found[k + 1] = ""
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:k]`` for every k from 0 to its length."""
        out, base, start = [0], 0, 0
        for match in [*(self.cut.finditer(text) if self.cut else ()), None]:
            plain = text[start : match.start() if match else len(text)]
            inner = self._plain_prefixes(plain + (match.group()[:-1] if match else ""))
            out += [base + c for c in inner[1:]]
            if match:
                base += self._plain_prefixes(plain)[-1] + 1
                out.append(base)
                start = match.end()
        return out

    def longest_prefix(self, counts: list[int], budget: int) -> int:
        """The length of the longest prefix of at most ``budget`` tokens, from stored counts (which need not ascend)."""
        return next(k for k in range(len(counts) - 1, -1, -1) if counts[k] <= budget)


_COUNTERS: dict[int, Counter] = {}


def counter(table) -> Counter:
    """The worker's counter of a broadcast vocabulary."""
    found = _COUNTERS.get(table.id)
    if found is None:
        _COUNTERS.clear()
        found = _COUNTERS[table.id] = Counter(table.value)
    return found


def count_tokens(
    df: DataFrame, vocabulary_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False
) -> DataFrame:
    """Count the tokens of whole texts.

    Returns ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens); with ``with_prefixes``
    also ``prefix_counts`` (tokens of each character prefix) and ``cut_at`` (characters of the longest prefix of at
    most ``limit`` tokens).
    """
    spark = df.sparkSession
    ship_package(spark)
    table = shared(spark, load_merges(vocabulary_path))
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ]
    if with_prefixes:
        fields += [T.StructField("prefix_counts", T.ArrayType(T.IntegerType())), T.StructField("cut_at", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(table)
        for batch in batches:
            found = texts(batch, "_text")
            columns = {id_col: batch.column(id_col), "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in found], pa.int64())}
            if with_prefixes:
                stored = [one.prefix_counts(t) for t in found]
                counts = [s[-1] for s in stored]
            else:
                counts = [one.count(t) for t in found]
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())}
            if with_prefixes:
                columns |= {"prefix_counts": pa.array(stored, pa.list_(pa.int32())), "cut_at": pa.array([one.longest_prefix(s, limit) for s in stored], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))
