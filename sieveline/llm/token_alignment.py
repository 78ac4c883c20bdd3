"""Alignment of two tokenizers over the same texts, and which of their tokens go together in the corpus.

*Encoding.* A reads a blank and the text, B the text (it puts the blank there itself). Both vocabularies begin anew where white
space follows something else: A's pattern looks at nothing before, and no piece of B holds a word mark, line end or tab after another
character (pattern and pieces are checked). So a text falls into chunks, white space and what follows up to the next, that are encoded
apart, and a worker remembers them for a while.

*Coalescing.* The tokens of both are byte ranges. All are sorted by start; where a start reaches the running maximum of the ends
before it, a new group begins. Within a group, the overlapping pairs of an A and a B token are expanded; there are fewer than the
group has tokens, since each side tiles the group. Pairs that end together are links.

*Counts.* Each text's distinct linked pairs with their numbers are written once, then added up by pair, combined before the
shuffle. The most frequent pairs, ``max_frequent`` of them at most, are broadcast, so that no pair is hot in what follows; texts look
their pairs up there. Pairs beyond are joined with the table of counts.

Texts that are null or empty, or that a tokenizer does not give back byte by byte (B reads U+2581 as a blank), have no
tokens: zeros, an empty digest, and no part in the counts. Rows are kept as they are, repeated ids and null ids too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import keep_table, ship_package
from sieveline.llm.piece_codec import load_pieces
from sieveline.llm.token_counts import byte_letters, load_merges

MEMO, MEMO_CHARS = 250_000, 16_000_000  # chunks that a worker remembers, and their length in all
SLICE = 1_000_000  # characters that are looked at together
JOINED = 20_000  # characters of chunks that are encoded in one text
STATS = ("n_a", "n_b", "n_groups", "n_links")


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, and the number of the group of each in that order."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    return order, np.cumsum(np.append(0, starts[order][1:] >= reached[:-1])) if len(order) else order


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs of two sorted tilings."""
    low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    sizes = high - low
    a = np.repeat(np.arange(len(a_starts)), sizes)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[a]


class Aligner:
    """Both tokenizers of a worker, and what it remembers of chunks."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte_of = {letter: n for n, letter in enumerate(byte_letters())}
        entries = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda e: e[1])
        special = {n for n, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = {n: t.encode() if n in special else bytes([byte_of[c] for c in t]) for t, n in entries}
        b = self.b
        inner = {c for p in map(b.id_to_piece, range(b.vocab_size())) if len(p) > 1 for c in p} - {"▁"}
        breaks = " " + "".join(c for c in "\n\t\r" if c not in inner)
        self.chunks = re.compile(rf"\s*\S+(?:[^\S{breaks}]\s*\S*)*|\s+").findall
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        self.a_length = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # what is written for a token: A ids end in a comma, the last of a group in a bar; B ids in a comma, the last of a group in a semicolon
        n = len(self.a_length)
        self.bar, self.b_comma, self.semicolon = n, 2 * n, 2 * n + len(self.b_length)
        self.written = [f"{i}{end}" for ids, ends in ((n, ",|"), (len(self.b_length), ",;")) for end in ends for i in range(ids)]
        self.restart()

    def restart(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []  # the groups of each chunk as text
        self.pool: list[np.ndarray] = []  # the links of all chunks, A id in the high half
        self.stats = np.zeros((0, 2 + len(STATS)), np.int64)  # not given back, STATS, end of the links in the pool
        self.chars = 0

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both tokenizers' ids of texts that start with white space."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank first, unless nothing follows; where the text has none it is a token of its own and goes again
        b = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        blank = [self.b.piece_to_id("▁")]
        return a, [np.array(blank if t == " " else x if t.startswith(" ") else x[1:], np.int64) for x, t in zip(b, texts)]

    def given_back(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        raw = text.encode("utf-8", "surrogatepass")
        return b"".join([self.a_bytes[i] for i in a.tolist()]) == raw == b"".join([self.b_bytes[i] for i in b.tolist()])

    def learn(self, keys: list[str]) -> None:
        """Encode chunks and remember their groups and links.

        Chunks are encoded one behind the other in one text, as they would stand in a document. Where a tokenizer does not give that text
        back, its chunks are encoded one by one, and those that are not given back are marked.
        """
        texts, members, size = [[]], [[]], 0
        for key in keys:
            alone = key[-1].isspace()  # only the end of a text may follow it
            if size + len(key) > JOINED or alone:
                texts.append([])
                members.append([])
                size = 0
            texts[-1].append(key)
            size = JOINED if alone else size + len(key)
        texts = [t for t in texts if t]
        joined = ["".join(t) for t in texts]
        a_all, b_all, order = [], [], []
        for a, b, text, part in zip(*self.encode(joined), joined, texts):
            if self.given_back(a, b, text):
                a_all.append(a)
                b_all.append(b)
                order += part
            else:
                for x, y, key in zip(*self.encode(part), part):
                    if self.given_back(x, y, key):
                        a_all.append(x)
                        b_all.append(y)
                        order.append(key)
                    else:
                        self._remember([key], [""], np.array([[1] + [0] * len(STATS)]), np.zeros(0, np.int64), np.zeros(1, np.int64))
        if not order:
            return
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_starts, b_starts = a_ends - self.a_length[a], b_ends - self.b_length[b]
        by_start, group = coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]))
        group_of = np.empty(len(group), np.int64)
        group_of[by_start] = group
        a_group, b_group = group_of[: len(a)], group_of[len(a) :]
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        code = np.concatenate([a + self.bar * a_last, b + np.where(b_last, self.semicolon, self.b_comma)])
        in_turn = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), group_of))  # stable: of each group A, then B
        written = [self.written[c] for c in code[in_turn].tolist()]
        x, y = overlaps(a_starts, a_ends, b_starts, b_ends)
        linked = a_ends[x] == b_ends[y]
        x, y = x[linked], y[linked]
        # every chunk ends where a group ends; its tokens, groups and links lie between its bytes
        bounds = np.cumsum([0, *(len(k.encode("utf-8", "surrogatepass")) for k in order)])
        a_at, b_at = np.searchsorted(a_starts, bounds), np.searchsorted(b_starts, bounds)
        group_at, link_at = np.append(a_group, group.max() + 1)[a_at], np.searchsorted(a_starts[x], bounds)
        stats = np.column_stack([np.zeros(len(order), np.int64)] + [np.diff(v) for v in (a_at, b_at, group_at, link_at)])
        cut = (a_at + b_at).tolist()
        self._remember(order, ["".join(written[i:j]) for i, j in zip(cut, cut[1:])], stats, a[x] << 32 | b[y], link_at[1:])

    def _remember(self, keys: list[str], names: list[str], stats: np.ndarray, links: np.ndarray, ends: np.ndarray) -> None:
        base = self.stats[-1, -1] if len(self.stats) else 0
        self.number.update(zip(keys, range(len(self.names), len(self.names) + len(keys))))
        self.names += names
        self.pool.append(links)
        self.stats = np.concatenate([self.stats, np.column_stack([stats, base + ends])])
        self.chars += sum(map(len, keys)) + sum(map(len, names))

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """STATS, groups as text, distinct links and their numbers, of every text."""
        none = np.zeros(len(STATS), np.int64), "", np.empty(0, np.int64), np.empty(0, np.int64)
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= SLICE):
                size += len(texts[stop] or "")
                stop += 1
            found, number = [self.chunks(" " + text) if text else [] for text in texts[start:stop]], self.number
            new = set().union(*found).difference(number)
            if new:
                self.learn(sorted(new))
            self.pool = [np.concatenate(self.pool)] if self.pool else []
            for parts in found:
                at = np.array([number[p] for p in parts], np.int64)
                total = self.stats[at, :-1].sum(axis=0)
                if not parts or total[0]:
                    yield none
                else:
                    names, sizes = self.names, self.stats[at, -2]
                    first = self.stats[at, -1] - sizes
                    links = self.pool[0][np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                    keys, counts = np.unique(links, return_counts=True)
                    yield total[1:], "".join([names[n] for n in at.tolist()])[:-1], keys, counts
            start = stop
            if len(self.names) > MEMO or self.chars > MEMO_CHARS:
                self.restart()


_ALIGNERS: dict[int, Aligner] = {}


def aligner(shared) -> Aligner:
    """The worker's aligner of a broadcast pair of vocabularies."""
    vocabulary, model = shared.value
    key = hash((vocabulary, model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(vocabulary, model)
    return _ALIGNERS[key]


def spans(groups: str, a_length: list[int]) -> list[dict]:
    """``first_byte, end_byte, a, b`` of groups written as text."""
    out, at = [], 0
    for group in groups.split(";") if groups else []:
        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
        end = at + sum(a_length[i] for i in a)
        out.append({"first_byte": at, "end_byte": end, "a": a, "b": b})
        at = end
    return out


def align_documents(
    df: DataFrame, vocabulary_path: str, model_path: str, max_frequent: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """One row per input row.

    ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: tokens, groups, links, how many links belong to the pair
    that their B token is in most often in the corpus, the counts of all links' pairs together, and the digest of the groups. With
    ``with_groups`` also ``groups``: byte range (of a blank and the text), A ids and B ids of each.
    """
    spark = df.sparkSession
    ship_package(spark)
    load_merges(vocabulary_path), load_pieces(model_path)  # both kinds begin anew at every word, or this fails
    shared = spark.sparkContext.broadcast((Path(vocabulary_path).read_text(encoding="utf-8"), Path(model_path).read_bytes()))
    groups_type = "array<struct<first_byte: long, end_byte: long, a: array<int>, b: array<int>>>"
    made = T.StructType.fromDDL(", ".join(f"{s} long" for s in STATS) + ", groups_sha256 string, pair array<long>, n array<int>" + (f", groups {groups_type}" if with_groups else ""))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(shared)
        for batch in batches:
            found = list(one.align(batch.column("_text").to_pylist()))
            stats = np.array([f[0] for f in found], np.int64).reshape(-1, len(STATS))
            offsets = pa.array(np.cumsum([0] + [len(f[2]) for f in found]), pa.int32())
            columns = {"row": batch.column("row"), "id": batch.column("id")} | {s: pa.array(stats[:, k], pa.int64()) for k, s in enumerate(STATS)} | {
                "groups_sha256": pa.array([hashlib.sha256(f[1].encode()).hexdigest() if f[1] else "" for f in found], pa.string()),
                "pair": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[2] for f in found] or [[]]), pa.int64())),
                "n": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[3] for f in found] or [[]]), pa.int32())),
            }
            if with_groups:
                item = pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
                columns["groups"] = pa.array([spans(f[1], one.a_length.tolist()) for f in found], pa.list_(item))
            yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", df.schema[id_col].dataType), *made.fields])
    aligned = keep_table(rows.mapInArrow(encode, schema), "aligned-texts")

    counts = aligned.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = keep_table(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "aligned-pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # at most one row for each token of B
    marked = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    sizes = counts.groupBy(F.floor(F.log2("count")).alias("size")).count().orderBy(F.desc("size")).collect()  # at most 64 rows
    least, held = 1 << 63, 0
    for r in sizes:
        held += r["count"]
        if held > max_frequent:
            break
        least = 1 << r["size"]
    all_held = held <= max_frequent
    frequent = marked.filter(F.col("count") >= F.lit(min(least, (1 << 63) - 1))).toArrow()  # at most max_frequent rows
    order = np.argsort(np.asarray(frequent.column("pair")))
    table = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy()[order] for c in ("pair", "count", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            sizes = np.asarray(batch.column("pair").value_lengths())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            pair, n = np.asarray(batch.column("pair").flatten()), np.asarray(batch.column("n").flatten()).astype(np.int64)
            at = np.searchsorted(known, pair)
            at[at == len(known)] = 0
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if hit.any():
                np.add.at(sums, owner[hit], n[hit] * count[at[hit]])
                np.add.at(bests, owner[hit], n[hit] * best[at[hit]])
            others = pa.array(np.append(0, np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))), pa.int32())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carried} | {
                "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()),
                "pair": pa.ListArray.from_arrays(others, pa.array(pair[~hit], pa.int64())), "n": pa.ListArray.from_arrays(others, pa.array(n[~hit], pa.int32())),
            })

    carried = [c for c in aligned.columns if c not in ("pair", "n")]
    fields = [f for f in schema.fields if f.name in carried] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
    out = aligned.mapInArrow(look_up, T.StructType([*fields, *[f for f in schema.fields if f.name in ("pair", "n")]]))
    if not all_held:
        out = keep_table(out, "aligned-rest")
        rest = out.select("row", F.inline(F.arrays_zip("pair", "n"))).join(marked, "pair")
        rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"))
        out = out.join(rest, "row", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        })
    return out.select(F.col("id").alias(id_col), *STATS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
