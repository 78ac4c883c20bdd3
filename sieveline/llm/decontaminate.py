"""Benchmark decontamination: spaced word seeds, bounds, then local alignment.

1. A test item's seeds are its ordered word triples that stand close together, with up to two words left out between
   them. In any alignment that reaches ``min_similarity``, some three words matched in a row lie that close both in the item and
   in the document (``seed_shape`` counts this for each item length; where triples do not suffice, as for very short items,
   pairs or single words are taken). So no such pair is lost, however common its seeds are: none is dropped.
2. One pass over the documents looks the seeds up. For every item hit, a bound comes first: with 2 for each document word
   that the item has and -1 for every other, no stretch of words can align better than its sum.
3. What the bound leaves is scored by Smith-Waterman alignment over words (match 2, mismatch and gap -1), as a share of the score of
   a full copy, in windows around the hits that are as wide as an alignment of ``min_similarity`` can be. Edited
   and shortened copies keep most of it.

Items go to the tasks in parts of at most about ``max_seeds`` seeds (8 bytes each, besides the items' words); a larger benchmark takes
more passes, with the same result. All is done inside the scan: only (document, item) pairs that are reported are shuffled.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Items of fewer than ``n`` words are too short
to be told from chance and are never reported; null and empty texts have no words. Repeated items and documents of one id
are each compared; a (document, item) pair is reported once, with its best alignment, the earliest of equals. Null ids
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ship_package, slices, texts
from sieveline.llm.neardup import U, _HASHES, _hash_of

TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH, MISS, GAP = 2, -1, 1
PER_WORD = 6  # seeds of an item of the usual shape, per word


def item_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def hashes_of(found: list[bytes]) -> np.ndarray:
    get = _HASHES.get
    return np.array([get(w) or _hash_of(w) for w in found], U)


def found_in(runs: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which of ``runs`` are among the sorted ``seeds``: their places, or -1."""
    at = np.searchsorted(seeds, runs)
    at[at == len(seeds)] = 0
    return np.where(seeds[at] == runs, at, -1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment score and the end (exclusive) of the earliest passage words that reach it."""
    ramp = np.arange(1, len(passage) + 1) * GAP
    before, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        now = np.maximum(before[:-1] + np.where(passage == word, MATCH, MISS), before[1:] - GAP)
        now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + ramp) - ramp, 0)
        top = int(now.max(initial=0))
        if top > best or top == best and top and int(now.argmax()) + 1 < end:
            best, end = top, int(now.argmax()) + 1
        before[1:] = now
    return best, end


def seed_shape(length: int, least: int) -> tuple[int, int]:
    """``size, slack`` of seeds without loss: an alignment of a score of ``least`` has ``size`` matches in a row with at most
    ``slack`` unmatched words between them. ``m`` matches leave ``2 m - least`` for unmatched words, in ``m - 1`` places."""
    counts = range(max(1, math.ceil(least / MATCH)), length + 1)
    for size in (3, 2):
        for slack in range(3):
            if all((m - 1) // (size - 1) * (slack + 1) > MATCH * m - least for m in counts):
                return size, slack
    return 1, 0


def spaced(ids: np.ndarray, size: int, slack: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of all ``size`` known words (``ids`` from 0 to ``words``, -1 is unknown) with at most ``slack`` others between them."""
    keys, places = [], []
    known = np.flatnonzero(ids >= 0)
    for steps in product(range(1, slack + 2), repeat=size - 1):
        if sum(steps) - len(steps) > slack:
            continue
        at, key = known[known < len(ids) - sum(steps)], 0
        for reach in np.cumsum([0, *steps]).tolist():
            word = ids[at + reach]
            at, key = at[word >= 0], (key * words + word)[word >= 0]
        keys.append(key)
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


class ItemIndex:
    """Items by their seeds, and what a document's words can score with each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], min_similarity: float, min_words: int):
        self.names = [name for name, _ in items]
        self.words: dict[bytes, int] = {}
        self.ids = [np.array([self.words.setdefault(w, len(self.words)) for w in found], np.int64) for _, found in items]
        self.base = len(self.words)
        self.least = [math.ceil(MATCH * min(len(ids) * min_similarity, min_words) - 1e-9) for ids in self.ids]
        shapes: dict[tuple[int, int], list[int]] = {}
        for k, ids in enumerate(self.ids):
            shapes.setdefault(seed_shape(len(ids), self.least[k]), []).append(k)
        self.seeds = []
        for shape, members in sorted(shapes.items()):
            keys = [np.unique(spaced(self.ids[k], *shape, self.base)[0]) for k in members]
            owner, key = np.repeat(members, [len(x) for x in keys]), np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            self.seeds.append((shape, distinct, np.append(first, len(key)), owner[order]))

    def hits(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Item numbers and the places of their seeds."""
        out: dict[int, list[int]] = {}
        for shape, distinct, first, owner in self.seeds:
            keys, places = spaced(ids, *shape, self.base)
            if not len(keys) or not len(distinct):
                continue
            at = found_in(keys, distinct)
            for seed, place in zip(at[at >= 0].tolist(), places[at >= 0].tolist()):
                for k in owner[first[seed] : first[seed + 1]].tolist():
                    out.setdefault(k, []).append(place)
        return out

    def leaks(self, found: list[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """``item, similarity, first word, last word`` of every item that reaches the similarity, and in each window where it does."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in found], np.int64)
        own = np.zeros(self.base + 1, bool)
        for k, places in self.hits(ids).items():
            item, least = self.ids[k], self.least[k]
            own[item] = True
            gain = np.where(own[ids], MATCH, MISS)
            own[item] = False
            if most(gain) < least:
                continue
            # m matches and g others score 2 m - g, so an alignment covers m + g words at most
            reach = max(len(item), 3 * len(item) - least)
            hits = np.unique(places)
            for group in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
                start, stop = max(0, int(group[0]) - reach), min(len(ids), int(group[-1]) + reach)
                if most(gain[start:stop]) < least:
                    continue
                passage = ids[start:stop]
                best, end = align(item, passage)
                if best >= least:
                    length = align(item[::-1], passage[:end][::-1])[1]
                    yield self.names[k], best / (MATCH * len(item)), start + end - length, start + end - 1


def most(gain: np.ndarray) -> int:
    """The largest sum of consecutive values."""
    total = np.concatenate([[0], np.cumsum(gain)])
    return int((total - np.minimum.accumulate(total)).max())


def in_parts(items: DataFrame, n: int, max_seeds: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Distinct items of at least ``n`` words, about ``max_seeds`` seeds' worth at a time."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / 4 * PER_WORD / max_seeds))  # few words are shorter than three letters and a blank
    mine = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for k in range(parts):
        split = ((r["item"], item_words(r["text"] or "")) for r in items.filter(mine == k).collect())  # a bounded part
        if some := [(item, found) for item, found in split if len(found) >= max(1, n)]:
            yield some


def contaminated(
    df: DataFrame, benchmark: DataFrame, n: int = 3, min_similarity: float = 0.5, max_seeds: int = 4_000_000, min_words: int = 50,
    id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``id_col, item_col, similarity, first_word, last_word`` of every document that holds (most of) an item.

    ``similarity``: alignment score over that of a full copy. Below ``min_similarity`` a pair is reported if its score is that of
    ``min_words`` verbatim words, so that a long passage of a longer item counts. Word numbers count from 0; ``last_word`` is included.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null").distinct()
    schema, scored = "doc long, item long, similarity double, first_word long, last_word long", None
    for part in in_parts(items, n, max_seeds):
        shared = spark.sparkContext.broadcast(part)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, min_similarity, min_words)
            for batch in slices(batches):
                rows = [(doc, *leak) for doc, text in zip(batch.column("doc").to_pylist(), texts(batch)) for leak in index.leaks(item_words(text))]
                if rows:
                    doc, item, similarity, first, last = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "doc": pa.array(doc, pa.int64()), "item": pa.array(item, pa.int64()), "similarity": pa.array(similarity, pa.float64()),
                        "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
                    })

        some = docs.mapInArrow(score, schema)
        scored = some if scored is None else scored.union(some)
    if scored is None:
        scored = spark.createDataFrame([], schema)
    best = scored.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("first_word")).alias("a"), (-F.col("last_word")).alias("b"))).alias("m")
    )
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("m.similarity").alias("similarity"),
        (-F.col("m.a")).alias("first_word"), (-F.col("m.b")).alias("last_word"),
    )
