"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

1. *Sketch.* A document is the set of its distinct word shingles. Rounds throw every shingle into a random bin; a bin
   keeps the smallest (round, value) that falls into it, and the rounds go on until every bin is full. After as many
   rounds as there are bins, round ``i`` puts all shingles into bin ``i``, so that every coordinate fills for sets of
   any size. Coordinates of two documents agree with the probability of their Jaccard similarity, concentrated as if
   the bins were drawn independently.
2. *Classes.* Documents with equal sets form a class, known by a digest of the set. Classes, not ids, are what is
   banded, compared and linked, so copies are never expanded into pairs, and an id with several texts has several classes.
3. *Bands.* Classes that agree on all coordinates of a band share a bucket. With 50 bands of 5 a pair at 0.8
   is missed with probability (1 - 0.8^5)^50 = 2e-9. Buckets are never cut or capped.
4. *Estimate.* Two bits of every coordinate go with the class. Pairs that differ in more coordinates than a pair at 0.8
   does with a probability of 4e-11 (6.5 standard deviations) are left out inside the join, before any row is made;
   documents that only share a passage fall away here.
5. *Bound.* A class has a bitmap of its shingles, ``BITS_EACH`` bits for each, folded to the smaller of two sizes to compare. A bit that
   the other lacks is a shingle that the other lacks, so the bitmaps bound the intersection from above. Pairs that cannot
   reach the threshold are refuted for certain, without their texts.
6. *Verification* on the full sets, texts read again from the input. First every class against one hub: of the best known members of
   all its buckets (those that share most buckets with most others: the text that others were made from, if there
   is one) the best known. That is at most one pair a class. Links make components; ``HUB_ROUNDS`` times this is done, against
   members of other components. What is left are pairs of one bucket in different components, and all of these are
   compared, so nothing depends on the choice of hubs. Pairs of one component need no comparison.
7. *Components* by alternating large-star and small-star steps, a logarithmic number of rounds, checkpointed. They are
   mapped to the smallest id of their classes at the end.

Texts move only for documents that have a candidate, sketches only for classes that have company: filters of bounded size leave the
others out before the shuffle, and joins stay exact. A bucket, a class or a hub may be of any size: groups are reduced
by aggregates that combine before the shuffle and joined by sort-merge joins, which split skewed keys. Tables on the way are
deleted when the next one is written.

Null and empty texts, and texts of white space, have the empty set: ``n_shingles`` 0 and no links. Texts shorter than
a shingle have one: all their words. Each row of a repeated id has the class of its own set; rows with different sets
are then one node only by their id: the id's rows, like linked classes, share a component. Null ids take no part in links and get a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import bind
from sieveline.llm.common import forget, keep_table, ship_package, slices, words
from sieveline.llm.filters import Filter, U, collect_filter, divided, mix

BANDS, ROWS = 50, 5
HUB_ROUNDS = 2
BITS_EACH = 8  # bits of the bitmap for each shingle, at least
MEMO = 150_000  # hashes of words that a worker remembers
_HASHES: dict[bytes, int] = {}
FILTER_BITS = 1 << 27  # bits of a filter of ids, classes or buckets, at most
CHUNK = 2048  # shingles times rounds of one step


def _hash_of(word: bytes) -> int:
    if len(_HASHES) >= MEMO:
        _HASHES.clear()
    value = _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return value


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = words(text)
    if not found:
        return np.empty(0, U)
    get = _HASHES.get
    h = np.array([get(w) or _hash_of(w) for w in found], U)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(found))], U)
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for k in range(size):
            out = mix(out + h[k : k + n] + U(0x9E3779B97F4A7C15))
    return np.unique(out)


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The coordinates of a set: (round, value) in one number, the smallest of each bin."""
    full = np.iinfo(np.uint64).max
    out = np.full(bins, full, U)
    shift = U(64 - int(2 * bins).bit_length())
    step = max(1, CHUNK // len(hashes))
    done = 0
    with np.errstate(over="ignore"):
        while done < bins:
            rounds = np.arange(done, min(bins, done + step), dtype=U)[:, None]
            drawn = mix(hashes[None, :] + mix(rounds + U(0x632BE59BD9B4E019)))
            into = (mix(drawn + U(0x9E3779B97F4A7C15)) >> U(33)) % U(bins)
            np.minimum.at(out, into.astype(np.int64).ravel(), ((rounds << shift) | (drawn >> (U(64) - shift))).ravel())
            done += step
            if out.max() != full:
                return out
        for at in np.flatnonzero(out == full):
            i = U(bins + int(at))
            out[at] = (i << shift) | (mix(hashes + mix(np.array([i + U(0x632BE59BD9B4E019)], U))).min() >> (U(64) - shift))
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band."""
    coordinates = coordinates.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93)
        for k in range(rows):
            key = mix(key + coordinates[:, k])
    return key.view(np.int64)


BITS = 0x5555555555555555


def two_bits(coordinates: np.ndarray) -> np.ndarray:
    """The last two bits of every coordinate, 32 to a number."""
    padded = np.zeros(-(-len(coordinates) // 32) * 32, U)
    padded[: len(coordinates)] = coordinates & U(3)
    return np.bitwise_or.reduce(padded.reshape(-1, 32) << (U(2) * np.arange(32, dtype=U)), axis=1).view(np.int64)


def close(a: Column, b: Column, bins: int, percent: int) -> Column:
    """Whether the estimate leaves a link possible. ``a``, ``b``: arrays of `two_bits`."""
    agree = percent / 100 + (1 - percent / 100) / 4
    most = math.ceil(bins * (1 - agree) + 6.5 * math.sqrt(bins * agree * (1 - agree)))
    apart = []
    for k in range(-(-bins // 32)):
        x = a[k].bitwiseXOR(b[k])
        apart.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(BITS))))
    return reduce(Column.__add__, apart) <= most


def node_of(hashes: np.ndarray) -> int | None:
    """The class of a set: 64 bits of its digest."""
    return int(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes())[:8], np.int64)[0]) if len(hashes) else None


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in as many 64-bit numbers, a power of two, as give each `BITS_EACH` bits."""
    cells = 1 << max(0, (BITS_EACH * len(hashes) - 1).bit_length() - 6)
    at = (mix(hashes ^ U(0x2545F4914F6CDD1D)) >> U(20)).astype(np.int64)
    out = np.zeros(cells, U)
    np.bitwise_or.at(out, (at >> 6) & (cells - 1), U(1) << (at & 63).astype(U))
    return out.view(np.int64)


def most_shared(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """The largest intersection that two bitmaps leave possible."""

    def folded(x: Column, size: Column) -> Column:
        # cells that fall together when the larger bitmap is folded
        return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(
            F.sequence(i, F.size(x) - 1, size), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(F.get(x, j)),
        ))

    def lacking(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda acc, c: acc + c)

    def bound(x: Column, y: Column) -> Column:
        return F.least(n_a - lacking(x, y), n_b - lacking(y, x))

    size = F.least(F.size(a), F.size(b))
    return F.when(F.size(a) == F.size(b), bound(a, b)).otherwise(bind(folded(a, size), lambda x: bind(folded(b, size), lambda y: bound(x, y))))


def signatures(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``id, n_shingles, node, keys, bits, cells`` of every row; all but the first two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, nodes, keys, bits, cells = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), size)
                counts.append(len(hashes))
                nodes.append(node_of(hashes))
                drawn = sketch(hashes, bands * rows) if len(hashes) else None
                keys.append(None if drawn is None else band_keys(drawn, bands, rows))
                bits.append(None if drawn is None else two_bits(drawn))
                cells.append(None if drawn is None else bitmap(hashes))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n_shingles": pa.array(counts, pa.int64()), "node": pa.array(nodes, pa.int64()),
                "keys": pa.array(keys, longs), "bits": pa.array(bits, longs), "cells": pa.array(cells, longs),
            })
        _HASHES.clear()

    return df.mapInArrow(run, "id long, n_shingles long, node long, keys array<long>, bits array<long>, cells array<long>")


def filter_of(df: DataFrame, column: str) -> Filter:
    """The distinct numbers of a column as a filter."""
    return collect_filter(df.select(F.col(column).alias("hash")), FILTER_BITS)


def shared_keys(reps: DataFrame, shared: DataFrame) -> DataFrame:
    """``node, key`` of every class, keys that surely are not among ``shared`` left out before any row is made."""
    known = reps.sparkSession.sparkContext.broadcast(filter_of(shared, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat = np.asarray(keys.flatten())
            may = known.value.has(flat.view(U))
            node = np.repeat(np.asarray(batch.column("node")), np.asarray(keys.value_lengths()))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[may], pa.int64()), "key": pa.array(flat[may], pa.int64())})

    return reps.select("node", "keys").mapInArrow(run, "node long, key long")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``a, b, n_a, n_b, shared``: the sizes and the intersection of the full sets of every pair of classes; ``b`` is the side that repeats.

    The text of a class is one of its representative's: rows of that id with another set are left out by their digest.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", F.col("rep").alias("id")), "node")
    needed = keep_table(needed, "neardup-needed")
    read, _ = divided(docs, "id", filter_of(needed, "id"))  # texts of other ids are not shuffled

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [node_of(shingle_set(t.as_py(), size)) == n for t, n in zip(batch.column("text"), batch.column("node").to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))
        _HASHES.clear()

    sides = read.join(needed, "id").select("node", "text").mapInArrow(own, "node long, text string").dropDuplicates(["node"])
    sides = keep_table(sides, "neardup-texts")
    both = pairs.join(sides.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(sides.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            n_a, n_b, shared = [], [], []
            for a, b, b_id in zip(batch.column("text_a"), batch.column("text_b"), batch.column("b").to_pylist()):
                if last != b_id or last_set is None:
                    last, last_set = b_id, shingle_set(b.as_py(), size)
                one = shingle_set(a.as_py(), size)
                n_a.append(len(one))
                n_b.append(len(last_set))
                shared.append(len(np.intersect1d(one, last_set, assume_unique=True)))
            yield pa.RecordBatch.from_pydict({
                "a": batch.column("a"), "b": batch.column("b"), "n_a": pa.array(n_a, pa.int64()),
                "n_b": pa.array(n_b, pa.int64()), "shared": pa.array(shared, pa.int64()),
            })
        _HASHES.clear()

    out = keep_table(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, shared long"), "neardup-verified")
    forget(sides, needed)
    return out


def linked(percent: int):
    return F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``edges`` (``a``, ``b``): the smallest id that can be reached."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = keep_table(edges, "links")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            near = near.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = near.join(least, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    before = mark(edges)
    while True:
        last, edges = edges, keep_table(star(star(edges, True), False), "links")
        after = mark(edges)
        forget(last)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept`` (whether it is the smallest id of its component)."""
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = keep_table(signatures(docs, size, bands, rows), "neardup-signatures")
    known_rows = signed.filter("node IS NOT NULL AND id IS NOT NULL")
    # one row per class, with what its smallest id's row says; equal sets have equal signatures
    classes = keep_table(known_rows.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "neardup-classes")
    copies, others = divided(known_rows, "node", filter_of(classes.filter("rows > 1"), "node"))
    lone = copies.join(classes.filter("rows > 1").select("node"), "node", "left_anti").unionByName(others)
    many = copies.join(classes.filter("rows > 1").select("node", F.col("rep").alias("id")), ["node", "id"]).dropDuplicates(["node"])
    columns = ("node", "n_shingles", "keys", "bits", "cells")
    reps = keep_table(lone.select(*columns).unionByName(many.select(*columns)), "neardup-representatives")
    banded = reps.select("node", F.explode("keys").alias("key"))
    shared = keep_table(banded.groupBy("key").agg(F.count("*").alias("others")).filter("others > 1"), "neardup-shared")
    counted = keep_table(shared_keys(reps, shared).join(shared, "key"), "neardup-buckets")
    known = keep_table(counted.groupBy("node").agg(F.sum("others").alias("known")), "neardup-known")
    members = keep_table(counted.select("key", "node").join(known, "node"), "neardup-members")
    linkable = keep_table(divided(reps, "node", filter_of(known, "node"))[0], "neardup-linkable")  # classes alone in all their buckets are never compared
    forget(reps, shared, counted, known)

    def side(name: str, *more: str) -> DataFrame:
        return linkable.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in more])

    near = (F.col("n_shingles_a") * 100 >= F.col("n_shingles_b") * percent) & (F.col("n_shingles_b") * 100 >= F.col("n_shingles_a") * percent)
    possible = near & close(F.col("bits_a"), F.col("bits_b"), bands * rows, percent)

    most = most_shared(F.col("cells_a"), F.col("cells_b"), F.col("n_shingles_a"), F.col("n_shingles_b"))
    reachable = bind(most, lambda m: m * 100 >= (F.col("n_shingles_a") + F.col("n_shingles_b") - m) * percent)
    sides = ("n_shingles", "bits", "cells")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are linked."""
        pairs = keep_table(pairs, "neardup-pairs")
        found = verify(pairs, docs, classes, size)
        forget(pairs)
        return found.filter(linked(percent)).select("a", "b")

    # rows of one id are one node; such ids are few
    repeated = known_rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most").select("id", "a")
    edges = known_rows.join(repeated, "id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    parts = keep_table(components(edges), "neardup-components")
    best = F.max(F.struct("known", "node", "component"))
    for _ in range(HUB_ROUNDS):
        placed = members.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = placed.groupBy("key").agg(best.alias("first"), F.min("component").alias("least"), F.max("component").alias("largest")).filter("least <> largest")
        opened = keep_table(placed.join(first.select("key", "first"), "key"), "neardup-open")
        second = opened.filter("component <> first.component").groupBy("key").agg(best.alias("second"))
        hub = F.when(F.col("component") != F.col("first.component"), F.col("first")).otherwise(F.col("second"))
        chosen = opened.join(second, "key").select("node", hub.alias("hub")).groupBy("node").agg(F.max("hub").alias("hub"))  # one hub a class
        pairs = chosen.select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        pairs = pairs.join(side("a", *sides), "a").join(side("b", *sides), "b").filter(possible & reachable).select("a", "b")
        new = links(pairs).union(parts.select(F.col("id").alias("a"), F.col("component").alias("b")))  # the components so far stand for all links inside them
        before, parts = parts, keep_table(components(new), "neardup-components")
        forget(before, opened)

    placed = members.join(parts.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "known", F.coalesce("component", "node").alias("component"))
    top = placed.groupBy("key").agg(best["component"].alias("main"), F.min("component").alias("least"), F.max("component").alias("largest")).filter("least <> largest")
    opened = keep_table(placed.join(top.select("key", "main"), "key").select("key", "node", "component", "main"), "neardup-open")
    if not opened.isEmpty():
        x = opened.filter("component <> main").select("key", F.col("node").alias("a"), F.col("component").alias("c_a"), "main").join(side("a", *sides, "keys"), "a")
        y = opened.select("key", F.col("node").alias("b"), F.col("component").alias("c_b")).join(side("b", *sides, "keys"), "b")
        apart = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("a") > F.col("b")))
        # a pair that shares several buckets is made once, in the bucket of the smallest key
        once = x.key == F.array_min(F.array_intersect("keys_a", "keys_b"))
        more = links(x.join(y, (x.key == y.key) & apart & possible & once & reachable).select("a", "b").distinct())
        before, parts = parts, keep_table(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "neardup-components")
        forget(before)
    forget(opened, members)

    placed_classes = classes.join(parts.withColumnRenamed("id", "node"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    smallest = placed_classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = keep_table(placed_classes.join(smallest, "component").select("node", "component_id"), "neardup-placed")
    out = (
        signed.drop("keys", "bits", "cells").join(by_node, "node", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
        .select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    )
    out = keep_table(out, "neardup-result")
    forget(signed, classes, linkable, parts, by_node)
    return out
