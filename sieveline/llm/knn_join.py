"""Exact top-k join of a query set with all vectors, by Voronoi cells.

1. Vectors become integers, floor(scale * x). Pivots are found in a bounded sample (``max_sample`` vectors in hash order
   of the id, a few rounds of moving centres); every vector belongs to the cell of its nearest pivot.
2. Summaries of each cell, combined before the shuffle: number of vectors, radius, and the distances of the
   vectors nearest to the pivot, ``k`` and as many more as one id has rows. With |q.x - q.p| <= |q| |x - p| they bound what a query can score in a cell: from the
   nearest vectors a score that k others reach for certain, from the radius the best score that a cell can hold.
3. A query asks for the cells whose best possible score reaches its certain one. Queries of neighbouring cells form a group,
   as many as fit in one block of queries, so that there are only as many groups as queries need. A
   cell's vectors are copied to those groups only that ask for it, and only those that can still reach the lowest
   certain score of one of the group's cells.
4. Groups and cells are cut into blocks of bounded size (random block numbers, counted from the summaries), a pair of
   blocks is one unit of work: one exact matrix product and its k best per query. The parts are merged by rank.

Cells of any size are spread over many blocks, and no task holds a cell or a group as a whole. The pivots and summaries
that are broadcast have at most ``pivots`` rows. Bounds only prune; they are widened by rounding error, so results are exact.

Vectors that are null or empty, or hold null or non-finite components, and rows with a null id take no part. Vectors
meet only others of their length: each occurring length is a join of its own. Rows of one id are taken once per
different vector; a query never meets rows of its own id. Ties go to the smaller id, then to the smaller rank of equal rows.
Scores are exact while they fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import hash_order, keep_table, ship_package

EXACT = 2.0**53
MOST_OWN = 64  # where an id has more rows, nothing is pruned by certain scores


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v`` (array of long) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & fine)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()


def find_pivots(sample: np.ndarray, pivots: int, rounds: int = 4) -> np.ndarray:
    """Centres of the sample after a few rounds; starts from its first vectors."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(pivots, len(centres))).astype(int)]
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    apart = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)[None, :]
    near = apart.argmin(1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(1))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def top_k_join(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 64, max_sample: int = 4096,
    block_rows: int = 8192, block_queries: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each query. ``is_query`` is a condition on ``id``."""
    spark = df.sparkSession
    ship_package(spark)
    whole = keep_table(integer_vectors(df, id_col, vector_col, scale), "knn-vectors")
    lengths = [r["n"] for r in whole.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]  # a table has few lengths
    solved = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for n in lengths:
        solved = solved.union(_scores_of_length(whole.filter(F.size("v") == n), is_query, k, pivots, max_sample, block_rows, block_queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged_cells(queries: dict[int, int], centres: np.ndarray, most: int) -> dict[int, int]:
    """The group of each query cell: neighbouring cells together while they have at most ``most`` queries."""
    left, group_of, group = dict(queries), {}, 0
    while left:
        start = min(left)
        here = [start]
        total = left.pop(start)
        for c in sorted(left, key=lambda c: (float(((centres[c] - centres[start]) ** 2).sum()), c)):
            if total + left[c] > most:
                break
            total += left.pop(c)
            here.append(c)
        group_of |= dict.fromkeys(here, group)
        group += 1
    return group_of


def _scores_of_length(rows: DataFrame, is_query: Column, k: int, pivots: int, max_sample: int, block_rows: int, block_queries: int) -> DataFrame:
    """``query_id, vec_id, score``: at least the k best of each query, among ``rows`` (id, v) of one length."""
    spark = rows.sparkSession
    own = rows.groupBy("id").count().agg(F.max("count")).first()[0]  # rows that one id has
    near = k + own if own <= MOST_OWN else 0
    first = rows.orderBy(hash_order("id"), "id").limit(max_sample).collect()  # at most max_sample vectors
    centres = find_pivots(np.array([r["v"] for r in first], np.float64), pivots)
    where = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, apart = nearest(matrix(batch.column("v")).astype(np.float64), where.value)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "cell": pa.array(near, pa.int32()), "apart": pa.array(apart, pa.float64())})

    placed = keep_table(rows.mapInArrow(assign, "id long, v array<long>, cell int, apart double"), "knn-cells")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            cells, apart = np.asarray(batch.column("cell")), np.asarray(batch.column("apart"))
            for c in np.unique(cells):
                here = apart[cells == c]
                n, far, close = kept.get(c, (0, 0.0, np.empty(0)))
                kept[c] = (n + len(here), max(far, here.max()), np.sort(np.concatenate([close, here]))[:near])
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(list(kept), pa.int32()), "n": pa.array([x[0] for x in kept.values()], pa.int64()),
            "far": pa.array([x[1] for x in kept.values()], pa.float64()), "close": pa.array([x[2].tolist() for x in kept.values()], pa.list_(pa.float64())),
        })

    parts = placed.select("cell", "apart").mapInArrow(partial, "cell int, n long, far double, close array<double>")
    merged = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("close"))), 1, max(1, near)).alias("close"))
    summary = {r["cell"]: (r["n"], r["far"], r["close"]) for r in merged.collect()}  # at most `pivots` rows
    cells = sorted(summary)
    facts = spark.sparkContext.broadcast((cells, np.array([summary[c][1] for c in cells]), [np.array(summary[c][2]) for c in cells]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, far, close = facts.value
        pivot = where.value[names]
        owner, apart = np.repeat(np.arange(len(names)), [len(c) for c in close]), np.concatenate(close)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("v")).astype(np.float64)
            size = np.sqrt((q * q).sum(1))[:, None]
            at_pivot = q @ pivot.T
            slack = 1e-9 * (1 + np.abs(at_pivot).max() + size.max() * max(far.max(), 1))
            sure = at_pivot[:, owner] - size * apart[None, :] - slack
            # rows of the query's own id may be among these, so more than k must reach the score
            certain = np.sort(sure, axis=1)[:, -near] if near and sure.shape[1] >= near else np.full(len(q), -np.inf)
            wanted = at_pivot + size * far[None, :] + slack >= certain[:, None]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "v": batch.column("v"), "cell": batch.column("cell"), "apart": batch.column("apart"), "certain": pa.array(certain, pa.float64()),
                "wants": pa.array([[names[j] for j in np.flatnonzero(row)] for row in wanted], pa.list_(pa.int32())),
            })

    asked = keep_table(placed.filter(is_query).mapInArrow(ask, "id long, v array<long>, cell int, apart double, certain double, wants array<int>"), "knn-queries")
    asking = asked.groupBy("cell").agg(F.count("*").alias("queries"), F.min("certain").alias("least"), F.max("apart").alias("reach")).collect()  # at most `pivots` rows
    pairs = [(r["asks"], r["cell"]) for r in asked.select(F.col("cell").alias("asks"), F.explode("wants").alias("cell")).distinct().collect()]  # at most pivots^2
    group_of = merged_cells({r["cell"]: r["queries"] for r in asking}, centres, block_queries)
    totals: dict[int, int] = {}
    for r in asking:
        totals[group_of[r["cell"]]] = totals.get(group_of[r["cell"]], 0) + r["queries"]
    wanted_by: dict[int, dict[int, list[int]]] = {c: {} for c in cells}  # of each cell: groups, and their cells that ask for it
    for asks, c in pairs:
        wanted_by[c].setdefault(group_of[asks], []).append(asks)
    plan = spark.sparkContext.broadcast({
        "group_of": group_of, "cells": {r["cell"]: (r["least"], r["reach"]) for r in asking}, "wanted_by": wanted_by,
        "query_blocks": {g: max(1, -(-n // block_queries)) for g, n in totals.items()}, "blocks": {c: max(1, -(-summary[c][0] // block_rows)) for c in cells},
    })

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = matrix(batch.column("v")).astype(np.float64), np.asarray(batch.column("cell"))
            block = np.asarray(batch.column("salt"))
            size = np.sqrt((x * x).sum(1))
            for c in np.unique(own):
                here = np.flatnonzero(own == c)
                for g, asks in p["wanted_by"][c].items():
                    good = np.zeros(len(here), bool)
                    for cell in asks:
                        least, reach = p["cells"][cell]
                        best = x[here] @ where.value[cell] + size[here] * reach
                        good |= best + 1e-9 * (1 + np.abs(best)) >= least
                    take = here[good]
                    if len(take):
                        part = batch.take(pa.array(take))
                        for b in range(p["query_blocks"][g]):
                            yield pa.RecordBatch.from_pydict({
                                "unit": pa.array([f"{g}/{b}/{c}/{s}" for s in block[take] % p["blocks"][c]], pa.string()),
                                "id": part.column("id"), "v": part.column("v"), "query": pa.array([False] * len(take)),
                            })

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            units, take = [], []
            for n, (cell, s, wants) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("salt").to_pylist(), batch.column("wants").to_pylist())):
                g = p["group_of"][cell]
                for c in wants:
                    for b in range(p["blocks"][c]):
                        units.append(f"{g}/{s % p['query_blocks'][g]}/{c}/{b}")
                        take.append(n)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "id": part.column("id"), "v": part.column("v"), "query": pa.array([True] * len(take))})

    salt = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).cast("int").alias("salt")
    work = "unit string, id long, v array<long>, query boolean"
    data = placed.select("id", "v", "cell", salt).mapInArrow(replicate, work)
    load = asked.select("id", "v", "cell", "wants", salt).mapInArrow(spread, work)

    def solve(unit: pd.DataFrame) -> pd.DataFrame:
        q, d = unit[unit["query"]], unit[~unit["query"]]
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(d):
            ids = d["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], np.stack(d["v"].to_numpy())[order]
            for start in range(0, len(q), 256):
                some = q.iloc[start : start + 256]
                scores = products(np.stack(some["v"].to_numpy()), rows)
                for name, line in zip(some["id"].to_numpy(), scores):
                    mine = ids != name
                    found, names = line[mine], ids[mine]
                    if len(found) > k:
                        cut = np.partition(found, len(found) - k)[len(found) - k]
                        sure = np.flatnonzero(found > cut)
                        pick = np.concatenate([sure, np.flatnonzero(found == cut)[: k - len(sure)]])
                    else:
                        pick = np.arange(len(found))
                    out["query_id"] += [name] * len(pick)
                    out["vec_id"] += names[pick].tolist()
                    out["score"] += found[pick].tolist()
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in out.items()})

    return data.union(load).groupBy("unit").applyInPandas(solve, "query_id long, vec_id long, score long")
