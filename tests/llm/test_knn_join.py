"""The join against all scores."""

import math
import random

from pyspark.sql import functions as F

from sieveline.llm import knn_join


def truth(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, set()).add(tuple(math.floor(1024 * x) for x in v))
    out = {}
    for q, qs in vectors.items():
        if q % 5 == 0:
            for x in qs:
                scored = sorted((-sum(a * b for a, b in zip(x, y)), d) for d, ys in vectors.items() if d != q for y in ys)
                out[q] = [(d, -s) for s, d in scored[:k]]
    return out


def found(spark, rows, k=4, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = {}
    for r in knn_join.top_k_join(df, F.col("id") % 5 == 0, k=k, **settings).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_equals_brute_force_with_small_blocks(spark):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[0 if i % 3 == 0 else i % 6]]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # ties
    assert found(spark, rows, pivots=7, block_rows=40, block_queries=10) == truth(rows, 4)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, []), (15, [1.0, None]), (20, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (1, [-1.0, 0.001]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (0, [1.0, 2.0])]
    assert found(spark, rows) == truth(rows, 4) and len(found(spark, rows)[0]) == 2
    assert found(spark, [(5, [1.0])]) == {} and found(spark, [(5, None)]) == {}
    df = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<double>")
    assert knn_join.top_k_join(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_mixed_lengths_and_repeated_ids_equal_sql(spark):
    """Vectors meet those of their length only; an id may have several vectors, as query and as candidate."""
    import duckdb

    from sieveline.llm.queries import KNN_SQL

    r = random.Random(6)
    rows = [(100 * (i % 3) if i % 7 == 0 else i, [float(r.choice([-1, 0.5, 2, r.gauss(0, 1)])) for _ in range(r.choice([2, 2, 3, 5]))]) for i in range(160)]
    rows += [(0, [1.0, 2.0, 3.0]), (3, [0.5, 0.5, 0.5]), (7, [])] + [(200, [float(n), 1.0]) for n in range(70)]  # more vectors of one id than any bound allows for
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, knn_join.top_k_join(df, F.col("id") % 100 == 0, pivots=5, block_rows=20, block_queries=6).select("query_id", "rank", "score").collect()))
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, v] for i, v in rows])
    want = sorted(db.sql(f"SELECT query_id, rank, score FROM ({KNN_SQL})").fetchall())
    assert got == want and len({r[0] for r in got}) == 3


def test_groups_follow_the_queries():
    import numpy as np

    centres = np.arange(10, dtype=float)[:, None]
    assert set(knn_join.merged_cells(dict.fromkeys(range(10), 3), centres, 100).values()) == {0}
    groups = knn_join.merged_cells(dict.fromkeys(range(10), 3), centres, 7)
    assert sorted(groups) == list(range(10)) and len(set(groups.values())) == 5 and groups[0] == groups[1]
    assert len(set(knn_join.merged_cells({2: 50, 4: 1, 5: 1}, centres, 7).values())) == 2
