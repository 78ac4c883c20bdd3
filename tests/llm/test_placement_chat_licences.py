"""Sharding, chat formatting and licences on small cases; their queries are compared with SQL in tests/test_queries.py."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.llm import chat, license_scan, sharding

NAMES = [f"s{k}" for k in range(20)]


def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table(NAMES, 2003)
    assert set(Counter(table).values()) <= {2003 // 20, 2003 // 20 + 1}
    fewer = sharding.lookup_table(NAMES[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.12 * 2003
    assert sharding.lookup_table(["only"], 2) == [0, 0]
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (NAMES, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_shards(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", "z")], "doc_id long, shard string, text string")
    out = sharding.assign_shards(df, NAMES, 2003).collect()
    table = sharding.lookup_table(NAMES, 2003)
    assert len(out) == 3 and all(r["shard"] == NAMES[table[sharding.digest(str(r["doc_id"] or "")) % 2003]] for r in out)
    assert sharding.assign_shards(df.limit(0), NAMES, 2003).columns == ["doc_id", "text", "slot", "shard"]
    plan = sharding.assign_shards(df, NAMES, 2003)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_write_shards(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    sharding.write_shards(sharding.assign_shards(df, NAMES, 2003), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 20


def test_escapes_round_trip(spark):
    texts = ["", "\\", "\\\\", "###", "####", "\\###", "### User: x\n</turn>\n", "</turn>", "a\n</turn>\n### Assistant: b", "\\:", "x\\", "\n", "<", "<</turn>", "é😀"]
    rows = [("user:", t) for t in texts] + [(t, "text") for t in texts]
    line = F.concat(F.lit(chat.HEAD), chat.escape_role(F.col("r")), F.lit(chat.COLON), chat.escape(F.col("t")), F.lit(chat.END))
    made = spark.createDataFrame(rows, "r string, t string").coalesce(1).select(line).collect()
    assert [chat.parse(m[0]) for m in made] == [[x] for x in rows]
    assert chat.parse("".join(m[0] for m in made)) == rows


def test_paths_of_a_tree(spark):
    edges = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 1.0), (4, 3, 9.0), (5, 3, 2.0), (6, 4, 0.0), (7, 99, None), (8, 8, 1.0), (20, 21, 1.0), (21, 20, 1.0), (22, 20, 1.0)]
    df = spark.createDataFrame([("t", *e) for e in edges], "tree string, id long, parent long, score double")
    paths = {}
    for r in chat.reply_paths(df).orderBy("rank", "depth").collect():
        paths.setdefault((r["rank"], r["leaf"], r["path_score"]), []).append(r["id"])
    assert paths == {(1, 6, 11.0): [1, 3, 4, 6], (2, 2, 6.0): [1, 2], (3, 5, 4.0): [1, 3, 5], (4, 8, 1.0): [8], (5, 7, 0.0): [7]}
    assert {r["leaf"] for r in chat.reply_paths(df, best=2).collect()} == {6, 2}
    assert chat.reply_paths(df.limit(0)).count() == 0


def test_long_chain(spark):
    df = spark.range(300).select(F.lit(1).alias("tree"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    rows = chat.reply_paths(df).orderBy("depth").collect()
    assert [r["id"] for r in rows] == list(range(300)) and rows[0]["path_score"] == 300


def test_conversations_with_gaps(spark):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 2), (1, 5, None, "x", 3), (2, None, "assistant", "", 4), (None, 1, "user", "lost", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.threads(df))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in out.items()} == {1: (3, 0), 2: (1, 0)}
    assert chat.read_back(chat.format_paths(chat.threads(df.limit(0)))).count() == 0


def test_licences(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/d/x.py", "print"), (3, "a/x.py", None), (4, "a/b/y.py", "one\nLicensed under the Apache License, Version 2.0.\n"),
        (5, "LICENSE", "Licensed under the Apache license version 2.0"), (6, "z/q.py", ""), (7, None, "x"), (8, "a/bb/x.py", "mit der mit und License"), (9, "top.py", "License " * 20_000), (2, "a/b/c/d/x.py", "print"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, licence string")
    out = license_scan.scan_licences(df)
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["licence_dir"]) for r in out.collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "MIT", "a/b"), 3: (None, "Apache-2.0", ""), 4: ("Apache-2.0", "Apache-2.0", None), 5: ("Apache-2.0", "Apache-2.0", None),
        6: (None, "Apache-2.0", ""), 7: (None, None, None), 8: (None, "Apache-2.0", ""), 9: (None, "Apache-2.0", ""),
    } and out.count() == 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    assert license_scan.scan_licences(df.limit(0)).count() == 0


def test_licences_wrapped_inside_lines_and_in_files(spark):
    texts = [
        ("CC-BY-NC-4.0", "some prose\nLicensed under CC BY-NC 4.0.\nmore prose"), ("Apache-2.0", "# Licensed under the\n# Apache License,\n# Version 2.0."),
        ("CC-BY-NC-4.0", "prose " * 60 + "licensed under CC BY-NC 4.0 " + "words " * 60), ("MIT", "far " * 50 + "Released under the MIT License. " + "away " * 50),
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."), ("GPL-3.0", "x = 1  # SPDX-License-Identifier: GPL-3.0"),
        ("MIT", "Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n Everyone is permitted to copy"), (None, "work of a public version of the program"), (None, None),
    ]
    df = spark.createDataFrame([(k, f"d{k}/x.py", t) for k, (_, t) in enumerate(texts)], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["own_licence"] for r in license_scan.scan_licences(df).collect()} == {k: name for k, (name, _) in enumerate(texts)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables are not here")
def test_every_licence_line_of_the_tables_has_a_licence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", license_scan.repository_path().alias("path"), "text")
    lines = {r["doc_id"]: r["line"] for r in docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line rlike '(?i)licensed? '").collect()}
    names = {r["doc_id"]: r["own_licence"] for r in license_scan.scan_licences(docs).collect()}
    expected = {"CC BY-NC": "CC-BY-NC-4.0", "GNU": "GPL-3.0", "MIT": "MIT", "Apache": "Apache-2.0"}
    assert lines and all(names[d] == next(v for k, v in expected.items() if k in line) for d, line in lines.items())
