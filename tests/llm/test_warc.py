"""WARC archives: round trips, digests, chunks, and what a damaged file does."""

import hashlib
from pathlib import Path

import pytest

from sieveline.llm import warc

S = "page_id long, url string, html string, size long, digest string"


def truth(rows, least):
    last = {}
    for i, _, html, *_ in rows:
        html = (html or "").encode()
        if len(html) >= least and i is not None:
            last[html] = max(i, last.get(html, i))
    out = []
    for i, _, html, *_ in rows:
        html = (html or "").encode()
        to = last.get(html)
        out.append((i, len(html), hashlib.sha1(html).hexdigest(), "response" if to is None or i == to else "revisit", None if i == to else to))
    return sorted(out, key=str)


def pages():
    long = "é🙂x" * 900 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    texts = [None, "", "a", "a", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, long, long, "<p>\r\n\r\n\n</p>\r\n\r\n", "﻿bom", "\x00\x1f"]
    rows = [(n * 7 % 31, f"http://a/{n}\r\nX-Bad: 1", t, 5, "d") for n, t in enumerate(texts)]
    return rows + [(None, None, "y" * 1000, 5, "d"), (None, None, "z" * 1500, 5, "d"), (None, None, "z" * 1500, 5, "d"), (40, "u", "w" * 1200, 5, "d"), (40, "u", "w" * 1200, 5, "d"), (3, "u", "w" * 1200, 5, "d")]


@pytest.mark.parametrize(("chunk", "split"), [(7, "4096"), (1000, "700"), (1 << 20, "128m")])
def test_round_trip(spark, chunk, split):
    """Chunks that cut characters, and files that are read in splits smaller than a record."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archived_pages(spark.createDataFrame(pages(), S).repartition(2), chunk_bytes=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == truth(pages(), 1000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_hold_payloads_and_standard_records(spark, tmp_path):
    rows = [r for r in pages() if r[0] is not None]
    archive = warc.write_archive(spark.createDataFrame(rows, S).coalesce(1), str(tmp_path / "a"), chunk_bytes=1500)
    raw = b"".join(p.read_bytes() for p in sorted(Path(archive.path).glob("part-*.txt")))
    at, seen, payloads = 0, [], {}
    while at < len(raw):  # record by record as the standard has it, by Content-Length alone
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        assert raw[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        seen.append(fields["WARC-Record-ID"])
        if fields["WARC-Type"] != "warcinfo":
            assert fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
            origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
            if fields["WARC-Type"] != "revisit":
                payloads.setdefault(origin, []).append((int(fields.get("WARC-Segment-Number", 1)), block if "WARC-Segment-Origin-ID" in fields else block.split(b"\r\n\r\n", 1)[1]))
        at = end + 8 + size
    assert len(seen) == len(set(seen))
    kept = [(r[1], r[2]) for r in truth(rows, 1000) if r[3] == "response"]
    assert sorted((len(p), hashlib.sha1(p).hexdigest()) for p in (b"".join(x for _, x in sorted(v)) for v in payloads.values())) == sorted(kept)
    chunks = warc.read_payloads(spark, archive).collect()
    assert max(len(r["data"]) for r in chunks) <= 1500 and sorted(b"".join(r["data"] for r in chunks)) == sorted(b"".join(x for v in payloads.values() for _, x in v))


def test_damage_is_found(spark, tmp_path):
    for n, (old, new) in enumerate([(b"yyyy", b"yyyz"), (b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 9"), (b"yyyy", b"yyy")]):
        archive = warc.write_archive(spark.createDataFrame(pages(), S).coalesce(1), str(tmp_path / f"d{n}"), chunk_bytes=1500)
        for part in Path(archive.path).glob("part-*.txt"):
            part.write_bytes(part.read_bytes().replace(old, new, 1))
        for crc in Path(archive.path).glob(".*.crc"):
            crc.unlink()
        with pytest.raises(Exception, match="does not have the payload|lacks its chunk|bytes long"):
            warc.read_records(spark, archive).collect()


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], S)).count() == 0
