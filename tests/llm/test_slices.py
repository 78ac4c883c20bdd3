"""Workers hold the texts of a slice of a batch as Python objects, not those of a whole batch."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sieveline.llm import common, piece_codec, toxicity


def test_slices_keep_every_row_in_order():
    rows = pa.RecordBatch.from_pydict({"n": pa.array(range(1300))})
    found = list(common.slices([rows, rows.slice(0, 0), rows.slice(0, 3)]))
    assert [b.num_rows for b in found] == [512, 512, 276, 3]
    assert [n for b in found for n in b.column("n").to_pylist()] == [*range(1300), 0, 1, 2]
    assert [len(a) for a in common.slices([rows.column("n")])] == [512, 512, 276]


def test_encoder_hands_on_a_slice_before_it_reads_the_next():
    class Counted:
        done = 0

        def run(self, text):
            self.done += 1
            return "1,2" if text else "", text

    one = Counted()
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(1100)), "_text": pa.array([None if n % 7 == 0 else f"t{n}" for n in range(1100)])})
    found = piece_codec.encoded(one, iter([batch]), "id", True)
    first = next(found)
    assert one.done == first.num_rows == common.SLICE
    rest = pa.Table.from_batches([first, *found]).to_pydict()
    assert rest["id"] == list(range(1100)) and rest["decoded"] == [t or "" for t in batch.column("_text").to_pylist()]
    assert rest["n_tokens"] == [2 if n % 7 else 0 for n in range(1100)]


def test_votes_of_slices_equal_those_of_single_texts(monkeypatch):
    terms = [b"t%d" % n for n in range(40)]
    scale = np.linspace(0.5, 2, 40)
    r = np.random.default_rng(3)
    texts = [None, "", *[" ".join(f"t{n}" for n in r.integers(0, 40, 6)) for _ in range(1200)]]
    texts = [t and t.replace("t", "x").translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]
    terms = [t.decode().replace("t", "x").translate(str.maketrans("0123456789", "abcdefghij")).encode() for t in terms]
    vectors = [toxicity.unit_vector(toxicity.counts_of(t, {w: i for i, w in enumerate(terms)}), scale) for t in texts[2:90]]
    model = {"terms": terms, "scale": scale.tolist(), "index": toxicity.BlockMaxIndex(vectors, 40), "labels": [n % 2 for n in range(88)], "ids": list(range(88))}
    model |= {"prior": 0.3, "slope": 2.0, "offset": -0.1, "k": 5}
    most = []
    nearest_of = toxicity.BlockMaxIndex.nearest_of
    monkeypatch.setattr(toxicity.BlockMaxIndex, "nearest_of", lambda self, queries, *a: (most.append(len(queries)), nearest_of(self, queries, *a))[1])
    (whole,) = toxicity.scored(model, iter([pa.array(texts)]), True)
    assert max(most) == common.SLICE and len(whole) == len(texts)
    single = [next(toxicity.scored(model, iter([pa.array([t], pa.string())]), True))[0].as_py() for t in texts[:100]]
    assert [(s["score"], s["evidence"]) for s in whole.to_pylist()[:100]] == [(s["score"], s["evidence"]) for s in single]
    (bare,) = toxicity.scored({"share": 0.25}, iter([pa.array(["a", None])]), True)
    assert bare.to_pylist() == [{"score": 0.25, "evidence": []}] * 2


def test_pipeline_stages_hand_over_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, held in (("10000", 1024), ("0", 1024), ("300", 300)):
            spark.conf.set(name, given)
            common.small_batches(spark)
            assert int(spark.conf.get(name)) == held
        spark.conf.set(name, "10000")
        docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "'a' text")
        corpus_pipeline.small_batches(spark)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert [r["n"] for r in sizes] == [1024, 1024, 952]
    finally:
        spark.conf.set(name, before)
