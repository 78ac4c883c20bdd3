"""The line field and the toxicity votes: parts against enumeration, the whole by held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np

from sieveline.llm import quality_crf, toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def test_forward_backward_equals_enumeration():
    evidence, bb, gg = [0.3, -1.2, 2.0, 0.1], 0.7, -0.4
    weights = {y: math.exp(sum(e for e, m in zip(evidence, y) if m) + sum(gg if a and b else bb if not a and not b else 0 for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=4)}
    z = sum(weights.values())
    good, e_bb, e_gg, log_z = quality_crf.forward_backward(evidence, bb, gg)
    assert np.allclose(good, [sum(w for y, w in weights.items() if y[k]) / z for k in range(4)]) and np.isclose(log_z, math.log(z))
    assert np.isclose(e_gg, sum(w * sum(a and b for a, b in zip(y, y[1:])) for y, w in weights.items()) / z)
    assert np.isclose(e_bb, sum(w * sum(not a and not b for a, b in zip(y, y[1:])) for y, w in weights.items()) / z)
    long, _, _, _ = quality_crf.forward_backward([5.0] * 5000 + [-5.0] * 5000, 1.0, 1.0)
    assert all(0 <= g <= 1 for g in long)


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    examples = [(r.normal(size=(n, 1 + 3 * quality_crf.OWN)), n % 2, 0.5) for n in (1, 3, 6)]
    w = r.normal(size=quality_crf.SIZE) * 0.2
    _, grad = quality_crf.loss_and_gradient(w, examples)
    for k in range(quality_crf.SIZE):
        d = np.zeros_like(w)
        d[k] = 1e-6
        assert np.isclose(grad[k], (quality_crf.loss_and_gradient(w + d, examples)[0] - quality_crf.loss_and_gradient(w - d, examples)[0]) / 2e-6, atol=1e-5)


def test_block_max_index_equals_all_cosines():
    r = random.Random(1)
    idf = [1 + r.random() * 4 for _ in range(30)]
    vectors = [toxicity.weights({r.randrange(30): r.randint(1, 4) for _ in range(r.randint(0, 6))}, idf) for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, 30)
    for n in range(0, 700, 7):
        q = dict(vectors[n])
        every = sorted((-sum(q.get(t, 0) * w for t, w in v), m) for m, v in enumerate(vectors) if m != n)
        got = index.nearest(vectors[n], 15, skip=n)
        want = [(s, m) for s, m in every if s < 0][:15]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
    assert index.nearest([], 15) == []


def corpus(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(500)]
    line = lambda: " ".join(r.choice(pool) for _ in range(r.randint(4, 15)))
    docs, labels = [], []
    for i in range(n):
        lines = [line() for _ in range(r.randint(1, 8))]
        bad, toxic = i % 7 == 0, i % 9 == 0
        if bad:
            lines = [lines[0]] + [" ".join(f"{w.upper()}!!" for w in x.split()) if i % 2 else " ".join([x.split()[0]] * 12) for x in lines * 2]
        if toxic:
            lines[-1] += f" snarf{r.choice(['ing', 'ed', 'er'])} " + line() + " gloob"
        docs.append((i, "\n".join(lines), "extra"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(2, 900)
    d, known = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    for out, column in ((quality_crf.quality_scores(d, known), 1), (toxicity.toxicity_scores(d, known, with_evidence=True), 2)):
        rows = out.collect()
        assert len(rows) == 900 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"]]
        assert sum(r["predicted"] == labels[r["doc_id"]][column] for r in held) >= 0.97 * len(held)
    assert all(e["label"] in (0, 1) and e["cosine"] <= 1 + 1e-9 for r in rows for e in r["evidence"])


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(3, 200)
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    for f in (quality_crf.quality_scores, toxicity.toxicity_scores):
        a, b = [sorted(map(tuple, f(d, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped)]
        assert [(r[0], round(r[2], 9)) for r in a] == [(r[0], round(r[2], 9)) for r in b]


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 50_000 + "\n\n", "c"), (None, "y", "d"), (3, "z", "e")], DOCS)
    none, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(3, 1, 1), (3, 1, 1), (9, 0, 0), (None, 0, 0), (1, None, None)], LABELS)
    for f in (quality_crf.quality_scores, toxicity.toxicity_scores):
        for known in (none, one):
            rows = f(d, known).collect()
            assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert f(d.limit(0), one).count() == 0
        assert f(d, one, carry=True).columns == ["doc_id", "text", "held_out", "score", "predicted"]


def test_places_of_ranges_come_with_their_sizes():
    """The index expands a number per range by its size, not once more per place."""
    from sieveline.llm.toxicity import ranges

    places, sizes = ranges(np.array([3, 0, 7]), np.array([5, 0, 8]))
    assert places.tolist() == [3, 4, 7] and sizes.tolist() == [2, 0, 1]
    places, sizes = ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(places) == len(sizes) == 0


def test_many_queries_at_once_equal_all_cosines():
    """Frequent terms come from one product for many queries, the others from blocks; the sums are those of the terms in order, so copies tie exactly."""
    r = random.Random(4)
    scale = [1 + r.random() * 4 for _ in range(300)]
    draw = lambda: {int(300 * r.random() ** 3): r.choice([1, 2, 5, 2000]) for _ in range(r.randint(0, 40))}
    counts = [draw() for _ in range(300)]
    counts += counts[:100]
    vectors = [toxicity.weights(c, scale) for c in counts]
    index = toxicity.BlockMaxIndex(vectors, 300)
    assert 0 < len(index.dense) < 300
    queries = [toxicity.unit_vector(c, np.array(scale)) for c in counts]
    assert [list(zip(t.tolist(), w.tolist())) for t, w in queries] == vectors
    got, own = list(index.nearest_of(queries, 15)), list(index.nearest_of(queries, 15, range(400)))
    for n, v in enumerate(vectors):
        every = []
        for m, other in enumerate(vectors):
            total, weight = 0.0, dict(v)
            for t, w in other:
                total += w * weight.get(t, 0.0)
            every.append((-total, m))
        every = sorted(x for x in every if x[0] < 0)
        assert got[n] == every[:15] and own[n] == [x for x in every if x[1] != n][:15]
