"""Toxicity of documents: votes of the nearest labelled examples by exact TF-IDF cosine.

*Fit.* Examples are a bounded sample of the labelled rows outside the held-out fold (``max_examples``, half of each
class where there are enough, in hash order of the id). All words of the examples are terms, none is left out; their document
frequencies are counted over all documents. A word's weight is (1 + ln count) x idf x the root of its chi-square with the
examples' labels, so that nearness is mostly nearness in what tells the classes apart. Votes are calibrated by a logistic curve over
the examples' own votes, each taken without itself, weighted back to the class shares of all labelled rows.

*Score.* The examples lie in an inverted index whose postings are cut into blocks of ``BLOCK`` examples; the largest
weight of each (term, block) bounds what a block can score. Terms of many examples are a matrix, so their part is known for every example at first;
the blocks whose bound reaches the k-th best of these parts are opened, so the k nearest are exact. Their votes are weighted by similarity, against
a small prior weight.

Index and vocabulary have one entry for each distinct word of an example, so they are broadcast. Scoring is one
projection over the documents; only the text goes to Python and only the score comes back. The frequency pass sends at most one row per
term and task.

Null and empty texts, and texts without any word of an example, have no neighbours: their score is the calibrated prior. With
examples of one class only (or none), the score is that class's share (0 without labels). Rows are kept as they are,
repeated ids too; of several labels of one id the largest counts, of several texts the one of the smallest digest is learnt from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import hash_order, held_out, keep_table, ship_package, slices, texts

BLOCK = 64
DENSE = 0.1  # share of the examples from which on a term is a row of a matrix
AT_ONCE = 64  # queries that are multiplied together
SLACK = 1e-9  # more than rounding changes a cosine
PRIOR_WEIGHT = 0.25
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # others part words


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def counts_of(text: str, index: dict[bytes, int]) -> dict[int, int]:
    """The terms of a text and how often they occur."""
    found = Counter(map(index.get, split_words(text)))
    found.pop(None, None)
    return found


def weights(counts: dict[int, int], scale: list[float]) -> list[tuple[int, float]]:
    """A unit vector of (1 + ln count) x scale, terms ascending."""
    raw = [(i, (1 + math.log(n)) * scale[i]) for i, n in sorted(counts.items())]
    norm = math.sqrt(sum(w * w for _, w in raw))
    return [(i, w / norm) for i, w in raw] if norm else []


LOGS = np.array([0.0] + [1 + math.log(n) for n in range(1, 1024)])


def unit_vector(counts: dict[int, int], scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`weights` as arrays of terms and weights."""
    t, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    order = np.argsort(t)
    t, n = t[order], n[order]
    raw = LOGS[np.minimum(n, len(LOGS) - 1)]
    for at in np.flatnonzero(n >= len(LOGS)):
        raw[at] = 1 + math.log(n[at])
    raw *= scale[t]
    norm = math.sqrt(sum((raw * raw).tolist()))
    return (t, raw / norm) if norm else (t[:0], raw[:0])


def as_arrays(vector: list[tuple[int, float]] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a vector; a tuple holds them already."""
    return vector if isinstance(vector, tuple) else (np.array([t for t, _ in vector], np.int64), np.array([w for _, w in vector], np.float64))


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, and the size of each."""
    sizes = end - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes), sizes


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors, examples numbered from 0; ties go to the smaller number.

    Terms of more than ``DENSE`` of the examples are rows of a matrix over all examples, which many queries multiply at once; the postings of the others
    are cut into blocks. A block's bound is the best of its examples by the frequent terms and the largest weight of each other term in it.
    """

    def __init__(self, vectors: list[list[tuple[int, float]]] | list[tuple[np.ndarray, np.ndarray]], terms: int):
        vectors = [as_arrays(v) for v in vectors]
        self.size, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in vectors]])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        frequent = np.flatnonzero(np.bincount(term, minlength=terms) > DENSE * len(vectors))
        self.row = np.full(terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        crowded = self.row[term] >= 0
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        self.dense[self.row[term[crowded]], example[crowded]] = weight[crowded]
        term, example, weight = term[~crowded], example[~crowded], weight[~crowded]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        self.term = term.astype(np.int32)
        run = term * self.blocks + self.example // BLOCK
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        self.posting = np.append(start, len(run))  # where the postings of each (term, block) begin
        self.block = (run[start] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(run[start] // self.blocks, np.arange(terms + 1))  # where the blocks of each term begin

    def nearest(self, query: list[tuple[int, float]], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(-cosine, number) of the k nearest examples of positive cosine, the best first."""
        return next(self.nearest_of([as_arrays(query)], k, [skip]))

    def nearest_of(self, queries: Sequence[tuple[np.ndarray, np.ndarray]], k: int, skips: Sequence[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """`nearest` of many queries: the terms of each, ascending, and their weights."""
        for start in range(0, len(queries), AT_ONCE):
            part = queries[start : start + AT_ONCE]
            frequent = np.zeros((len(part), len(self.dense)))
            for n, (t, w) in enumerate(part):
                row = self.row[t]
                frequent[n, row[row >= 0]] = w[row >= 0]
            for n, ((t, w), scores) in enumerate(zip(part, frequent @ self.dense)):
                yield self._best(t, w, scores, k, skips[start + n] if skips is not None else -1)

    def _best(self, t: np.ndarray, w: np.ndarray, scores: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """``scores``: what the frequent terms give each example."""
        if not len(t) or not self.size:
            return []
        row = self.row[t]
        rare = row < 0
        at, sizes = ranges(self.first[t[rare]], self.first[t[rare] + 1])
        block, factor = self.block[at], np.repeat(w[rare], sizes)
        if skip >= 0:
            scores[skip] = 0.0
        low = np.partition(scores[: self.size], self.size - k)[self.size - k] if self.size > k else 0.0
        bounds = scores.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, self.most[at] * factor, self.blocks)
        here = np.flatnonzero((bounds >= low - SLACK)[block])
        opened = at[here]
        place, sizes = ranges(self.posting[opened], self.posting[opened + 1])
        example, product = self.example[place], self.weight[place] * np.repeat(factor[here], sizes)
        scores += np.bincount(example, product, len(scores))
        if skip >= 0:
            scores[skip] = 0.0
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - SLACK]
        # the sums of these few again, term after term, so that equal examples have equal cosines
        slot = np.full(len(scores), -1, np.int32)
        slot[found] = np.arange(len(found))
        slot = slot[example]
        own = np.flatnonzero(slot >= 0)
        crowded = self.dense[row[~rare][:, None], found] * w[~rare][:, None]
        order = np.argsort(np.append(self.term[place[own]], np.repeat(t[~rare], len(found))), kind="stable")
        slot = np.append(slot[own], np.tile(np.arange(len(found)), len(crowded)))[order]
        exact = np.bincount(slot, np.append(product[own], crowded)[order], len(found))
        best = np.argsort(-exact, kind="stable")[:k]
        return list(zip((-exact[best]).tolist(), found[best].tolist()))


def vote(found: list[tuple[float, int]], labels: list[int], prior: float) -> float:
    """The share of toxic among neighbours, weighted by squared cosine, with the prior as one weak neighbour."""
    total, toxic = PRIOR_WEIGHT, PRIOR_WEIGHT * prior
    for score, n in found:
        total += score * score
        toxic += score * score * labels[n]
    return toxic / total


def calibrate(votes: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to probabilities, classes weighted to ``share`` of ones."""
    ones = labels.sum()
    weight = np.where(labels == 1, share / ones, (1 - share) / (len(labels) - ones)) * len(labels)
    x = np.stack([votes - 0.5, np.ones(len(votes))], 1)
    beta, ridge = np.zeros(2), np.diag([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (labels - p)) - ridge @ beta)
        beta = beta + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int, k: int) -> dict:
    """``docs``: id, text. ``labels``: id, label (0 or 1), only rows that may be learnt from."""
    known = docs.select("id").distinct().join(labels.groupBy("id").agg(F.max("label").alias("label")), "id")
    known = keep_table(known, "toxicity-labels")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return {"share": share}
    ones = min(sizes[1], max(max_examples // 2, max_examples - sizes[0]))
    picks = [known.filter(F.col("label") == c).orderBy(hash_order("id"), "id").limit(n) for c, n in ((1, ones), (0, max_examples - ones))]
    sample = docs.join(F.broadcast(picks[0].union(picks[1])), "id")  # at most max_examples ids
    sample = sample.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = keep_table(sample, "toxicity-examples")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                found = sorted(set(split_words(text)))
                yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.binary()), "label": pa.array([label] * len(found), pa.int32())})

    n1, n0 = sample.filter("label = 1").count(), sample.filter("label = 0").count()
    found = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(distinct_words, "term binary, label int")
    found = found.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).toArrow().sort_by("term")  # words of max_examples texts
    terms = found.column("term").to_pylist()
    if not terms:
        return {"share": share}
    a, b = np.asarray(found.column("a"), float), np.asarray(found.column("b"), float)
    chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n1 + n0 - a - b) * n1 * n0, 1)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found, rows = {t: i for i, t in enumerate(shared.value)}, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                own = set(map(index.get, split_words(text.as_py() or "")))
                own.discard(None)
                found[np.fromiter(own, np.int64, len(own))] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"i": pa.array([*at.tolist(), -1], pa.int32()), "n": pa.array([*found[at].tolist(), rows], pa.int64())})

    counted = docs.select("text").mapInArrow(frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # one row per term
    df = dict(zip(counted.column("i").to_pylist(), counted.column("n").to_pylist()))
    idf = np.log((df[-1] + 1) / (np.array([df.get(i, 0) for i in range(len(terms))]) + 1)) + 1
    scale = (idf * np.sqrt(chi)).tolist()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(shared.value)}
        for batch in slices(batches):
            found = [sorted(counts_of(t, index).items()) for t in texts(batch)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "label": batch.column("label"),
                "i": pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                "n": pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32())),
            })

    rows = sample.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(sparse, "id long, label int, i array<int>, n array<int>")
    rows = rows.toArrow().sort_by([("label", "ascending"), ("id", "ascending")])  # at most max_examples sparse rows
    factors = np.array(scale)
    vectors = [unit_vector(dict(zip(i.as_py(), n.as_py())), factors) for i, n in zip(rows.column("i"), rows.column("n"))]
    marks, ids = rows.column("label").to_pylist(), rows.column("id").to_pylist()
    # examples whose strongest term is the same lie in one block
    order = sorted(range(len(vectors)), key=lambda n: (int(vectors[n][0][vectors[n][1].argmax()]) if len(vectors[n][0]) else -1, marks[n], ids[n]))
    vectors, marks, ids = [[x[n] for n in order] for x in (vectors, marks, ids)]
    index = BlockMaxIndex(vectors, len(terms))
    prior = ones / max_examples if sizes[0] + sizes[1] > max_examples else share
    votes = np.array([vote(near, marks, prior) for near in index.nearest_of(vectors, k, range(len(vectors)))])
    slope, offset = calibrate(votes, np.array(marks), share)
    shared.destroy()
    return {"share": share, "terms": terms, "scale": scale, "index": index, "labels": marks, "ids": ids, "prior": prior, "slope": slope, "offset": offset, "k": k}


EVIDENCE = "array<struct<id: long, cosine: double, label: int>>"
SCORED = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])


def scored(m: dict, parts: Iterator[pa.Array], with_evidence: bool) -> Iterator[pa.Array]:
    """Score and evidence of every text by the model ``m``, an array for each of ``parts``, worked out a slice at a time."""
    terms, scale = {t: i for i, t in enumerate(m.get("terms", []))}, np.array(m.get("scale", []))
    for part in parts:
        made = [pa.array([], SCORED)]
        for piece in slices([part]):
            scores, near = [], []
            queries = [unit_vector(counts_of(text or "", terms), scale) for text in piece.to_pylist()] if terms else []
            for found in m["index"].nearest_of(queries, m["k"]) if terms else [[]] * len(piece):
                scores.append(1 / (1 + math.exp(-(m["slope"] * (vote(found, m["labels"], m["prior"]) - 0.5) + m["offset"]))) if terms else m["share"])
                near.append([{"id": m["ids"][n], "cosine": -s, "label": m["labels"][n]} for s, n in found] if with_evidence else [])
            made.append(pa.StructArray.from_arrays([pa.array(scores, SCORED[0].type), pa.array(near, SCORED[1].type)], fields=list(SCORED)))
        yield pa.concat_arrays(made)


def toxicity_scores(
    df: DataFrame, labels: DataFrame, max_examples: int = 4000, k: int = 15, cut: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", with_evidence: bool = False, carry: bool = False,
) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; with ``with_evidence`` also the neighbours (id, cosine, label).

    With ``carry`` the other columns of ``df`` come along, except those named like a new one.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    model = fit(docs, known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")), max_examples, k)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<score: double, evidence: {EVIDENCE}>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(shared.value, parts, with_evidence)

    made = ["held_out", "score", "predicted", "evidence"]
    kept = [id_col] + [c for c in df.columns if carry and c != id_col and c not in made]
    out = df.select(*[F.col(f"`{c}`") for c in kept], score.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("_scored"))
    out = out.withColumns({"held_out": held_out(id_col), "score": F.col("_scored.score"), "evidence": F.col("_scored.evidence")})
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int")).select(*[f"`{c}`" for c in kept], "held_out", "score", "predicted", *(["evidence"] if with_evidence else []))
