"""Document quality: a linear-chain conditional random field marks every line good or bad.

*Model.* A line's evidence for "good" is linear in its own features (shares of capitals, symbols, separators, digits,
words that repeat their neighbour, repeated lines, length) and in those of the lines before and after it; two weights
reward neighbouring lines of one mark. Forward-backward gives each line's probability of being good; the document's
score is their mean, weighted by line length in bytes.

*Fit.* Labels exist per document, so a labelled document is a chain of equal marks. A bounded sample of labelled rows
outside the held-out fold (``max_examples``, half of each class where there are enough, in hash order of the id) is
written once; each step of the quasi-Newton solver is one aggregate over it that returns a gradient of some 40
numbers. No text and no feature table comes to the driver.

*Score.* One projection over whole texts, no shuffle; lost tasks are run again.

Null and empty texts, and texts of white space, are one empty line. Line ends are line feeds. With examples of one
class only (or none) every score is that class's share (1 without labels). Rows are kept as they are, repeated ids
too; of several labels of one id the smallest counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import hash_order, held_out, keep_table, ship_package, slices, texts

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
PLAIN = b" \t\r\x0b\x0c.,'\"-?:;()" + UPPER + LOWER + DIGITS + HIGH
SEPARATORS = b"|/\\>=_"
OWN = 12  # features of a line itself
SIZE = 1 + 3 * OWN + 2  # bias, own and neighbours' features, two transition weights
RIDGE = 1e-4
STEPS = 40


def line_features(line: bytes, seen: bool) -> tuple[float, ...]:
    n = len(line)
    if not n:
        return (0.0,) * (OWN - 1) + (1.0,)
    upper = n - len(line.translate(None, UPPER))
    letters = upper + n - len(line.translate(None, LOWER + HIGH))
    capitals = upper / letters if letters else 0.0
    symbols = len(line.translate(None, PLAIN)) / n
    separators = (n - len(line.translate(None, SEPARATORS))) / n
    digits = (n - len(line.translate(None, DIGITS))) / n
    found = line.split()
    count = len(found)
    again = sum(map(eq, found, found[1:])) / (count - 1) if count > 1 else 0.0
    same = 1 - len(set(found)) / count if count > 1 else 0.0
    return (
        capitals, 1.0 if capitals > 0.6 and letters > 3 else 0.0, symbols, 1.0 if symbols > 0.06 else 0.0,
        separators, 1.0 if separators > 0.03 else 0.0, again, 1.0 if again > 0.2 else 0.0, same,
        1.0 if seen and count > 2 else 0.0, digits, 1.0 if count < 2 else 0.0,
    )


def document_features(text: str) -> tuple[np.ndarray, list[int]]:
    """One row per line (bias, own, previous, next) and the line lengths."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    own, before = [], set()
    for line in lines:
        own.append(line_features(line, line in before))
        before.add(line)
    x = np.zeros((len(lines), 1 + 3 * OWN))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    x[1:, 1 + OWN : 1 + 2 * OWN] = x[:-1, 1 : 1 + OWN]
    x[:-1, 1 + 2 * OWN :] = x[1:, 1 : 1 + OWN]
    return x, [len(line) for line in lines]


def forward_backward(evidence: list[float], both_bad: float, both_good: float) -> tuple[list[float], float, float, float]:
    """P(good) of every line, expected numbers of bad-bad and good-good neighbours, and the log partition function."""
    bb, gg = math.exp(both_bad), math.exp(both_good)
    ratios = [math.exp(max(-30.0, min(30.0, e))) for e in evidence]
    n, log_z = len(ratios), 0.0
    forward = []  # P(good) of the prefix sums, normalised step by step
    b, g = 1.0, ratios[0]
    for k in range(n):
        if k:
            b, g = b * bb + g, (b + g * gg) * ratios[k]
        total = b + g
        log_z += math.log(total)
        b, g = b / total, g / total
        forward.append(g)
    good = [0.0] * n
    good[-1] = forward[-1]
    e_bb = e_gg = 0.0
    b, g = 1.0, 1.0
    for k in range(n - 2, -1, -1):
        f, r = forward[k], ratios[k + 1]
        p_bb, p_bg, p_gb, p_gg = (1 - f) * bb * b, (1 - f) * r * g, f * b, f * gg * r * g
        total = p_bb + p_bg + p_gb + p_gg
        e_bb += p_bb / total
        e_gg += p_gg / total
        good[k] = (p_gb + p_gg) / total
        b, g = bb * b + r * g, b + gg * r * g
        total = b + g
        b, g = b / total, g / total
    return good, e_bb, e_gg, log_z


def loss_and_gradient(w: np.ndarray, examples: list[tuple[np.ndarray, int, float]]) -> tuple[float, np.ndarray]:
    """Negative log-likelihood per line of documents whose lines all have the document's mark; (features, mark, weight)."""
    loss, grad = 0.0, np.zeros(SIZE)
    for x, mark, weight in examples:
        evidence = np.clip(x @ w[:-2], -30, 30)
        n = len(x)
        good, e_bb, e_gg, log_z = forward_backward(evidence.tolist(), w[-2], w[-1])
        scale = weight / n
        loss -= scale * ((evidence.sum() + w[-1] * (n - 1) if mark else w[-2] * (n - 1)) - log_z)
        grad[:-2] -= scale * (((1.0 if mark else 0.0) - np.array(good)) @ x)
        grad[-2] -= scale * ((0 if mark else n - 1) - e_bb)
        grad[-1] -= scale * ((n - 1 if mark else 0) - e_gg)
    return loss, grad


def minimise(value, size: int, steps: int = STEPS) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; ``value(w)`` gives loss and gradient."""
    w = np.zeros(size)
    loss, grad = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, np.abs(q).max())
        for (s, y), a in zip(past, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        rate = 1.0
        for _ in range(12):
            there = w - rate * q
            new_loss, new_grad = value(there)
            if new_loss <= loss - 1e-4 * rate * (grad @ q):
                break
            rate /= 3
        else:
            return w
        s, y = there - w, new_grad - grad
        done = abs(loss - new_loss) < 1e-5 * max(1e-3, abs(loss))
        w, loss, grad = there, new_loss, new_grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-8:]
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_examples: int) -> dict:
    """``docs``: id, text. ``labels``: id, label (0 or 1), only rows that may be learnt from."""
    known = docs.select("id").distinct().join(labels.groupBy("id").agg(F.min("label").alias("label")), "id")
    known = keep_table(known, "quality-labels")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if len(sizes) < 2:
        return {"share": sizes.get(1, 0) / sum(sizes.values()) if sizes else 1.0}
    bad = min(sizes[0], max(max_examples // 2, max_examples - sizes[1]))
    picks = [known.filter(F.col("label") == c).orderBy(hash_order("id"), "id").limit(n) for c, n in ((0, bad), (1, max_examples - bad))]
    sample = docs.join(F.broadcast(picks[0].union(picks[1])), "id")  # at most max_examples ids; of several texts of one the smallest digest's
    sample = sample.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", F.col("label").cast("int").alias("label"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                x, _ = document_features(text)
                yield pa.RecordBatch.from_pydict({"x": pa.array([x.astype(np.float32).ravel()], pa.list_(pa.float32())), "label": pa.array([label], pa.int32())})

    sample = keep_table(sample.mapInArrow(features, "x array<float>, label int"), "quality-examples")
    sample = sample.coalesce(max(1, min(sample.rdd.getNumPartitions(), sample.sparkSession.sparkContext.defaultParallelism)))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = {c: 0.5 / n for c, n in counts.items()}

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0.0, np.zeros(SIZE)
            for batch in batches:
                marks = batch.column("label").to_pylist()
                rows = [np.asarray(x.values, np.float64).reshape(-1, 1 + 3 * OWN) for x in batch.column("x")]
                part, part_grad = loss_and_gradient(w, [(x, m, weight[m]) for x, m in zip(rows, marks)])
                loss, grad = loss + part, grad + part_grad
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(SIZE + 1), pa.int32()), "v": pa.array([loss, *grad], pa.float64())})

        got = {r["i"]: r["v"] for r in sample.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return got[0] + RIDGE * float(w @ w), np.array([got[i + 1] for i in range(SIZE)]) + 2 * RIDGE * w

    return {"weights": minimise(value, SIZE)}


def quality_scores(
    df: DataFrame, labels: DataFrame, max_examples: int = 2000, cut: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", with_lines: bool = False, carry: bool = False,
) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row; with ``with_lines`` also each line's probability of being good.

    With ``carry`` the other columns of ``df`` come along, except those named like a new one.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    model = fit(docs, known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")), max_examples)

    kind = pa.struct([("score", pa.float64()), ("lines", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<score: double, lines: array<double>>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = model.get("weights")
        for part in parts:
            scores, lines = [], []
            for text in part:
                text = text.as_py() or ""
                if w is None:
                    lines.append([model["share"]] * (text.count("\n") + 1 if with_lines else 0))
                    scores.append(model["share"])
                    continue
                x, lengths = document_features(text)
                good, _, _, _ = forward_backward((x @ w[:-2]).tolist(), w[-2], w[-1])
                total = sum(lengths)
                mean = sum(map(float.__mul__, good, map(float, lengths))) / total if total else sum(good) / len(good)
                scores.append(min(1.0, max(0.0, mean)))
                lines.append(good if with_lines else [])
            yield pa.StructArray.from_arrays([pa.array(scores, kind[0].type), pa.array(lines, kind[1].type)], fields=list(kind))

    # only the text goes to Python; the rest of the row stays in the JVM
    made = ["held_out", "score", "predicted", "lines"]
    kept = [id_col] + [c for c in df.columns if carry and c != id_col and c not in made]
    out = df.select(*[F.col(f"`{c}`") for c in kept], score.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("_scored"))
    out = out.withColumns({"held_out": held_out(id_col), "score": F.col("_scored.score"), "lines": F.col("_scored.lines")})
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int")).select(*[f"`{c}`" for c in kept], "held_out", "score", "predicted", *(["lines"] if with_lines else []))
