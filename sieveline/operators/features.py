"""TF-IDF as long tables ``(id, term, ...)``, feature blocks, SVD and embeddings."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import fixed
from sieveline.functions import patterns, text, tokens
from sieveline.session import forget, materialize


@dataclass(frozen=True)
class TfidfSpec:
    """What one vectoriser does. ``analyzer`` is ``word`` or ``char`` (inside blank-separated words)."""

    analyzer: str
    low: int
    high: int
    max_features: int
    min_df: int = 1
    max_df: float = 1.0
    stop_words: tuple[str, ...] = ()
    sublinear: bool = False
    strip_accents: bool = False


STOP = tuple(fixed.STOP_WORDS)
WORD_SPEC = TfidfSpec("word", 1, 3, 15_000, min_df=2, stop_words=STOP)
CHAR_SPEC = TfidfSpec("char", 3, 7, 15_000)
SUBLINEAR_SPEC = TfidfSpec("word", 1, 2, 50_000, min_df=3, max_df=0.95, sublinear=True, strip_accents=True)


def _source(spec: TfidfSpec, text_col: str) -> Column:
    c = F.coalesce(F.col(text_col), F.lit(""))
    return text.strip_accents(F.lower(c)) if spec.strip_accents else c


def word_terms(spec: TfidfSpec, text_col: str) -> Column:
    return tokens.word_ngrams(tokens.word_tokens(_source(spec, text_col), spec.stop_words), spec.low, spec.high)


def _joined_tokens(spec: TfidfSpec, text_col: str) -> Column:
    """The tokens of a text as one string, a blank between them (tokens hold none): much cheaper to hand to Python than an array."""
    return F.array_join(tokens.word_tokens(_source(spec, text_col), spec.stop_words), " ")


def _distinct_words(df: DataFrame, spec: TfidfSpec, text_col: str, *keep: str) -> DataFrame:
    words = tokens.count_terms(tokens.blank_separated_words(_source(spec, text_col)))
    return df.select(*keep, F.inline(words)).withColumnsRenamed({"term": "word", "tf": "n"})


def _grams(spec: TfidfSpec) -> Column:
    return F.explode(tokens.word_char_ngrams(F.col("word"), spec.low, spec.high)).alias("term")


# ---------------------------------------------------------------- vocabularies


def term_counts(df: DataFrame, spec: TfidfSpec, text_col: str = "comment_text", id_col: str = "id") -> DataFrame:
    """``(id, term, tf)`` of all terms, counted inside the row. Only the rows of repeated ids are summed by id and term, so that
    nothing else is shuffled; for characters, whose n-grams are many times the text. Word terms stay one row for each row of ``df``."""
    if spec.analyzer == "word":
        return df.select(F.col(id_col).alias("id"), F.inline(tokens.count_terms(word_terms(spec, text_col))))
    rows = df.select(F.col(id_col).alias("id"), F.lower(_source(spec, text_col)).alias("text"))
    low, high = spec.low, spec.high

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, terms, tf = [], [], []
            for row, lowered in enumerate(batch.column("text")):
                found = Counter()
                for word in lowered.as_py().split():  # parted where `tokens.blank_separated_words` does
                    padded = f" {word} "
                    size = len(padded)
                    found.update([padded[i : i + n] for n in range(low, min(high, size) + 1) for i in range(size - n + 1)] if size >= low else [padded])
                owner.extend([row] * len(found))
                terms.extend(found.keys())
                tf.extend(found.values())
                if len(terms) >= HELD or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int32())], ["id", "term", "tf"])
                    owner, terms, tf = [], [], []

    schema = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    repeated = materialize(rows.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_again")), "repeated-ids")
    again = F.col("id").eqNullSafe(F.col("_again"))
    once = rows.join(repeated, again, "left_anti").mapInArrow(count, schema)
    summed = rows.join(repeated, again, "left_semi").mapInArrow(count, schema).groupBy("id", "term").agg(F.sum("tf").cast("int").alias("tf"))
    return once.unionByName(summed)


def corpus_counts(df: DataFrame, spec: TfidfSpec, text_col: str = "comment_text", id_col: str = "id") -> DataFrame:
    """``(term, cf, df)``: occurrences and messages of every term."""
    return (
        term_counts(df, spec, text_col, id_col)
        .groupBy("term")
        .agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    )


def select_vocabulary(counts: DataFrame, n_docs: Column, spec: TfidfSpec) -> DataFrame:
    """Document-frequency limits first, then the ``max_features`` most frequent terms.

    Equal counts are broken by the term, so that the choice is reproducible.
    """
    if "df" in counts.columns:
        counts = counts.filter((F.col("df") >= spec.min_df) & (F.col("df") <= n_docs * spec.max_df))
    return counts.orderBy(F.desc("cf"), "term").limit(spec.max_features)


def doc_count(df: DataFrame) -> Column:
    return df.select(F.count("*").alias("n")).scalar()


KNOWN_BITS = 1 << 24  # of the filter of possible parts, 2 MB
HELD = 200_000  # terms that a task adds up before it hands them on
SLICE = 512  # rows that are Python objects at once


def _known(terms: DataFrame) -> bytes:
    """The terms as bits by their hash, for `_is_known`. The filter has one size, so that it can be broadcast; it may pass others too."""
    at = terms.select(F.pmod(F.xxhash64("term"), F.lit(KNOWN_BITS)).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).collect()  # at most KNOWN_BITS / 64 rows
    out = np.zeros(KNOWN_BITS // 64, "<i8")
    out[[r["cell"] for r in cells]] = [r["bits"] for r in cells]
    return out.tobytes()


def _is_known(bits: bytes) -> Callable[[str], bool]:
    @lru_cache(maxsize=1 << 17)
    def test(term: str) -> bool:
        at = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42) % KNOWN_BITS  # as Spark's xxhash64
        return bool(bits[at >> 3] >> (at & 7) & 1)

    return test


def _runs(parts: list[bool], size: int) -> list[int]:
    """Places where ``size`` parts in a row are known."""
    out, length = [], 0
    for place, good in enumerate(parts):
        length = length + 1 if good else 0
        if length >= size:
            out.append(place - size + 1)
    return out


CODE_BITS = 21  # of the number of a token inside a key
PENDING = 1 << 20  # distinct n-grams that a task holds as numbers before it hands them on


def _split(joined: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of texts that `_joined_tokens` made: the row of each, its place among the distinct tokens, and these."""
    parts = pc.split_pattern(joined.fill_null(""), " ")
    coded = parts.flatten().dictionary_encode()
    owner, place = np.repeat(np.arange(len(parts)), np.asarray(parts.value_lengths())), np.asarray(coded.indices)
    filled = np.asarray(pc.not_equal(coded.dictionary, "").cast(pa.int8())).astype(bool)[place]  # a text without tokens splits into one empty part
    return owner[filled], place[filled], coded.dictionary


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct columns of ``keys`` with the sums of their numbers."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    keys = keys[:, order]
    first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    return keys[:, first], *[np.add.reduceat(n[order], first) for n in numbers]


class _WordGrams:
    """N-grams of ``size`` tokens whose parts are all known, counted as numbers: a token has one of `CODE_BITS` bits, three share a number.

    ``known`` tests tokens, then n-grams of two tokens, and so on up to ``size - 1``.
    """

    def __init__(self, size: int, known: Sequence[Callable[[str], bool]]):
        self.size, self.known = size, known
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.tokens: list[str] = []
        self.pending: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.held = 0

    def _code_of(self, token: str) -> int:
        if self.known and not self.known[0](token):
            code = -1
        else:
            code = len(self.tokens)
            self.tokens.append(token)
        self.code[token] = code
        return code

    def _packed(self, codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        keys = np.zeros((-(-size // 3), len(starts)), np.int64)
        for k in range(size):
            keys[k // 3] = keys[k // 3] << CODE_BITS | codes[starts + k]
        return keys

    def terms(self, keys: np.ndarray, size: int) -> pa.Array:
        tokens = pa.array(self.tokens, pa.string())
        parts = []
        for k in range(size):
            place = (min(size, k // 3 * 3 + 3) - 1 - k) * CODE_BITS
            parts.append(tokens.take(pa.array(keys[k // 3] >> place & ((1 << CODE_BITS) - 1))))
        return pc.binary_join_element_wise(*parts, " ")

    def add(self, group: int, owner: np.ndarray, place: np.ndarray, distinct: pa.Array) -> None:
        get = self.code.get
        coded = np.array([c if (c := get(t)) is not None else self._code_of(t) for t in distinct.to_pylist()], np.int64)
        codes = coded[place] if len(place) else np.zeros(0, np.int64)
        starts = np.flatnonzero(codes >= 0)
        for size in range(2, self.size + 1):
            ahead = starts + size - 1
            fits = ahead < len(codes)
            starts = starts[fits]
            starts = starts[(codes[starts + size - 1] >= 0) & (owner[starts + size - 1] == owner[starts])]
            if size < self.size and len(starts):  # those that are known, and known again from their second token on
                keys = self._packed(codes, starts, size)
                found, inverse = np.unique(keys[0], return_inverse=True) if len(keys) == 1 else np.unique(keys, axis=1, return_inverse=True)
                test = self.known[size - 1]
                good = np.array([test(t) for t in self.terms(np.atleast_2d(found), size).to_pylist()], bool)[inverse.ravel()]
                starts = starts[good]
                is_known = np.zeros(len(codes) + 1, bool)
                is_known[starts] = True
                starts = starts[is_known[starts + 1]]
        if not len(starts):
            return
        keys, row = self._packed(codes, starts, self.size), owner[starts]
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)  # both keep the order of rows
        keys, row = keys[:, order], row[order]
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        first = np.flatnonzero(new)
        new[1:] |= row[1:] != row[:-1]
        cf, rows = np.diff(np.append(first, len(row))), np.add.reduceat(new.astype(np.int64), first)
        self.pending.setdefault(group, []).append((keys[:, first], cf, rows))
        self.held += len(first)

    def _combine(self) -> None:
        for g, parts in self.pending.items():
            if len(parts) > 1:
                self.pending[g] = [_summed(np.concatenate([p[0] for p in parts], axis=1), *[np.concatenate([p[k] for p in parts]) for k in (1, 2)])]
        self.held = sum(len(p[1]) for parts in self.pending.values() for p in parts)

    def full(self) -> bool:
        if self.held >= PENDING:
            self._combine()
        return self.held >= PENDING or len(self.code) >= HELD

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        self._combine()
        for g, parts in self.pending.items():
            for keys, cf, rows in parts:
                for start in range(0, len(cf), HELD):
                    part = slice(start, start + HELD)
                    yield pa.RecordBatch.from_pydict({
                        "term": self.terms(keys[:, part], self.size), "group": pa.array(np.full(len(cf[part]), g, np.int32)),
                        "cf": pa.array(cf[part].astype(np.int64)), "df": pa.array(rows[part]),
                    })
        self.clear()


def _char_level(sizes: tuple[int, ...], part: int, low: int, known: Callable[[str], bool] | None, word: str) -> list[str]:
    """N-grams of a word of the given sizes whose parts of ``part`` characters are all known."""
    padded = f" {word} "
    if known is None:
        return [padded[i : i + low] for i in range(len(padded) - low + 1)] or [padded]
    flags = [known(padded[i : i + part]) for i in range(len(padded) - part + 1)]
    return [padded[i : i + size] for size in sizes for i in _runs(flags, size - part + 1)]


def _sum_of(column: str, groups: Sequence[int]) -> Column:
    return reduce(Column.__add__, [F.get(column, F.lit(g)) for g in groups])


def distinct_words(rows: DataFrame) -> DataFrame:
    """``(group, unit, n)``: the blank-separated words of lower-cased texts (``group``, ``text``), counted inside the task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for g, n in found.items():
                yield pa.RecordBatch.from_pydict({"group": pa.array([g] * len(n), pa.int32()), "unit": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})
            found.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                for g, lowered in zip(piece.column("group").to_pylist(), piece.column("text").to_pylist()):
                    found.setdefault(g, Counter()).update(lowered.split())  # parted where `tokens.blank_separated_words` does
                if sum(map(len, found.values())) >= HELD:
                    yield from handed_on()
        yield from handed_on()

    return rows.mapInArrow(count, "group int, unit string, n long").groupBy("group", "unit").agg(F.sum("n").alias("n"))


def vocabulary_levels(
    df: DataFrame, spec: TfidfSpec, n_docs: Sequence[int], views: Sequence[Sequence[int]], text_col: str = "comment_text", group_col: str | None = None
) -> list[DataFrame]:
    """Tables ``(term, cf, df)`` that hold every term of any view's vocabulary; ``cf`` and ``df`` have one number per group of rows.

    A view is a set of groups, such as all folds but one. One level after the other, n-grams grow by a token (by a character): an n-gram is no
    more frequent than its parts, so once ``max_features`` eligible terms are counted, only n-grams are looked at whose
    parts all reach the last of their counts, in some view. The others are neither built nor shuffled. Terms are
    combined in the tasks, and known parts are a filter of fixed size. Characters have no document counts (``df`` is null).
    """
    groups = len(n_docs)
    group = F.col(group_col) if group_col else F.lit(0)
    word = spec.analyzer == "word"
    by_group = lambda name: F.array(*[F.coalesce(F.sum(F.when(F.col("group") == g, F.col(name))), F.lit(0)) for g in range(groups)])
    if not word and (spec.min_df > 1 or spec.max_df < 1.0):  # document counts of all n-grams decide
        rows = _distinct_words(df.withColumns({"_row": F.monotonically_increasing_id(), "group": group}), spec, text_col, "_row", "group")
        in_row = rows.select("_row", "group", "n", _grams(spec)).groupBy("_row", "group", "term").agg(F.sum("n").alias("tf"), F.lit(1).alias("one"))
        return [materialize(in_row.groupBy("term").agg(by_group("tf").alias("cf"), by_group("one").alias("df")), "term-counts")]
    if word:  # tokens are found once, for all levels
        units = df.select(group.cast("int").alias("group"), _joined_tokens(spec, text_col).alias("unit"))
        units = materialize(units, "tokens") if spec.high > 1 else units
        levels: list[tuple[int, ...]] = [(n,) for n in range(1, spec.high + 1)]
    else:
        units = materialize(distinct_words(df.select(group.cast("int").alias("group"), F.lower(_source(spec, text_col)).alias("text"))), "distinct-words")
        levels = [(spec.low,), (spec.low + 1,), tuple(range(spec.low + 2, spec.high + 1))]
        levels = [tuple(n for n in sizes if n <= spec.high) for sizes in levels]
    context, tables, filters = df.sparkSession.sparkContext, [], []
    levels = [sizes for sizes in levels if sizes]
    for sizes in levels:
        part = sizes[0] - 1

        def count_words(batches: Iterator[pa.RecordBatch], size=sizes[0], filters=tuple(filters)) -> Iterator[pa.RecordBatch]:
            grams = _WordGrams(size, [_is_known(f.value) for f in filters])
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(start, SLICE)
                    owner, place, distinct = _split(piece.column("unit"))
                    of_row = np.asarray(piece.column("group").fill_null(-1))[owner]
                    for g in np.unique(of_row).tolist():
                        if g >= 0:
                            here = of_row == g
                            grams.add(g, owner[here], place[here], distinct)
                    if grams.full():
                        yield from grams.handed_on()
            yield from grams.handed_on()

        def count_chars(batches: Iterator[pa.RecordBatch], sizes=sizes, filters=tuple(filters), part=part) -> Iterator[pa.RecordBatch]:
            known = _is_known(filters[-1].value) if filters else None
            found: dict[int, Counter] = {}

            def handed_on() -> Iterator[pa.RecordBatch]:
                for g, cf in found.items():
                    yield pa.RecordBatch.from_pydict({
                        "term": pa.array(cf.keys(), pa.string()), "group": pa.array([g] * len(cf), pa.int32()),
                        "cf": pa.array(cf.values(), pa.int64()), "df": pa.array([0] * len(cf), pa.int64()),
                    })
                found.clear()

            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(start, SLICE)
                    for g, one, n in zip(*[piece.column(c).to_pylist() for c in ("group", "unit", "n")]):
                        if one is None or g is None:
                            continue
                        cf = found.setdefault(g, Counter())
                        for term in _char_level(sizes, part, spec.low, known, one):
                            cf[term] = cf.get(term, 0) + n
                        if len(cf) >= HELD:
                            yield from handed_on()
                if sum(map(len, found.values())) >= HELD:
                    yield from handed_on()
            yield from handed_on()

        count = count_words if word else count_chars
        totals = units.mapInArrow(count, "term string, group int, cf long, df long").groupBy("term").agg(
            by_group("cf").alias("cf"), (by_group("df") if word else F.lit(None).cast("array<bigint>")).alias("df")
        )
        tables.append(materialize(totals, "term-counts"))
        if sizes is levels[-1]:
            break
        possible = F.lit(False)
        for view in views:
            least = view_vocabulary(tables, spec, n_docs, view).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
            bound = least["cf"] if least["n"] >= spec.max_features else 0
            reaches = _sum_of("cf", view) >= max(1, bound)
            possible = possible | (reaches & (_sum_of("df", view) >= spec.min_df) if word else reaches)
        filters.append(context.broadcast(_known(tables[-1].filter(possible))))
    for f in filters:
        f.destroy()
    forget(units)
    return tables


def view_vocabulary(tables: list[DataFrame], spec: TfidfSpec, n_docs: Sequence[int], view: Sequence[int]) -> DataFrame:
    """``(term, cf, df)`` of the chosen terms of one view."""
    counts = reduce(DataFrame.unionByName, tables).select("term", _sum_of("cf", view).alias("cf"), _sum_of("df", view).alias("df"))
    if spec.analyzer == "word" and spec.low > 1:
        counts = counts.filter(F.size(F.split("term", " ")) >= spec.low)
    if spec.analyzer == "word" or spec.min_df > 1 or spec.max_df < 1.0:
        return select_vocabulary(counts.filter("df > 0"), F.lit(sum(n_docs[g] for g in view)), spec)
    return select_vocabulary(counts.filter("cf > 0").drop("df"), F.lit(0), spec).withColumn("df", F.lit(None).cast("bigint"))


def _ranks_first(spec: TfidfSpec) -> bool:
    """Whether terms are chosen before their document frequencies are known: character n-grams without limits on these."""
    return spec.analyzer == "char" and spec.min_df <= 1 and spec.max_df >= 1.0


def _chosen(df: DataFrame, spec: TfidfSpec, text_col: str) -> tuple[int, DataFrame]:
    n = df.count()
    return n, view_vocabulary(vocabulary_levels(df, spec, [n], [[0]], text_col), spec, [n], [0])


def _ranked_terms(df: DataFrame, spec: TfidfSpec, text_col: str) -> tuple[int, list[str]]:
    """A vocabulary that is ranked first, in the order of its terms; at most ``max_features``, on the driver."""
    n = df.count()
    tables = vocabulary_levels(df, spec, [n], [[0]], text_col)
    terms = sorted((r["term"] for r in view_vocabulary(tables, spec, [n], [0]).collect()), key=lambda t: t.encode("utf-8", "surrogatepass"))
    forget(*tables)
    return n, terms


def _counted_choice(df: DataFrame, spec: TfidfSpec, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """A vocabulary that is ranked first, and every row's counts of its terms, from which the document frequencies come."""
    n, terms = _ranked_terms(df, spec, text_col)
    counted = materialize(counted_rows(df.select(F.col(id_col).alias("id"), text_col), spec, terms, text_col).select("id", "indices", "tf"), "counted")
    return _with_idf(document_counts(counted, terms), n), counted


def fit_vocabulary(df: DataFrame, spec: TfidfSpec, text_col: str = "comment_text", id_col: str = "id") -> DataFrame:
    """``(term, idx, df, idf)`` of one vectoriser; ``idx`` follows the order of the terms.

    The choice runs while this is called (`vocabulary_levels`). Without document-frequency limits, character n-grams are
    ranked from the distinct words of the whole table; document frequencies are then counted for the chosen ones only.
    """
    if _ranks_first(spec):
        n, terms = _ranked_terms(df, spec, text_col)
        return _with_idf(document_frequencies(df, spec, terms, text_col), n)
    n, chosen = _chosen(df, spec, text_col)
    return _with_idf(chosen, n)


def _with_idf(chosen: DataFrame, n: int) -> DataFrame:
    # at most max_features rows, so one ordered window is small
    idx = F.row_number().over(W.orderBy("term")) - 1
    idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    return chosen.select("term", idx.alias("idx"), "df", idf.alias("idf"))


def document_counts(counted: DataFrame, terms: list[str]) -> DataFrame:
    """``(term, df)`` of a vocabulary from the rows' positions in it."""
    found = counted.select(F.explode("indices").alias("idx")).groupBy("idx").agg(F.count("*").alias("df"))
    placed = counted.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    return placed.join(found, "idx", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def document_frequencies(df: DataFrame, spec: TfidfSpec, terms: list[str], text_col: str) -> DataFrame:
    """``(term, df)`` of a vocabulary from the text: tasks add up what they find, and no row's counts are written."""
    placed = df.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    if not terms:
        return placed.select("term", F.lit(0).cast("bigint").alias("df"))
    shared = df.sparkSession.sparkContext.broadcast(terms)  # lives as long as the plan that reads it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, total = _positions(shared.value, spec), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.column("text").slice(start, SLICE)
                total += np.bincount(_row_counts(positions(piece), len(piece), len(total))[1], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"idx": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})

    found = df.select(_countable(spec, text_col).alias("text")).mapInArrow(count, "idx int, n long").groupBy("idx").agg(F.sum("n").alias("df"))
    return placed.join(found, "idx", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


# ---------------------------------------------------------------- weights, inside the row

_COUNTS = "struct<indices: array<int>, tf: array<int>, values: array<double>>"


def units(owner: np.ndarray, tf: np.ndarray, idf: np.ndarray, rows: int, sublinear: bool) -> np.ndarray:
    """L2-normalised weights of the counts of several messages; ``owner`` is the message of each."""
    raw = (np.log(tf) + 1 if sublinear else tf) * idf
    norm = np.sqrt(np.bincount(owner, raw * raw, rows))
    return raw / np.where(norm == 0, 1.0, norm)[owner]


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def owners(column: pa.Array) -> np.ndarray:
    """The row of every item of an array of lists."""
    return np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, and the size of each."""
    sizes = end - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes), sizes


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, position in the vocabulary, how often


def _word_positions(terms: list[str], spec: TfidfSpec) -> Callable[[pa.Array], Hits]:
    """From the texts' tokens, joined by blanks, to the positions of the vocabulary's n-grams in them.

    Beginnings of terms are numbered level by level, a beginning being the one before and a token, so that the walk from a token stops as soon as
    no term can follow. All tokens of a batch take a step at once.
    """
    code: dict[str, int] = {}
    levels: list[dict[tuple[int, int], int]] = [{} for _ in range(spec.high)]
    places: list[dict[int, int]] = [{} for _ in range(spec.high)]
    for i, t in enumerate(terms):
        node = 0
        parts = t.split(" ")
        for level, token in zip(levels, parts):
            node = level.setdefault((node, code.setdefault(token, len(code))), len(level))
        places[len(parts) - 1][node] = i
    count = max(1, len(code))
    tables = []
    for level, found in zip(levels, places):
        key = np.array([node * count + token for node, token in level], np.int64)
        order = np.argsort(key)
        place = np.full(len(level), -1, np.int64)
        place[list(found)] = list(found.values())
        tables.append((key[order], order, place))

    def positions(joined: pa.Array) -> Hits:
        owner, place, distinct = _split(joined)
        coded = np.array([code.get(t, -1) for t in distinct.to_pylist()], np.int64)
        codes = coded[place] if len(place) else np.zeros(0, np.int64)
        start, node, rows, at = np.flatnonzero(codes >= 0), 0, [], []
        for k, (key, order, place) in enumerate(tables):
            fits = start + k < len(codes)
            start, node = start[fits], node[fits] if k else 0
            token = codes[np.minimum(start + k, len(codes) - 1)] if len(codes) else start
            step = node * count + token
            near = np.minimum(np.searchsorted(key, step), len(key) - 1) if len(key) else np.zeros(len(step), np.int64)
            good = (token >= 0) & (owner[start + k] == owner[start]) & (key[near] == step) if len(key) else np.zeros(len(step), bool)
            start, node = start[good], order[near[good]]
            hit = place[node]
            rows.append(owner[start[hit >= 0]])
            at.append(hit[hit >= 0])
        rows, at = np.concatenate(rows), np.concatenate(at)
        return rows, at, np.ones(len(at))

    return positions


def _char_positions(terms: list[str], spec: TfidfSpec) -> Callable[[pa.Array], Hits]:
    """From lower-cased texts to the positions of the vocabulary's n-grams in their words.

    A word's n-grams are looked up once per task and remembered, so the cost per message is one look-up per word. In the JVM the
    same is some twenty-five rows per word through a join and an aggregate, many times slower.
    """
    index, low, high, remembered = {t: i for i, t in enumerate(terms)}, spec.low, spec.high, 200_000
    for t in terms:  # beginnings of terms, so that a walk can stop at the first miss
        for end in range(low, len(t)):
            index.setdefault(t[:end], -1)

    class Words(dict):
        """The number of each word; the positions of word ``n`` are ``flat[ends[n] : ends[n + 1]]``."""

        def __init__(self):
            self.flat, self.ends = array("q"), array("q", [0])

        def __missing__(self, word: str) -> int:
            padded = f" {word} "
            size, get, found = len(padded), index.get, []
            if size < low:
                found.append(get(padded, -1))
            for start in range(size - low + 1):
                end = start + low
                at = get(padded[start:end])
                while at is not None:
                    if at >= 0:
                        found.append(at)
                    if end == size or end - start == high:
                        break
                    end += 1
                    at = get(padded[start:end])
            self.flat.extend([f for f in found if f >= 0])
            self.ends.append(len(self.flat))
            number = self[word] = len(self.ends) - 2
            return number

    memo = Words()

    def positions(lowered: pa.Array) -> Hits:
        nonlocal memo
        if len(memo) >= remembered:
            memo = Words()
        number, codes, sizes = memo.__getitem__, [], []
        for one in lowered.to_pylist():
            words = one.split() if one else []  # parted where `tokens.blank_separated_words` does
            codes.append(np.fromiter(map(number, words), np.int64, len(words)))
            sizes.append(len(words))
        owner, codes = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.zeros(0, np.int64), *codes])
        used = len(memo.ends)
        (pair,), times = _summed((owner * used + codes)[None, :], np.ones(len(codes))) if len(codes) else (np.zeros((1, 0), np.int64), np.zeros(0))
        flat, ends = np.array(memo.flat, np.int64), np.array(memo.ends, np.int64)
        place, sizes = ranges(ends[pair % used], ends[pair % used + 1])
        return np.repeat(pair // used, sizes), flat[place], np.repeat(times, sizes)

    return positions


def _positions(terms: list[str], spec: TfidfSpec) -> Callable[[pa.Array], Hits]:
    """From `_countable` texts to the positions of the vocabulary's n-grams in them."""
    return (_word_positions if spec.analyzer == "word" else _char_positions)(terms, spec)


CELLS = 1 << 20  # counts that are dense at once


def _row_counts(hits: Hits, rows: int, width: int) -> Hits:
    """Hits of equal row and position added up; rows ascend, and positions inside them."""
    owner, at, times = hits
    order = np.argsort(owner, kind="stable")
    owner, at, times = owner[order], at[order], times[order]
    step, out = max(1, CELLS // max(1, width)), []
    for start in range(0, rows, step):
        n = min(step, rows - start)
        first, end = np.searchsorted(owner, [start, start + n])
        counts = np.bincount((owner[first:end] - start) * width + at[first:end], times[first:end], n * width)
        found = np.flatnonzero(counts)
        out.append((found // max(1, width) + start, found % max(1, width), counts[found]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _counter(terms: list[str], idf: Sequence[float] | None, spec: TfidfSpec, context):
    """Arrow function from a message's `_countable` text to the positions, ascending, of the vocabulary's n-grams in it and their
    counts or, with ``idf``, their weights; the other of the two is empty."""
    shared = context.broadcast((terms, None if idf is None else np.array(idf, float)))  # lives as long as the plan that reads it

    @F.arrow_udf(_COUNTS)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, scale = shared.value
        positions = _positions(terms, spec)
        for batch in batches:
            made = []
            for start in range(0, len(batch), SLICE):
                piece = batch.slice(start, SLICE)
                owner, at, tf = _row_counts(positions(piece), len(piece), len(terms))
                sizes, nothing = np.bincount(owner, minlength=len(piece)), np.zeros(len(piece), int)
                weights = None if scale is None else units(owner, tf, scale[at], len(piece), spec.sublinear)
                made.append(pa.StructArray.from_arrays([
                    lists(at.astype(np.int32), sizes, pa.int32()),
                    lists(tf.astype(np.int32), sizes, pa.int32()) if scale is None else lists(np.zeros(0, np.int32), nothing, pa.int32()),
                    lists(np.zeros(0), nothing, pa.float64()) if scale is None else lists(weights, sizes, pa.float64()),
                ], ["indices", "tf", "values"]))
            yield pa.concat_arrays(made) if made else pa.array([], pa.struct([("indices", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))

    return count.asNondeterministic()  # so that no filter on its result runs it a second time


def _countable(spec: TfidfSpec, text_col: str) -> Column:
    return _joined_tokens(spec, text_col) if spec.analyzer == "word" else F.lower(_source(spec, text_col))


def _counted(df: DataFrame, spec: TfidfSpec, terms: list[str], idf: Sequence[float] | None, text_col: str) -> DataFrame:
    return df.withColumn("_found", _counter(terms, idf, spec, df.sparkSession.sparkContext)(_countable(spec, text_col)))


def counted_rows(df: DataFrame, spec: TfidfSpec, terms: list[str], text_col: str, indices: str = "indices", tf: str = "tf") -> DataFrame:
    """``df`` with the positions, ascending, and counts of the terms in each row. ``terms`` is a fitted vocabulary in its order."""
    if not terms:
        nothing = F.array().cast("array<int>")
        return df.withColumns({indices: nothing, tf: nothing})
    found = _counted(df, spec, terms, None, text_col)
    return found.withColumns({indices: F.col("_found.indices"), tf: F.col("_found.tf")}).drop("_found")


def tfidf_rows(df: DataFrame, spec: TfidfSpec, terms: list[str], idf: Sequence[float], text_col: str = "comment_text", indices: str = "indices", values: str = "values") -> DataFrame:
    """``df`` with the positions and L2-normalised weights of the terms in each row: one narrow projection."""
    if not terms:
        return df.withColumns({indices: F.array().cast("array<int>"), values: F.array().cast("array<double>")})
    found = _counted(df, spec, terms, idf, text_col)
    return found.withColumns({indices: F.col("_found.indices"), values: F.col("_found.values")}).drop("_found")


def fitted_terms(vocabulary: DataFrame, *columns: str) -> list[list]:
    """Columns of a vocabulary in the order of its terms. It has at most ``max_features`` rows and comes to the driver."""
    rows = vocabulary.select("idx", *columns).orderBy("idx").collect()
    return [[r[c] for r in rows] for c in columns]


def tfidf(
    df: DataFrame,
    spec: TfidfSpec,
    text_col: str = "comment_text",
    id_col: str = "id",
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``(id, term, idx, weight)``; fits the vocabulary on the same table unless one is given.

    Weights are made inside the row, so nothing is shuffled by id.
    """
    if vocabulary is None and _ranks_first(spec):
        vocabulary, counted = _counted_choice(df, spec, text_col, id_col)
        vocabulary = materialize(vocabulary, "vocabulary")
        weigh = _weigher(fitted_terms(vocabulary, "idf")[0], spec.sublinear, df.sparkSession.sparkContext)
        rows = counted.withColumn("values", weigh("indices", "tf"))
    else:
        vocabulary = materialize(fit_vocabulary(df, spec, text_col, id_col), "vocabulary") if vocabulary is None else vocabulary
        rows = tfidf_rows(df.select(F.col(id_col).alias("id"), text_col), spec, *fitted_terms(vocabulary, "term", "idf"), text_col)
    long = rows.select("id", F.inline(F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("weight"))))
    return long.join(F.broadcast(vocabulary.select("term", "idx")), "idx").select("id", "term", "idx", "weight")


def _weigher(idf: Sequence[float], sublinear: bool, context):
    """Arrow function from positions and counts to L2-normalised weights."""
    shared = context.broadcast(np.array(idf, float))  # lives as long as the plan that reads it

    @F.arrow_udf("array<double>")
    def weigh(indices: pa.Array, tf: pa.Array) -> pa.Array:
        at = np.asarray(indices.flatten())
        x = units(owners(indices), np.asarray(tf.flatten()).astype(float), shared.value[at], len(indices), sublinear)
        return lists(x, np.asarray(indices.value_lengths()), pa.float64())

    return weigh.asNondeterministic()


def feature_union(blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """Stack ``(id, idx, weight)`` blocks side by side: each starts where the one before ends."""
    out, offset = None, 0
    for block, width in blocks:
        part = block.select("id", (F.col("idx") + offset).alias("idx"), "weight")
        out = part if out is None else out.unionByName(part)
        offset += width
    return out


def _shift(offset: int) -> Callable[[Column], Column]:
    return lambda index: index + offset


def union_rows(df: DataFrame, blocks: Sequence[tuple[TfidfSpec, DataFrame]], text_col: str = "comment_text") -> tuple[DataFrame, int]:
    """``df`` with ``indices`` and ``values`` of several fitted vectorisers side by side, and the width of all: one narrow projection."""
    out, width, at, x = df, 0, [], []
    for b, (spec, vocabulary) in enumerate(blocks):
        terms, idf = fitted_terms(vocabulary, "term", "idf")
        out = tfidf_rows(out, spec, terms, idf, text_col, f"_i{b}", f"_v{b}")
        at.append(F.transform(f"_i{b}", _shift(width)))
        x.append(F.col(f"_v{b}"))
        width += len(terms)
    return out.select(*df.columns, F.concat(*at).alias("indices"), F.concat(*x).alias("values")), width


def sparse_rows(features: DataFrame) -> DataFrame:
    """``(id, indices, values)``. A row holds no more entries than there are columns."""
    return (
        features.groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_f"))
        .select("id", F.col("_f.idx").alias("indices"), F.col("_f.weight").alias("values"))
    )


BLOCK = 1024  # numbers (or rows of a matrix) of a partial sum that travel together
FAN_IN = 64  # partial sums that are added up at once
AT_ONCE = 64 << 20  # bytes of partial sums that come to the driver without being added up before
PIECE = 512  # entries that are multiplied at once


def blocks_of(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's partial sum in blocks; blocks of zeros stay behind."""
    for block in range(0, len(total), BLOCK):
        part = total[block : block + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "z": pa.array([part.tobytes()], pa.binary())})


def add_up(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: tuple[int, ...], tasks: int | None = None) -> np.ndarray:
    """The sum of all tasks' `blocks_of`, an array of bounded ``shape``. ``tasks``: how many parts ``rows`` has, if known.

    Few and small partial sums come to the driver at once; others are first summed by tasks, ``FAN_IN`` at a time and then all.
    """
    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(z) for z in parts["z"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "z": [total.tobytes()]})

    parts = rows.mapInArrow(partial, "block int, z binary")
    tasks = rows.rdd.getNumPartitions() if tasks is None else tasks
    if tasks > FAN_IN:
        parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("block", "part").applyInPandas(add, "block int, z binary")
    if min(tasks, FAN_IN) * int(np.prod(shape)) * 8 > AT_ONCE:
        parts = parts.groupBy("block").applyInPandas(add, "block int, z binary")
    out = np.zeros(shape)
    for r in parts.collect():  # at most AT_ONCE bytes, or one array of this shape
        out[r["block"] : r["block"] + BLOCK] += np.frombuffer(r["z"]).reshape(-1, *shape[1:])
    return out


PACKED = 128  # rows of a packed block


def packed(rows: DataFrame, *more: str) -> DataFrame:
    """Sparse rows, written once as blocks of bytes: what is read many times then passes from the JVM to Python as it is, not number by number.

    ``more`` are columns of numbers, or of arrays of them that are all of one length. See `unpacked`.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED):
                piece = batch.slice(start, PACKED)
                made = {"n": pa.array([piece.num_rows], pa.int32()), "sizes": np.asarray(piece.column("indices").value_lengths()).astype(np.int32)}
                made |= {"at": np.asarray(piece.column("indices").flatten()).astype(np.int32), "x": np.asarray(piece.column("values").flatten()).astype(float)}
                for name in more:
                    column = piece.column(name)
                    made[name] = np.asarray(column.flatten() if pa.types.is_list(column.type) else column).astype(float)
                yield pa.RecordBatch.from_pydict({k: v if k == "n" else pa.array([v.tobytes()], pa.binary()) for k, v in made.items()})

    schema = ", ".join(["n int", *[f"{name} binary" for name in ("sizes", "at", "x", *more)]])
    return materialize(rows.select("indices", "values", *more).mapInArrow(pack, schema), "packed")


def unpacked(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """Of each block of `packed`: the number of rows, row number, index and value of every entry, and the columns asked for."""
    for k, n in enumerate(batch.column("n").to_pylist()):
        sizes, at, x, *rest = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in [("sizes", np.int32), ("at", np.int32), ("x", float), *[(m, float) for m in more]])
        yield n, np.repeat(np.arange(n), sizes), at, x, *rest


class Entries:
    """A block of sparse rows: row number, index and value of every entry."""

    def __init__(self, n: int, owner: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.n, self.owner, self.at, self.x = n, owner, at, x

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.x * w[self.at], self.n)

    def back(self, p: np.ndarray, width: int) -> np.ndarray:
        """The transpose times ``p``, a number for each row."""
        return np.bincount(self.at, self.x * p[self.owner], width)


class CountedEntries:
    """A block of `Counted`: a value is a count (or 1 + its logarithm) times the term's idf, over its segment's length. Most counts are 1, so that
    coefficients can be scaled by the idf instead, and few values are touched one by one."""

    def __init__(self, n: int, sizes: np.ndarray, at: np.ndarray, more: np.ndarray, factor: np.ndarray, idf: np.ndarray):
        self.n, self.sizes, self.at, self.more, self.factor, self.idf = n, sizes, at, more, factor, idf
        self.filled = np.flatnonzero(sizes)
        self.first = (np.cumsum(sizes) - sizes)[self.filled]
        norm = np.sqrt(self._sums(self._counted(idf * idf, factor * factor)))
        self.norm = np.where(norm == 0, 1.0, norm)

    def _counted(self, numbers: np.ndarray, factor: np.ndarray) -> np.ndarray:
        out = numbers[self.at]
        out[self.more] *= factor
        return out

    def _sums(self, entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        if len(self.first):
            out[self.filled] = np.add.reduceat(entries, self.first)
        return out

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.sizes.reshape(self.n, -1).sum(axis=1)) if len(self.sizes) else np.zeros(0, np.int64)

    @property
    def x(self) -> np.ndarray:
        return self._counted(self.idf, self.factor) / np.repeat(self.norm, self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        of_segment = self._sums(self._counted(self.idf * w, self.factor)) / self.norm
        return of_segment.reshape(self.n, -1).sum(axis=1) if len(of_segment) else np.zeros(self.n)

    def back(self, p: np.ndarray, width: int) -> np.ndarray:
        """The transpose times ``p``, a number for each row."""
        spread = np.repeat(np.repeat(p, len(self.sizes) // max(1, self.n)) / self.norm, self.sizes)
        spread[self.more] *= self.factor
        return np.bincount(self.at, spread, width) * self.idf


class Packed:
    """Rows as blocks of bytes. ``parts(batch, *more)`` makes `Entries` of the blocks of a batch, with the columns asked for."""

    def __init__(self, blocks: DataFrame, parts: Callable[..., Iterator[tuple]] | None = None):
        self.blocks, self.parts = blocks, parts or plain_parts
        self._tasks: int | None = None

    def count(self) -> int:
        return self.blocks.agg(F.sum("n")).first()[0] or 0

    @property
    def tasks(self) -> int:
        if self._tasks is None:
            self._tasks = self.blocks.rdd.getNumPartitions()
        return self._tasks


def plain_parts(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    for n, owner, at, x, *rest in unpacked(batch, *more):
        yield Entries(n, owner, at, x), *rest


def as_packed(rows: DataFrame | Packed) -> Packed:
    return rows if isinstance(rows, Packed) else Packed(rows)


def _coded(numbers: np.ndarray) -> bytes:
    """Whole numbers, most of them from 0 to 255, as a byte each; the places and values of the others stand before."""
    others = np.flatnonzero((numbers < 0) | (numbers > 255))
    low = numbers.astype(np.uint8)
    low[others] = 0
    return b"".join(part.tobytes() for part in (np.array([len(others)], "<i4"), others.astype("<i4"), numbers[others].astype("<i4"), low))


def _decoded(coded: pa.Buffer) -> np.ndarray:
    """What `_coded` made bytes of."""
    n = int(np.frombuffer(coded, "<i4", 1)[0])
    out = np.frombuffer(coded, np.uint8, offset=4 + 8 * n).astype(np.int64)
    out[np.frombuffer(coded, "<i4", n, 4)] = np.frombuffer(coded, "<i4", n, 4 + 4 * n)
    return out


@dataclass
class Counted:
    """Every row's counts of the terms of several vectorisers, side by side, as blocks of bytes: one to two bytes an entry, where weights would take twelve.

    The weights of a view (`weighted`) are made when a block is read, so that all views share one table. A block has rows of one ``group``;
    of a row, the counts of one vectoriser are a segment.
    """

    blocks: DataFrame
    widths: list[int]
    sublinear: list[bool]

    @property
    def width(self) -> int:
        return sum(self.widths)

    def document_frequencies(self, groups: int) -> np.ndarray:
        """Rows of each group with each term (groups x width)."""
        width, rows = self.width, Packed(self.blocks.select("group", "gaps"))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((groups, width))
            for batch in batches:
                for k, g in enumerate(batch.column("group").to_pylist()):
                    total[g] += np.bincount(np.cumsum(_decoded(batch.column("gaps")[k].as_buffer())), minlength=width)
            yield from blocks_of(total)

        return add_up(rows.blocks, partial, (groups, width), rows.tasks)

    def weighted(self, idf: Sequence[np.ndarray], groups: Sequence[int] | None = None, weights: dict[int, float] | None = None) -> Packed:
        """The rows of ``groups`` (all if None) with the idf of each vectoriser's terms, 0 for terms of other views. ``weights`` are those of the classes;
        rows of none weigh nothing."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(np.concatenate([np.zeros(0), *idf]))  # lives as long as the plan that reads it
        ends, sublinear = np.cumsum(self.widths), np.array(self.sublinear, bool)

        def parts(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
            for k, n in enumerate(batch.column("n").to_pylist()):
                sizes, at, place, tf = (_decoded(batch.column(c)[k].as_buffer()) for c in ("sizes", "gaps", "more", "tf"))
                at, place, tf = np.cumsum(at), np.cumsum(place), tf.astype(float)
                if sublinear.any():
                    tf = np.where(sublinear[np.searchsorted(ends, at[place], "right")], np.log(tf) + 1, tf)
                yield CountedEntries(n, sizes, at, place, tf, shared.value), *[_of_block(batch, k, name, weights) for name in more]

        return Packed(self.blocks if groups is None else self.blocks.filter(F.col("group").isin(*groups)), parts)

    def classes(self, groups: Sequence[int]) -> DataFrame:
        """``y`` of the rows of ``groups`` that have one."""
        return self.blocks.filter(F.col("group").isin(*groups)).select(F.explode("y").alias("y")).filter("y IS NOT NULL")


def _of_block(batch: pa.RecordBatch, k: int, name: str, weights: dict[int, float] | None) -> np.ndarray | pa.Array:
    """A column of block ``k`` of `Counted`: ``id`` as it is; ``dense``; ``y``, 0 if null; ``weight``, 0 if ``y`` is null."""
    column = batch.column("y" if name == "weight" else name)
    if name == "dense":
        return np.frombuffer(column[k].as_buffer(), float)
    values = column[k].values
    if name == "id":
        return values
    y = np.asarray(values.cast(pa.float64()))  # null: not a number
    if name == "y":
        return np.nan_to_num(y)
    return sum((w * (y == c) for c, w in weights.items()), np.zeros(len(y)))


def packed_counts(rows: DataFrame, vectorisers: Sequence[tuple[TfidfSpec, list[str]]], text_col: str = "text") -> Counted:
    """`Counted` from ``rows`` with ``id``, ``y`` (int), ``group`` (int, from 0 on), ``dense`` (array<double>) and a text, which is read once for all vectorisers."""
    specs, widths = [spec for spec, _ in vectorisers], [len(terms) for _, terms in vectorisers]
    shared = rows.sparkSession.sparkContext.broadcast([terms for _, terms in vectorisers])
    starts, several = np.append(0, np.cumsum(widths)).tolist(), len(widths)
    source = rows.select("id", "y", "group", "dense", *[_countable(spec, text_col).alias(f"_s{b}") for b, spec in enumerate(specs)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [_positions(terms, spec) if terms else None for spec, terms in zip(specs, shared.value)]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                n, found = piece.num_rows, [(np.zeros(0, np.int64),) * 3]
                for b, positions in enumerate(ways):
                    if positions:
                        owner, at, tf = _row_counts(positions(piece.column(f"_s{b}")), n, widths[b])
                        found.append((owner * several + b, at + starts[b], tf))
                segment, at, tf = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
                order = np.argsort(segment, kind="stable")
                at, tf, sizes = at[order], tf[order], np.bincount(segment, minlength=n * several).reshape(n, several)
                ends, group = np.cumsum(sizes.sum(axis=1)), np.asarray(piece.column("group"))
                by_group = np.argsort(group, kind="stable")
                for same in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
                    for own in (same[k : k + PACKED] for k in range(0, len(same), PACKED)):
                        place, _ = ranges(ends[own] - sizes[own].sum(axis=1), ends[own])
                        more = np.flatnonzero(tf[place] > 1)
                        coded = {"sizes": sizes[own].ravel(), "gaps": np.diff(at[place], prepend=0), "more": np.diff(more, prepend=0), "tf": tf[place][more]}
                        mine, whole = piece.take(pa.array(own)), pa.array([0, len(own)], pa.int32())
                        yield pa.RecordBatch.from_pydict({
                            "n": pa.array([len(own)], pa.int32()), "group": pa.array(group[own[:1]], pa.int32()),
                            "id": pa.ListArray.from_arrays(whole, mine.column("id")), "y": pa.ListArray.from_arrays(whole, mine.column("y")),
                            "dense": pa.array([np.asarray(mine.column("dense").flatten()).astype(float).tobytes()], pa.binary()),
                            **{name: pa.array([_coded(numbers)], pa.binary()) for name, numbers in coded.items()},
                        })

    schema = T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("id", T.ArrayType(rows.schema["id"].dataType)), T.StructField("y", T.ArrayType(T.IntegerType())),
        *[T.StructField(name, T.BinaryType()) for name in ("dense", "sizes", "gaps", "more", "tf")],
    ])
    blocks = materialize(source.mapInArrow(pack, schema), "counted")
    shared.destroy()
    return Counted(blocks, widths, [spec.sublinear for spec in specs])


def joined(blocks: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Blocks of `unpacked` (without further columns) put together up to ``most`` rows: a wide matrix is then read and added to once for many rows."""
    held, rows = [], 0
    for n, owner, at, x in blocks:
        if held and rows + n > most:
            yield rows, *map(np.concatenate, zip(*held))
            held, rows = [], 0
        held.append((owner + rows, at, x))
        rows += n
    if held:
        yield rows, *map(np.concatenate, zip(*held))


def _times(owner: np.ndarray, at: np.ndarray, x: np.ndarray, q: np.ndarray, rows: int) -> np.ndarray:
    """A batch of sparse rows times a matrix, in pieces, so that no large product is made: row by row if rows are long. ``owner`` ascends."""
    out, x = np.zeros((rows, q.shape[1]), q.dtype), x.astype(q.dtype, copy=False)
    here, first = np.unique(owner, return_index=True)
    if len(at) < LONG * len(here):
        for start in range(0, len(at), PIECE):
            part = slice(start, start + PIECE)
            here, first = np.unique(owner[part], return_index=True)
            out[here] += np.add.reduceat(x[part, None] * q[at[part]], first, axis=0)
        return out
    for row, start, end in zip(here.tolist(), first.tolist(), [*first[1:].tolist(), len(owner)]):
        for k in range(start, end, PIECE):
            part = slice(k, min(k + PIECE, end))
            out[row] += x[part] @ q[at[part]]
    return out


LONG = 16  # entries of a row from which on a product of its own is cheaper
MATRIX = ("n", "sizes", "at", "x", "gaps", "more", "tf")  # columns of packed rows that make the matrix
ROWS = 1024  # rows of a dense block
CROWDED = 0.04  # share of a block's rows from which on a column is cheaper as a dense one
CLEAR = 1e-3  # share of the largest singular value from which on single precision finds a direction


def _blocks(owner: np.ndarray, at: np.ndarray, x: np.ndarray, rows: int, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in blocks of `ROWS` rows, frequent columns apart: the rows, the frequent columns, their dense block, and what is left as sparse entries."""
    slot = np.full(width, -1, np.int64)
    for start in range(0, rows, ROWS):
        n = min(ROWS, rows - start)
        first, end = np.searchsorted(owner, [start, start + n])
        o, a, v = owner[first:end] - start, at[first:end], x[first:end]
        columns = np.flatnonzero(np.bincount(a, minlength=width) > CROWDED * n)
        slot[columns] = np.arange(len(columns))
        place = slot[a]
        slot[columns] = -1
        crowded = place >= 0
        block = np.bincount(o[crowded] * len(columns) + place[crowded], v[crowded], n * len(columns)).reshape(n, len(columns))
        yield slice(start, start + n), columns, block, o[~crowded], a[~crowded], v[~crowded]


def _gram_times(rows: DataFrame | Packed, q: np.ndarray) -> np.ndarray:
    """``A^T (A q)`` in one pass over `packed` rows. Tasks add up their own rows, a batch as one sparse matrix and its transpose."""
    rows = as_packed(rows)
    shared, parts = rows.blocks.sparkSession.sparkContext.broadcast(q), rows.parts

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        z = np.zeros(q.shape)
        for n, owner, at, x in joined(((e.n, e.owner, e.at, e.x) for batch in batches for (e,) in parts(batch)), ROWS):
            for own, columns, block, o, a, v in _blocks(owner, at, x, n, len(q)):
                y, block = _times(o, a, v, q, own.stop - own.start), block.astype(q.dtype, copy=False)
                if len(columns):
                    y += block @ q[columns]
                    z[columns] += block.T @ y
                if len(a):
                    order = np.argsort(a, kind="stable")
                    rare, place = np.unique(a[order], return_inverse=True)
                    z[rare] += _times(place, o[order], v[order], y, len(rare))
        yield from blocks_of(z)

    out = add_up(rows.blocks.select(*[c for c in rows.blocks.columns if c in MATRIX]), partial, q.shape, rows.tasks)
    shared.destroy()
    return out


def fit_svd(rows: DataFrame | Packed, size: int, k: int, oversample: int = 10, passes: int = 6, tol: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (size x r) and singular values of the uncentred feature matrix, r at most ``k``.

    A randomised range finder: ``k + oversample`` random directions are multiplied by ``A^T A`` and made orthogonal again,
    at most ``passes`` times, one pass over the rows each; fewer if the values have settled. The number of jobs does not
    depend on ``k``. The matrix stays distributed; only factors, bounded by ``size * (k + oversample)``, are broadcast.

    Directions are found in single precision as long as all values are far above its rounding; the last pass, which makes the values and vectors
    that are returned, is always in double precision.

    The rank is cut: energies that rounding cannot tell from zero give no component. Those are at most
    ``eps * max(rows, size)`` of the largest, so no singular value below ``sqrt`` of that share of the first is kept.
    """
    n = rows.count()
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + oversample, max(1, n)))))[0]  # n rows span at most n directions
    before, blocks, values, settled = None, rows if isinstance(rows, Packed) else Packed(packed(rows)), np.zeros(0), False
    for p in range(passes):
        exact = p == passes - 1 or settled or p > 0 and not values[-1:].sum() > CLEAR * values[:1].sum()
        z = _gram_times(blocks, q if exact else q.astype(np.float32))
        energy, turn = np.linalg.eigh(q.T @ z)
        order = np.argsort(-energy)[:k]
        values = np.sqrt(np.maximum(energy[order], 0.0))
        vectors = q @ turn[:, order]
        settled = before is not None and np.abs(values - before).max() <= tol * max(values[0], 1e-12)
        if settled and exact:
            break
        before, q = values, np.linalg.qr(z)[0]
    if blocks is not rows:
        forget(blocks.blocks)
    floor = np.sqrt(np.finfo(float).eps * max(n, size)) * values[0] if len(values) else 0.0
    rank = int((values > floor).sum())
    return vectors[:, :rank], values[:rank]


def svd_project(rows: DataFrame | Packed, components: np.ndarray) -> DataFrame:
    """Adds ``dense``: the row times the components, by Arrow batches with the factors broadcast. Rows of `Counted` become ``(id, dense)``."""
    if isinstance(rows, Packed):
        return _project_packed(rows, components)
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(components))  # lives as long as the plan that reads it

    @F.pandas_udf("array<double>")
    def project(indices: pd.Series, values: pd.Series) -> pd.Series:
        v = shared.value
        sizes = np.array([len(i) for i in indices])
        if not sizes.any() or not v.shape[1]:
            return pd.Series([np.zeros(v.shape[1])] * len(sizes))
        owner, out = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), v.shape[1]))
        for own, columns, block, o, a, x in _blocks(owner, np.concatenate(list(indices)).astype(int), np.concatenate(list(values)), len(sizes), len(v)):
            out[own] = _times(o, a, x, v, own.stop - own.start)
            if len(columns):
                out[own] += block @ v[columns]
        return pd.Series(list(out))

    return rows.withColumn("dense", project("indices", "values"))


def _project_packed(rows: Packed, components: np.ndarray) -> DataFrame:
    shared, parts = rows.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(components)), rows.parts  # lives as long as the plan that reads it

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for entries, ids in (part for batch in batches for part in parts(batch, "id")):
            out = np.zeros((entries.n, v.shape[1]))
            for own, columns, block, o, a, x in _blocks(entries.owner, entries.at, entries.x, entries.n, len(v)):
                out[own] = _times(o, a, x, v, own.stop - own.start)
                if len(columns):
                    out[own] += block @ v[columns]
            yield pa.RecordBatch.from_arrays([ids, lists(out.ravel(), np.full(entries.n, v.shape[1]), pa.float64())], ["id", "dense"])

    return rows.blocks.mapInArrow(project, T.StructType([_id_field(rows), T.StructField("dense", T.ArrayType(T.DoubleType()))]))


def _id_field(rows: Packed) -> T.StructField:
    return T.StructField("id", rows.blocks.schema["id"].dataType.elementType)


def weight_rows(rows: Packed) -> DataFrame:
    """``(id, indices, values)`` of rows of `Counted`."""
    parts = rows.parts

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, ids in (part for batch in batches for part in parts(batch, "id")):
            sizes = np.bincount(entries.owner, minlength=entries.n)
            yield pa.RecordBatch.from_arrays([ids, lists(entries.at.astype(np.int32), sizes, pa.int32()), lists(entries.x, sizes, pa.float64())], ["id", "indices", "values"])

    return rows.blocks.mapInArrow(unpack, T.StructType([_id_field(rows), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))


def packed_union(df: DataFrame, blocks: Sequence[tuple[TfidfSpec, DataFrame]], text_col: str = "comment_text", id_col: str = "id") -> tuple[Packed, int]:
    """What `union_rows` makes, written once in a form that many passes read: counts, from which every pass makes the weights, and the width of all."""
    fitted = [(spec, *fitted_terms(vocabulary, "term", "idf")) for spec, vocabulary in blocks]
    rows = df.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("y"), F.lit(0).alias("group"), F.array().cast("array<double>").alias("dense"), F.col(text_col).alias("text"))
    counted = packed_counts(rows, [(spec, terms) for spec, terms, _ in fitted])
    return counted.weighted([np.array(idf, float) for _, _, idf in fitted]), counted.width


# ---------------------------------------------------------------- embeddings


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """The built-in encoder, as a Column: signed hashing of blank-separated tokens, then unit length. Whole texts; a text without tokens is all zeros."""

    def key(word: Column) -> Column:
        # slot and sign from the leading digits of the digest
        return text.bind(F.md5(word), lambda d: F.conv(F.substring(d, 1, 8), 16, 10).cast("long") % dim * 2 + (F.substring(d, 9, 1) >= "8").cast("long"))

    words = tokens.blank_separated_words(F.coalesce(c, F.lit("")))
    counts = F.map_from_entries(tokens.count_terms(F.transform(words, key), "bigint"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    number = lambda found, at: F.coalesce(F.try_element_at(found, at), F.lit(0))

    def unit_length(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))
        return text.bind(norm, lambda n: F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float")))

    return text.bind(text.bind(counts, lambda m: F.transform(slots, lambda s: number(m, s * 2) - number(m, s * 2 + 1))), unit_length)


def first_words(c: Column, n: int) -> Column:
    """The text up to the end of its ``n``-th blank-separated word."""
    blank = f"[{patterns.BLANKS}]"
    return F.regexp_extract(c, rf"(?U)^{blank}*+(?:[^{patterns.BLANKS}]++{blank}*+){{0,{n}}}", 0)


def embed_batch(
    df: DataFrame,
    text_col: str = "comment_text",
    out_col: str = "embedding",
    encoder: Callable | None = None,
    batch_size: int = 128,
    max_words: int | None = None,
    dim: int = 64,
) -> DataFrame:
    """Adds a vector per text.

    Without ``encoder`` that is `hashed_embedding`, all in the JVM. An encoder is loaded once per Python worker and called with batches of
    ``batch_size`` texts; rows are sorted by length inside their partition first, so that the texts of a batch are about equally long and a model that
    pads them wastes little. ``max_words`` cuts longer texts before they are encoded (None: nothing is cut).
    """
    c = F.coalesce(F.col(text_col), F.lit(""))
    cut = c if max_words is None else first_words(c, max_words)
    if encoder is None:
        return df.withColumn(out_col, hashed_embedding(cut, dim))
    udf = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    by_length = df.withColumn("_text", cut).withColumn("_length", F.char_length("_text")).sortWithinPartitions("_length")
    return by_length.withColumn(out_col, udf("_text")).drop("_text", "_length")
