"""Sets of hashes or ids as bits of bounded size: what surely is not in a set needs no shuffle to find that out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
LEAST_BITS, MOST_BITS, PROBES = 1 << 20, 1 << 28, 3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Filter:
    """A set of hashes as bits, ``PROBES`` for each; lets about one in a thousand others pass."""

    def __init__(self, size: int, bits: bytes):
        self.size, self.bits = size, np.frombuffer(bits, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray, size: int, probe: int) -> np.ndarray:
        return (mix(hashes ^ U(0xA0761D6478BD642F + probe)) & U(size - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            at = self.places(hashes[left], self.size, probe)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            out[left[~hit]] = False
            left = left[hit]
        return out


def collect_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of a ``hash`` column without nulls, with at least 32 bits for each value, up to ``most_bits`` in all. Its bytes come to the driver once."""
    n = hashes.count()
    size = min(most_bits, max(LEAST_BITS, 1 << (32 * n - 1).bit_length())) if n else LEAST_BITS

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.asarray(batch.column("hash")).view(U)
            at = np.unique(np.concatenate([Filter.places(hashes, size, probe) for probe in range(PROBES)]))
            cell, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first) if len(at) else at
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "value": pa.array(value, pa.int64())})

    found = hashes.mapInArrow(bits, "cell long, value long").groupBy("cell").agg(F.bit_or("value").alias("value")).toArrow()  # at most most_bits / 64 rows
    out = np.zeros(size >> 6, "<i8")
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("value"))
    return Filter(size, out.tobytes())


def divided(df: DataFrame, column: str, known: Filter) -> tuple[DataFrame, DataFrame]:
    """Rows whose number in ``column`` may be in the filter, and rows whose number is not, nulls too. Only that column goes to Python."""
    shared = df.sparkSession.sparkContext.broadcast(known)  # lives as long as the plans that read it

    @F.arrow_udf("boolean")
    def may(values: pa.Array) -> pa.Array:
        found = shared.value.has(np.asarray(values.fill_null(0)).view(U)) & np.asarray(values.is_valid())
        return pa.array(found, pa.bool_())

    number = F.col(f"`{column}`").cast("long")
    return df.filter(may(number)), df.filter(~may(number))
