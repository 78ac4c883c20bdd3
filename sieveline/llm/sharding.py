"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a step from its
name's digest; any step below a prime visits every slot). The shards take turns, each claiming its most preferred free
slot, until the table is full. Shards get equal numbers of slots (within one), and if a shard leaves, few of the other
slots change hands. A row's slot is a digest of its key modulo the table size; a broadcast join finds the shard.

The table depends on the shards alone: ``slots`` rows, at most ``MAX_SLOTS``, which bounds the broadcast. Rows are
placed one by one: no shuffle, and a hot source or a large group of copies spreads over all shards, since the key is
the row's id. Null keys go to the slot of the empty text. Rows are kept as they are, repeated ids in the same shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def digest(text: str) -> int:
    """60 bits of the md5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The number of the shard of every slot."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError("need distinct shards and a prime number of slots, not fewer than shards")
    at = [digest(f"{name}/offset") % slots for name in shards]
    step = [digest(f"{name}/step") % (slots - 1) + 1 for name in shards]
    table, left = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """A key's slot: 60 bits of its md5, modulo the table size."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, shards: list[str], slots: int, key_col: str = "doc_id") -> DataFrame:
    """All columns of ``df`` with ``slot`` and ``shard`` (columns of these names are replaced)."""
    names = df.sparkSession.createDataFrame(
        [(slot, shards[n]) for slot, n in enumerate(lookup_table(shards, slots))], "slot int, shard string"
    )
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), slots))
    return placed.join(F.broadcast(names), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows are spread over as many files as tasks held some."""
    df.write.partitionBy("shard").parquet(path)


def shard_sql(shards: list[str], slots: int) -> str:
    """The same placement of ``documents`` in DuckDB's SQL: turns by recursion over the table, then one look-up."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    names = ", ".join(f"({n}, '{name}')" for n, name in enumerate(shards))
    return f"""
WITH RECURSIVE
names(n, shard) AS (VALUES {names}),
prefs AS (SELECT n, shard, {number.format("shard || '/offset'")} % {slots} AS offs,
                 {number.format("shard || '/step'")} % {slots - 1} + 1 AS step FROM names),
orders AS MATERIALIZED (SELECT n, list_transform(range({slots}), lambda k: ((offs + k * step) % {slots})::INTEGER) AS pref FROM prefs),
turns(turn, taken, slot) AS (
  SELECT 0, list_transform(range({slots}), lambda k: 0::TINYINT), -1
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(taken[1:pick], [1::TINYINT]), taken[pick + 2:]), pick
  FROM (SELECT turn, taken, list_filter(pref, lambda s: taken[s + 1] = 0)[1] AS pick
        FROM turns JOIN orders ON orders.n = turns.turn % {len(shards)} WHERE turn < {slots})
),
slots AS MATERIALIZED (SELECT slot, shard FROM turns JOIN names ON names.n = (turn - 1) % {len(shards)} WHERE slot >= 0)
SELECT doc_id, slots.slot::INTEGER AS slot, slots.shard
FROM documents JOIN slots ON slots.slot = {number.format("coalesce(doc_id::VARCHAR, '')")} % {slots}
"""
