"""Reply trees to formatted conversations.

*Paths.* Messages with parents form trees. Joining the parent table with itself doubles how far a jump reaches, so after
a logarithmic number of joins every message knows its root, its depth and the sum of scores on its way up. Leaves are
ranked by that sum within their tree; for the chosen ones the same jump tables, taken from the longest to the shortest,
list every message on the path. Nothing is longer than the paths that are asked for.

*Format.* A turn is ``### Role: text`` on a line of its own, then ``</turn>``. Inside roles and texts a backslash goes
before every backslash, before ``###`` and before ``</turn>`` (and, in roles, before a colon), so control strings in a
text never count and the original comes back exactly. Assistant texts, unescaped, are what the loss mask covers.

One conversation is one row of output and so must fit into a task; everything before moves single messages. Jump tables
are written to the shared folder, so a lost executor costs a task and not the loop.

Null texts and roles are empty. A parent that is missing, is the message itself or is null makes a root; messages on a
cycle belong to no path. Rows without a conversation or tree are in none. Turns of equal number are ordered by role, then text; equal rows are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import keep_table, ship_package

HEAD, COLON, END = "### ", ": ", "\n</turn>\n"
LEARNT = "assistant"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<\n]++|\\.|<|\n(?!</turn>\n))*+)\n</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(column):
    """Backslash before backslashes, ``###`` and ``</turn>``."""
    column = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    column = F.replace(column, F.lit("###"), F.lit("\\###"))
    return F.replace(column, F.lit("</turn>"), F.lit("\\</turn>"))


def escape_role(column):
    return F.replace(escape(column), F.lit(":"), F.lit("\\:"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a formatted conversation, at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of ``messages`` (``tree, id, parent, score``; ids are unique within a tree).

    Returns ``tree, leaf, rank, path_score, id, depth``: a row for every message of the ``best`` paths of each tree (all
    paths if None), ranked by the sum of scores, then by leaf.
    """
    nodes = messages.select("tree", "id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    # up: the message that a jump leads to (null: past the root); hops, total: of the messages passed, this one included
    jump = keep_table(
        nodes.join(known, ["tree", "parent"], "left")
        .select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("total")),
        "chat-jumps",
    )
    first, jumps = jump, [jump]
    left = jump.filter("up is not null").count()
    while left:
        far = jump.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("total").alias("plus"))
        moved = jump.filter("up is not null").join(far, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("total") + F.col("plus")).alias("total")
        )
        jump = keep_table(jump.filter("up is null").union(moved), "chat-jumps")
        before, left = left, jump.filter("up is not null").count()
        if left == before:  # every doubling closes some path, unless only cycles are left
            break
        jumps.append(jump)
    # what still leads somewhere now lies on or above a cycle
    ways = jump.filter("up is null")
    inner = first.filter("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = ways.join(inner, ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "id")))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    chosen = keep_table(ranked.select("tree", F.col("id").alias("leaf"), "rank", F.col("total").alias("path_score"), F.col("hops").alias("length")), "chat-leaves")
    path = chosen.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("back"))
    for table in reversed(jumps):
        step = table.filter("up is not null").select("tree", "id", "up", "hops")
        both = F.array(F.struct("id", "back"), F.struct(F.col("up").alias("id"), (F.col("back") + F.col("hops")).alias("back")))
        path = path.join(step, ["tree", "id"], "left").select("tree", "leaf", F.inline(both)).filter("id is not null")
    return path.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "rank", "path_score", "id", (F.col("length") - 1 - F.col("back")).alias("depth"))


def threads(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as messages: every turn answers the one before it."""
    turns = turns.filter("conv_id is not null")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    plain = turns.select(
        F.col("conv_id").alias("tree"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    numbered = plain.withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def format_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row per chosen path: ``tree, leaf, rank, path_score, formatted``. ``messages`` has ``role`` and ``text`` too."""
    messages = keep_table(messages.select("tree", "id", "parent", "score", "role", "text"), "chat-messages")
    path = reply_paths(messages, best)
    line = F.concat(F.lit(HEAD), escape_role(F.coalesce("role", F.lit(""))), F.lit(COLON), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    lines = path.join(messages.select("tree", "id", line.alias("line")), ["tree", "id"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct("depth", "line"))), lambda t: t["line"])
    return lines.groupBy("tree", "leaf", "rank", "path_score").agg(F.concat_ws("", turns).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text itself says: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t) for t in batch.column("formatted").to_pylist()]
            learnt = ["".join(text for role, text in turns if role == LEARNT) for turns in found]
            sha = [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest() for turns in found]
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "n_turns": pa.array([len(t) for t in found], pa.int64()), "turns_sha256": pa.array(sha, pa.string()),
                "loss_chars": pa.array([len(t) for t in learnt], pa.int64()),
                "loss_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in learnt], pa.string()),
                "formatted_chars": pa.array([len(t) for t in batch.column("formatted").to_pylist()], pa.int64()),
            })

    return formatted.select(F.col("tree").cast("long").alias("conv_id"), "formatted").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


CONVERSATIONS_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), lines AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS safe_role
  FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length(safe_role) + length(safe) + 15)::BIGINT AS formatted_chars
FROM lines GROUP BY conv_id
"""
