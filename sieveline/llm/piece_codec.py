"""SentencePiece encoding and decoding of merge-type models, exact, in Arrow batches.

No merge crosses from a letter to a word mark, so a text falls into chunks (word marks, then other characters) that
are encoded apart. A chunk is encoded by backtracking: Aho-Corasick matches give the pieces that start at each
character, the longest is tried first, a piece is taken only if re-merging it with its left neighbour gives back the
pair, and a bitfield keeps positions that led nowhere. A chunk is cut further wherever no piece holds its two
characters side by side, since nothing merges there; characters outside the vocabulary become byte pieces. Pieces of equal score (runs of word marks) have no order of their own, so a chunk that
starts with several marks is merged directly.

Chunks are remembered per worker, so a frequent word costs one look-up. The vocabulary (at most a few MB) is read on
the driver and broadcast; executors need no file. One projection, no shuffle: lost tasks are simply run again.

Null and empty texts have no tokens and decode to the empty text. Rows are kept as they are, repeated ids too.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import ship_package, slices, texts
from sieveline.llm.merges import MEMO, Merger

MARK = "▁"


def load_pieces(path: str) -> dict:
    """The pieces, scores and byte pieces of a merge-type model whose normaliser leaves texts as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, special, raw = [], {}, set(), {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        pieces.append(piece)
        if model.is_byte(i):
            raw[i] = int(piece[3:5], 16)
        elif model.is_control(i) or model.is_unknown(i):
            special.add(i)
        elif not model.is_unused(i):
            scores[piece] = (i, -model.get_score(i))
    if any(MARK in piece.lstrip(MARK) for piece in scores):
        raise ValueError("the model has pieces with a word mark after other characters; chunks would not be independent")
    return {"pieces": pieces, "scores": scores, "special": special, "bytes": raw}


class Codec:
    """Encodes and decodes with one loaded vocabulary."""

    def __init__(self, table: dict):
        self.ids = {piece: i for piece, (i, _) in table["scores"].items()}
        self.rank = {piece: r for piece, (_, r) in table["scores"].items()}
        self.byte_ids = {b: i for i, b in table["bytes"].items()}
        self.raw = table["bytes"]
        self.special = table["special"]
        self.plain = [piece.replace(MARK, " ") for piece in table["pieces"]]
        self.chars = {piece for piece in self.rank if len(piece) == 1}
        self.inside = {piece[k : k + 2] for piece in self.rank for k in range(len(piece) - 1)}
        rank = self.rank
        self.merger = Merger(rank, lambda a, b: rank.get(a + b))
        self.memo: dict[str, tuple[str, str]] = {}

    def _merge_long(self, text: str) -> list[str]:
        """The merge procedure with a heap, for runs of word marks of any length."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if 0 <= i and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p is not None]

    def _known(self, run: str) -> list[int]:
        """Ids of a run of known characters."""
        pieces = None if run.startswith(MARK * 2) else self.merger.encode(run)
        if pieces is None:
            pieces = self._merge_long(run)
        return [self.ids[p] for p in pieces]

    def segments(self, chunk: str) -> list[str]:
        """Cut a chunk wherever no piece holds the two characters side by side; no merge ever crosses there."""
        inside, out, start = self.inside, [], 0
        for end in range(1, len(chunk)):
            if chunk[end - 1 : end + 1] not in inside:
                out.append(chunk[start:end])
                start = end
        out.append(chunk[start:])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the word mark that encoding puts first taken off again."""
        raw = bytearray()
        for i in ids:
            if i in self.raw:
                raw.append(self.raw[i])
            elif i not in self.special:
                raw += self.plain[i].encode("utf-8")
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _segment(self, segment: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of one segment; remembered."""
        if segment in self.chars or len(segment) > 1:
            ids = self._known(segment)
            entry = (",".join(map(str, ids)), "".join([self.plain[i] for i in ids]))
        else:
            raw = segment.encode("utf-8")
            entry = (",".join([str(self.byte_ids[b]) for b in raw]), segment)
        self._remember(segment, entry)
        return entry

    def _entry(self, chunk: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of one chunk; remembered."""
        segments = self.segments(chunk)
        if len(segments) == 1:
            return self._segment(chunk)
        get, segment = self.memo.get, self._segment
        parts = [get(s) or segment(s) for s in segments]
        entry = (",".join([p[0] for p in parts]), "".join([p[1] for p in parts]))
        if len(chunk) <= 12:
            self._remember(chunk, entry)
        return entry

    def _remember(self, text: str, entry: tuple[str, str]) -> None:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[text] = entry

    def chunks(self, text: str) -> list[str]:
        """The independent chunks of a text, each with its word marks."""
        text = text.replace(MARK, " ")
        out, marks = [], ""
        for word in text.split(" "):
            marks += MARK
            if word:
                out.append(marks + word)
                marks = ""
        return [*out, marks] if marks else out

    def run(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a whole text."""
        if not text:
            return "", ""
        get, entry = self.memo.get, self._entry
        found = [get(c) or entry(c) for c in self.chunks(text)]
        return ",".join([e[0] for e in found]), "".join([e[1] for e in found])[1:]

    def encode(self, text: str) -> list[int]:
        joined = self.run(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []


_CODECS: dict[int, Codec] = {}


def codec(table) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    found = _CODECS.get(table.id if hasattr(table, "id") else id(table))
    if found is None:
        _CODECS.clear()
        found = _CODECS[table.id if hasattr(table, "id") else id(table)] = Codec(table.value if hasattr(table, "value") else table)
    return found


class _Shared:
    """A broadcast and its number, which the worker keeps its codec under."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def shared(spark, table: dict) -> _Shared:
    broadcast = spark.sparkContext.broadcast(table)
    return _Shared(broadcast, hash((id(broadcast), len(table["pieces"]))))


def encoded(one: Codec, batches: Iterator[pa.RecordBatch], id_col: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches of ``id_col`` and ``_text``, encoded and decoded a slice at a time."""
    for batch in slices(batches):
        found = [one.run(t) for t in texts(batch, "_text")]
        columns = {
            id_col: batch.column(id_col),
            "n_tokens": pa.array([i.count(",") + 1 if i else 0 for i, _ in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in found], pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in found], pa.list_(pa.int32()))
            columns["decoded"] = pa.array([d for _, d in found], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``, and with
    ``with_ids`` also ``ids`` (array of int) and ``decoded``.
    """
    spark = df.sparkSession
    ship_package(spark)
    table = shared(spark, load_pieces(model_path))
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(codec(table), batches, id_col, with_ids)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, T.StructType(fields))
