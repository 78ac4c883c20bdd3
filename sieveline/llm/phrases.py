"""Phrase collocations: frequent word n-grams by Misra-Gries summaries, exact counts, and a cohesion score.

Words are counted per language first. Longer phrases are found in two steps, neighbouring pairs and then all longer
ones, each of two passes over the texts:

1. *Summaries.* An n-gram whose parts cannot all be frequent is not frequent itself, so only runs of possibly frequent
   parts are looked at. Tasks combine what they find and send it as blocks of (key, count) to hash partitions. A
   partition keeps a Misra-Gries summary: at most ``CAPACITY`` counters; when there are more, the next largest count is
   taken from all and the rest dropped. What was taken in total bounds how much any n-gram can be undercounted, and it
   stays below ``min_count`` since there are as many partitions as it takes for the capacity to exceed the
   partition's mass divided by ``min_count``. So every frequent n-gram survives. (A summary grows rather than break
   this bound, should a partition get more than its share.) Summaries merge: counters and what was taken add up.
2. *Exact counts.* Survivors become bits of a filter, at most ``MOST_BITS`` (32 MB), which is broadcast. A second pass counts the
   phrases that pass it by their text, tasks send their counts to hash partitions as blocks, and only those with ``min_count``
   occurrences stay. Hashes and filters only let too much
   through, so counts and results are exact whatever collides.

Scores, cuts and the phrases inside longer ones are joins of the tables of counts. Frequent words and phrases are combined in
the tasks before they are shuffled, so that a word or phrase of any frequency is a few rows.

Null and empty texts have no words. A null language reads as ``und``. Rows of one id are separate texts; ids are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import keep_table, ship_package
from sieveline.llm.filters import Filter, U, collect_filter, mix

MIN_WORDS, MAX_WORDS = 2, 5
CAPACITY = 1 << 20  # counters of a summary
BLOCK_WORDS = 1 << 18  # words that a task looks at together
VOCABULARY = 1 << 17  # words that a task remembers
HELD = 1 << 17  # phrases that a task counts before it sends them
PER_PART = 1 << 17  # survivors whose counts one task adds up
SEPARATORS = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Words:
    """Texts as word numbers; 0 parts pieces. Numbers hold until the next `restart`."""

    def __init__(self):
        self.restart()

    def restart(self) -> None:
        self.number: dict[bytes, int] = {b".": 0}
        self.names: list[bytes] = [b""]
        self.hashes = np.zeros(1, U)

    def _add(self, word: bytes) -> int:
        n = self.number[word] = len(self.names)
        self.names.append(word)
        return n

    def numbers(self, text: str) -> list[int]:
        number, add = self.number, self._add
        found = text.encode("utf-8", "surrogatepass").lower().translate(SEPARATORS).replace(b".", b" . ").split()
        return [number[w] if w in number else add(w) for w in found]

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        new = self.names[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in new], U)])
        return self.hashes[numbers]


class Block:
    """Consecutive texts: word numbers with a break after each text, their hashes, and the language of every place."""

    def __init__(self, words: Words, texts: list[list[int]], langs: list[str]):
        self.words, self.langs = words, sorted(set(langs))
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.numbers = np.fromiter((n for text in texts for n in (*text, 0)), np.int64, sum(len(t) + 1 for t in texts))
        self.lang = np.repeat([at[lang] for lang in langs], [len(t) + 1 for t in texts])
        salt = np.array([xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=7) for lang in self.langs], U)
        with np.errstate(over="ignore"):
            self.hash = mix(words.hashed(self.numbers) + salt[self.lang])

    def starts(self, frequent: Filter) -> np.ndarray:
        """Places of words that may be frequent."""
        return np.flatnonzero((self.numbers > 0) & frequent.has(self.hash))

    def grow(self, places: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """From the places and hashes of the possible phrases of ``size - 1`` words, those of ``size`` words whose beginning and rest are both possible."""
        next_too = np.flatnonzero(places[1:] == places[:-1] + 1)
        both = places[next_too]
        with np.errstate(over="ignore"):
            grown = mix(hashes[next_too] * U(0x9E3779B97F4A7C15) + self.hash[both + size - 1] + U(size))
        return both, grown

    def texts_of(self, places: np.ndarray, size: int) -> Iterator[tuple[str, str, int]]:
        """``lang, phrase, count`` of the distinct phrases of ``size`` words that start at ``places``, told apart by their words."""
        if not len(places):
            return
        key = self.numbers[places]
        for k in range(1, size):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words.names) + self.numbers[places + k]
        key = np.unique(key, return_inverse=True)[1] * len(self.langs) + self.lang[places]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        names = self.words.names
        for place, count in zip(places[first].tolist(), counts.tolist()):
            phrase = b" ".join([names[n] for n in self.numbers[place : place + size]])
            yield self.langs[self.lang[place]], phrase.decode("utf-8", "surrogatepass"), count


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    words, texts, langs, held = Words(), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                texts.append(words.numbers(text))
                langs.append(lang)
                held += len(texts[-1])
                if held >= BLOCK_WORDS or len(words.names) >= VOCABULARY:
                    yield Block(words, texts, langs)
                    texts, langs, held = [], [], 0
                    if len(words.names) >= VOCABULARY:
                        words.restart()
    if texts:
        yield Block(words, texts, langs)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


class Summary:
    """Misra-Gries counters of one hash partition; ``lost`` bounds how much any key is undercounted."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.lost = capacity, threshold, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add counts of keys: blocks, or the counters of another summary with what it has lost."""
        both, total = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.lost += lost
        if len(both) > self.capacity:
            take = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            if self.lost + take < self.threshold:
                self.lost += take
                total -= take
                both, total = both[total > 0], total[total > 0]
        self.keys, self.counts = both, total

    def survivors(self) -> np.ndarray:
        return self.keys[self.counts + self.lost >= self.threshold]


def parts_of(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition and key within it."""
    return ((hashes >> U(32)) % U(parts)).astype(np.int64), (hashes & U(0xFFFFFFFF)).astype(np.uint32)


def whole_hash(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What filters know of a hash: its partition and key."""
    return mix(part.astype(U) << U(32) | keys.astype(U))


def frequent_hashes(docs: DataFrame, look: Callable[[Block], Iterator[np.ndarray]], mass: int, min_count: int, capacity: int) -> tuple[DataFrame, int]:
    """``hash`` of every n-gram that ``look`` finds at least ``min_count`` times in all blocks, and some others, and the number of partitions."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * mass / (capacity * min_count)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for hashes in look(block):
                part, key = parts_of(hashes, parts)
                order = np.lexsort((key, part))
                part, key = part[order], key[order]
                new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))) if len(key) else order
                counts = np.diff(np.append(new, len(key)))
                part, key = part[new], key[new]
                once = counts == 1
                for p in np.unique(part).tolist():
                    mine = slice(*np.searchsorted(part, [p, p + 1]))
                    single = once[mine]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p], pa.int32()), "once": pa.array([key[mine][single].tobytes()], pa.binary()),
                        "more": pa.array([key[mine][~single].tobytes()], pa.binary()), "counts": pa.array([counts[mine][~single].astype(np.uint32).tobytes()], pa.binary()),
                    })

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Summary] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # at most about `capacity` keys of each partition

        def merge(p: int) -> None:
            kept.setdefault(p, Summary(capacity, min_count)).merge(*[np.concatenate(x) for x in zip(*waiting.pop(p))])

        for batch in batches:
            for p, once, more, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "once", "more", "counts")]):
                single, several = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
                times = np.concatenate([np.ones(len(single), np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)])
                waiting.setdefault(p, []).append((np.concatenate([single, several]), times))
                if sum(len(x) for x, _ in waiting[p]) >= capacity:
                    merge(p)
        for p in sorted({*kept, *waiting}):
            if p in waiting:
                merge(p)
            found = kept[p].survivors()
            yield pa.RecordBatch.from_pydict({"hash": pa.array(whole_hash(np.full(len(found), p), found).view(np.int64), pa.int64())})

    sent = docs.mapInArrow(send, "part int, once binary, more binary, counts binary").repartition(parts, "part")
    return keep_table(sent.mapInArrow(summarise, "hash long"), "phrase-survivors"), parts


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, f`` of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            key = block.lang * len(block.words.names) + block.numbers
            key, counts = np.unique(key[block.numbers > 0], return_counts=True)
            lang, number = np.divmod(key, len(block.words.names))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([block.langs[k] for k in lang.tolist()], pa.string()),
                "phrase": pa.array([block.words.names[n].decode("utf-8", "surrogatepass") for n in number.tolist()], pa.string()), "f": pa.array(counts, pa.int64()),
            })

    return docs.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).withColumn("n_words", F.lit(1))


def word_hashes(words: DataFrame) -> DataFrame:
    """The hashes that blocks give to the words of a table ``lang, phrase``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=7) for x in batch.column("lang").to_pylist()]
            own = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in batch.column("phrase").to_pylist()]
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_pydict({"hash": pa.array(mix(np.array(own, U) + np.array(salt, U)).view(np.int64), pa.int64())})

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def count_phrases(docs: DataFrame, min_count: int = 100, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of all words, and of the phrases of 2 to 5 words that occur at least ``min_count`` times in their language."""
    spark = docs.sparkSession
    words = keep_table(count_words(docs), "phrase-words")
    mass = words.agg(F.sum("f")).first()[0] or 0
    known = spark.sparkContext.broadcast(collect_filter(word_hashes(words.filter(F.col("f") >= min_count))))

    def pairs(block: Block) -> Iterator[np.ndarray]:
        places = block.starts(known.value)
        yield block.grow(places, block.hash[places], 2)[1]

    pair_hashes, pair_parts = frequent_hashes(docs, pairs, mass, min_count, capacity)
    known_pairs = spark.sparkContext.broadcast(collect_filter(pair_hashes))

    def possible_pairs(block: Block) -> tuple[np.ndarray, np.ndarray]:
        places = block.starts(known.value)
        places, found = block.grow(places, block.hash[places], 2)
        take = known_pairs.value.has(whole_hash(*parts_of(found, pair_parts)))
        return places[take], found[take]

    def longer(block: Block) -> Iterator[np.ndarray]:
        places, found = possible_pairs(block)
        for size in range(3, MAX_WORDS + 1):
            places, found = block.grow(places, found, size)
            yield found

    hashes, parts = frequent_hashes(docs, longer, mass * (MAX_WORDS - 2), min_count, capacity)
    known_longer = spark.sparkContext.broadcast(collect_filter(hashes))

    parts_of_counts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * (pair_hashes.count() + hashes.count()) / PER_PART))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            part = np.array([xxhash.xxh3_64_intdigest(f"{lang}\0{phrase}".encode("utf-8", "surrogatepass")) % parts_of_counts for (lang, phrase), _ in rows], np.int64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            offsets = pa.array([*first.tolist(), len(rows)], pa.int32())
            rows = [rows[k] for k in order.tolist()]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(found, pa.int32()), "lang": pa.ListArray.from_arrays(offsets, pa.array([k[0] for k, _ in rows], pa.string())),
                "phrase": pa.ListArray.from_arrays(offsets, pa.array([k[1] for k, _ in rows], pa.string())), "f": pa.ListArray.from_arrays(offsets, pa.array([n for _, n in rows], pa.int64())),
            })

        for block in blocks(batches):
            places, found = possible_pairs(block)
            for size in range(MIN_WORDS, MAX_WORDS + 1):
                if size > 2:
                    places, found = block.grow(places, found, size)
                    take = known_longer.value.has(whole_hash(*parts_of(found, parts)))
                    places, found = places[take], found[take]
                for lang, phrase, n in block.texts_of(places, size):
                    held[lang, phrase] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()  # the survivors of some partitions, about PER_PART each
        for batch in batches:
            flat = [batch.column(c).flatten() for c in ("lang", "phrase", "f")]
            for lang, phrase, n in zip(*[c.to_pylist() for c in flat]):
                total[lang, phrase] += n
        rows = [(lang, phrase, phrase.count(" ") + 1, n) for (lang, phrase), n in total.items() if n >= min_count]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([r[0] for r in rows], pa.string()), "phrase": pa.array([r[1] for r in rows], pa.string()),
            "n_words": pa.array([r[2] for r in rows], pa.int32()), "f": pa.array([r[3] for r in rows], pa.int64()),
        })

    counted = docs.mapInArrow(count, "part int, lang array<string>, phrase array<string>, f array<long>").repartition(parts_of_counts, "part")
    counted = keep_table(counted.mapInArrow(add_up, "lang string, phrase string, n_words int, f long"), "phrase-counts")
    for one in (known, known_pairs, known_longer):
        one.destroy()
    return words, counted


def part_of(first: Column, size: Column) -> Column:
    """Words ``first`` .. ``first + size - 1`` of the array ``w`` (from 1), joined by blanks."""
    return F.array_join(F.slice("w", first, size), " ")


def score_of(scale: int) -> Column:
    """floor(scale * a * n / (l * r)) of the columns ``a``, ``n``, ``l``, ``r``: exact while the products have at most 38 digits."""
    return F.expr(f"CAST({scale} * CAST(a AS DECIMAL(18,0)) AS DECIMAL(20,0)) * CAST(n AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")


def collocations(
    df: DataFrame, min_count: int = 100, top: int = 2000, scale: int = 1000, inside_percent: int = 100, capacity: int = CAPACITY, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of each language.

    ``a``: occurrences of the phrase; ``l``, ``r``: of the two parts of its weakest cut; ``n``: words of the language; ``score``:
    floor(scale * a * n / (l * r)), in exact decimals. A phrase inside a longer frequent one goes if ``100 * f(longer) >=
    inside_percent * a``. Equal scores are ranked by falling ``a``, then by the phrase's bytes.
    """
    ship_package(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, phrases = count_phrases(docs, min_count, capacity)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = words.filter(F.col("f") >= min_count).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    split = phrases.withColumn("w", F.split("phrase", " "))

    cuts = split.select("lang", "phrase", "n_words", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part_of(F.lit(1), F.col("k")).alias("first"), part_of(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.withColumn("score", score_of(scale))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    # an n-gram is no more frequent than what it holds, so it is enough to look one word further
    if inside_percent == 100:
        inner = F.array(part_of(F.lit(1), F.col("n_words") - 1), part_of(F.lit(2), F.col("n_words") - 1))
    else:
        inner = F.flatten(F.transform(
            F.sequence(F.lit(MIN_WORDS), F.col("n_words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda at: part_of(at, size)),
        ))
    inside = split.filter("n_words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(100 * whole("longer") >= inside_percent * whole("a"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
