"""Registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import chat, decontaminate, knn_join, license_scan, neardup, phrases, piece_codec, quality_crf, sharding, token_alignment, token_counts, toxicity, warc
from sieveline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKEN_LIMIT = 1024
SHARDS = [f"shard-{n:02d}" for n in range(64)]
SLOTS = 4099


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


KNN_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM vectors q JOIN vectors d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op2_knn_join", KNN_SQL)
def op2_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k_join(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


@query("op3_quality_crf")
def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


NEARDUP_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.other, d.doc_id) AS kept
FROM sets d LEFT JOIN least l ON l.doc_id = d.doc_id
"""


@query("op4_near_duplicates", NEARDUP_SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op5_piece_codec")
def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_sharding", sharding.shard_sql(SHARDS, SLOTS))
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents").select("doc_id"), SHARDS, SLOTS)


@query("op9_chat_formatting", chat.CONVERSATIONS_SQL)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_paths(chat.threads(turns)))


@query("op6_license_scan", license_scan.licence_sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", license_scan.repository_path().alias("path"), "text")
    return license_scan.scan_licences(docs)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


WARC_SQL = """
WITH pages_of AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM pages_of)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM sized
"""


@query("op12_warc", WARC_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


PHRASE_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, doc, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS n_words),
grams AS (SELECT lang, n_words, unnest(list_transform(range(1, len(w) - n_words + 2), lambda i: array_to_string(list_slice(w, i, i + n_words - 1), ' '))) AS phrase
  FROM split, sizes WHERE len(w) >= n_words),
counts AS MATERIALIZED (SELECT lang, n_words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE n_words = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, n_words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE n_words >= 2 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, n_words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, c.k + 1, c.n_words), ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_sizes AS (SELECT lang, w, a AS longer, n_words, unnest(range(2, n_words)) AS m FROM candidates WHERE n_words > 2),
inside AS (SELECT lang, longer, unnest(list_transform(range(1, n_words - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase FROM inner_sizes),
most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE coalesce(100 * m.longer >= 100 * a, false) = false
QUALIFY rank <= 2000
"""


@query("op13_phrases", PHRASE_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
