"""Sources, sinks, rules, joins and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline import fixed
from sieveline.functions import rules as R
from sieveline.functions import scores, text
from sieveline.operators import joins as J
from sieveline.operators import profile as P
from sieveline.operators import sampling as M
from sieveline.plans import fixtures as fx
from sieveline.plans import sql as S
from sieveline.plans.registry import query, table
from sieveline.session import scratch_path
from sieveline.sources import tables as src
from sieveline.sources.rules import demo_rules, rules_table

MESSAGE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("comment_text", T.StringType())]
)


# ------------------------------------------------------------------ sources and sinks
@query(
    "read_messages_csv",
    f"WITH {S.NULL_MESSAGES} SELECT id, CASE WHEN comment_text NOT IN {S.ql(fixed.NA_TOKENS)} THEN comment_text END AS comment_text "
    "FROM null_messages",
)
def read_messages_csv(spark, sf):
    path = scratch_path(spark, "messages")
    src.write_table(fx.null_messages(spark, sf), path)
    return src.read_messages_csv(spark, path, MESSAGE_SCHEMA)


@query("read_columns_pruned", "SELECT doc_id AS id, toxic FROM labels")
def read_columns_pruned(spark, sf):
    return src.require_columns(table(spark, sf, "labels"), ["doc_id", "toxic"]).select(F.col("doc_id").alias("id"), "toxic")


@query(
    "require_columns",
    "SELECT 'documents' AS table_name, 'comment_text,toxic' AS missing_columns, count(*) AS rows FROM documents "
    "UNION ALL SELECT 'labels', 'comment_text', count(*) FROM labels",
)
def require_columns(spark, sf):
    out = None
    for name, required in (("documents", ["doc_id", "comment_text", "toxic"]), ("labels", ["doc_id", "comment_text", "toxic"])):
        df = table(spark, sf, name)
        missing = ",".join(src.missing_columns(df, required))
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(missing).alias("missing_columns"), "rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


def _rule_hit(rule) -> str:
    if rule["type"] == "lexicon":
        return f"len(list_filter({S.words('nrm')}, lambda x: x IN {S.ql(rule['words'])})) > 0"
    pattern = dict(S.REGEX_RULES)[rule["category"]]
    return f"regexp_matches(nrm, {S.q(pattern)})"


_RULES = fixed.DEFAULT_RULES + fixed.DEMO_RULES
_LONGEST = [sorted(r.get("words") or [""], key=len, reverse=True)[0] for r in _RULES]


@query(
    "rules_table",
    f"WITH {S.SPIKED}, n AS (SELECT {S.norm('comment_text')} AS nrm FROM spiked) "
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, {S.q(r['category'])} AS category, '{r['type']}' AS type, {len(r.get('words') or [])} AS n_words, "
        f"{S.q(_LONGEST[i]) if r.get('words') else 'NULL'} AS first_word, count(*) FILTER ({_rule_hit(r)}) AS messages FROM n"
        for i, r in enumerate(_RULES)
    ),
)
def rules_table_query(spark, sf):
    """The rule table with the number of messages each rule finds, counted in one pass."""
    rules = demo_rules()
    normal = fx.spiked(spark, sf).select(text.normalize_message(F.col("comment_text")).alias("c"))
    counts = normal.agg(*[F.count_if(R.rule_match(F.col("c"), r)).alias(f"r{r.ord}") for r in rules])
    items = F.array(*[F.struct(F.lit(r.ord).alias("ord"), F.col(f"r{r.ord}").alias("messages")) for r in rules])
    return rules_table(spark, rules).join(counts.select(F.inline(items)), "ord").select(
        "ord", "category", "type", F.size("words").alias("n_words"), F.get("words", F.lit(0)).alias("first_word"), "messages"
    )


@query("write_table", f"WITH {S.SPIKED}, {S.chain('spiked')} SELECT id, cleaned AS comment_text FROM s9")
def write_table(spark, sf):
    path = scratch_path(spark, "cleaned") + ".parquet"
    src.write_table(P.clean_messages(fx.spiked(spark, sf)), path)
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)


REPORT_SCHEMA = "dataset struct<total_rows bigint, nan_filled bigint>, labels map<string, struct<positive: bigint, rate: double>>"


@query(
    "write_report",
    f"WITH {S.NULL_MESSAGES}, {S.LABELS}, d AS (SELECT count(*) AS n, count(*) FILTER (comment_text IS NULL) AS k FROM null_messages), "
    "l AS (SELECT count(*) AS n, CAST(sum(toxic) AS BIGINT) AS a, CAST(sum(low_quality) AS BIGINT) AS b FROM labs) "
    "SELECT d.n AS total_rows, d.k AS nan_filled, 'toxic' AS label, l.a AS positive, round(100.0 * l.a / l.n, 4) AS rate FROM d, l "
    "UNION ALL SELECT d.n, d.k, 'low_quality', l.b, round(100.0 * l.b / l.n, 4) FROM d, l",
)
def write_report(spark, sf):
    """A nested report written as JSON, read back and flattened."""
    counts = fx.null_messages(spark, sf).agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("comment_text").isNull()).alias("nan_filled")
    )
    dist = P.label_distribution(fx.labelled(spark, sf), fx.LABELS)
    entries = dist.agg(
        F.map_from_entries(
            F.collect_list(F.struct("label", F.struct("positive", F.col("positive_rate").alias("rate"))))
        ).alias("labels")
    )
    report = counts.select(F.struct("total_rows", "nan_filled").alias("dataset"), entries.scalar().alias("labels"))
    path = scratch_path(spark, "report")
    src.write_report(report, path)
    return src.read_report(spark, path, REPORT_SCHEMA).select("dataset.*", F.explode("labels").alias("label", "v")).select(
        "total_rows", "nan_filled", "label", "v.positive", "v.rate"
    )


_VECTOR = (
    "len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, "
    "round(CAST(embedding[1] AS DOUBLE), 6) AS first_value"
)


def _vector_columns():
    numbers = F.col("embedding").cast("array<double>")
    return [
        F.size("embedding").cast("long").alias("dim"),
        F.round(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.round(F.get(numbers, F.lit(0)), 6).alias("first_value"),
    ]


@query("embedding_store", f"SELECT vec_id AS id, {_VECTOR} FROM embeddings")
def embedding_store(spark, sf):
    path = scratch_path(spark, "embeddings")
    src.embedding_store(table(spark, sf, "embeddings"), path, id_col="vec_id")
    return spark.read.schema("id bigint, embedding array<float>").parquet(path).select("id", *_vector_columns())


# ------------------------------------------------------------------ rules
@query(
    "rule_matches",
    f"WITH {S.SPIKED}, n AS (SELECT id, {S.norm('comment_text')} AS nrm FROM spiked) SELECT id, "
    + ", ".join(f"({_rule_hit(r)}) AS rule_{i}" for i, r in enumerate(_RULES))
    + " FROM n",
)
def rule_matches(spark, sf):
    c = F.col("c")
    normal = fx.spiked(spark, sf).select("id", text.normalize_message(F.col("comment_text")).alias("c"))
    return normal.select("id", *[R.rule_match(c, r).alias(f"rule_{r.ord}") for r in demo_rules()])


@query(
    "tier1_inspect",
    f"WITH {S.SPIKED}, {S.tier1_cte('spiked')} SELECT id, t_status AS status, t_reason AS reason, t_trigger AS trigger FROM t1",
)
def tier1_inspect(spark, sf):
    verdict = R.tier1_inspect(text.normalize_message(F.col("comment_text")), demo_rules())
    return fx.spiked(spark, sf).select("id", verdict.alias("v")).select("id", "v.*")


RULEORDER = [r for r in demo_rules() if not r.category.startswith("PII")]
_RULEORDER_SQL = "CASE " + " ".join(
    f"WHEN {_rule_hit(r)} THEN {S.q(r['category'])}" for r in _RULES if not r["category"].startswith("PII")
) + " END"


@query(
    "tier1_inspect_ruleorder",
    f"WITH {S.SPIKED}, n AS (SELECT id, lower(comment_text) AS nrm FROM spiked) SELECT id, {_RULEORDER_SQL} AS reason FROM n",
)
def tier1_inspect_ruleorder(spark, sf):
    return fx.spiked(spark, sf).select("id", R.tier1_inspect_ruleorder(F.col("comment_text"), RULEORDER).alias("reason"))


@query(
    "tier1_predict",
    f"WITH {S.NULL_MESSAGES}, {S.tier1_cte('null_messages')} SELECT id, CASE WHEN t_reason IS NULL THEN 0 ELSE 1 END AS pred, "
    "coalesce(t_reason, '') AS category FROM t1",
)
def tier1_predict(spark, sf):
    verdict = R.tier1_predict(text.normalize_message(F.col("comment_text")), demo_rules())
    return fx.null_messages(spark, sf).select("id", verdict.alias("v")).select("id", "v.*")


# ------------------------------------------------------------------ joins
@query(
    "integrity_check",
    f"WITH {S.LABELS}, b AS (SELECT id, CASE WHEN id % 29 = 0 THEN 1 - toxic ELSE toxic END AS toxic, "
    "CASE WHEN id % 31 = 0 THEN NULL ELSE low_quality END AS low_quality FROM labs), "
    "j AS (SELECT a.id AS ai, b.id AS bi, a.toxic AS a_t, b.toxic AS b_t, a.low_quality AS a_l, b.low_quality AS b_l FROM labs a "
    "FULL OUTER JOIN b ON a.id = b.id) SELECT count(ai) AS original_rows, count(bi) AS preprocessed_rows, CAST(0 AS BIGINT) AS duplicate_rows, "
    "count(ai) = count(bi) AS row_count_match, '' AS missing_columns, count(*) FILTER (ai IS NULL OR bi IS NULL) AS mismatch_id, "
    "count(*) FILTER (NOT coalesce(a_t = b_t, false)) AS mismatch_toxic, count(*) FILTER (NOT coalesce(a_l = b_l, false)) AS mismatch_low_quality, "
    "false AS passed FROM j",
)
def integrity_check(spark, sf):
    original = fx.labels(spark, sf)
    changed = original.withColumn(
        "toxic", F.when(F.col("id") % 29 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    ).withColumn("low_quality", F.when(F.col("id") % 31 != 0, F.col("low_quality")))
    return J.integrity_check(original, changed, fx.LABELS)


@query(
    "attach_test_labels",
    f"WITH {S.DOCS}, {S.LABELS}, l AS (SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE toxic END AS toxic, low_quality FROM labs) "
    "SELECT d.id, d.comment_text, l.toxic, l.low_quality FROM docs d JOIN l ON d.id = l.id WHERE least(l.toxic, l.low_quality) >= 0",
)
def attach_test_labels(spark, sf):
    unscored = fx.labels(spark, sf).withColumn(
        "toxic", F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.col("toxic"))
    )
    return J.attach_test_labels(fx.documents(spark, sf), unscored, fx.LABELS)


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(
    "attach_embeddings",
    f"WITH {S.LABELS} SELECT l.id, l.toxic, {_VECTOR} FROM labs l JOIN embeddings e ON l.id = e.vec_id",
)
def attach_embeddings(spark, sf):
    joined = J.attach_embeddings(fx.labels(spark, sf), _embeddings(spark, sf), strict=False)
    return joined.select("id", "toxic", *_vector_columns())


@query(
    "embedding_coverage",
    f"WITH {S.LABELS}, j AS (SELECT l.id AS a, e.vec_id AS b FROM labs l FULL OUTER JOIN embeddings e ON l.id = e.vec_id) "
    "SELECT count(*) FILTER (b IS NULL) AS rows_without_embedding, count(*) FILTER (a IS NULL) AS embeddings_without_row, "
    "count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, CAST(0 AS BIGINT) AS repeated_ids FROM j",
)
def embedding_coverage(spark, sf):
    return J.embedding_coverage(fx.labels(spark, sf), _embeddings(spark, sf))


_AUDIT = (
    f"{S.LABELS}, a AS (SELECT *, (id % 5) IN (0, 2, 4) AS eligible FROM labs), "
    "b AS (SELECT *, eligible AND toxic = 0 AS corrected FROM a)"
)


@query(
    "apply_label_audit",
    f"WITH {_AUDIT} SELECT id, CASE WHEN corrected THEN 1 ELSE toxic END AS toxic, low_quality, corrected FROM b",
)
def apply_label_audit(spark, sf):
    return J.apply_label_audit(fx.labels(spark, sf), fx.audit_candidates(spark, sf))


@query(
    "label_audit_report",
    f"WITH {_AUDIT} SELECT count(*) AS rows_in_input_dataset, count(*) FILTER (corrected) AS rows_corrected, "
    "count(*) FILTER (toxic = 0) AS non_toxic_before, count(*) FILTER (toxic = 1) AS toxic_before, "
    "count(*) FILTER (toxic = 0 AND NOT corrected) AS non_toxic_after, count(*) FILTER (toxic = 1 OR corrected) AS toxic_after, "
    "count(*) AS audit_rows_loaded, count(*) FILTER (eligible) AS high_confidence_candidates, "
    "(SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM b WHERE corrected ORDER BY id LIMIT 100)) "
    "AS corrected_ids_sample FROM b",
)
def label_audit_report(spark, sf):
    return J.label_audit_report(fx.labels(spark, sf), fx.audit_candidates(spark, sf))


_TERM_CATEGORY = "CASE " + " ".join(f"WHEN term IN {S.ql(r['words'])} THEN {S.q(r['category'])}" for r in S.LEXICONS) + " END"


@query(
    "lexicon_term_hits",
    f"WITH {S.SPIKED}, h AS (SELECT id, unnest(list_filter({S.words(S.norm('comment_text'))}, lambda x: x IN {S.ql(S.ALL_WORDS)})) AS term "
    f"FROM spiked) SELECT {_TERM_CATEGORY} AS category, term, count(*) AS hits, count(DISTINCT id) AS messages FROM h GROUP BY term",
)
def lexicon_term_hits(spark, sf):
    return J.lexicon_term_hits(fx.spiked(spark, sf), demo_rules())


@query(
    "tier1_errors",
    f"WITH {S.TIER1_LABELLED} SELECT *, CASE WHEN any_toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS tier1_error_type "
    "FROM tl1 WHERE any_toxic <> tier1_pred",
)
def tier1_errors(spark, sf):
    return J.tier1_errors(fx.tier1_labelled(spark, sf))


@query("binary_target", f"WITH {S.LABELS} SELECT id, greatest(toxic, low_quality) AS is_toxic FROM labs")
def binary_target(spark, sf):
    return fx.labels(spark, sf).select("id", scores.binary_target(fx.LABELS).alias("is_toxic"))


# ------------------------------------------------------------------ samples, splits, folds
def _key(seed: int) -> str:
    return f"md5(concat('{seed}:', CAST(id AS VARCHAR)))"


@query("sample_n", f"WITH {S.DOCS} SELECT id, comment_text FROM docs ORDER BY {_key(42)}, id LIMIT 100")
def sample_n(spark, sf):
    return M.sample_n(fx.documents(spark, sf), 100)


@query(
    "balanced_sample",
    f"WITH {S.LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {_key(42)}, id) AS rn FROM labs) "
    "SELECT id, toxic, low_quality FROM r WHERE rn <= 40",
)
def balanced_sample(spark, sf):
    return M.balanced_sample(fx.labels(spark, sf), "toxic", 40)


_RANKED = (
    f"{S.LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {_key(42)}, id) AS rn, "
    "count(*) OVER (PARTITION BY toxic) AS n FROM labs)"
)


@query(
    "stratified_split",
    f"WITH {_RANKED} SELECT id, toxic, low_quality, CASE WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END AS part FROM r",
)
def stratified_split(spark, sf):
    return M.stratified_split(fx.labels(spark, sf), "toxic")


@query("stratified_folds", f"WITH {_RANKED} SELECT id, toxic, low_quality, CAST((rn - 1) % 3 AS INTEGER) AS fold FROM r")
def stratified_folds(spark, sf):
    return M.stratified_folds(fx.labels(spark, sf), "toxic")


@query(
    "example_rows",
    f"WITH {S.TIER1_LABELLED} SELECT id, substring(comment_text, 1, 200) AS example FROM tl1 WHERE any_toxic = 1 AND tier1_pred = 0 "
    "ORDER BY id LIMIT 15",
)
def example_rows(spark, sf):
    missed = fx.tier1_labelled(spark, sf).filter("any_toxic = 1 AND tier1_pred = 0")
    return M.example_rows(missed, 15)
