"""Text cleaning and its profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text
from sieveline.operators import profile as P
from sieveline.operators import reports as R
from sieveline.plans import fixtures as fx
from sieveline.plans import sql as S
from sieveline.plans.registry import query, table
from sieveline.session import scratch_path

CHAIN = f"WITH {S.SPIKED}, {S.chain('spiked')}"


def _step(name: str, step, expression: str, source: str = "spiked"):
    """One cleaning step on its own, over the raw spiked texts."""

    @query(name, f"WITH {S.SPIKED} SELECT id, {expression} AS out FROM {source}")
    def run(spark, sf):
        return fx.spiked(spark, sf).select("id", step(F.col("comment_text")).alias("out"))

    return run


@query(
    "blank_to_empty",
    rf"WITH {S.NULL_MESSAGES} SELECT id, CASE WHEN comment_text IS NULL OR regexp_matches(comment_text, '^\s*$') "
    "THEN '' ELSE comment_text END AS out FROM null_messages",
)
def blank_to_empty(spark, sf):
    return fx.null_messages(spark, sf).select("id", text.blank_to_empty(F.col("comment_text")).alias("out"))


@query(
    "html_unescape",
    "SELECT page_id AS id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), "
    "'&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS out FROM pages",
)
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), text.html_unescape(F.col("html")).alias("out")
    )


_step("unicode_fold", text.unicode_fold, S.fold("comment_text"))
_step("strip_wiki", text.strip_wiki, S.wiki("comment_text"))
_step("strip_urls_ips", text.strip_urls_ips, S.urls("comment_text"))
_step("lowercase", F.lower, "lower(comment_text)")
_step("expand_contractions", lambda c: text.expand_contractions(F.lower(c)), S.expand("lower(comment_text)"))
_step("deobfuscate_profanity", lambda c: text.deobfuscate_profanity(F.lower(c)), S.deobfuscate("lower(comment_text)"))
_step("collapse_punct", text.collapse_punct, S.punct("comment_text"))
_step("strip_non_alnum", lambda c: text.strip_non_alnum(F.lower(c)), S.alnum("lower(comment_text)"))
_step("squeeze_whitespace", text.squeeze_whitespace, S.squeeze("comment_text"))
_step("normalize_message", text.normalize_message, S.norm("comment_text"))
_step(
    "custom_steps",
    lambda c: text.apply_steps(
        c, [lambda t: F.regexp_replace(t, "[0-9]+", "#"), F.reverse, lambda t: F.concat(t, F.lit("."))]
    ),
    "concat(reverse(regexp_replace(comment_text, '[0-9]+', '#', 'g')), '.')",
)


@query("caps_flag", f"WITH {S.SPIKED} SELECT id, {S.caps(S.fold('comment_text'))} AS out FROM spiked")
def caps_flag(spark, sf):
    return fx.spiked(spark, sf).select("id", text.mostly_caps(text.unicode_fold(F.col("comment_text"))).alias("out"))


@query(
    "capslock_prefix",
    f"WITH {S.SPIKED} SELECT id, CASE WHEN {S.caps('comment_text')} THEN concat('{fixed.CAPS_TOKEN} ', "
    "lower(comment_text)) ELSE lower(comment_text) END AS out FROM spiked",
)
def capslock_prefix(spark, sf):
    c = F.col("comment_text")
    return fx.spiked(spark, sf).select("id", text.capslock_prefix(F.lower(c), text.mostly_caps(c)).alias("out"))


@query("clean_text", f"{CHAIN} SELECT id, cleaned AS out FROM s9")
def clean_text(spark, sf):
    return fx.spiked(spark, sf).select("id", text.clean_text(F.col("comment_text")).alias("out"))


def _counter(step: str, found: str) -> str:
    return (
        f"SELECT '{step}' AS step, count(*) FILTER (NOT blank AND {found} > 0) AS rows_affected, "
        f"CAST(coalesce(sum({found}) FILTER (NOT blank), 0) AS BIGINT) AS total_matches FROM s9"
    )


_COUNTERS = [
    ("html_unescape", "0"),
    ("unicode_normalization", "CAST(folded <> raw AS INTEGER)"),
    ("capslock_detection", "CAST(caps AS INTEGER)"),
    ("wiki_noise_removal", f"len(regexp_extract_all(folded, {S.q(S.WIKI)}))"),
    ("url_ip_removal", f"len(regexp_extract_all(no_wiki, {S.q(S.URLS)}))"),
    ("contraction_expansion", f"len(regexp_extract_all(low, {S.q(S.CONTRACTION)}))"),
    (
        "profanity_deobfuscation",
        "(" + " + ".join(f"len(regexp_extract_all(expanded, {S.q(S.stem_pattern(s))}))" for s in fixed.PROFANITY_STEMS) + ")",
    ),
    ("repeated_punct_collapse", S.repeats("plain")),
    ("non_alnum_strip", f"len(regexp_extract_all(single, {S.q(S.NON_ALNUM)}))"),
]


@query(
    "step_counters",
    f"{CHAIN} "
    + " UNION ALL ".join(_counter(*c) for c in _COUNTERS)
    + " UNION ALL SELECT 'empty_or_nan', count(*) FILTER (blank), count(*) FILTER (blank) FROM s9",
)
def step_counters(spark, sf):
    return P.step_counters(fx.spiked(spark, sf))


@query(
    "contraction_top20",
    f"{CHAIN}, hits AS (SELECT unnest(regexp_extract_all(low, {S.q(S.CONTRACTION)})) AS contraction FROM s9 WHERE NOT blank) "
    "SELECT contraction, count(*) AS n FROM hits GROUP BY contraction ORDER BY n DESC, contraction LIMIT 20",
)
def contraction_top20(spark, sf):
    return P.contraction_top(fx.spiked(spark, sf))


@query(
    "profanity_by_word",
    f"{CHAIN}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}' AS word, CAST(sum(len(regexp_extract_all(expanded, {S.q(S.stem_pattern(s))}))) AS BIGINT) AS n FROM s9"
        for s in fixed.PROFANITY_STEMS
    )
    + ") SELECT * FROM c WHERE n > 0",
)
def profanity_by_word(spark, sf):
    return P.profanity_by_word(fx.spiked(spark, sf))


@query(
    "length_stats",
    f"{CHAIN} SELECT round(avg(length(cleaned)), 2) AS mean, round(quantile_cont(length(cleaned), 0.5), 2) AS median, "
    "round(stddev_samp(length(cleaned)), 2) AS std, min(length(cleaned)) AS min, max(length(cleaned)) AS max, "
    "round(quantile_cont(length(cleaned), 0.25), 2) AS p25, round(quantile_cont(length(cleaned), 0.75), 2) AS p75, "
    "round(quantile_cont(length(cleaned), 0.95), 2) AS p95 FROM s9",
)
def length_stats(spark, sf):
    return P.length_stats(P.clean_messages(fx.spiked(spark, sf)))


@query("caps_count", f"{CHAIN} SELECT count(*) AS rows, count(*) FILTER (starts_with(cleaned, '{fixed.CAPS_TOKEN}')) AS caps_rows FROM s9")
def caps_count(spark, sf):
    return P.caps_count(P.clean_messages(fx.spiked(spark, sf)))


_PARTLY = (
    f"{S.NULL_MESSAGES}, {S.LABELS}, partly AS (SELECT m.id, m.comment_text, l.toxic, l.low_quality "
    "FROM null_messages m LEFT JOIN labs l ON m.id = l.id)"
)


def partly_labelled(spark, sf):
    return fx.null_messages(spark, sf).join(fx.labels(spark, sf), "id", "left")


@query(
    "null_profile",
    f"WITH {_PARTLY}, t AS (SELECT count(*) AS n, count(*) FILTER (comment_text IS NULL) AS c, count(*) FILTER (toxic IS NULL) AS t, "
    "count(*) FILTER (low_quality IS NULL) AS l, count(*) FILTER (comment_text IS NULL OR toxic IS NULL OR low_quality IS NULL) "
    "AS rows_with_any_null FROM partly), u AS (SELECT 'comment_text' AS \"column\", c AS nulls FROM t UNION ALL SELECT 'toxic', t FROM t "
    "UNION ALL SELECT 'low_quality', l FROM t) SELECT u.\"column\", u.nulls, round(100.0 * u.nulls / t.n, 4) AS percentage, "
    "t.c + t.t + t.l AS total_nulls, t.rows_with_any_null FROM u, t WHERE u.nulls > 0",
)
def null_profile(spark, sf):
    return P.null_profile(partly_labelled(spark, sf))


@query(
    "drop_null_text",
    f"WITH {S.NULL_MESSAGES} SELECT count(*) AS rows_before, count(*) FILTER (comment_text IS NULL) AS rows_dropped, "
    "count(comment_text) AS rows_after, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM null_messages "
    "WHERE comment_text IS NULL ORDER BY id LIMIT 50)) AS dropped_ids_sample FROM null_messages",
)
def drop_null_text(spark, sf):
    return P.drop_null_report(fx.null_messages(spark, sf))


@query(
    "label_distribution",
    f"WITH {S.LABELLED}, t AS (SELECT count(*) AS n, count(*) FILTER (trim(comment_text) = '') AS e, CAST(sum(toxic) AS BIGINT) AS a, "
    "CAST(sum(low_quality) AS BIGINT) AS b FROM labelled), u AS (SELECT 'toxic' AS label, a AS positive, n, e FROM t UNION ALL "
    "SELECT 'low_quality', b, n, e FROM t) SELECT label, positive, n - positive AS negative, "
    "round(100.0 * positive / n, 4) AS positive_rate, e AS empty_texts FROM u",
)
def label_distribution(spark, sf):
    return P.label_distribution(fx.labelled(spark, sf), fx.LABELS)


def faulty(spark, sf):
    """Partly labelled messages with repeated ids, unscored and out-of-range labels."""
    key = F.col("id")
    toxic = F.when(key % 11 == 0, F.lit(-1)).when(key % 13 == 0, F.lit(2)).otherwise(F.col("toxic"))
    return (
        partly_labelled(spark, sf)
        .withColumn("toxic", toxic)
        .withColumn("ord", key)
        .withColumn("id", F.when(key % 17 == 1, key - 1).otherwise(key))
    )


_FAULTY = (
    f"{_PARTLY}, faulty AS (SELECT CASE WHEN id % 17 = 1 THEN id - 1 ELSE id END AS id, comment_text, "
    "CASE WHEN id % 11 = 0 THEN -1 WHEN id % 13 = 0 THEN 2 ELSE toxic END AS toxic, low_quality, id AS ord FROM partly), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM faulty), "
    "marked AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate_ids' WHEN trim(coalesce(comment_text, '')) = '' THEN 'empty_comment_text' "
    "WHEN toxic IS NULL OR low_quality IS NULL THEN 'missing_label_values' WHEN toxic = -1 OR low_quality = -1 THEN "
    "'rows_with_minus_one_labels' WHEN toxic NOT IN (0, 1) OR low_quality NOT IN (0, 1) THEN 'invalid_label_values' END AS why FROM ranked)"
)


@query(
    "drop_invalid_labels",
    f"WITH {_FAULTY} SELECT count(*) AS input_rows, "
    + ", ".join(f"count(*) FILTER (why = '{r}') AS {r}" for r in P.DROP_REASONS)
    + ", count(*) FILTER (why IS NULL) AS output_rows, count(*) FILTER (why IS NULL AND greatest(toxic, low_quality) = 0) AS non_toxic, "
    "count(*) FILTER (why IS NULL AND greatest(toxic, low_quality) = 1) AS toxic FROM marked",
)
def drop_invalid_labels(spark, sf):
    return P.drop_invalid_report(faulty(spark, sf), fx.LABELS, order_col="ord")


@query(
    "drop_invalid_labels_rows",
    f"WITH {_FAULTY} SELECT id, comment_text, toxic, low_quality, ord FROM marked WHERE why IS NULL",
)
def drop_invalid_labels_rows(spark, sf):
    return P.drop_invalid_labels(faulty(spark, sf), fx.LABELS, order_col="ord")


_STEP_ROWS = " UNION ALL ".join(_counter(*c) for c in _COUNTERS) + " UNION ALL SELECT 'empty_or_nan', count(*) FILTER (blank), count(*) FILTER (blank) FROM s9"


@query(
    "preprocessing_report",
    f"{CHAIN}, steps AS ({_STEP_ROWS}), hits AS (SELECT unnest(regexp_extract_all(low, {S.q(S.CONTRACTION)})) AS c FROM s9 WHERE NOT blank), "
    "top AS (SELECT c, count(*) AS n FROM hits GROUP BY c ORDER BY n DESC, c LIMIT 20) "
    "SELECT step, rows_affected, total_matches, (SELECT count(*) FROM s9) AS total_rows, (SELECT count(*) FROM s9) AS written_rows, "
    "(SELECT round(avg(length(cleaned)), 2) FROM s9) AS mean_length, (SELECT round(quantile_cont(length(cleaned), 0.95), 2) FROM s9) AS p95_length, "
    "(SELECT string_agg(c || '=' || n, ',' ORDER BY n DESC, c) FROM top) AS contractions FROM steps",
)
def preprocessing_report(spark, sf):
    """The cleaned table written and counted in one pass; the report written as JSON and read back."""
    base = scratch_path(spark, "cleaning")
    report = R.clean_with_report(fx.spiked(spark, sf), f"{base}/clean.parquet", source="documents", report_path=f"{base}/report")
    again = spark.read.schema(report.schema).json(f"{base}/report")
    listed = F.array_join(F.transform("transformations.contractions_top_20", lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ",")
    written = spark.read.parquet(f"{base}/clean.parquet").count()
    return again.select(
        F.inline("transformations.steps"), F.col("dataset.total_rows").alias("total_rows"), F.lit(written).cast("long").alias("written_rows"),
        F.col("text_length_stats_post.mean").alias("mean_length"), F.col("text_length_stats_post.p95").alias("p95_length"), listed.alias("contractions"),
    )


_VALID = (
    f"{S.LABELLED}, prepared AS (SELECT id, CASE WHEN id % 37 = 0 THEN NULL ELSE comment_text END AS comment_text, toxic, low_quality FROM labelled), "
    "k AS (SELECT count(*) AS n, count(comment_text) AS kept, CAST(count(*) - count(comment_text) AS BIGINT) AS nulls, "
    "CAST(sum(toxic) FILTER (comment_text IS NOT NULL) AS BIGINT) AS toxic, round(avg(length(comment_text)), 2) AS mean_length FROM prepared)"
)


@query(
    "validation_report",
    f"WITH {_VALID} SELECT 'same' AS run, 'validated' AS status, n AS original_rows, nulls AS null_texts, n AS rows_before, nulls AS rows_dropped, kept AS rows_after, "
    "toxic, mean_length, kept AS written_rows FROM k UNION ALL SELECT 'changed', 'aborted', n, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM k",
)
def validation_report(spark, sf):
    """Two runs of the validation job: one that goes through, and one that ends at the comparison and writes nothing."""
    base = scratch_path(spark, "validation")
    original = fx.labelled(spark, sf).select("id", "comment_text", *fx.LABELS)
    prepared = original.withColumn("comment_text", F.when(F.col("id") % 37 != 0, F.col("comment_text")))
    changed = prepared.withColumn("toxic", 1 - F.col("toxic"))
    out = None
    for name, table_of in (("same", prepared), ("changed", changed)):
        report = R.validate(original, table_of, fx.LABELS, f"{base}/{name}.parquet", report_path=f"{base}/{name}-report")
        again = spark.read.schema(report.schema).json(f"{base}/{name}-report")
        passed = again.first()["status"] == "validated"
        written = spark.read.parquet(f"{base}/{name}.parquet").count() if passed else 0
        part = again.select(
            F.lit(name).alias("run"), "status", "integrity.original_rows", F.col("null_profile.total_nulls").alias("null_texts"), "null_rows.rows_before", "null_rows.rows_dropped",
            "null_rows.rows_after", F.get("labels", F.lit(0))["positive"].alias("toxic"), F.col("text_length_stats.mean").alias("mean_length"), F.lit(written).cast("int").alias("written_rows"),
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("written_rows", F.col("written_rows").cast("long"))
