"""Cleaning counters and table statistics, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import patterns, text
from sieveline.sources.tables import require_columns


def _matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def clean_messages(
    df: DataFrame, text_col: str = "comment_text", config: text.CleanConfig = text.CleanConfig()
) -> DataFrame:
    """The table with its text cleaned in place."""
    require_columns(df, [text_col])
    return df.withColumn(text_col, text.clean_text(F.col(text_col), config))


STEPS = [
    "html_unescape", "unicode_normalization", "capslock_detection", "wiki_noise_removal",
    "url_ip_removal", "contraction_expansion", "profanity_deobfuscation",
    "repeated_punct_collapse", "non_alnum_strip", "empty_or_nan",
]


def tracked_stages(df: DataFrame, text_col: str, config: text.CleanConfig) -> DataFrame:
    """Per row: how much each step found, and the cleaned text. Blank rows skip all steps.

    Each stage is its own projection, so that no stage is computed twice; the whole stays narrow.
    """
    none = F.lit(0)
    out = df.withColumn("_blank", text.is_blank(F.col(text_col))).withColumn(
        "_s", F.when(~F.col("_blank"), F.col(text_col)).otherwise(F.lit(""))
    )

    def cut(name, pattern, on):
        """A step that puts a blank for each match: found once, counted and replaced from the pieces."""
        nonlocal out
        if not on:
            out = out.withColumn(f"_n_{name}", none)
            return
        out = out.withColumn("_p", text.cut_at(F.col("_s"), pattern))
        out = out.withColumns({f"_n_{name}": F.size("_p") - 1, "_s": F.array_join("_p", " ")}).drop("_p")

    def changed(name, step, on):
        nonlocal out
        if not on:
            out = out.withColumn(f"_n_{name}", none)
            return
        out = out.withColumn("_t", step(F.col("_s")))
        out = out.withColumns({f"_n_{name}": (F.col("_t") != F.col("_s")).cast("int"), "_s": F.col("_t")}).drop("_t")

    changed("html_unescape", text.html_unescape, config.unescape_html)
    changed("unicode_normalization", text.unicode_fold, config.normalize_unicode)
    out = out.withColumn("_n_capslock_detection", text.mostly_caps(F.col("_s")).cast("int") if config.detect_caps else none)
    cut("wiki_noise_removal", patterns.WIKI_MARKS, config.strip_wiki)
    cut("url_ip_removal", patterns.URLS_AND_IPS, config.strip_urls)
    out = out.withColumn("_s", F.lower("_s"))
    no_hits = F.array().cast("array<string>")

    def replaced(name, hits_name, pattern, on, hint, replacement, shown):
        """A step that replaces what it finds by a function of it: found once, for the counts and for the replacement."""
        nonlocal out
        if not on:
            out = out.withColumns({hits_name: no_hits, f"_n_{name}": none})
            return
        found = F.regexp_extract_all("_s", F.lit(pattern), F.lit(0))
        out = out.withColumn("_h", found if hint is None else F.when(hint(F.col("_s")), found).otherwise(no_hits))
        out = out.withColumns({
            "_s": text.replace_found(F.col("_s"), pattern, F.col("_h"), replacement), f"_n_{name}": F.size("_h"), hits_name: shown(F.col("_h")),
        }).drop("_h")

    replaced("contraction_expansion", "_contractions", patterns.CONTRACTIONS, config.expand_contractions, text.may_hold_contraction, text.long_form, lambda h: h)
    replaced(
        "profanity_deobfuscation", "_profanity", patterns.PROFANITY, config.deobfuscate, None, text.profanity_stem, lambda h: F.transform(h, text.profanity_stem)
    )
    if config.collapse_punct:
        doubled = text.may_repeat_punct(F.col("_s"))
        out = out.withColumn("_n_repeated_punct_collapse", F.when(doubled, _matches(F.col("_s"), patterns.REPEATED_PUNCTUATION)).otherwise(none))
        out = out.withColumn("_s", F.when(F.col("_n_repeated_punct_collapse") > 0, text.collapse_punct(F.col("_s"))).otherwise(F.col("_s")))
    else:
        out = out.withColumn("_n_repeated_punct_collapse", none)
    cut("non_alnum_strip", patterns.NOT_ALPHANUMERIC, config.strip_non_alnum)
    body = text.apply_steps(text.squeeze_whitespace(F.col("_s")), config.custom_steps)
    if config.detect_caps:
        body = text.capslock_prefix(body, F.col("_n_capslock_detection") == 1)
    return (
        out.withColumn("_n_empty_or_nan", F.col("_blank").cast("int"))
        .withColumn("_clean", F.when(F.col("_blank"), F.lit("")).otherwise(body))
        .drop("_s", "_blank")
    )


def step_counters(
    df: DataFrame, text_col: str = "comment_text", config: text.CleanConfig = text.CleanConfig()
) -> DataFrame:
    """Rows changed and matches found per step, from one pass over the table."""
    staged = tracked_stages(df, text_col, config)
    sums = [F.count_if(F.col(f"_n_{s}") > 0).alias(f"r_{s}") for s in STEPS]
    sums += [F.coalesce(F.sum(f"_n_{s}"), F.lit(0)).alias(f"m_{s}") for s in STEPS]
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("step"),
                F.col(f"r_{s}").cast("long").alias("rows_affected"),
                F.col(f"m_{s}").cast("long").alias("total_matches"),
            )
            for s in STEPS
        ]
    )
    return staged.agg(*sums).select(F.inline(rows))


def contraction_top(
    df: DataFrame, text_col: str = "comment_text", k: int = 20, config: text.CleanConfig = text.CleanConfig()
) -> DataFrame:
    """The most frequent contractions, as found by the cleaner just before it expands them."""
    staged = tracked_stages(df, text_col, config)
    return (
        staged.select(F.explode("_contractions").alias("contraction"))
        .groupBy("contraction")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "contraction")
        .limit(k)
    )


def profanity_by_word(
    df: DataFrame, text_col: str = "comment_text", config: text.CleanConfig = text.CleanConfig()
) -> DataFrame:
    staged = tracked_stages(df, text_col, config)
    return (
        staged.select(F.explode("_profanity").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def quantiles_from_counts(counts: DataFrame, value: str, n: str, points: Sequence[float], keys=()) -> DataFrame:
    """Exact, linearly interpolated quantiles from a ``value, n`` histogram."""
    return counts.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(float(p)) for p in points]), F.col(n)).alias("q")
    )


def length_stats(df: DataFrame, text_col: str = "comment_text") -> DataFrame:
    """Text length statistics.

    The lengths are first counted per value, which combines before the shuffle and leaves one row
    per distinct length; moments and exact quantiles then come from that small histogram.
    """
    lengths = (
        df.select(F.char_length(text_col).cast("long").alias("v"))
        .filter("v IS NOT NULL")
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    v, n = F.col("v"), F.col("n")
    total, first = F.sum("n"), F.sum(v * n)
    # integer sums of squares stay exact far longer than doubles do
    second = F.sum((v * v).cast("decimal(38,0)") * n)
    quantiles = F.percentile("v", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95)]), n)
    one = lengths.agg(
        total.alias("n"), first.alias("s1"), second.alias("s2"),
        F.min("v").alias("min"), F.max("v").alias("max"), quantiles.alias("q"),
    )
    count, s1 = F.col("n").cast("double"), F.col("s1").cast("double")
    centred = F.col("n").cast("decimal(38,0)") * F.col("s2") - F.col("s1").cast("decimal(38,0)") * F.col("s1")
    variance = F.try_divide(centred.cast("double"), count * (count - 1))
    return one.select(
        F.round(F.try_divide(s1, count), 2).alias("mean"),
        F.round(F.get("q", F.lit(1)), 2).alias("median"),
        F.round(F.sqrt(variance), 2).alias("std"),
        "min", "max",
        F.round(F.get("q", F.lit(0)), 2).alias("p25"),
        F.round(F.get("q", F.lit(2)), 2).alias("p75"),
        F.round(F.get("q", F.lit(3)), 2).alias("p95"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column with their share, for the columns that have any, plus the totals."""
    names = list(columns or df.columns)
    any_null = F.lit(False)
    for name in names:
        any_null = any_null | F.col(name).isNull()
    counts = df.agg(
        F.count("*").alias("_rows"),
        F.count_if(any_null).alias("_any"),
        *[F.count_if(F.col(name).isNull()).alias(f"_c{i}") for i, name in enumerate(names)],
    )
    items = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(f"_c{i}").alias("nulls")) for i, name in enumerate(names)]
    )
    total = sum((F.col(f"_c{i}") for i in range(len(names))), F.lit(0))
    return (
        counts.select("_rows", F.col("_any").alias("rows_with_any_null"), total.alias("total_nulls"), F.inline(items))
        .filter("nulls > 0")
        .select(
            "column", "nulls",
            F.round(100.0 * F.col("nulls") / F.col("_rows"), 4).alias("percentage"),
            "total_nulls", "rows_with_any_null",
        )
    )


def drop_null_text(df: DataFrame, text_col: str = "comment_text") -> DataFrame:
    return df.filter(F.col(text_col).isNotNull())


def drop_null_report(
    df: DataFrame, text_col: str = "comment_text", id_col: str = "id", sample: int = 50
) -> DataFrame:
    """Rows before, dropped and after, and the first dropped ids (a report of fixed length)."""
    counts = df.agg(
        F.count("*").alias("rows_before"), F.count_if(F.col(text_col).isNull()).alias("rows_dropped")
    )
    first = (
        df.filter(F.col(text_col).isNull())
        .select(F.col(id_col).cast("string").alias("i"), F.col(id_col).alias("k"))
        .orderBy("k")
        .limit(sample)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "i"))), lambda x: x["i"]), ",").alias("ids"))
    )
    return counts.select(
        "rows_before", "rows_dropped",
        (F.col("rows_before") - F.col("rows_dropped")).alias("rows_after"),
        first.scalar().alias("dropped_ids_sample"),
    )


def label_distribution(df: DataFrame, labels: Sequence[str], text_col: str = "comment_text") -> DataFrame:
    """Positives, negatives and rate per label, with the count of blank texts."""
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(text.trim_blanks(F.col(text_col)) == "").alias("empty_texts"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(f"p_{name}") for name in labels],
    )
    items = F.array(
        *[F.struct(F.lit(name).alias("label"), F.col(f"p_{name}").cast("long").alias("positive")) for name in labels]
    )
    return counts.select("rows", "empty_texts", F.inline(items)).select(
        "label", "positive", (F.col("rows") - F.col("positive")).alias("negative"),
        F.round(F.try_divide(100.0 * F.col("positive"), F.col("rows")), 4).alias("positive_rate"),
        "empty_texts",
    )


def caps_count(cleaned: DataFrame, text_col: str = "comment_text") -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("rows"),
        F.count_if(F.startswith(F.col(text_col), F.lit(fixed.CAPS_TOKEN))).alias("caps_rows"),
    )


DROP_REASONS = [
    "duplicate_ids", "empty_comment_text", "missing_label_values", "invalid_label_values",
    "rows_with_minus_one_labels",
]


def mark_invalid(
    df: DataFrame, labels: Sequence[str], id_col: str = "id", text_col: str = "comment_text", order_col: str | None = None
) -> DataFrame:
    """Each kept-or-dropped row with its first drop reason (null for a good row).

    Of equal ids the first by ``order_col`` stays (without it, the row of the smallest hash). That is an aggregate over the id rather than a
    window, so an id with very many copies is combined before the shuffle; the dropped copies come
    back as a count in ``copies``.
    """
    order = F.col(order_col) if order_col else F.xxhash64(*[F.col(c) for c in df.columns if c != id_col])
    others = [c for c in df.columns if c != id_col]
    first = df.groupBy(id_col).agg(
        F.min_by(F.struct(*others), order).alias("_r"), F.count("*").alias("copies")
    )
    kept = first.select(id_col, "copies", *[F.col(f"_r.{c}").alias(c) for c in others])

    return kept.withColumn("drop_reason", drop_reason(labels, text_col))


def drop_reason(labels: Sequence[str], text_col: str) -> Column:
    """Why a row is dropped; null for a good one. Looks at the row only."""

    def any_of(test):
        found = F.lit(False)
        for name in labels:
            found = found | test(F.col(name))
        return found

    return (
        F.when(text.is_blank(F.col(text_col)), F.lit("empty_comment_text"))
        .when(any_of(lambda c: c.isNull()), F.lit("missing_label_values"))
        .when(any_of(lambda c: c == -1), F.lit("rows_with_minus_one_labels"))
        .when(any_of(lambda c: ~c.isin(0, 1)), F.lit("invalid_label_values"))
    )


def drop_invalid_labels(df: DataFrame, labels: Sequence[str], **names) -> DataFrame:
    """The good rows."""
    return mark_invalid(df, labels, **names).filter("drop_reason IS NULL").drop("drop_reason", "copies")


def drop_invalid_report(
    df: DataFrame, labels: Sequence[str], id_col: str = "id", text_col: str = "comment_text", order_col: str | None = None
) -> DataFrame:
    """Rows in and out, drops by reason and the class counts afterwards.

    A row's reason and class are found before rows of one id meet, so that only they are shuffled, no text. The same rows stay as in `mark_invalid`.
    """
    worst = F.greatest(*[F.col(c) for c in labels]) if len(labels) > 1 else F.col(labels[0])
    order = F.col(order_col) if order_col else F.xxhash64(*[F.col(c) for c in df.columns if c != id_col])
    flags = df.select(F.col(id_col).alias("_id"), order.alias("_order"), F.struct(drop_reason(labels, text_col).alias("reason"), worst.alias("worst")).alias("_flags"))
    marked = flags.groupBy("_id").agg(F.min_by("_flags", "_order").alias("_f"), F.count("*").alias("copies")).select("_f.*", "copies")
    good = F.col("reason").isNull()
    return marked.agg(
        F.sum("copies").alias("input_rows"),
        F.sum(F.col("copies") - 1).alias("duplicate_ids"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in DROP_REASONS[1:]],
        F.count_if(good).alias("output_rows"),
        F.count_if(good & (F.col("worst") == 0)).alias("non_toxic"),
        F.count_if(good & (F.col("worst") == 1)).alias("toxic"),
    )
