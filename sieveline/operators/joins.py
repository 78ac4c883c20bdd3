"""Keyed comparison, attachment and correction of message tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import rules as R
from sieveline.functions import text, tokens
from sieveline.sources.rules import rule_words
from sieveline.sources.tables import missing_columns


def integrity_check(
    original: DataFrame, prepared: DataFrame, columns: Sequence[str], id_col: str = "id"
) -> DataFrame:
    """One row: row counts, missing columns, differing values per column, and the verdict.

    Rows are matched by key. Both tables are stacked and grouped by id, with each side reduced to
    fixed-size values before the shuffle, so repeated ids are counted and never multiplied; the rows of a repeated id are
    compared as a bag of values per column. Null
    against null counts as different. Missing columns or unequal row counts end the comparison:
    the mismatch columns are then 0.
    """
    missing = missing_columns(prepared, [id_col, *columns])
    shared = [] if missing else list(columns)

    def side(df: DataFrame, mark: int) -> DataFrame:
        return df.select(F.col(id_col).alias("_id"), F.lit(mark).alias("_side"), *shared)

    left = side(original, 0)
    # without the id column the second table can only be counted
    right = (
        side(prepared, 1)
        if not missing
        else prepared.select(F.lit(None).cast(left.schema["_id"].dataType).alias("_id"), F.lit(1).alias("_side"))
    )

    def pick(mark: int, name: str):
        return F.min(F.when(F.col("_side") == mark, F.col(name)))

    def bag(name: str):
        # 0 if both sides hold the same values equally often; rows of one side count with the other sign
        sign = F.when(F.col("_side") == 0, F.lit(1)).otherwise(F.lit(-1))
        return F.sum(sign * F.pmod(F.xxhash64(F.col(name), F.col(name).isNull()), F.lit(1 << 40)))

    per_id = (
        left.unionByName(right)
        .groupBy("_id")
        .agg(
            F.count_if(F.col("_side") == 0).alias("_n0"),
            F.count_if(F.col("_side") == 1).alias("_n1"),
            *[pick(0, c).alias(f"_a_{c}") for c in shared],
            *[pick(1, c).alias(f"_b_{c}") for c in shared],
            *[bag(c).alias(f"_d_{c}") for c in shared],
        )
    )
    both = (F.col("_n0") > 0) & (F.col("_n1") > 0)
    sums = per_id.agg(
        F.coalesce(F.sum("_n0"), F.lit(0)).alias("original_rows"),
        F.coalesce(F.sum("_n1"), F.lit(0)).alias("preprocessed_rows"),
        F.coalesce(F.sum(F.greatest(F.col("_n0"), F.col("_n1"), F.lit(1)) - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("_n0") != F.col("_n1")).alias(f"mismatch_{id_col}"),
        *[
            F.count_if(
                both & ((F.col(f"_d_{c}") != 0) & (F.col("_n0") == F.col("_n1")) | ~F.coalesce(F.col(f"_a_{c}") == F.col(f"_b_{c}"), F.lit(False)))
            ).alias(f"mismatch_{c}")
            for c in shared
        ],
    )
    names = [f"mismatch_{c}" for c in [id_col, *shared]]
    comparable = (F.col("original_rows") == F.col("preprocessed_rows")) & F.lit(not missing)
    counted = [F.when(comparable, F.col(n)).otherwise(F.lit(0)).alias(n) for n in names]
    out = sums.select(
        "original_rows", "preprocessed_rows", "duplicate_rows",
        (F.col("original_rows") == F.col("preprocessed_rows")).alias("row_count_match"),
        F.lit(",".join(missing)).alias("missing_columns"),
        *counted,
        comparable.alias("_comparable"),
    )
    all_equal = F.col("_comparable")
    for n in names:
        all_equal = all_equal & (F.col(n) == 0)
    return out.withColumn("passed", all_equal).drop("_comparable")


def attach_test_labels(
    messages: DataFrame, labels: DataFrame, label_columns: Sequence[str], id_col: str = "id"
) -> DataFrame:
    """Messages with their separately kept labels; unscored rows (any -1) are left out.

    The filter is on the label side only, so it reaches that scan. No hint: the side to broadcast,
    if any, is chosen from its measured size.
    """
    worst = F.least(*[F.col(c) for c in label_columns]) if len(label_columns) > 1 else F.col(label_columns[0])
    scored = labels.select(id_col, *label_columns).filter(worst >= 0)
    return messages.join(scored, id_col)


def embedding_coverage(df: DataFrame, embeddings: DataFrame, id_col: str = "id") -> DataFrame:
    """How many ids each side has alone, both, and how many rows repeat an id; one aggregate."""
    keys = df.select(id_col, F.lit(0).alias("_side")).unionByName(embeddings.select(id_col, F.lit(1).alias("_side")))
    per_id = keys.groupBy(id_col).agg(
        F.count_if(F.col("_side") == 0).alias("_r"), F.count_if(F.col("_side") == 1).alias("_e")
    )
    return per_id.agg(
        F.count_if((F.col("_r") > 0) & (F.col("_e") == 0)).alias("rows_without_embedding"),
        F.count_if((F.col("_r") == 0) & (F.col("_e") > 0)).alias("embeddings_without_row"),
        F.count_if((F.col("_r") > 0) & (F.col("_e") > 0)).alias("matched"),
        F.count_if((F.col("_r") > 1) | (F.col("_e") > 1)).alias("repeated_ids"),
    )


def attach_embeddings(
    df: DataFrame, embeddings: DataFrame, id_col: str = "id", vector_col: str = "embedding", strict: bool = True
) -> DataFrame:
    """Rows with their vectors. ``strict`` raises unless ids match one to one."""
    if strict:
        gaps = embedding_coverage(df, embeddings, id_col).first()
        if gaps.rows_without_embedding or gaps.embeddings_without_row or gaps.repeated_ids:
            raise ValueError(f"embeddings do not match the rows: {gaps.asDict()}")
    return df.join(embeddings.select(id_col, vector_col), id_col)


def audit_eligible(
    candidates: DataFrame,
    single: Sequence[str] = fixed.AUDIT_SINGLE_RULES,
    combined: Sequence[Sequence[str]] = fixed.AUDIT_COMBINED_RULES,
    id_col: str = "id",
    rules_col: str = "rules",
) -> DataFrame:
    """One row per candidate id: does its set of rule hits satisfy the policy?

    An id may come in several candidate rows; each rule of the policy is one boolean maximum, so
    nothing is collected.
    """
    needed = sorted({*single, *[r for group in combined for r in group]})
    seen = candidates.groupBy(id_col).agg(
        F.count("*").alias("candidate_rows"),
        *[F.max(F.array_contains(rules_col, r)).alias(f"_has_{i}") for i, r in enumerate(needed)],
    )
    has = {r: F.coalesce(F.col(f"_has_{i}"), F.lit(False)) for i, r in enumerate(needed)}
    eligible = F.lit(False)
    for rule in single:
        eligible = eligible | has[rule]
    for group in combined:
        every = F.lit(True)
        for rule in group:
            every = every & has[rule]
        eligible = eligible | every
    return seen.select(id_col, "candidate_rows", eligible.alias("eligible"))


def apply_label_audit(df: DataFrame, candidates: DataFrame, label_col: str = "toxic", id_col: str = "id", **policy) -> DataFrame:
    """The table with eligible labels corrected from 0 to 1, and ``corrected`` marking them."""
    verdict = audit_eligible(candidates, id_col=id_col, **policy).filter("eligible").select(id_col, "eligible")
    fix = F.coalesce(F.col("eligible"), F.lit(False)) & (F.col(label_col) == 0)
    return (
        df.join(verdict, id_col, "left")
        .withColumn("corrected", F.coalesce(fix, F.lit(False)))
        .withColumn(label_col, F.when(F.col("corrected"), F.lit(1)).otherwise(F.col(label_col)).cast("int"))
        .drop("eligible")
    )


def label_audit_report(
    df: DataFrame, candidates: DataFrame, label_col: str = "toxic", id_col: str = "id", sample: int = 100, **policy
) -> DataFrame:
    audited = apply_label_audit(df, candidates, label_col, id_col, **policy)
    c, y = F.col("corrected"), F.col(label_col)
    counts = audited.agg(
        F.count("*").alias("rows_in_input_dataset"),
        F.count_if(c).alias("rows_corrected"),
        F.count_if((y == 0) | c).alias("non_toxic_before"),
        F.count_if((y == 1) & ~c).alias("toxic_before"),
        F.count_if(y == 0).alias("non_toxic_after"),
        F.count_if(y == 1).alias("toxic_after"),
    )
    loaded = audit_eligible(candidates, id_col=id_col, **policy).agg(
        F.sum("candidate_rows").alias("rows"), F.count_if("eligible").alias("eligible")
    )
    ids = (
        audited.filter("corrected").select(id_col).orderBy(id_col).limit(sample)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("ids"))
    )
    return counts.select(
        "*",
        loaded.select("rows").scalar().alias("audit_rows_loaded"),
        loaded.select("eligible").scalar().alias("high_confidence_candidates"),
        ids.scalar().alias("corrected_ids_sample"),
    )


def lexicon_term_hits(df: DataFrame, rules: list[R.Rule], text_col: str = "comment_text") -> DataFrame:
    """Every lexicon word found, with its category, number of hits and number of messages.

    Each message counts its own hits, so the shuffle carries one row per word and task; the word
    list, as long as the rule table, joins after the aggregation.
    """
    hits = F.regexp_extract_all(
        text.normalize_message(F.col(text_col)), F.lit(R.lexicon_pattern(rules)), F.lit(0)
    )
    counts = (
        df.select(F.inline(tokens.count_terms(hits)))
        .groupBy("term")
        .agg(F.sum("tf").alias("hits"), F.count("*").alias("messages"))
    )
    words = rule_words(df.sparkSession, R.lexicons(rules))
    return counts.join(F.broadcast(words), "term").select("category", "term", "hits", "messages")


def tier1_errors(
    predictions: DataFrame, y_true: str = "any_toxic", y_pred: str = "tier1_pred"
) -> DataFrame:
    """The rows the rules got wrong, with the kind of error."""
    kind = F.when(F.col(y_true) == 1, F.lit("false_negative")).otherwise(F.lit("false_positive"))
    return predictions.filter(F.col(y_true) != F.col(y_pred)).withColumn("tier1_error_type", kind)
