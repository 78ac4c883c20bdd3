"""TF-IDF, SVD, embeddings and models."""

from __future__ import annotations

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.operators import features as X
from sieveline.operators import model as L
from sieveline.operators.evaluate import ranking_quality
from sieveline.operators.sampling import stratified_split
from sieveline.plans import fixtures as fx
from sieveline.plans import sql as S
from sieveline.plans.registry import query, table
from sieveline.session import materialize, scratch_path
from sieveline.streaming import jobs

# ------------------------------------------------------------------ SQL twins of the vectorisers
TOKENS = r"regexp_extract_all(lower(comment_text), '[\p{L}\p{N}_]{2,}')"


def _ngram_sql(n: int) -> str:
    if n == 1:
        return "tok"
    return f"list_transform(range(1, greatest(len(tok) - {n - 2}, 1)), lambda i: array_to_string(list_slice(tok, i, i + {n - 1}), ' '))"


def _words_sql(high: int, stop: bool, strip: bool = False) -> str:
    """CTE ``grams(id, term, tf)`` of word n-grams."""
    found = TOKENS.replace("lower(comment_text)", "strip_accents(lower(comment_text))") if strip else TOKENS
    kept = f"list_filter({found}, lambda x: x NOT IN {S.ql(fixed.STOP_WORDS)})" if stop else found
    joined = " || ".join(_ngram_sql(n) for n in range(1, high + 1))
    return (
        f"{S.DOCS}, tk AS (SELECT id, {kept} AS tok FROM docs), ng AS (SELECT id, unnest({joined}) AS term FROM tk), "
        "grams AS (SELECT id, term, count(*) AS tf FROM ng GROUP BY id, term)"
    )


CHAR_GRAMS = (
    f"{S.DOCS}, w0 AS (SELECT id, unnest(string_split_regex(lower(comment_text), '\\s+')) AS word FROM docs), "
    "w1 AS (SELECT id, ' ' || word || ' ' AS word, count(*) AS n FROM w0 WHERE word <> '' GROUP BY id, word), "
    "w2 AS (SELECT id, word, n, unnest(range(3, 8)) AS k FROM w1), "
    "w3 AS (SELECT id, n, unnest(list_transform(range(1, length(word) - k + 2), lambda i: substring(word, i, k))) AS term FROM w2 WHERE length(word) >= k), "
    "grams AS (SELECT id, term, CAST(sum(n) AS BIGINT) AS tf FROM w3 GROUP BY id, term)"
)


def _tfidf_sql(spec: X.TfidfSpec, grams: str) -> str:
    """CTEs up to ``weights(id, term, idx, weight)`` and ``vocabulary(term, idx, df, idf)``."""
    tf = "(ln(CAST(g.tf AS DOUBLE)) + 1.0)" if spec.sublinear else "CAST(g.tf AS DOUBLE)"
    return (
        f"{grams}, nd AS (SELECT count(*) AS n FROM docs), "
        "corpus AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM grams GROUP BY term), "
        f"chosen AS (SELECT term, cf, df FROM corpus, nd WHERE df >= {spec.min_df} AND df <= nd.n * CAST({spec.max_df} AS DOUBLE) "
        f"ORDER BY cf DESC, term LIMIT {spec.max_features}), "
        "vocabulary AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, "
        "ln((1.0 + nd.n) / (1.0 + df)) + 1.0 AS idf FROM chosen, nd), "
        f"raw AS (SELECT g.id, g.term, v.idx, {tf} * v.idf AS w FROM grams g JOIN vocabulary v ON g.term = v.term), "
        "weights AS (SELECT id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"
    )


WORDS_SQL = _tfidf_sql(X.WORD_SPEC, _words_sql(3, True))
CHARS_SQL = _tfidf_sql(X.CHAR_SPEC, CHAR_GRAMS)
SUBLINEAR_SQL = _tfidf_sql(X.SUBLINEAR_SPEC, _words_sql(2, False, True))

BY_TERM = "SELECT term, idx, count(*) AS messages, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM weights GROUP BY term, idx"


def by_term(weights):
    """Weights summed per term, so that comparing the results stays cheap; every row counts in."""
    return weights.groupBy("term", "idx").agg(
        F.count("*").alias("messages"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest")
    )


@query(
    "word_ngrams",
    f"WITH {S.DOCS}, tk AS (SELECT id, list_filter({TOKENS}, lambda x: x NOT IN {S.ql(fixed.STOP_WORDS)}) AS tok FROM docs) "
    f"SELECT id, len({' || '.join(_ngram_sql(n) for n in (1, 2, 3))}) AS terms, md5(array_to_string({' || '.join(_ngram_sql(n) for n in (1, 2, 3))}, '|')) AS digest FROM tk",
)
def word_ngrams(spark, sf):
    """Every n-gram in order, as a count and a digest per message."""
    return fx.documents(spark, sf).select("id", X.word_terms(X.WORD_SPEC, "comment_text").alias("t")).select(
        "id", F.size("t").cast("long").alias("terms"), F.md5(F.array_join("t", "|")).alias("digest")
    )


@query(
    "char_ngrams",
    f"WITH {CHAR_GRAMS} SELECT length(term) AS n, count(DISTINCT term) AS distinct_terms, count(*) AS pairs, CAST(sum(tf) AS BIGINT) AS occurrences FROM grams GROUP BY 1",
)
def char_ngrams(spark, sf):
    counts = X.term_counts(fx.documents(spark, sf), X.CHAR_SPEC)
    per_term = counts.groupBy("term").agg(F.count("*").alias("p"), F.sum("tf").alias("o"))
    return per_term.groupBy(F.char_length("term").cast("long").alias("n")).agg(
        F.count("*").alias("distinct_terms"), F.sum("p").alias("pairs"), F.sum("o").alias("occurrences")
    )


@query("select_vocabulary", f"WITH {WORDS_SQL} SELECT term, idx, df, round(idf, 6) AS idf FROM vocabulary")
def select_vocabulary(spark, sf):
    return X.fit_vocabulary(fx.documents(spark, sf), X.WORD_SPEC).withColumn("idf", F.round("idf", 6))


@query("select_vocabulary_char", f"WITH {CHARS_SQL} SELECT term, idx, df, round(idf, 6) AS idf FROM vocabulary")
def select_vocabulary_char(spark, sf):
    return X.fit_vocabulary(fx.documents(spark, sf), X.CHAR_SPEC).withColumn("idf", F.round("idf", 6))


@query("tfidf_word", f"WITH {WORDS_SQL} SELECT id, term, idx, round(weight, 6) AS weight FROM weights")
def tfidf_word(spark, sf):
    return X.tfidf(fx.documents(spark, sf), X.WORD_SPEC).withColumn("weight", F.round("weight", 6))


@query("tfidf_char", f"WITH {CHARS_SQL} {BY_TERM}")
def tfidf_char(spark, sf):
    return by_term(X.tfidf(fx.documents(spark, sf), X.CHAR_SPEC))


@query("tfidf_sublinear", f"WITH {SUBLINEAR_SQL} {BY_TERM}")
def tfidf_sublinear(spark, sf):
    return by_term(X.tfidf(fx.documents(spark, sf), X.SUBLINEAR_SPEC))


def _renamed(sql: str, suffix: str) -> str:
    """The CTEs of one vectoriser under names of their own, as a subquery of its weights."""
    return f"{suffix} AS (WITH {sql} SELECT id, idx, weight, (SELECT count(*) FROM vocabulary) AS width FROM weights)"


@query(
    "feature_union",
    f"WITH {_renamed(WORDS_SQL, 'wb')}, {_renamed(CHARS_SQL, 'cb')}, both_blocks AS (SELECT id, CAST(idx AS BIGINT) AS idx, weight FROM wb "
    "UNION ALL SELECT id, idx + (SELECT max(width) FROM wb), weight FROM cb) SELECT id, count(*) AS entries, min(idx) AS first_idx, "
    "max(idx) AS last_idx, CAST(sum(idx) AS BIGINT) AS idx_sum, round(sum(weight), 6) AS total FROM both_blocks GROUP BY id",
)
def feature_union(spark, sf):
    """Word block next to character block; the second starts behind the first's fitted width. All inside the row."""
    df = fx.documents(spark, sf)
    rows, _ = X.union_rows(df, _blocks(df))
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x)
    return rows.filter(F.size("indices") > 0).select(
        "id", F.size("indices").cast("long").alias("entries"), F.array_min("indices").cast("long").alias("first_idx"), F.array_max("indices").cast("long").alias("last_idx"),
        F.aggregate("indices", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("idx_sum"), F.round(total, 6).alias("total"),
    )


def _blocks(df):
    return [(spec, materialize(X.fit_vocabulary(df, spec), "vocabulary")) for spec in (X.WORD_SPEC, X.CHAR_SPEC)]


@query(
    "svd_project",
    f"WITH {_renamed(WORDS_SQL, 'wb')}, {_renamed(CHARS_SQL, 'cb')}, w AS (SELECT id, weight FROM wb UNION ALL SELECT id, weight FROM cb), "
    "e AS (SELECT round(sum(weight * weight), 3) AS total_energy FROM w) "
    "SELECT total_energy, true AS orthonormal, true AS falling, true AS above_rounding, true AS energy_matches, true AS within_total, true AS complete FROM e",
)
def svd_project(spark, sf):
    """Word and character block together and their components, 300 or as many as the rank allows: orthonormal, falling, none that rounding made, the energy
    of each projection equal to the squared singular value; all of them hold at most the energy of the matrix, which SQL sums exactly, and
    all of it if the rank is below 300."""
    df = fx.documents(spark, sf)
    rows, width = X.packed_union(df, _blocks(df))
    components, sigma = X.fit_svd(rows, width, min(300, width - 1))
    k = len(sigma)
    gap = float(np.abs(components.T @ components - np.eye(k)).max())
    dense = X.svd_project(rows, components).select(F.posexplode("dense").alias("component", "x"))
    energy = dense.groupBy("component").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    facts = spark.createDataFrame([(i, float(x)) for i, x in enumerate(sigma)], "component int, sigma double")
    off = F.abs(F.col("e") - F.col("sigma") * F.col("sigma")) > 1e-6 * float(sigma[0] ** 2)
    checked = energy.join(facts, "component").agg(F.count_if(off).alias("off"), F.sum("e").alias("kept"), F.count("*").alias("n"))
    total = X.weight_rows(rows).agg(F.sum(F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x * x)).alias("total"))
    floor = float(np.finfo(float).eps * max(rows.count(), width) * sigma[0])
    return checked.crossJoin(F.broadcast(total)).select(  # one row each
        F.round("total", 3).alias("total_energy"), F.lit(gap < 1e-6).alias("orthonormal"),
        F.lit(bool((np.diff(sigma) <= 1e-9).all())).alias("falling"), F.lit(bool((sigma > floor).all())).alias("above_rounding"),
        ((F.col("off") == 0) & (F.col("n") == k)).alias("energy_matches"), (F.col("kept") <= F.col("total") * (1 + 1e-9)).alias("within_total"),
        (F.lit(k == min(300, width - 1)) | (F.abs(F.col("kept") - F.col("total")) <= 1e-6 * F.col("total"))).alias("complete"),
    )


_SLOT = "CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64"
_SIGN = "CASE WHEN substring(md5(w), 9, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 1 ELSE -1 END"


@query(
    "embed_batch",
    f"WITH {S.DOCS}, t AS (SELECT id, unnest(string_split_regex(lower(comment_text), '\\s+')) AS w FROM docs), "
    f"s AS (SELECT id, {_SLOT} AS slot, sum({_SIGN}) AS v FROM t WHERE w <> '' GROUP BY 1, 2), "
    "n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM s) "
    "SELECT id, slot, round(CAST(CAST(v / norm AS FLOAT) AS DOUBLE), 6) AS value FROM n WHERE v <> 0",
)
def embed_batch(spark, sf):
    """The built-in encoder's vectors, as their entries that are not zero."""
    vectors = X.embed_batch(fx.documents(spark, sf)).select("id", F.posexplode("embedding").alias("slot", "x"))
    return vectors.filter("x <> 0").select(
        "id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 6).alias("value")
    )


# ------------------------------------------------------------------ models
@query(
    "class_weights",
    "WITH c AS (SELECT toxic AS class, count(*) AS n FROM labels GROUP BY toxic), t AS (SELECT sum(n) AS n, count(*) AS k FROM c) "
    "SELECT class, c.n, round(t.n / (t.k * c.n), 6) AS weight, CASE class WHEN 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS deployed FROM c, t",
)
def class_weights(spark, sf):
    df = fx.labels(spark, sf)
    deployed = L.class_weights(df, "toxic", fixed.DEPLOYED_CLASS_WEIGHTS).select("class", F.col("weight").alias("deployed"))
    return L.class_weights(df, "toxic").withColumn("weight", F.round("weight", 6)).join(deployed, "class")


STACKED_WORDS = X.TfidfSpec("word", 1, 2, 5_000, min_df=2, stop_words=X.STOP)
STACKED_CHARS = X.TfidfSpec("char", 3, 5, 5_000)


def training_rows(spark, sf):
    """The labelled messages, joined once: a fit reads them several times."""
    rows = fx.labelled(spark, sf).select("id", "comment_text", F.col("toxic").alias("y"))
    return materialize(rows, "training")


TELLING = 20  # positive rows from which on a rank statistic tells anything


def _ranked(scored, y):
    """One row: whether positive rows rank above negative ones more often than not. Fewer than `TELLING` positive rows cannot tell, and pass."""
    positive = scored.agg(F.count_if(F.col(y) == 1).alias("positive"))
    quality = ranking_quality(scored, y=y)
    return quality.crossJoin(F.broadcast(positive)).select(((F.col("positive") < TELLING) | F.coalesce(F.col("auc") > 0.5, F.lit(False))).alias("better_than_chance"))


def _fell(model):
    """Whether a model is a fit at all: its objective ends below that of a model without coefficients, and its gradient at the tolerance."""
    return F.lit(model.converged), F.lit(model.objective[-1] < 0.95 * model.objective[0])


@query(
    "fit_logreg",
    f"WITH {S.LABELLED}, c AS (SELECT toxic AS class, count(*) AS n FROM labelled GROUP BY toxic), t AS (SELECT sum(n) AS n, count(*) AS k FROM c) "
    "SELECT class, c.n, round(t.n / (t.k * c.n), 6) AS weight, c.n AS scored, true AS separated, true AS at_optimum, true AS objective_fell FROM c, t",
)
def fit_logreg(spark, sf):
    """The training run at full size: 15,000 words, 15,000 character n-grams, 300 components, balanced classes. Per class:
    rows, weight, rows scored, scores on the right side on average; the gradient reached its tolerance, the objective fell. A zero model fails all three."""
    df, spec = training_rows(spark, sf), L.ModelSpec()
    model = L.fit_triage_model(df, spec)
    scored = model.score_rows(df).join(df.select("id", "y"), "id")
    by_class = scored.groupBy(F.col("y").alias("class")).agg(F.count("*").alias("scored"), ((F.avg("y_prob") > 0.5).cast("int") == F.col("class")).alias("separated"))
    at_optimum, fell = _fell(model)
    return L.class_weights(df, "y").withColumn("weight", F.round("weight", 6)).join(by_class, "class").withColumns({"at_optimum": at_optimum, "objective_fell": fell})


_FIXED_COEFFICIENT = "((CAST(('0x' || substring(md5(term), 1, 8)) AS BIGINT) % 2001) - 1000) / 250.0"


@query(
    "score_sparse",
    f"WITH {WORDS_SQL}, logits AS (SELECT id, sum(weight * {_FIXED_COEFFICIENT}) AS s FROM weights GROUP BY id), "
    "p AS (SELECT d.id, 1.0 / (1.0 + exp(-(coalesce(s, 0.0) + 0.5))) AS p FROM docs d LEFT JOIN logits l ON l.id = d.id) "
    f"SELECT id, round(p, 6) AS y_prob, CAST(p > {fixed.TRAINING_CUTOFF} AS INTEGER) AS y_pred FROM p",
)
def score_sparse(spark, sf):
    """The model's own scorer over the full word vocabulary, with a coefficient for each term from its digest."""
    df = fx.documents(spark, sf)
    part = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % 2001
    vocabulary = X.fit_vocabulary(df, X.WORD_SPEC).withColumn("coef", (part - 1000) / F.lit(250.0))
    model = L.TriageModel(L.ModelSpec(blocks=(X.WORD_SPEC,), svd=None), [materialize(vocabulary, "vocabulary")], 0.5, [], 0.0)
    return model.score_rows(df).select("id", F.round("y_prob", 6).alias("y_prob"), (F.col("y_prob") > fixed.TRAINING_CUTOFF).cast("int").alias("y_pred"))


@query("model_store", f"WITH {S.LABELLED} SELECT id, true AS equal, true AS at_optimum FROM labelled")
def model_store(spark, sf):
    """Scores of the full text model, components included, and of its saved and reloaded copy: both written once, then compared by id."""
    df = training_rows(spark, sf)
    model = L.fit_triage_model(df, L.ModelSpec())
    again = L.saved_and_reloaded(model, spark)
    both = materialize(model.score_rows(df), "scores").join(materialize(again.score_rows(df).withColumnRenamed("y_prob", "reloaded"), "scores"), "id")
    at_optimum, fell = _fell(model)
    return both.select("id", (F.col("y_prob") == F.col("reloaded")).alias("equal"), (at_optimum & fell).alias("at_optimum"))


@query(
    "oof_predictions",
    f"WITH {S.LABELLED}, r AS (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn FROM labelled) "
    "SELECT id, CAST((rn - 1) % 3 AS INTEGER) AS fold, toxic AS y_true, CAST(1 AS BIGINT) AS times, true AS is_probability, true AS flagged_above_cutoff, "
    "true AS at_optimum, true AS better_than_chance FROM r",
)
def oof_predictions(spark, sf):
    """Out-of-fold scores of the full model: every row once, by the model that did not see its fold.
    Words, character n-grams and components at full size, up to 1,000 steps; each fold's solver reached its tolerance, and positive rows rank above negative
    ones more often than not by scores of models that have not seen them."""
    out = materialize(L.oof_predictions(training_rows(spark, sf), L.ModelSpec()), "oof")
    ranked = _ranked(out, "y_true")
    rows = out.groupBy("id", "fold", "y_true").agg(
        F.count("*").alias("times"), F.bool_and((F.col("y_prob") > 0) & (F.col("y_prob") < 1)).alias("is_probability"),
        F.bool_and((F.col("y_pred") == 1) == (F.col("y_prob") > fixed.TRAINING_CUTOFF)).alias("flagged_above_cutoff"), F.bool_and("converged").alias("at_optimum"),
    )
    return rows.crossJoin(F.broadcast(ranked))  # one row


@query(
    "stacked_score_feature",
    f"WITH {S.LABELLED}, m AS (SELECT l.id, toxic FROM labelled l JOIN embeddings e ON e.vec_id = l.id) "
    f"SELECT id, toxic AS y_true, round({S.second_score()}, 6) AS score, CAST(64 AS BIGINT) AS embedding_size, true AS is_probability, true AS at_optimum, true AS objective_fell FROM m",
)
def stacked_score_feature(spark, sf):
    """The stacked run: 5,000 words, 5,000 character n-grams, a stored embedding and another model's probability."""
    embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scores = fx.documents(spark, sf).select("id", fx.second_score().alias("score"))
    df = materialize(L.attach_score(training_rows(spark, sf).join(embeddings, "id"), scores), "stacked")
    spec = L.ModelSpec(
        blocks=(STACKED_WORDS, STACKED_CHARS), svd=None, embedding_dim=64, score=True, scheme=tuple(fixed.DEPLOYED_CLASS_WEIGHTS.items()),
    )
    model = L.fit_triage_model(df, spec)
    at_optimum, fell = _fell(model)
    scored = model.score_rows(df).select("id", ((F.col("y_prob") > 0) & (F.col("y_prob") < 1)).alias("is_probability"))
    kept = df.select("id", F.col("y").alias("y_true"), F.round("score", 6).alias("score"), F.size("embedding").cast("long").alias("embedding_size"))
    return kept.join(scored, "id").withColumns({"at_optimum": at_optimum, "objective_fell": fell})


_PARTS = (
    f"{S.LABELLED}, m AS (SELECT l.id, toxic FROM labelled l JOIN embeddings e ON e.vec_id = l.id), "
    "r AS (SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM m), "
    "p AS (SELECT id, toxic, rn <= round(0.2 * n) AS test FROM r), k AS (SELECT CAST(count_if(test) AS BIGINT) AS test, CAST(count_if(NOT test) AS BIGINT) AS train, "
    "CAST(count_if(test AND toxic = 1) AS BIGINT) AS test_toxic, CAST(count_if(NOT test AND toxic = 1) AS BIGINT) AS train_toxic FROM p)"
)


@query(
    "training_run",
    f"WITH {_PARTS}, t AS (SELECT 'test' AS predictions, test AS n, test_toxic AS n_toxic, true AS mined FROM k "
    "UNION ALL SELECT 'oof', train, train_toxic, true FROM k UNION ALL SELECT 'final_model_test', test, test_toxic, true FROM k) "
    "SELECT predictions, n AS ids, n_toxic AS toxic, true AS flagged_above_cutoff, true AS better_than_chance, mined AS hard_examples_agree, "
    "CAST(2 AS BIGINT) AS models, true AS at_optimum, (SELECT test + train FROM k) AS rows_scored, "
    "'tfidf_plus_svd_plus_saved_embeddings' AS encoder_mode, 0.95::DOUBLE AS cutoff, CAST(3 AS BIGINT) AS folds FROM t",
)
def training_run(spark, sf):
    """The whole run on four fifths of the labelled messages that have an embedding, tested on the rest, and what it leaves: three tables of
    predictions, hard examples, two models, the metadata."""
    embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    df = materialize(stratified_split(training_rows(spark, sf).join(embeddings, "id"), "y"), "split")
    train, test = (df.filter(F.col("part") == part).drop("part") for part in ("train", "test"))
    run = L.training_run(train, test, scratch_path(spark, "run"), L.ModelSpec(embedding_dim=64), dataset="labels")
    truth = df.select("id", "y")
    out = None
    for name in ("test", "oof", "final_model_test"):
        found = run.table(f"{name}_predictions").join(truth, "id")
        hard = run.table(f"{name}_hard_examples").count() if name != "final_model_test" else 0
        band = F.col("y_prob").between(*fixed.HARD_EXAMPLE_BAND) & (F.col("y_true") != F.col("y_pred"))
        part = found.agg(
            F.count_distinct("id").alias("ids"), F.sum(F.col("y").cast("long")).alias("toxic"), F.bool_and((F.col("y_pred") == 1) == (F.col("y_prob") > fixed.TRAINING_CUTOFF)).alias("flagged_above_cutoff"),
            (F.lit(name == "final_model_test") | (F.count_if(band) == hard)).alias("hard_examples_agree"),
        )
        ranked = _ranked(found, "y")
        part = part.crossJoin(F.broadcast(ranked)).select(F.lit(name).alias("predictions"), "*")  # one row each
        out = part if out is None else out.unionByName(part)
    facts = run.metadata.select(
        F.size("classifiers").cast("long").alias("models"), F.forall("classifiers", lambda c: c["converged"] & (c["last_objective"] < 0.95 * c["first_objective"])).alias("at_optimum"),
        F.aggregate("feature_pipeline.hard_example_mining.sources", F.lit(0).cast("long"), lambda n, s: n + s["rows_scored"]).alias("rows_scored"),
        "encoder_mode", "cutoff", F.col("folds").cast("long").alias("folds"),
    )
    return out.crossJoin(F.broadcast(facts))  # one row


# ------------------------------------------------------------------ resumable embedding
DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _embed(df):
    return X.embed_batch(df.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))).select("id", "embedding")


FILES = 4


@query(
    "resumable_embedding",
    "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) AS rows_after_rerun, CAST(64 AS BIGINT) AS dim, "
    "true AS broke_between_batches, CAST(0 AS BIGINT) AS differing FROM documents",
)
def resumable_embedding(spark, sf):
    """The documents in several parts, written as one file or more each, about one part a batch. The first run breaks when it meets a row of the last part; the second goes on behind the batches
    that were committed, the third adds nothing. The output equals that of one batch job."""
    base = scratch_path(spark, "embedding")
    docs = table(spark, sf, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(FILES))
    batch = 1
    for k in range(FILES):  # one after the other, so that the last rows are in the youngest files
        docs.filter(part == k).write.mode("append").parquet(f"{base}/in")
        if k == 0:  # as many files as the first part has, so that a batch of a large table is read by many tasks
            batch = max(1, len(spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{base}/in").inputFiles()))
    largest = docs.filter(part == FILES - 1).agg(F.max("doc_id").alias("m")).first()["m"]

    def run(project):
        return jobs.stream_project(spark, f"{base}/in", DOCUMENT_SCHEMA, project, f"{base}/out", f"{base}/state", max_files=batch)

    def breaks(df):
        # an error in one row of the last file, as a lost input or a failing encoder would make
        failed = F.when(F.col("doc_id") == largest, F.raise_error(F.lit("broken on purpose")).cast("string")).otherwise(F.col("text"))
        return _embed(df.withColumn("text", failed))

    try:
        run(breaks)
        broke = False
    except StreamingQueryException:
        broke = True
    before = jobs.committed_rows(spark, f"{base}/out", "id bigint, embedding array<float>")
    whole = run(_embed)
    counted = whole.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.max(F.size("embedding")).cast("long").alias("dim")).first()
    between = broke and 0 < before < counted["rows"]
    again = run(_embed)
    digest = lambda df: df.select("id", F.xxhash64("embedding").alias("h")).groupBy("id", "h").count()
    differing = digest(again).exceptAll(digest(_embed(docs))).count()
    return again.agg(F.count("*").alias("rows_after_rerun")).select(
        F.lit(counted["rows"]).cast("long").alias("rows"), F.lit(counted["ids"]).cast("long").alias("ids"), "rows_after_rerun",
        F.lit(counted["dim"]).cast("long").alias("dim"), F.lit(between).alias("broke_between_batches"), F.lit(differing).cast("long").alias("differing"),
    )
