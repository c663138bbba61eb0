"""Queries over retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..operators import retrieval
from ..operators.index import Index


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, d):
    """One index of the documents for all queries of a session."""
    return Index.of(_docs(spark, d), "documents", "plain")


def bm25_topk(spark, d):
    return _index(spark, d).bm25(_asked(spark, d)).select("query_id", "rank", "doc_id")


def tfidf_topk(spark, d):
    return _index(spark, d).cosine(_asked(spark, d)).select("query_id", "rank", "doc_id")


def exact_alias(spark, d):
    """Exact hits by normalised text: a benchmark item that is a whole document."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    a = _t(spark, d, "benchmark").select("item_id", norm(F.col("text")).alias("k")).where("k <> ''")
    b = _docs(spark, d).select("doc_id", norm(F.col("text")).alias("k"))
    return a.join(b, "k").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def adaptive_scope(spark, d):
    """A customer's cheapest open order; where none is open, the cheapest of any kind, marked."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    pick = lambda x: x.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))
    return retrieval.scoped(pick(o.where("o_orderstatus = 'O'")), pick(o), "o_custkey")


def collection_counts(spark, d):
    """Documents of each language collection, absent ones as 0."""
    names = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    n = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return names.join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


def token_f1(spark, d):
    a = _t(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    b = _docs(spark, d).select(F.col("doc_id").alias("key"), "text").join(a.select("key"), "key", "left_semi")
    out = retrieval.token_f1(a, b)
    return out.select("key", "common", "n_left", "n_right", round_half_up(2.0 * F.col("common") / (F.col("n_left") + F.col("n_right")), 6).alias("f1"))


def align_by_key(spark, d):
    """First prediction of each key against gold, and gold keys without one."""
    gold = _t(spark, d, "customer").select(F.lower(F.trim("c_name")).alias("key"), F.col("c_custkey").alias("gold"))
    pred = _t(spark, d, "orders").select(F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("k"), "o_orderkey")
    first = pred.groupBy("k").agg(F.min("o_orderkey").alias("pred"))
    return gold.join(first, F.col("key") == F.col("k"), "left").select("key", "gold", "pred", F.col("pred").isNull().alias("missing"))


def _fields(spark, d):
    """Gold and predicted fields in long form: orders' status against the lines' own."""
    line = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("status"), F.count("*").alias("lines"))
    o = _t(spark, d, "orders").join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    f = F.array(
        F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("gold"), F.col("status").alias("pred")),
        F.struct(F.lit("priority").alias("field"), F.substring("o_orderpriority", 1, 1).alias("gold"), F.least(F.col("lines"), F.lit(5)).cast("string").alias("pred")),
    )
    return o.select("o_orderkey", F.explode(f).alias("f")).select("o_orderkey", "f.*")


def field_metrics(spark, d):
    x = _fields(spark, d)
    both = F.col("gold").isNotNull() & F.col("pred").isNotNull()
    return x.groupBy("field").agg(F.count("gold").alias("gold_n"), F.count("pred").alias("pred_n"), F.count_if(both).alias("comparable"), F.count_if(both & (F.col("gold") == F.col("pred"))).alias("correct"))


def overall_quality(spark, d):
    m = field_metrics(spark, d)
    return m.agg(round_half_up(F.sum("correct") / F.sum("comparable"), 6).alias("micro"), round_half_up(F.sum(round_half_up(F.col("correct") / F.col("comparable"), 9)) / F.count("*"), 6).alias("macro"))


def quality_vs_labels(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(_t(spark, d, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.percentile("n_chars", F.lit(0.5)).alias("median_chars"))


def vector_norms(spark, d):
    """Longest and shortest vector of each label, by whole-number coordinates."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000.0).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return e.groupBy("label").agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.min(square).alias("shortest"))


_TERMS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_POST = f"""d0 AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
d1 AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM d1 GROUP BY 1, 2),
tot AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d0),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q1 AS (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark)"""
_RANK = "r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g) SELECT query_id, rank, doc_id FROM r WHERE rank <= 5"
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_FIELDS = """l AS (SELECT l_orderkey, min(l_linestatus) AS status, count(*) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT * FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
x AS (SELECT 'status' AS field, o_orderstatus AS gold, status AS pred FROM o
      UNION ALL SELECT 'priority', substr(o_orderpriority, 1, 1), CAST(least(lines, 5) AS VARCHAR) FROM o),
m AS (SELECT field, count(gold) AS gold_n, count(pred) AS pred_n, count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NOT NULL) AS comparable,
             count(*) FILTER (WHERE gold = pred) AS correct FROM x GROUP BY 1)"""
QUERIES = {
    "bm25_topk": (
        bm25_topk,
        f"WITH {_POST}, g AS (SELECT query_id, doc_id, sum(CAST(floor(ln(1e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * n / (n_terms / CAST(n_docs AS DOUBLE)))) * 1e6 + 0.5e0) AS BIGINT)) AS score FROM (SELECT DISTINCT * FROM q1) q JOIN dfs USING (term) JOIN p USING (term), tot GROUP BY 1, 2), {_RANK}",
    ),
    "tfidf_topk": (
        tfidf_topk,
        f"""WITH {_POST}, qp AS (SELECT query_id, term, count(*) AS tf FROM q1 GROUP BY 1, 2),
dw0 AS (SELECT doc_id, term, (1e0 + ln(CAST(tf AS DOUBLE))) * (ln((1e0 + n_docs) / (1e0 + df)) + 1e0) AS w FROM p JOIN dfs USING (term), tot),
qw0 AS (SELECT query_id, term, (1e0 + ln(CAST(tf AS DOUBLE))) * (ln((1e0 + n_docs) / (1e0 + df)) + 1e0) AS w FROM qp JOIN dfs USING (term), tot),
ds AS (SELECT doc_id, sqrt(CAST(sum(CAST(floor(w * w * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e6) AS size FROM dw0 GROUP BY 1),
qs AS (SELECT query_id, sqrt(CAST(sum(CAST(floor(w * w * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e6) AS size FROM qw0 GROUP BY 1),
g AS (SELECT query_id, doc_id, floor(CAST(sum(CAST(floor((a.w / qs.size) * (b.w / ds.size) * 1e9 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e5 + 0.5e0) AS score
      FROM qw0 a JOIN qs USING (query_id) JOIN dw0 b USING (term) JOIN ds USING (doc_id) GROUP BY 1, 2), {_RANK}""",
    ),
    "exact_alias": (exact_alias, f"WITH a AS (SELECT item_id, {_NORM} AS k FROM benchmark), b AS (SELECT doc_id, {_NORM} AS k FROM documents) SELECT item_id, min(doc_id) AS doc_id, count(*) AS n FROM a JOIN b USING (k) WHERE k <> '' GROUP BY 1"),
    "adaptive_scope": (
        adaptive_scope,
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS b, bool_or(o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS has FROM orders) SELECT o_custkey, o_orderkey, false AS relaxed FROM r WHERE o_orderstatus = 'O' AND a = 1 UNION ALL SELECT o_custkey, o_orderkey, true FROM r WHERE NOT has AND b = 1",
    ),
    "collection_counts": (collection_counts, "SELECT l.lang, count(d.doc_id) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) l(lang) LEFT JOIN documents d ON d.lang = l.lang GROUP BY 1"),
    "token_f1": (
        token_f1,
        f"WITH a AS (SELECT item_id AS key, unnest({_TERMS}) AS term FROM benchmark), b AS (SELECT doc_id AS key, unnest({_TERMS}) AS term FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)), l AS (SELECT key, term, count(*) AS l FROM a GROUP BY 1, 2), r AS (SELECT key, term, count(*) AS r FROM b GROUP BY 1, 2), j AS (SELECT key, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM l FULL JOIN r USING (key, term)), g AS (SELECT key, CAST(sum(least(l, r)) AS BIGINT) AS common, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM j GROUP BY 1) SELECT *, floor(2e0 * common / (n_left + n_right) * 1e6 + 0.5e0) / 1e6 AS f1 FROM g",
    ),
    "align_by_key": (
        align_by_key,
        "WITH p AS (SELECT 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k, min(o_orderkey) AS pred FROM orders GROUP BY 1) SELECT lower(trim(c_name)) AS key, c_custkey AS gold, pred, pred IS NULL AS missing FROM customer LEFT JOIN p ON k = lower(trim(c_name))",
    ),
    "field_metrics": (field_metrics, f"WITH {_FIELDS} SELECT * FROM m"),
    "overall_quality": (
        overall_quality,
        f"WITH {_FIELDS} SELECT floor(sum(correct) / CAST(sum(comparable) AS DOUBLE) * 1e6 + 0.5e0) / 1e6 AS micro, floor(sum(floor(correct / CAST(comparable AS DOUBLE) * 1e9 + 0.5e0) / 1e9) / count(*) * 1e6 + 0.5e0) / 1e6 AS macro FROM m",
    ),
    "quality_vs_labels": (quality_vs_labels, "SELECT lang, quality, toxic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, quantile_cont(n_chars, 0.5) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3"),
    "vector_norms": (
        vector_norms,
        "WITH e AS (SELECT label, list_sum(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000e0) AS BIGINT) * CAST(floor(CAST(x AS DOUBLE) * 1000e0) AS BIGINT))) AS s FROM embeddings) SELECT label, count(*) AS n, CAST(max(s) AS BIGINT) AS longest, CAST(min(s) AS BIGINT) AS shortest FROM e GROUP BY 1",
    ),
}
