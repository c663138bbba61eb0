"""Lexical and vector retrieval over document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, terms

def bm25(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best documents of each query (query_id, text) by BM25; scores in millionths."""
    return Index.build(docs, kind="plain").bm25(queries, k)


def tfidf(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest documents by cosine of sublinear, smoothed TF-IDF; ten-thousandths."""
    return Index.build(docs, kind="plain").cosine(queries, k)


def scoped(hits: DataFrame, relaxed: DataFrame, key: str) -> DataFrame:
    """Hits within scope; for keys without any, the relaxed ones, marked."""
    rest = relaxed.join(hits.select(F.col(key).alias("has")).distinct(), F.col(key) == F.col("has"), "left_anti")
    return hits.withColumn("relaxed", F.lit(False)).unionByName(rest.withColumn("relaxed", F.lit(True)))


def token_f1(left: DataFrame, right: DataFrame) -> DataFrame:
    """``key, common, n_left, n_right``: bag overlap of two texts by key (key, text)."""
    bag = lambda df, n: df.select("key", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias(n))
    a, b = bag(left, "l"), bag(right, "r")
    both = a.join(b, ["key", "term"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.groupBy("key").agg(F.sum(F.least(zero(F.col("l")), zero(F.col("r")))).alias("common"), F.sum(zero(F.col("l"))).alias("n_left"), F.sum(zero(F.col("r"))).alias("n_right"))
