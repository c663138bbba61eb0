"""Profiling of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_placeholder, round_half_up, trimmed


def cells(df: DataFrame, columns: list[str], row: str = "row_index") -> DataFrame:
    """``row_index, column, value``: one row a cell, nulls as empty."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("value")) for c in columns])
    return df.select(F.col(row).alias("row_index"), F.explode(values).alias("c")).select("row_index", "c.column", "c.value")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled, placeholders, effective values, fill rate, distinct, longest."""
    c = cells(df, columns)
    filled = F.trim("value") != ""
    absent = is_placeholder(trimmed(F.col("value")))
    real = F.when(~absent, trimmed(F.col("value")))
    return c.groupBy("column").agg(
        F.count_if(filled).alias("non_empty"),
        F.count_if(filled & absent).alias("placeholders"),
        F.count(real).alias("effective"),
        round_half_up(F.count(real) / F.count("*"), 4).alias("fill_rate"),
        F.count_distinct(real).alias("n_unique"),
        F.coalesce(F.max(F.length(real)), F.lit(0)).cast("long").alias("max_length"),
    )


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k commonest values of each column, ties by first row."""
    c = cells(df, columns).where(~is_placeholder(trimmed(F.col("value"))))
    by = c.groupBy("column", trimmed(F.col("value")).alias("value")).agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "first_row", "value"))
    return by.withColumn("rank", rank).where(F.col("rank") <= k)


def kinds(df: DataFrame, columns: list[str], sample: int = 400) -> DataFrame:
    """A type for each column from its first effective values: the limit is the rule's own."""
    c = cells(df, columns).where(~is_placeholder(trimmed(F.col("value")))).withColumn("value", trimmed(F.col("value")))
    nth = F.row_number().over(Window.partitionBy("column").orderBy("row_index"))
    by = c.withColumn("nth", nth).where(F.col("nth") <= sample).groupBy("column").agg(
        F.bool_and(F.col("value").rlike("^[+-]?[0-9]+$")).alias("i"), F.bool_and(F.col("value").rlike(r"^[+-]?[0-9]*\.?[0-9]+$")).alias("d"),
        F.bool_and(F.col("value").rlike("^(?i)https?://")).alias("u"), F.count_distinct(F.lower("value")).alias("k"), F.count("*").alias("n"),
    )
    kind = F.when(F.col("i"), "integer").when(F.col("d"), "decimal").when(F.col("u"), "url").when(F.col("k") <= F.greatest(F.lit(2), F.floor(F.col("n") / 20)), "categorical").otherwise("text")
    return by.select("column", kind.alias("kind"))


def duplicate_keys(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Of the k commonest keys those found more than once."""
    by = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return by.orderBy(F.col("n").desc(), F.col("key").asc_nulls_first()).limit(k).where("n > 1")


def warnings(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``warning, column, count``: what in a profile needs a look; nothing else is listed."""
    c = cells(df, columns)
    total = df.agg(F.count("*").alias("count")).select(F.lit("input_empty").alias("warning"), F.lit(None).cast("string").alias("column"), "count")
    repeated = df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("count"))
    keys = duplicate_keys(df, key).agg(F.count("*").alias("count"))
    spoilt = c.agg(F.count_if(F.col("value").rlike("Ã.|Â.|â€|â„")).alias("count"))
    named = lambda frame, name: frame.where("count > 0").select(F.lit(name).alias("warning"), F.lit(None).cast("string").alias("column"), "count")
    held = (F.trim("value") != "") & is_placeholder(trimmed(F.col("value")))
    absent = c.groupBy("column").agg(F.count_if(held).alias("count"), F.count("*").alias("n")).where(F.col("count") > 0.5 * F.col("n")).select(F.lit("mostly_placeholders").alias("warning"), "column", "count")
    return total.where("count = 0").unionByName(named(repeated, "duplicate_rows")).unionByName(named(keys, "duplicate_keys")).unionByName(named(spoilt, "mojibake")).unionByName(absent)
