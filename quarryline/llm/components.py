"""Connected components of a graph held as a table of links.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in
MapReduce and Beyond"): each hooks neighbours to the smallest node seen, so the
links end as stars around the smallest node of every component.  Every step is
two joins and a pre-aggregated minimum over links alone; nothing is collected, and
each step's links are written to the shared folder.  A hub's links are salted, so the
centre of a giant component is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


SALTS = 64


def with_lowest(df: DataFrame, key: str, by: str, value: str, name: str) -> DataFrame:
    """``df`` and ``name``, the least ``value`` of all rows with the same ``key``.

    Rows are dealt by the key and a salt from ``by``; of a key, at most ``SALTS`` rows
    meet in one place.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = df.groupBy(F.col(key).alias("_key"), F.col("_salt").alias("_part")).agg(F.min(value).alias("_least"))
    least = parts.groupBy(F.col("_key").alias("_of")).agg(F.min("_least").alias(name))
    told = parts.join(least, F.col("_key") == F.col("_of")).select("_key", "_part", name)
    return df.join(told, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_part"))).drop("_salt", "_key", "_part")


def told(rows: DataFrame, dim: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the columns of ``dim``, which has a row a key; a key that many rows have
    is dealt by a salt from ``by`` too."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    dealt = rows.select(key, "_salt").distinct().join(dim, key)
    return rows.join(dealt, [key, "_salt"]).drop("_salt")


def _starred(links: DataFrame, large: bool) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    met = with_lowest(both, "u", "v", "v", "least").withColumn("m", F.least("u", "least"))
    if large:
        out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("l")).select("l.a", "l.b")
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b: long): root is the smallest reachable.

    Links may repeat, point either way or from a node to itself.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = settled(links.select(lo.alias("a"), hi.alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        stars = settled(_starred(now, True), "stars")  # else the plan of one step is in that of the other six times
        now = settled(_starred(stars, False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(now.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
