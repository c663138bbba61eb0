"""Classification by single words, and brands inferred from part numbers: the plain forms.

The product record has both with phrases, scopes and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_prefix, round_half_up

# Weights and thresholds of classification.
STRONG, WEAK, BONUS, AMBIGUOUS = 10.0, 3.0, 0.5, 0.80

# A small taxonomy of our own: (leaf, classpath, keyword, weight); weight 0 excludes.
LEAVES = [
    ("fasteners", "Hardware>Fasteners>Bolts", "bolt", STRONG), ("fasteners", "Hardware>Fasteners>Bolts", "rod", WEAK), ("fasteners", "Hardware>Fasteners>Bolts", "steel", WEAK),
    ("gears", "Hardware>Drive Parts>Gears", "gear", STRONG), ("gears", "Hardware>Drive Parts>Gears", "large", WEAK),
    ("rings", "Hardware>Seals>Rings", "ring", STRONG), ("rings", "Hardware>Seals>Rings", "small", WEAK),
    ("plates", "Building>Metal>Plates", "plate", STRONG), ("plates", "Building>Metal>Plates", "steel", WEAK),
    ("anvils", "Tools>Forging>Anvils", "anvil", STRONG), ("anvils", "Tools>Forging>Anvils", "old", WEAK),
    ("gadgets", "Tools>Gadgets>Widgets", "widget", STRONG), ("gadgets", "Tools>Gadgets>Widgets", "gizmo", WEAK), ("gadgets", "Tools>Gadgets>Widgets", "hot", 0.0),
]
FALLBACK = ("generic_product", "General>General>Generic Products")


def keywords(spark: SparkSession) -> DataFrame:
    """The taxonomy as rows: bounded by the pack."""
    return spark.createDataFrame(LEAVES, "leaf string, classpath string, keyword string, weight double")


def leaf_scores(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Score of each leaf a description has keywords of; an excluding one rules a leaf out.

    Words meet keywords in an equi-join, so it holds for taxonomies of any size.
    """
    tokens = rows.select("row_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("Part_Desc"), F.lit("[a-z0-9]+"), 0))).alias("keyword"))
    hits = tokens.join(words, "keyword")
    by = hits.groupBy("row_index", "leaf", "classpath").agg(
        F.sum("weight").alias("total"), F.count("*").alias("n"), F.min("weight").alias("least"), F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("matched")
    )
    return by.where("least > 0").select("row_index", "leaf", "classpath", (F.col("total") + BONUS * (F.col("n") - 1)).alias("score"), "matched")


def candidates(rows: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row_index").orderBy(F.col("score").desc(), "leaf"))
    return leaf_scores(rows, words).withColumn("rank", rank).where(F.col("rank") <= k)


def classify(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Each row's leaf with confidence and ambiguity; the fallback leaf where none matches."""
    c = candidates(rows, words, 2)
    best = c.groupBy("row_index").agg(
        F.max(F.when(F.col("rank") == 1, F.col("leaf"))).alias("leaf"), F.max(F.when(F.col("rank") == 1, F.col("classpath"))).alias("classpath"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    ratio = F.col("second") / F.col("score")
    sure = F.least(F.lit(0.97), 0.55 * F.least(F.lit(1.0), F.col("score") / 16.0) + 0.45 * (0.35 + 0.65 * (1.0 - ratio)))
    best = best.withColumn("ambiguous", ratio >= AMBIGUOUS)
    best = best.withColumn("confidence", round_half_up(F.when(F.col("ambiguous"), F.least(F.lit(0.55), sure)).otherwise(sure), 4))
    met = rows.select("row_index").join(best, "row_index", "left")
    return met.select(
        "row_index", F.coalesce("leaf", F.lit(FALLBACK[0])).alias("leaf"), F.coalesce("classpath", F.lit(FALLBACK[1])).alias("classpath"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def prefix_rules(rows: DataFrame, brand: DataFrame) -> DataFrame:
    """Letter prefixes of part numbers that go with one brand only, seen twice or more."""
    met = rows.select("row_index", "Mfg_Part_Num").join(brand.where("brand IS NOT NULL").select("row_index", "brand"), "row_index")
    each = met.select("brand", "Mfg_Part_Num", F.explode(F.array(*[alpha_prefix(F.col("Mfg_Part_Num"), n) for n in (5, 4, 3)])).alias("prefix")).where("prefix IS NOT NULL")
    by = each.groupBy("prefix").agg(F.count("*").alias("support"), F.count_distinct("brand").alias("n_brands"), F.min("brand").alias("brand"), F.min("Mfg_Part_Num").alias("first_part"))
    return by.where("n_brands = 1 AND support >= 2").select("prefix", "brand", "support", "first_part")


def infer_brands(rows: DataFrame, brand: DataFrame) -> DataFrame:
    """A brand for rows without one, by the longest learned prefix of the part number."""
    bare = rows.join(brand.where("brand IS NULL").select("row_index"), "row_index", "left_semi")
    each = bare.select("row_index", F.explode(F.array(*[alpha_prefix(F.col("Mfg_Part_Num"), n) for n in (5, 4, 3)])).alias("prefix")).where("prefix IS NOT NULL")
    met = each.join(prefix_rules(rows, brand), "prefix")
    rank = F.row_number().over(Window.partitionBy("row_index").orderBy(F.length("prefix").desc()))
    sure = F.least(F.lit(0.55), 0.30 + 0.06 * F.col("support") + 0.03 * F.length("prefix"))
    return met.withColumn("rank", rank).where("rank = 1").select("row_index", "prefix", "brand", round_half_up(sure, 4).alias("confidence"))
