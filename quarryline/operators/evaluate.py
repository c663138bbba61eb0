"""Evaluation: predictions held against labelled rows, field by field, and quality ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compared, compared_tokens, round_half_up
from .product import LIMITS, present

# What the overall quality weighs, and from which token F1 a text counts as right.
QUALITY = {"accuracy": 0.30, "semantic": 0.15, "lov": 0.15, "char": 0.10, "validation": 0.15, "evidence": 0.15}
RIGHT = 0.95


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of tokens as bags: 1 if both are empty, 0 if one is."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * common, both), F.lit(0.0)))


def aligned(predicted: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both by normalised key, the first prediction of a key counting; and gold keys
    without one."""
    order = Window.partitionBy("_key").orderBy("row_index")
    first = predicted.withColumn("_key", compared(F.col(key))).where("_key <> ''").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    asked = gold.withColumn("_gold", compared(F.col(key))).where("_gold <> ''")
    met = first.select("_key", *[F.col(c).alias(f"p_{c}") for c in predicted.columns]).join(asked.select("_gold", *[F.col(c).alias(f"g_{c}") for c in gold.columns]), F.col("_key") == F.col("_gold"))
    return met, asked.join(first.select("_key"), F.col("_gold") == F.col("_key"), "left_anti").select(key)


def field_metrics(met: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Per field (``exact`` or ``semantic``): how often gold and prediction are filled, how
    many are right, and the summed similarity in millionths."""
    told = [F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), compared(F.col(f"p_{f}")).alias("p"), compared(F.col(f"g_{f}")).alias("g"), compared_tokens(F.col(f"p_{f}")).alias("pt"), compared_tokens(F.col(f"g_{f}")).alias("gt")) for f, kind in fields.items()]
    each = met.select(F.explode(F.array(*told)).alias("x")).select("x.*").withColumn("f1", bag_f1(F.col("pt"), F.col("gt")))
    asked = F.col("g") != ""
    right = F.when(F.col("kind") == "semantic", F.col("f1") >= RIGHT).otherwise(F.col("p") == F.col("g"))
    return each.groupBy("field", "kind").agg(
        F.count_if(asked).alias("comparable"), F.count_if(F.col("p") != "").alias("predicted"), F.count_if(asked & right).alias("correct"),
        F.sum(F.when(asked, F.floor(F.col("f1") * 1e6 + 0.5)).otherwise(0)).cast("long").alias("similarity"),
    )


def quality(p: DataFrame) -> DataFrame:
    """One row of ratios that need no labels: limits, controlled values, evidence, review,
    validation, confidence."""
    over = reduce(lambda a, b: a + b, [F.when(F.length(F.col(f"descriptions.{f}")) > n, 1).otherwise(0) for f, n in LIMITS.items()])
    said = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.col(f"descriptions.{f}"), F.lit("")) != "", 1).otherwise(0) for f in LIMITS])
    judged = F.size(F.filter(present(), lambda a: a["approved"].isNotNull()))
    good = F.size(F.filter(present(), lambda a: F.coalesce(a["approved"], F.lit(False))))
    ratio = lambda a, b, empty: round_half_up(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(empty), 6)
    one = F.lit(1)
    return p.agg(
        F.count("*").alias("n"),
        ratio(said - over, said, 1.0).alias("char_compliance"),
        ratio(good, judged, 1.0).alias("lov_compliance"),
        ratio(F.when(F.col("status").isin("NEEDS_REVIEW", "FAILED"), 1).otherwise(0), one, 0.0).alias("review_rate"),
        ratio(F.when(F.col("n_errors") == 0, 1).otherwise(0), one, 0.0).alias("validation_pass_rate"),
        round_half_up(F.sum(F.floor(F.col("confidence") * 10000 + 0.5).cast("long")) / 10000.0 / F.count("*"), 6).alias("mean_confidence"),
    )


def overall(metrics: DataFrame, ratios: DataFrame, conformant: bool = True) -> DataFrame:
    """Micro and macro accuracy, mean similarity and the weighed overall quality; a row that
    breaks the schema halves it."""
    exact, free = F.col("kind") == "exact", F.col("kind") == "semantic"
    asked = F.col("comparable") > 0
    m = metrics.agg(
        F.coalesce(F.try_divide(F.sum(F.when(exact, F.col("correct"))), F.sum(F.when(exact, F.col("comparable")))), F.lit(0.0)).alias("micro"),
        F.coalesce(F.avg(F.when(exact & asked, F.col("correct") / F.col("comparable"))), F.lit(0.0)).alias("macro"),
        F.coalesce(F.avg(F.when(free & asked, F.col("similarity") / 1e6 / F.col("comparable"))), F.lit(0.0)).alias("semantic"),
    )
    met = m.crossJoin(ratios)  # one row each
    parts = {"accuracy": "micro", "semantic": "semantic", "lov": "lov_compliance", "char": "char_compliance", "validation": "validation_pass_rate"}
    score = reduce(lambda a, b: a + b, [QUALITY[k] * F.col(c) for k, c in parts.items()]) + QUALITY["evidence"]
    return met.select(*[round_half_up(F.col(c), 4).alias(c) for c in ("micro", "macro", "semantic")], round_half_up(score * (1.0 if conformant else 0.5), 4).alias("overall"))
