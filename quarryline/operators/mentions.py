"""Brand names mentioned in free text, guarded against words that only look like brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed_words(c: Column) -> Column:
    """Each word of a text with the characters before it, as ``word, start``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+|[^a-z0-9]+)"), 1)
    before = lambda i: F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda n, x: n + F.length(x))
    placed = F.transform(runs, lambda x, i: F.struct(x.alias("word"), F.when(i == 0, 0).otherwise(before(F.greatest(i, F.lit(1)))).alias("start")))
    return F.filter(placed, lambda x: x["word"].rlike("^[a-z0-9]"))


def candidates(rows: DataFrame, names: DataFrame, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """``row_index, <also>, canonical, alias, nth, start, stop, confidence, symbol``: every alias
    found, whole and not ruled out by the word behind it.

    Words meet the first words of the aliases in an equi-join, so it holds for lexicons
    of any size; an alias of several words is then compared at its place.
    """
    words = rows.select("row_index", *also, F.col(text).alias("text"), F.explode(placed_words(F.col(text))).alias("w"))
    met = words.join(names, F.col("w.word") == F.col("first_word")).withColumn("start", F.col("w.start")).withColumn("stop", F.col("w.start") + F.length("alias"))
    same = F.lower(F.substring("text", F.col("start") + 1, F.length("alias"))) == F.col("alias")
    whole = ~F.substring("text", F.col("stop") + 1, F.lit(1)).rlike("[A-Za-z0-9]")
    tail = F.ltrim(F.substring("text", F.col("stop") + 1, F.lit(40)), F.lit(" -,/"))
    follows = F.lower(F.regexp_extract(tail, "^([A-Za-z]+)", 1))
    asked = F.size("require_after") > 0
    blocked = F.when(asked, ~F.array_contains("require_after", follows)).otherwise((follows != "") & F.array_contains("reject_after", follows))
    sure = F.when(F.length("alias") >= 4, 0.90).otherwise(0.75)
    return met.where(same & whole & ~blocked).select("row_index", *also, "canonical", "alias", "nth", "start", "stop", sure.alias("confidence"), "symbol")


def apart(found: Column) -> Column:
    """Candidates that overlap no longer one: taken greedily, the longest alias first."""
    kind = "array<struct<nth:int,start:int,stop:int,canonical:string,alias:string,confidence:double>>"
    free = lambda taken, c: ~F.exists(taken, lambda t: (c["stop"] > t["start"]) & (c["start"] < t["stop"]))
    return F.aggregate(F.array_sort(found), F.array().cast(kind), lambda taken, c: F.when(free(taken, c), F.concat(taken, F.array(c))).otherwise(taken))


def mentions(rows: DataFrame, names: DataFrame, text: str = "Part_Desc", also: tuple[str, ...] = ()) -> DataFrame:
    """``row_index, <also>, mentions``: each row's mentions that don't overlap, longest alias first."""
    one = F.struct("nth", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "canonical", "alias", "confidence")
    by = candidates(rows, names, text, also).groupBy("row_index", *also).agg(F.collect_list(one).alias("found"))  # at most a few a row
    return by.select("row_index", *also, apart(F.col("found")).alias("mentions"))


def best(rows: DataFrame, names: DataFrame, text: str = "Part_Desc", also: tuple[str, ...] = ()) -> DataFrame:
    """``row_index, <also>, brand, alias, confidence``: each row's surest mention, the earliest of
    equals.  ``also`` names columns of the row that come along, so that nothing joins back for them."""
    first = F.array_min(F.transform("mentions", lambda m: F.struct((-m["confidence"]).alias("minus"), m["start"].alias("start"), m["canonical"].alias("brand"), m["alias"].alias("alias"))))
    return mentions(rows, names, text, also).select("row_index", *also, first.alias("m")).select("row_index", *also, "m.brand", "m.alias", (-F.col("m.minus")).alias("confidence"))
