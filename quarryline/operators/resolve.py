"""Masters mined from the feed itself, and resolution of rows against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, code_of, match_key, name_of
from .fuzzy import matched

DISTRIBUTOR_FROM = 3
DERIVED = 0.94


def mentions(feed: DataFrame) -> DataFrame:
    """Cleaned supplier and brand mentions of each row; a row has a mention per brand column."""
    feed = feed.withColumn("_supplier", clean(F.col("Part_Manuf")))
    supplier = F.col("_supplier")
    brands = F.array(*[F.struct(F.lit(i).alias("nth"), clean(F.col(c)).alias("brand")) for i, c in enumerate(("E1_Brand", "DIB_Brand"))])
    return feed.select(
        "row_index", "Mfg_Part_Num", "Part_Desc", name_of(supplier).alias("supplier"), code_of(supplier).alias("code"), match_key(name_of(supplier)).alias("supplier_key"), F.filter(brands, lambda b: b["brand"].isNotNull()).alias("brands")
    )


def brand_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_index", "supplier_key", F.explode("brands").alias("b")).select("row_index", "supplier_key", "b.nth", "b.brand", match_key(F.col("b.brand")).alias("brand_key"))


def manufacturers(rows: DataFrame) -> DataFrame:
    """One row per supplier key: first spelling, first code, rows, brand fan-out, distributor."""
    named = rows.where("supplier_key IS NOT NULL")
    base = named.groupBy("supplier_key").agg(F.min_by("supplier", "row_index").alias("name"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("row_index"))).alias("code"), F.count("*").alias("n_rows"))
    fan = brand_rows(named).groupBy(F.col("supplier_key").alias("k")).agg(F.count_distinct("brand_key").alias("fan_out"))
    out = base.join(fan, F.col("supplier_key") == F.col("k"), "left").drop("k").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))
    return out.withColumn("distributor", F.col("fan_out") >= DISTRIBUTOR_FROM)


def brands(rows: DataFrame) -> DataFrame:
    """One row per brand key: first spelling and number of mentions."""
    first = F.struct("row_index", "nth")
    return brand_rows(rows).groupBy("brand_key").agg(F.min_by("brand", first).alias("name"), F.count("*").alias("n_mentions"))


def edges(rows: DataFrame) -> DataFrame:
    """Brand and supplier seen together: times, and first row."""
    return brand_rows(rows).where("supplier_key IS NOT NULL").groupBy("brand_key", "supplier_key").agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def owners(rows: DataFrame) -> DataFrame:
    """Suppliers of each brand by rank: makers before distributors, then the commoner, then the earlier."""
    e = edges(rows).join(manufacturers(rows).select("supplier_key", "name", "distributor"), "supplier_key")
    rank = F.row_number().over(Window.partitionBy("brand_key").orderBy("distributor", F.col("n").desc(), "first_row", "supplier_key"))
    return e.withColumn("rank", rank)


def resolve_suppliers(rows: DataFrame, master: DataFrame, fuzzily: bool = False, official: bool = False) -> DataFrame:
    """Each row's manufacturer by code, then by key, by an alias and by a fuzzy key, with method
    and confidence.  A master mined from the rows themselves has every key, so the fuzzy step
    is for masters from elsewhere; these may have ``aliases`` (array) and, if ``official``, keep
    the method's full confidence.  ``ambiguous`` is a fuzzy best with a rival too near to it."""
    codes = master.where("code IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(F.upper("code")).orderBy("supplier_key"))).where("nth = 1")
    by_code = codes.select(F.upper("code").alias("c"), F.col("name").alias("code_name"))
    by_key = master.select(F.col("supplier_key").alias("k"), F.col("name").alias("key_name"))
    met = rows.join(by_code, F.upper("code") == F.col("c"), "left").join(by_key, F.col("supplier_key") == F.col("k"), "left")
    if "aliases" in master.columns:
        told = master.select("name", F.explode("aliases").alias("alias")).select(match_key(F.col("alias")).alias("a"), "name").where("a IS NOT NULL AND a <> ''")
        met = met.join(told.groupBy("a").agg(F.min("name").alias("alias_name")), F.col("supplier_key") == F.col("a"), "left")
    else:
        met = met.withColumn("alias_name", F.lit(None).cast("string"))
    if fuzzily:
        strange = met.where("code_name IS NULL AND key_name IS NULL AND alias_name IS NULL AND supplier_key IS NOT NULL").select(F.col("supplier_key").alias("asked")).distinct()
        near = matched(strange, master.select(F.col("supplier_key").alias("name"))).select("asked", "verdict", F.when(F.col("verdict") == "fuzzy", F.col("name")).alias("near"), F.col("score").alias("likeness"))
        met = met.join(near, F.col("supplier_key") == F.col("asked"), "left").join(master.select(F.col("supplier_key").alias("n"), F.col("name").alias("near_name")), F.col("near") == F.col("n"), "left")
    else:
        met = met.withColumns({"near_name": F.lit(None).cast("string"), "likeness": F.lit(None).cast("double"), "verdict": F.lit(None).cast("string")})
    exact = F.col("supplier") == F.col("key_name")
    method = F.when(F.col("code_name").isNotNull(), "code").when(exact, "exact").when(F.col("key_name").isNotNull(), "normalized").when(F.col("alias_name").isNotNull(), "alias").when(F.col("near_name").isNotNull(), "fuzzy").when(F.col("verdict") == "ambiguous", "ambiguous").when(F.col("supplier").isNotNull(), "unresolved")
    score = F.when(method == "code", 0.99).when(method == "exact", 0.98).when(method == "normalized", 0.95).when(method == "alias", 0.92).when(method == "fuzzy", 0.78 * F.col("likeness") / 100.0).otherwise(0.0)
    weight = F.lit(1.0 if official else DERIVED)
    return met.select("row_index", "supplier", F.coalesce("code_name", "key_name", "alias_name", "near_name").alias("manufacturer"), method.alias("method"), (score * weight).alias("confidence"))


def resolve_brands(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each row's brand: the first filled brand column decides, known or not."""
    first: Column = F.get("brands", F.lit(0))["brand"]
    asked = rows.select("row_index", first.alias("asked"), match_key(first).alias("k"))
    met = asked.join(known.select(F.col("brand_key").alias("bk"), F.col("name").alias("brand"), "n_mentions"), F.col("k") == F.col("bk"), "left")
    sure = F.col("n_mentions") > 1
    method = F.when(F.col("asked").isNull(), "none").when(sure, "exact").otherwise("input_unverified")
    return met.select("row_index", F.coalesce(F.when(sure, F.col("brand")), F.col("asked")).alias("brand"), method.alias("method"), F.when(method == "exact", 0.98 * DERIVED).when(method == "input_unverified", 0.55).otherwise(0.0).alias("confidence"))


def manufacturer_of_record(rows: DataFrame) -> DataFrame:
    """``of_record`` by the masters that the rows themselves make."""
    return of_record(rows, owners(rows), manufacturers(rows))


def of_record(rows: DataFrame, owned: DataFrame, makers: DataFrame) -> DataFrame:
    """A brand's first owner unless it only distributes; else the row's own supplier."""
    top = owned.where("rank = 1").select("brand_key", F.col("name").alias("owner"), F.col("distributor").alias("owner_distributes"))
    own = makers.select("supplier_key", F.col("name").alias("own"), "distributor")
    first = F.get("brands", F.lit(0))["brand"]
    met = rows.select("row_index", "supplier_key", match_key(first).alias("brand_key")).join(top, "brand_key", "left").join(own, "supplier_key", "left")
    made = F.col("owner").isNotNull() & ~F.col("owner_distributes")
    how = F.when(made, "brand_owner").when(F.col("own").isNotNull() & ~F.col("distributor"), "supplier_direct").when(F.col("own").isNotNull(), "distributor_only").otherwise("unresolved")
    return met.select("row_index", F.when(made, F.col("owner")).when(how == "supplier_direct", F.col("own")).alias("manufacturer"), how.alias("method"))
