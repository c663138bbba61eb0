"""Named collections to search, and searches over them: exact terms first, then words and
character runs.

Documents are rows ``collection, doc_id, text, payload, terms``.  The score is 0.65 times
the cosine of TF-IDF over words and word pairs plus 0.35 times that over runs of three to
five characters; term counts are dampened, document frequencies smoothed (``index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import TYPES, UNITS
from ..packs import OWN, Pack
from .index import Index

COLLECTIONS = ("manufacturer_brand", "lov", "uom", "fittings", "faucets", "guidelines", "examples")
_SCHEMA = "collection string, doc_id string, text string, payload map<string,string>, terms array<string>"


def search(queries: DataFrame, docs: DataFrame, k: int = 5, min_score: float = 0.0, where: dict[str, str] | None = None) -> DataFrame:
    """The k best of ``docs`` for each query: an index made for this call alone (``Index.search``)."""
    return Index.build(docs).search(queries, k, min_score, where)


def scoped_values(asked: DataFrame, index: Index, k: int = 8) -> DataFrame:
    """Approved values for raw ones (``query_id, leaf, label, text``): the label's own, and where
    none of them is like it, any of the leaf, marked ``relaxed``."""
    return index.adaptive(asked.withColumn("collection", F.lit("lov")), ["leaf", "label"], k).drop("collection")


def rescued(values: DataFrame, known: Index | DataFrame) -> DataFrame:
    """``values`` (``query_id, leaf, label, text``) with ``rescue``, the approved value one of whose
    exact terms it is, and else ``suggestion``, the nearest one."""
    index = known if isinstance(known, Index) else Index.build(known)
    found = scoped_values(values, index, 1)
    named = index.documents.select(F.col("doc_id").alias("d"), F.try_element_at("payload", F.lit("value")).alias("value"))
    best = found.join(named, F.col("doc_id") == F.col("d")).select(F.col("query_id").alias("q"), "value", "exact", "relaxed")
    met = values.join(best, F.col("query_id") == F.col("q"), "left")
    sure = F.col("exact") & ~F.col("relaxed")
    return met.select("query_id", "leaf", "label", "text", F.when(sure, F.col("value")).alias("rescue"), F.when(~sure, F.col("value")).alias("suggestion"))


# --- collections -------------------------------------------------------------------


def masters(makers: DataFrame, brands: DataFrame) -> DataFrame:
    """Manufacturers and brands as documents; names and codes are exact terms."""
    pay = lambda kind: F.create_map(F.lit("kind"), F.lit(kind), F.lit("name"), F.col("name"))
    a = makers.select(F.concat(F.lit("m:"), "name").alias("doc_id"), F.concat_ws(" ", "name", "code").alias("text"), pay("manufacturer").alias("payload"), F.array_compact(F.array("name", "code")).alias("terms"))
    b = brands.select(F.concat(F.lit("b:"), "name").alias("doc_id"), F.col("name").alias("text"), pay("brand").alias("payload"), F.array("name").alias("terms"))
    return a.unionByName(b).select(F.lit("manufacturer_brand").alias("collection"), "doc_id", "text", "payload", "terms")


def vocabulary(spark: SparkSession, pack: Pack = OWN) -> DataFrame:
    """Approved values as documents, one for each leaf and attribute that has them."""
    rows = [("lov", f"{leaf.id}/{a.label}/{v}", " ".join([v, *more]), {"leaf": leaf.id, "label": a.label, "value": v}, [v, *more]) for leaf in pack.leaves for a in leaf.attributes for v, more in a.values]
    return spark.createDataFrame(rows, _SCHEMA)


def units(spark: SparkSession) -> DataFrame:
    rows = [("uom", u, " ".join([u, TYPES[u], *names.split("|")]), {"unit": u, "kind": TYPES[u]}, [u, *names.split("|")]) for u, names in UNITS.items()]
    return spark.createDataFrame(rows, _SCHEMA)


def guidelines(blocks: DataFrame) -> DataFrame:
    """Blocks of a guideline document (``nth, heading, text``) as documents; found by words."""
    text = F.trim(F.concat_ws(" ", "heading", "text"))
    rows = blocks.select(F.lit("guidelines").alias("collection"), F.concat(F.lit("g:"), F.col("nth").cast("string")).alias("doc_id"), text.alias("text"), F.create_map(F.lit("heading"), F.coalesce("heading", F.lit(""))).alias("payload"), F.array().cast("array<string>").alias("terms"))
    return rows.where("text <> ''")


def specifications(collection: str, cells: DataFrame) -> DataFrame:
    """Rows of a supplied specification workbook (``sheet, row, header, value``) as documents of
    ``fittings`` or ``faucets``; filled cells are the payload."""
    filled = cells.where("trim(coalesce(value, '')) <> ''").groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("nth", "header", "value"))).alias("cells"))
    text = F.array_join(F.transform("cells", lambda c: c["value"]), " ")
    pay = F.map_from_entries(F.filter(F.transform("cells", lambda c: F.struct(c["header"], c["value"])), lambda e: e["header"].isNotNull()))
    return filled.select(F.lit(collection).alias("collection"), F.concat_ws(":", F.lit(collection), "sheet", F.col("row").cast("string")).alias("doc_id"), text.alias("text"), pay.alias("payload"), F.array().cast("array<string>").alias("terms"))


def examples(labelled: DataFrame) -> DataFrame:
    """Labelled rows (``row_index, Part_Desc, Classpath``) as documents."""
    return labelled.where("coalesce(trim(Classpath), '') <> ''").select(F.lit("examples").alias("collection"), F.concat(F.lit("x:"), F.col("row_index").cast("string")).alias("doc_id"), F.col("Part_Desc").alias("text"), F.create_map(F.lit("classpath"), F.col("Classpath")).alias("payload"), F.array().cast("array<string>").alias("terms"))


def stats(docs: DataFrame) -> DataFrame:
    """``collection, n``: documents of each of the seven collections, absent ones with none."""
    names = docs.sparkSession.createDataFrame([(c,) for c in COLLECTIONS], "collection string")
    return names.join(docs.groupBy("collection").agg(F.count("*").alias("k")), "collection", "left").select("collection", F.coalesce("k", F.lit(0)).alias("n"))
