"""Queries over learned state, answers in JSON, masters from elsewhere and rows that fail."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import match_key
from ..operators import product, resolve
from ..operators.feed import feed
from ..operators.isolate import isolated
from ..storage import settled, shared_dir
from ..streaming.learning import Learned, learn
from .product import REVIEWED
from .sqltext import ROWS

BATCHES, FILES = 5, 16


def _learned(spark, d) -> Learned:
    """The feed in five parts by row index, each of ``FILES`` files at most, streamed a part a
    micro-batch into a state of its own; a part's files are read by as many tasks."""
    root = f"{shared_dir(spark)}/learned-{uuid.uuid4().hex}"
    rows = settled(feed(spark, d), "feed")
    rows.repartitionByRange(BATCHES * FILES, "row_index").write.parquet(f"{root}/feed")
    files = len(spark.read.schema(rows.schema).parquet(f"{root}/feed").inputFiles())  # fewer for fewer rows
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(f"{root}/feed")
    learn(stream, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return Learned(spark, f"{root}/state")


def learned_masters(spark, d):
    """Manufacturers after five micro-batches: those of one batch."""
    return _learned(spark, d).manufacturers()


def learned_owners(spark, d):
    return _learned(spark, d).owners().select("brand_key", "supplier_key", "n", "first_row", "name", "distributor", "rank")


def learned_prefixes(spark, d):
    return _learned(spark, d).prefix_rules().select("prefix", "learned", "support", "first_part", F.array_join("suppliers", "|").alias("suppliers"))


def _answers(spark, d):
    """Turns as answers of a model: a fence, prose around, text after, a lost brace, a lost quote
    and brace, or whole."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    body = F.to_json(F.struct("role", F.struct("turn", "text").alias("said")), {"ignoreNullFields": "false"})
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    cut = lambda n: F.substring(body, F.lit(1), F.length(body) - n)
    spoilt = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nAnything else?")))
        .when(kind == 1, F.concat(F.lit("It is "), body, F.lit(" and {so} on")))
        .when(kind == 2, F.concat(body, F.lit("}}")))
        .when(kind == 3, F.concat(cut(1), F.lit(",  ")))
        .when(kind == 4, cut(3))
        .otherwise(body)
    )
    return t.select("conv_id", "turn", kind.cast("int").alias("kind"), spoilt.alias("answer"))


def repaired_answers(spark, d):
    """What is read back from each answer, by balancing braces and by closing strings too."""
    schema = "role string, said struct<turn: bigint, text: string>"
    read = _answers(spark, d).withColumns({"plain": answers.answer_fields(F.col("answer"), schema), "deep": answers.answer_fields(F.col("answer"), schema, deep=True)})
    said = lambda c: [F.col(f"{c}.role").alias(f"{c}_role"), F.col(f"{c}.said.turn").alias(f"{c}_turn"), F.md5(F.col(f"{c}.said.text")).alias(f"{c}_text")]
    return read.select("conv_id", "turn", "kind", *said("plain"), *said("deep"))


def _led(frame):
    """Characters that a row's own pattern takes at the head of its text, times its factor, as 64 bits."""
    import re

    import numpy as np

    n = [len(re.match(p, t or "")[0]) * int(x) for p, t, x in zip(frame["pattern"], frame["Part_Desc"], frame["factor"], strict=True)]
    return frame.assign(led=[int(np.int64(v)) for v in n])


def isolated_failures(spark, d):
    """The record where a step of the user's fails on rows with a bad pattern or an overflow: these
    are FAILED with their error, all others as without it."""
    rows = settled(feed(spark, d), "feed")
    i = F.col("row_index")
    asked = rows.select("row_index", "Part_Desc", F.when(i % 17 == 0, "([A-Z]+").otherwise("[A-Z]*").alias("pattern"), F.when(i % 19 == 0, "9" * 20).otherwise("1").alias("factor"))
    tried = settled(isolated(asked, _led, "led long").select("row_index", "led", "error"), "tried")
    p = product.enriched(rows, stages=("inference", "parsing", "extraction", "descriptions", "validation", "scoring"))
    done = product.reviewed(p.join(tried, "row_index"), "error")
    return done.select("row_index", "led", F.col("error.kind").alias("error"), "status")


def foreign_master(spark, d):
    """The feed's suppliers against a master from elsewhere, the supplier table in other spellings:
    without codes, every third with a letter lost, every fifth under an alias alone."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    n = F.col("s_suppkey")
    name = F.concat(F.regexp_replace("s_name", "#0*", " "), F.lit(" Industrial"))
    spelt = F.when(n % 5 == 0, F.concat(F.lit("House of "), n.cast("string"))).when(n % 3 == 0, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 60))).otherwise(name)
    master = s.select(spelt.alias("name"), F.lit(None).cast("string").alias("code"), match_key(spelt).alias("supplier_key"), F.when(n % 5 == 0, F.array(name)).otherwise(F.array().cast("array<string>")).alias("aliases"))
    rows = resolve.mentions(feed(spark, d))
    shown = F.when(F.col("supplier").isNotNull(), F.concat(F.regexp_replace("supplier", "#0*", " "), F.lit(" Industrial")))
    rows = settled(rows.withColumn("supplier", shown).withColumn("supplier_key", match_key(F.col("supplier"))).select("row_index", "supplier", "code", "supplier_key"), "asked")
    got = resolve.resolve_suppliers(rows, settled(master, "master"), fuzzily=True, official=True)
    return got.select("row_index", "manufacturer", "method", F.floor(F.col("confidence") * 10000 + 0.5).cast("long").alias("points"))


_PX = f"""WITH {ROWS},
fb AS (SELECT row_index, arg_min(brand_key, nth) AS brand_key FROM br GROUP BY 1),
px AS (SELECT brand_key, supplier_key, Mfg_Part_Num AS mpn, upper(substr(Mfg_Part_Num, 1, n)) AS prefix FROM rws JOIN fb USING (row_index), (VALUES (3), (4), (5)) v(n)
       WHERE length(Mfg_Part_Num) >= n AND regexp_matches(substr(Mfg_Part_Num, 1, n), '^[A-Za-z]+$')),
pj AS (SELECT px.*, bm.name FROM px JOIN bm USING (brand_key) WHERE n_mentions > 1)
SELECT prefix, min(name) AS learned, count(*) AS support, min(mpn) AS first_part, coalesce(string_agg(DISTINCT supplier_key, '|' ORDER BY supplier_key), '') AS suppliers
FROM pj GROUP BY 1 HAVING count(DISTINCT brand_key) = 1 AND count(*) >= 2"""
_ANSWERS = """SELECT conv_id, turn, CAST((conv_id + turn) % 6 AS INTEGER) AS kind,
CASE WHEN (conv_id + turn) % 6 <> 4 THEN role END AS plain_role, CASE WHEN (conv_id + turn) % 6 <> 4 THEN turn END AS plain_turn, CASE WHEN (conv_id + turn) % 6 <> 4 THEN md5(text) END AS plain_text,
role AS deep_role, turn AS deep_turn, md5(text) AS deep_text FROM conversations"""
QUERIES = {
    "learned_masters": (learned_masters, f"WITH {ROWS} SELECT * FROM mf"),
    "learned_owners": (learned_owners, f"WITH {ROWS} SELECT brand_key, supplier_key, n, first_row, name, distributor, rank FROM ow"),
    "learned_prefixes": (learned_prefixes, _PX),
    "repaired_answers": (repaired_answers, _ANSWERS),
    "foreign_master": (foreign_master, None),
    "isolated_failures": (
        isolated_failures,
        f"WITH {REVIEWED} SELECT row_index, CASE WHEN row_index % 17 <> 0 AND row_index % 19 <> 0 THEN CAST(length(regexp_extract(f.Part_Desc, '^[A-Z]*')) AS BIGINT) END AS led, CASE WHEN row_index % 17 = 0 THEN 'PatternError' WHEN row_index % 19 = 0 THEN 'OverflowError' END AS error, CASE WHEN row_index % 17 = 0 OR row_index % 19 = 0 THEN 'FAILED' ELSE status END AS status FROM vz JOIN feed f USING (row_index)",
    ),
}
