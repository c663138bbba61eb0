"""The product feed: six text columns and a row index, here derived from the part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "DIB_Brand", "Part_Manuf"]

FEED_SQL = """
ps AS (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_partkey),
feed0 AS (
  SELECT p_partkey AS row_index, p_partkey % 60 AS k, p_name, p_size, p_brand, s_name, sk,
         upper(substr(p_type, 1, 3)) || chr(CAST(64 + CAST(substr(p_brand, 7) AS INTEGER) AS INTEGER)) || CAST(p_partkey AS VARCHAR) AS mpn
  FROM part LEFT JOIN ps ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = sk),
feed AS (
  SELECT row_index, mpn AS Mfg_Part_Num,
         mpn || ' ' || CASE k % 12 WHEN 5 THEN 'Ironclad ' WHEN 0 THEN 'iron clad ' WHEN 8 THEN 'Torque wrench ' WHEN 4 THEN 'Torque ' ELSE '' END
         || p_name || ' ' || CAST(p_size AS VARCHAR) || CASE WHEN k % 3 = 0 THEN ' inches' ELSE 'in' END
         || CASE WHEN k % 6 = 0 THEN ' 120V' ELSE '' END || CASE WHEN k % 10 = 0 THEN ' 4x2x1' ELSE '' END
         || CASE WHEN k % 10 = 3 THEN ' Ultra Series' ELSE '' END || CASE WHEN k % 15 = 7 THEN ' Ironclad head' ELSE '' END
         || CASE WHEN k % 4 = 0 THEN ' - Steel  Heavy Duty' WHEN k % 4 = 1 THEN ' SS w/ safety clip' ELSE '' END AS Part_Desc,
         CASE k % 5 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN NULL ELSE p_brand END AS E1_Brand,
         CASE k % 4 WHEN 0 THEN '-- No DIB Brand --' WHEN 3 THEN p_brand ELSE '' END AS DIB_Brand,
         CASE WHEN row_index % 23 = 0 OR sk IS NULL THEN '-' ELSE s_name || ' Inc (' || lpad(CAST(sk AS VARCHAR), 4, '0') || ')' END AS Part_Manuf
  FROM feed0)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    first = read("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("sk"))
    rows = read("part").join(first, F.col("l_partkey") == F.col("p_partkey"), "left").join(read("supplier"), F.col("s_suppkey") == F.col("sk"), "left")
    k = F.col("p_partkey") % 60
    mpn = F.concat(F.upper(F.substring("p_type", 1, 3)), F.chr(64 + F.substring("p_brand", 7, 9).cast("int")), F.col("p_partkey").cast("string"))
    desc = F.concat(
        mpn, F.lit(" "), F.when(k % 12 == 5, "Ironclad ").when(k % 12 == 0, "iron clad ").when(k % 12 == 8, "Torque wrench ").when(k % 12 == 4, "Torque ").otherwise(""), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.when(k % 3 == 0, " inches").otherwise("in"),
        F.when(k % 6 == 0, " 120V").otherwise(""), F.when(k % 10 == 0, " 4x2x1").otherwise(""),
        F.when(k % 10 == 3, " Ultra Series").otherwise(""), F.when(k % 15 == 7, " Ironclad head").otherwise(""),
        F.when(k % 4 == 0, " - Steel  Heavy Duty").when(k % 4 == 1, " SS w/ safety clip").otherwise(""),
    )
    return rows.select(
        F.col("p_partkey").alias("row_index"),
        mpn.alias("Mfg_Part_Num"),
        desc.alias("Part_Desc"),
        F.when(k % 5 == 0, "-- Unbranded --").when(k % 5 == 1, F.lit(None)).otherwise(F.col("p_brand")).alias("E1_Brand"),
        F.when(k % 4 == 0, "-- No DIB Brand --").when(k % 4 == 3, F.col("p_brand")).otherwise("").alias("DIB_Brand"),
        F.when((F.col("p_partkey") % 23 == 0) | F.col("sk").isNull(), "-")
        .otherwise(F.concat("s_name", F.lit(" Inc ("), F.lpad(F.col("sk").cast("string"), 4, "0"), F.lit(")")))
        .alias("Part_Manuf"),
    )
