"""Queries over the feed: profiling, masters, resolution, enrichment, routing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, profile, resolve
from ..operators.feed import FIELDS, feed
from .sqltext import FEED_SQL, ROWS, placeholder, quoted, round_half_up, trimmed

_CELLS = f"{FEED_SQL}, cells AS (" + " UNION ALL ".join(f"SELECT row_index, '{c}' AS \"column\", coalesce({c}, '') AS value FROM feed" for c in FIELDS) + ")"


def _rows(spark, d):
    return resolve.mentions(feed(spark, d))


def profile_columns(spark, d):
    return profile.profile(feed(spark, d), FIELDS)


def profile_top_values(spark, d):
    return profile.top_values(feed(spark, d), FIELDS)


def profile_types(spark, d):
    return profile.kinds(feed(spark, d), FIELDS)


def dup_rows(spark, d):
    by = spark.read.parquet(f"{d}/documents.parquet").groupBy("text", "lang").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def dup_keys(spark, d):
    return profile.duplicate_keys(spark.read.parquet(f"{d}/events.parquet"), "user_id")


def encoding_issues(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").agg(F.count_if(F.col("text").rlike("Ã.|Â.|â€|â„")).alias("issues"), F.count("*").alias("n"))


def mine_manufacturers(spark, d):
    return resolve.manufacturers(_rows(spark, d))


def mine_brands(spark, d):
    return resolve.brands(_rows(spark, d))


def brand_edges(spark, d):
    return resolve.edges(_rows(spark, d))


def distributors(spark, d):
    return resolve.manufacturers(_rows(spark, d)).where("distributor").select("supplier_key", "fan_out")


def brand_owner_rank(spark, d):
    return resolve.owners(_rows(spark, d)).select("brand_key", "supplier_key", "name", "n", "rank")


def resolve_supplier(spark, d):
    rows = _rows(spark, d)
    return resolve.resolve_suppliers(rows, resolve.manufacturers(rows))


def resolve_brand(spark, d):
    rows = _rows(spark, d)
    return resolve.resolve_brands(rows, resolve.brands(rows))


def manufacturer_of_record(spark, d):
    return resolve.manufacturer_of_record(_rows(spark, d))


def orphans_anti(spark, d):
    """Parts never sold in a lot of more than 48."""
    part, line = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    return part.join(line.where("l_quantity > 48"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


def known_semi(spark, d):
    rows = _rows(spark, d)
    makers = resolve.manufacturers(rows).where("NOT distributor").select(F.col("supplier_key").alias("k"))
    return rows.join(makers, F.col("supplier_key") == F.col("k"), "left_semi").select("row_index", "supplier_key")


def _leaf(spark, d):
    rows = _rows(spark, d)
    return rows, enrich.classify(rows, enrich.keywords(spark))


def classify_leaf(spark, d):
    return _leaf(spark, d)[1]


def classify_candidates(spark, d):
    return enrich.candidates(_rows(spark, d), enrich.keywords(spark))


def unclassified(spark, d):
    return _leaf(spark, d)[1].where(F.col("leaf") == enrich.FALLBACK[0]).select("row_index")


def _brand(rows):
    return resolve.resolve_brands(rows, resolve.brands(rows))


def prefix_rules(spark, d):
    rows = _rows(spark, d)
    return enrich.prefix_rules(rows, _brand(rows))


def prefix_infer(spark, d):
    rows = _rows(spark, d)
    return enrich.infer_brands(rows, _brand(rows))


def dashboard_rollup(spark, d):
    """Products by department, class and leaf level, with subtotals."""
    _, leaf = _leaf(spark, d)
    p = F.split("classpath", ">")
    return leaf.select(F.get(p, F.lit(0)).alias("dept"), F.get(p, F.lit(1)).alias("cls"), F.get(p, F.lit(2)).alias("fine")).rollup("dept", "cls", "fine").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def evidence_edges(spark, d):
    rows = _rows(spark, d)
    brand = _brand(rows)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    product = F.concat(F.lit("product:"), F.col("row_index").cast("string"))
    made = resolve.manufacturer_of_record(rows).where("manufacturer IS NOT NULL").select(product.alias("src"), node("manufacturer", "manufacturer").alias("dst"), F.col("method").alias("label"))
    branded = brand.where("brand IS NOT NULL").select(product.alias("src"), node("brand", "brand").alias("dst"), F.col("method").alias("label"))
    return made.unionByName(branded)


_KW = "kw(leaf, classpath, keyword, weight) AS (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)}, CAST({w} AS DOUBLE))" for a, b, c, w in enrich.LEAVES) + ")"
_CLASS = f"""{ROWS}, {_KW},
tk AS (SELECT DISTINCT row_index, unnest(regexp_extract_all(lower(Part_Desc), '[a-z0-9]+')) AS keyword FROM rws),
ls AS (SELECT row_index, leaf, classpath, sum(weight) + 0.5e0 * (count(*) - 1) AS score, string_agg(keyword, ',' ORDER BY keyword) AS matched
       FROM tk JOIN kw USING (keyword) GROUP BY 1, 2, 3 HAVING min(weight) > 0),
cd AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_index ORDER BY score DESC, leaf) AS INTEGER) AS rank FROM ls),
b1 AS (SELECT row_index, max(leaf) FILTER (WHERE rank = 1) AS leaf, max(classpath) FILTER (WHERE rank = 1) AS classpath,
              max(score) FILTER (WHERE rank = 1) AS score, coalesce(max(score) FILTER (WHERE rank = 2), 0) AS second FROM cd GROUP BY 1),
b2 AS (SELECT *, second / score AS ratio, least(0.97e0, 0.55e0 * least(1e0, score / 16e0) + 0.45e0 * (0.35e0 + 0.65e0 * (1e0 - second / score))) AS sure FROM b1),
lf AS (SELECT rws.row_index, coalesce(leaf, '{enrich.FALLBACK[0]}') AS leaf, coalesce(classpath, '{enrich.FALLBACK[1]}') AS classpath, coalesce(score, 0e0) AS score,
              coalesce(ratio >= 0.8e0, false) AS ambiguous,
              coalesce({round_half_up("CASE WHEN ratio >= 0.8e0 THEN least(0.55e0, sure) ELSE sure END", 4)}, 0e0) AS confidence
       FROM rws LEFT JOIN b2 USING (row_index))"""
_PREFIX = f"""{ROWS},
px AS (SELECT b.row_index, b.brand, r.Mfg_Part_Num AS mpn, n, nullif(upper(regexp_extract(r.Mfg_Part_Num, '^([A-Za-z]{{' || n || '}})', 1)), '') AS prefix
       FROM rb b JOIN rws r USING (row_index), (VALUES ('3'), ('4'), ('5')) v(n)),
pr AS (SELECT prefix, min(brand) AS brand, count(*) AS support, min(mpn) AS first_part FROM px WHERE brand IS NOT NULL AND prefix IS NOT NULL
       GROUP BY 1 HAVING count(DISTINCT brand) = 1 AND count(*) >= 2)"""
_PREFIX = _PREFIX.replace("regexp_extract(r.Mfg_Part_Num, '^([A-Za-z]{' || n || '})', 1)", "CASE WHEN regexp_matches(substr(r.Mfg_Part_Num, 1, CAST(n AS INTEGER)), '^[A-Za-z]+$') AND length(r.Mfg_Part_Num) >= CAST(n AS INTEGER) THEN substr(r.Mfg_Part_Num, 1, CAST(n AS INTEGER)) ELSE '' END")

_MOR = """mor AS (SELECT r.row_index, o.name AS owner, o.distributor AS od, mf.name AS own, mf.distributor AS d FROM rws r
  LEFT JOIN (SELECT row_index, arg_min(brand_key, nth) AS bk FROM br GROUP BY 1) f USING (row_index)
  LEFT JOIN (SELECT * FROM ow WHERE rank = 1) o ON o.brand_key = f.bk LEFT JOIN mf ON mf.supplier_key = r.supplier_key)"""

_REAL = f"CASE WHEN NOT {placeholder(trimmed('value'))} THEN {trimmed('value')} END"
QUERIES = {
    "profile_columns": (
        profile_columns,
        f"WITH {_CELLS}, r AS (SELECT \"column\", value, {_REAL} AS real FROM cells) SELECT \"column\", count(*) FILTER (WHERE trim(value) <> '') AS non_empty, count(*) FILTER (WHERE trim(value) <> '' AND real IS NULL) AS placeholders, count(real) AS effective, {round_half_up('count(real) / CAST(count(*) AS DOUBLE)', 4)} AS fill_rate, count(DISTINCT real) AS n_unique, coalesce(max(length(real)), 0) AS max_length FROM r GROUP BY 1",
    ),
    "profile_top_values": (
        profile_top_values,
        f"WITH {_CELLS}, r AS (SELECT \"column\", row_index, {_REAL} AS value FROM cells), g AS (SELECT \"column\", value, count(*) AS n, min(row_index) AS first_row FROM r WHERE value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, first_row, value) AS INTEGER) AS rank FROM g) SELECT * FROM k WHERE rank <= 5",
    ),
    "profile_types": (
        profile_types,
        f"WITH {_CELLS}, r AS (SELECT \"column\", row_index, {_REAL} AS value FROM cells), k AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY row_index) AS nth FROM r WHERE value IS NOT NULL), g AS (SELECT \"column\", bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) AS i, bool_and(regexp_matches(value, '^[+-]?[0-9]*\\.?[0-9]+$')) AS d, bool_and(regexp_matches(value, '(?i)^https?://')) AS u, count(DISTINCT lower(value)) AS k, count(*) AS n FROM k WHERE nth <= 400 GROUP BY 1) SELECT \"column\", CASE WHEN i THEN 'integer' WHEN d THEN 'decimal' WHEN u THEN 'url' WHEN k <= greatest(2, n // 20) THEN 'categorical' ELSE 'text' END AS kind FROM g",
    ),
    "dup_rows": (dup_rows, "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang) SELECT CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicates FROM g"),
    "dup_keys": (dup_keys, "WITH g AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key NULLS FIRST LIMIT 20) SELECT * FROM g WHERE n > 1"),
    "encoding_issues": (encoding_issues, "SELECT count(*) FILTER (WHERE regexp_matches(text, 'Ã.|Â.|â€|â„')) AS issues, count(*) AS n FROM documents"),
    "mine_manufacturers": (mine_manufacturers, f"WITH {ROWS} SELECT * FROM mf"),
    "mine_brands": (mine_brands, f"WITH {ROWS} SELECT * FROM bm"),
    "brand_edges": (brand_edges, f"WITH {ROWS} SELECT * FROM ed"),
    "distributors": (distributors, f"WITH {ROWS} SELECT supplier_key, fan_out FROM mf WHERE distributor"),
    "brand_owner_rank": (brand_owner_rank, f"WITH {ROWS} SELECT brand_key, supplier_key, name, n, rank FROM ow"),
    "resolve_supplier": (resolve_supplier, f"WITH {ROWS} SELECT * FROM rs"),
    "resolve_brand": (resolve_brand, f"WITH {ROWS} SELECT * FROM rb"),
    "manufacturer_of_record": (
        manufacturer_of_record,
        f"WITH {ROWS}, {_MOR} SELECT row_index, CASE WHEN owner IS NOT NULL AND NOT od THEN owner WHEN own IS NOT NULL AND NOT d THEN own END AS manufacturer, CASE WHEN owner IS NOT NULL AND NOT od THEN 'brand_owner' WHEN own IS NOT NULL AND NOT d THEN 'supplier_direct' WHEN own IS NOT NULL THEN 'distributor_only' ELSE 'unresolved' END AS method FROM mor",
    ),
    "orphans_anti": (orphans_anti, "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)"),
    "known_semi": (known_semi, f"WITH {ROWS} SELECT row_index, supplier_key FROM rws WHERE supplier_key IN (SELECT supplier_key FROM mf WHERE NOT distributor)"),
    "classify_leaf": (classify_leaf, f"WITH {_CLASS} SELECT * FROM lf"),
    "classify_candidates_top5": (classify_candidates, f"WITH {_CLASS} SELECT * FROM cd WHERE rank <= 5"),
    "unclassified": (unclassified, f"WITH {_CLASS} SELECT row_index FROM lf WHERE leaf = '{enrich.FALLBACK[0]}'"),
    "prefix_rules": (prefix_rules, f"WITH {_PREFIX} SELECT prefix, brand, support, first_part FROM pr"),
    "prefix_infer": (
        prefix_infer,
        f"WITH {_PREFIX}, j AS (SELECT px.row_index, px.prefix, pr.brand, support, row_number() OVER (PARTITION BY px.row_index ORDER BY length(px.prefix) DESC) AS rank FROM px JOIN pr ON px.prefix = pr.prefix WHERE px.brand IS NULL) SELECT row_index, prefix, brand, {round_half_up('least(0.55e0, 0.30e0 + 0.06e0 * support + 0.03e0 * length(prefix))', 4)} AS confidence FROM j WHERE rank = 1",
    ),
    "dashboard_rollup": (
        dashboard_rollup,
        f"WITH {_CLASS}, p AS (SELECT split_part(classpath, '>', 1) AS dept, split_part(classpath, '>', 2) AS cls, split_part(classpath, '>', 3) AS fine FROM lf) SELECT dept, cls, fine, count(*) AS n, CAST(grouping(dept, cls, fine) AS BIGINT) AS level FROM p GROUP BY ROLLUP (dept, cls, fine)",
    ),
    "evidence_edges": (evidence_edges, f"WITH {ROWS}, {_MOR} SELECT 'product:' || row_index AS src, 'manufacturer:' || CASE WHEN owner IS NOT NULL AND NOT od THEN owner ELSE own END AS dst, CASE WHEN owner IS NOT NULL AND NOT od THEN 'brand_owner' ELSE 'supplier_direct' END AS label FROM mor WHERE (owner IS NOT NULL AND NOT od) OR (own IS NOT NULL AND NOT d) UNION ALL SELECT 'product:' || row_index, 'brand:' || brand, method FROM rb WHERE brand IS NOT NULL"),
}
