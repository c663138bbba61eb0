"""Queries over delivery rows, assets, evaluation, fuzzy names and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.measures import UNITS
from ..functions.text import STOP
from ..operators import delivery, evaluate, fuzzy, product, profile, resolve, search
from ..operators.feed import FIELDS, feed
from .product import DESCRIBED, PACK, REVIEWED
from .sqltext import FEED_SQL, ROWS, placeholder, quoted, round_half_up, trimmed

HEADERS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "MANUFACTURER_NAME", "BRAND_NAME", "MANUFACTURER_PART_NUMBER", "Dept", "Class", "Fine", "Classpath", "Product Name", "MOBILE_DESC", "SHORT_DESC", "With", "Product Image"]
HEADERS += [f"ATTRIBUTE_{part} {i}" for i in range(1, 61) for part in ("LABEL", "VALUE", "UOM")] + [f"ITEM_FEATURES_{i}" for i in range(1, 21)] + [f"Ref URL {i}" for i in range(1, 11)] + [f"Alternate Image {i}" for i in range(1, 9)]
HEADERS += ["MFR URL", "Actual Image (Yes/No)", "Specification Sheet", "Instruction/Installation Manual", "Owners/User Manual", "Service Manual", "Warranty Information", "Catalog", "Line Drawing", "Submittal", "SDS", "UNSPSC", "TRADE_NAME", "Standard/Approvals", "MARKETING_DESCRIPTION", "LONG_DESC1", "RETAIL_DESC", "INVOICE_DESC", "Unilog_Brand"]


def _plan(spark, d):
    p = product.enriched(feed(spark, d), stages=("inference", "extraction", "descriptions"))
    manifest = p.where("row_index % 3 = 0").select(F.concat(F.regexp_replace(F.coalesce("brand", F.lit("")), "[^A-Za-z0-9]", ""), F.lit("_"), F.col("Mfg_Part_Num"), F.lit(".jpg")).alias("name"))
    found = p.where("row_index % 5 = 0").select("row_index", F.lit("sds").alias("key"))
    return p, delivery.confirmed(delivery.planned(p, ("sds", "catalog"), 1), manifest, found)


def asset_plan(spark, d):
    return _plan(spark, d)[1]


def delivery_rows(spark, d):
    """All 252 columns of the template for every product."""
    p, plan = _plan(spark, d)
    return delivery.delivery(p, HEADERS, feed(spark, d), delivery.asset_map(plan))


def benchmark_inputs(spark, d):
    """Labelled inputs, then the rows of the corpus whose part numbers aren't among them."""
    rows = feed(spark, d)
    gold = rows.where("row_index % 7 = 0").select(F.lit("gold").alias("source"), *FIELDS)
    seen = gold.select(F.lower(F.trim("Mfg_Part_Num")).alias("k"))
    rest = rows.join(seen, F.lower(F.trim("Mfg_Part_Num")) == F.col("k"), "left_anti").select(F.lit("corpus").alias("source"), *FIELDS)
    return gold.unionByName(rest)


def _metrics(spark, d):
    p = product.enriched(feed(spark, d))
    told = p.select("row_index", "Mfg_Part_Num", "brand", F.col("descriptions.SHORT_DESC").alias("said"))
    gold = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 = 0").join(feed(spark, d).select("row_index", "Mfg_Part_Num"), F.col("p_partkey") == F.col("row_index"))
    gold = gold.select("Mfg_Part_Num", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), F.concat_ws(" ", "p_brand", "p_name", "Mfg_Part_Num").alias("said"))
    met, _ = evaluate.aligned(told, gold, "Mfg_Part_Num")
    return evaluate.field_metrics(met, {"brand": "exact", "said": "semantic"}), p


def evaluation_fields(spark, d):
    return _metrics(spark, d)[0]


def quality_ratios(spark, d):
    return evaluate.quality(product.enriched(feed(spark, d)))


def evaluation_overall(spark, d):
    metrics, p = _metrics(spark, d)
    return evaluate.overall(metrics, evaluate.quality(p))


def profile_warnings(spark, d):
    """What a feed's profile warns of: duplicate rows and keys, spoilt text, sentinels."""
    odd = feed(spark, d).withColumns({"Part_Desc": F.when(F.col("row_index") % 40 == 0, F.concat("Part_Desc", F.lit(" Ã©"))).otherwise(F.col("Part_Desc")), "E1_Brand": F.when(F.col("row_index") % 3 < 2, "-").otherwise(F.col("E1_Brand"))})
    return profile.warnings(odd.unionByName(odd.where("row_index % 50 = 0")), FIELDS, "Mfg_Part_Num")


def fuzzy_names(spark, d):
    """Misspelt supplier and nation names against all of them: the best, and how sure."""
    names = spark.read.parquet(f"{d}/supplier.parquet").select(F.lower(F.regexp_replace("s_name", "#0*", " ")).alias("name"))
    names = names.unionByName(spark.read.parquet(f"{d}/nation.parquet").select(F.concat_ws(" ", F.lower(F.regexp_replace("n_name", "_", " ")), F.lit("trading")).alias("name")))
    asked = names.select(F.when(F.length("name") % 2 == 0, F.concat(F.substring("name", 1, 4), F.substring("name", 6, 60))).otherwise(F.concat("name", F.lit("x"))).alias("asked"))
    return fuzzy.matched(asked, names)


def _documents(spark, d):
    rows = resolve.mentions(feed(spark, d))
    makers, brands = resolve.manufacturers(rows), resolve.brands(rows)
    return search.masters(makers, brands).unionByName(search.vocabulary(spark)).unionByName(search.units(spark))


def collection_stats(spark, d):
    return search.stats(_documents(spark, d))


def hybrid_search(spark, d):
    """Part names asked with a letter lost, or as they are, against all part names."""
    names = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct()
    docs = names.select(F.lit("parts").alias("collection"), F.col("p_name").alias("doc_id"), F.col("p_name").alias("text"), F.create_map(F.lit("noun"), F.element_at(F.split("p_name", " "), -1)).alias("payload"), F.array("p_name").alias("terms"))
    asked = names.select(F.col("p_name").alias("query_id"), F.lit("parts").alias("collection"), F.when(F.length("p_name") % 2 == 0, F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 40))).otherwise(F.col("p_name")).alias("text"))
    return search.search(asked, docs, 3, 0.2).drop("collection")


def lov_rescue(spark, d):
    """Raw values brought to approved ones: by an exact term in their own slot, else the nearest."""
    p = product.enriched(feed(spark, d), stages=("inference", "extraction"))
    raw = p.select("leaf", F.explode("attributes").alias("a")).where("a.value IS NOT NULL AND a.label IN ('Material', 'Color', 'Duty')").select("leaf", "a.label", F.concat(F.lower("a.value"), F.when(F.length("a.value") > 5, "").otherwise("x")).alias("text")).distinct()
    asked = raw.withColumn("query_id", F.concat_ws("/", "leaf", "label", "text"))
    return search.rescued(asked, search.vocabulary(spark)).select("query_id", "rescue", "suggestion")


def nearest_centre(spark, d):
    """Each vector's nearest label centre by cosine: centres are sums of whole components."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    each = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    centres = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))  # a label's centre: as many numbers as a vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    met = v.drop("label").crossJoin(F.broadcast(centres))  # labels are few: a class each
    cosine = F.floor(dot("v", "c") / F.sqrt(dot("v", "v").cast("double")) / F.sqrt(dot("c", "c").cast("double")) * 1e6 + 0.5).cast("long")
    return met.select("vec_id", "label", cosine.alias("score")).groupBy("vec_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label"))).alias("b")).select("vec_id", "b.label", "b.score")


# --- the SQL -----------------------------------------------------------------------

_STEM = "trim(regexp_replace(regexp_replace(regexp_replace({c}, '[®™©]', '', 'g'), '[^A-Za-z0-9_\\s-]', '', 'g'), '[\\s-]+', '_', 'g'), '_')"
_PLAN = f"""{DESCRIBED},
st AS (SELECT row_index, mpn, coalesce(brand, '') AS b, concat_ws('_', nullif({_STEM.format(c="coalesce(brand, '')")}, ''), nullif({_STEM.format(c="mpn")}, '')) AS stem FROM iz WHERE coalesce(mpn, '') <> ''),
mn AS (SELECT DISTINCT regexp_replace(b, '[^A-Za-z0-9]', '', 'g') || '_' || mpn || '.jpg' AS name FROM st WHERE row_index % 3 = 0),
pl0 AS (SELECT row_index, unnest([struct_pack(key := 'product_image', name := stem || '.jpg'), struct_pack(key := 'alternate_image_1', name := stem || '_1.jpg'), struct_pack(key := 'sds', name := stem || '_SDS.pdf'), struct_pack(key := 'catalog', name := stem || '_Catalog.pdf')]) AS a FROM st WHERE stem <> ''),
pl AS (SELECT row_index, a.key AS key, a.name AS name, a.name IN (SELECT name FROM mn) OR (a.key = 'sds' AND row_index % 5 = 0) AS confirmed FROM pl0)"""


def _delivery_sql() -> str:
    """The template's columns, each from its own place; families by position."""
    own = {
        "Mfg_Part_Num": "f.Mfg_Part_Num", "Part_Desc": "f.Part_Desc", "E1_Brand": "f.E1_Brand", "MANUFACTURER_NAME": "manufacturer", "BRAND_NAME": "brand", "MANUFACTURER_PART_NUMBER": "mpn",
        "Dept": "split_part(classpath, '>', 1)", "Class": "split_part(classpath, '>', 2)", "Fine": "split_part(classpath, '>', 3)", "Classpath": "classpath", "Product Name": "name", "With": "with_clause",
        "MOBILE_DESC": "MOBILE_DESC", "SHORT_DESC": "SHORT_DESC", "LONG_DESC1": "LONG_DESC1", "RETAIL_DESC": "RETAIL_DESC", "INVOICE_DESC": "INVOICE_DESC",
        "Product Image": "image", "Actual Image (Yes/No)": "CASE WHEN image IS NOT NULL THEN 'Yes' END", "SDS": "sds", "Catalog": "catalog", "Alternate Image 1": "alternate",
    }
    slots = max(len(x.attributes) for x in PACK.leaves)
    own |= {f"ATTRIBUTE_{part} {i}": f"{part.lower()}_{i}" for i in range(1, slots + 1) for part in ("LABEL", "VALUE", "UOM")}
    spread = ", ".join(f"max(CASE WHEN pos = {i} THEN {part} END) AS {part}_{i}" for i in range(1, slots + 1) for part in ("label", "value", "uom"))
    files = ", ".join(f"max(CASE WHEN key = '{k}' AND confirmed THEN pl.name END) AS {n}" for k, n in (("product_image", "image"), ("sds", "sds"), ("catalog", "catalog"), ("alternate_image_1", "alternate")))
    cells = ", ".join((f"coalesce(CAST({own[h]} AS VARCHAR), '')" if h in own else "''") + f' AS "{h}"' for h in HEADERS)
    return f"WITH {_PLAN}, sp AS (SELECT row_index, {spread} FROM ez GROUP BY 1), fs AS (SELECT row_index, {files} FROM pl GROUP BY 1) SELECT dz.row_index, {cells} FROM dz JOIN feed f USING (row_index) LEFT JOIN sp USING (row_index) LEFT JOIN fs USING (row_index)"


_CMP = "trim(regexp_replace(translate(lower(trim(coalesce({c}, ''))), '®™©', ''), '\\s+', ' ', 'g'), ' .,;')"
_TOK = "list_filter(regexp_split_to_array(" + _CMP + ", '[^a-z0-9/.-]+'), lambda t: t <> '' AND t NOT IN (" + ", ".join(map(quoted, STOP)) + "))"
_EVAL = f"""{REVIEWED},
gd AS (SELECT f.Mfg_Part_Num AS k, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS gbrand, p_brand || ' ' || p_name || ' ' || f.Mfg_Part_Num AS gsaid FROM part JOIN feed f ON f.row_index = p_partkey WHERE p_partkey % 3 = 0),
glv AS (SELECT gbrand, gsaid, brand AS pbrand, SHORT_DESC AS psaid FROM gd JOIN vz ON lower(vz.mpn) = lower(gd.k)),
fd0 AS (SELECT 'brand' AS field, 'exact' AS kind, {_CMP.format(c="pbrand")} AS p, {_CMP.format(c="gbrand")} AS g, {_TOK.format(c="pbrand")} AS pt, {_TOK.format(c="gbrand")} AS gt FROM glv
        UNION ALL SELECT 'said', 'semantic', {_CMP.format(c="psaid")}, {_CMP.format(c="gsaid")}, {_TOK.format(c="psaid")}, {_TOK.format(c="gsaid")} FROM glv),
fd1 AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda y: y = t)), len(list_filter(gt, lambda y: y = t))))), 0) AS common FROM fd0),
fd2 AS (SELECT *, CASE WHEN len(pt) + len(gt) = 0 THEN 1e0 ELSE 2e0 * common / (len(pt) + len(gt)) END AS f1 FROM fd1),
fm AS (SELECT field, kind, count(*) FILTER (WHERE g <> '') AS comparable, count(*) FILTER (WHERE p <> '') AS predicted, count(*) FILTER (WHERE g <> '' AND CASE kind WHEN 'semantic' THEN f1 >= 0.95e0 ELSE p = g END) AS correct,
              CAST(coalesce(sum(floor(f1 * 1e6 + 0.5e0)) FILTER (WHERE g <> ''), 0) AS BIGINT) AS similarity FROM fd2 GROUP BY 1, 2)"""
_QUALITY = f"""ra AS (SELECT count(*) AS n, count(*) FILTER (WHERE length(MOBILE_DESC) <= 80) + count(*) FILTER (WHERE length(INVOICE_DESC) <= 40) + count(*) FILTER (WHERE length(SHORT_DESC) <= 240) + count(*) FILTER (WHERE length(LONG_DESC1) <= 4000) + count(*) FILTER (WHERE length(RETAIL_DESC) <= 240) AS fit,
                count(nullif(MOBILE_DESC, '')) + count(nullif(INVOICE_DESC, '')) + count(nullif(SHORT_DESC, '')) + count(nullif(LONG_DESC1, '')) + count(nullif(RETAIL_DESC, '')) AS said,
                count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS reviewed, count(*) FILTER (WHERE n_errors = 0) AS valid, CAST(sum(CAST(floor(confidence * 10000 + 0.5e0) AS BIGINT)) AS BIGINT) / 1e4 AS sure FROM vz),
rl AS (SELECT count(approved) AS judged, count(*) FILTER (WHERE approved) AS good FROM er WHERE value IS NOT NULL),
rq AS (SELECT n, {round_half_up("CASE WHEN said > 0 THEN fit / CAST(said AS DOUBLE) ELSE 1e0 END", 6)} AS char_compliance, {round_half_up("CASE WHEN judged > 0 THEN good / CAST(judged AS DOUBLE) ELSE 1e0 END", 6)} AS lov_compliance,
              {round_half_up("reviewed / CAST(n AS DOUBLE)", 6)} AS review_rate, {round_half_up("valid / CAST(n AS DOUBLE)", 6)} AS validation_pass_rate, {round_half_up("sure / n", 6)} AS mean_confidence FROM ra, rl)"""

_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS c, coalesce({c}, '') AS v FROM fd" for c in FIELDS)
_WARN = f"""WITH {FEED_SQL}, fx AS (SELECT * REPLACE (CASE WHEN row_index % 40 = 0 THEN Part_Desc || ' Ã©' ELSE Part_Desc END AS Part_Desc, CASE WHEN row_index % 3 < 2 THEN '-' ELSE E1_Brand END AS E1_Brand) FROM feed),
fd AS (SELECT * FROM fx UNION ALL SELECT * FROM fx WHERE row_index % 50 = 0), cl AS ({_CELLS}), n AS (SELECT count(*) AS n FROM fd),
dr AS (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS k FROM (SELECT count(*) AS k FROM fd GROUP BY {", ".join(FIELDS)}) WHERE k > 1),
dk AS (SELECT count(*) AS k FROM (SELECT count(*) AS k FROM fd GROUP BY Mfg_Part_Num ORDER BY k DESC, Mfg_Part_Num NULLS FIRST LIMIT 20) WHERE k > 1),
en AS (SELECT count(*) AS k FROM cl WHERE regexp_matches(v, 'Ã.|Â.|â€|â„')),
ph AS (SELECT c, count(*) AS k FROM cl WHERE trim(v) <> '' AND {placeholder(trimmed("v"))} GROUP BY 1)
SELECT 'input_empty' AS warning, CAST(NULL AS VARCHAR) AS "column", n AS count FROM n WHERE n = 0 UNION ALL SELECT 'duplicate_rows', NULL, k FROM dr WHERE k > 0 UNION ALL SELECT 'duplicate_keys', NULL, k FROM dk WHERE k > 0
UNION ALL SELECT 'mojibake', NULL, k FROM en WHERE k > 0 UNION ALL SELECT 'mostly_placeholders', c, k FROM ph, n WHERE k > 0.5e0 * n"""

def _tf(name: str, table: str, key: str) -> str:
    pairs = "list_filter(list_transform(ws, lambda w, i: CASE WHEN i < len(ws) THEN w || ' ' || ws[i + 1] END), lambda x: x IS NOT NULL)"
    runs = "flatten(list_transform(list_filter(string_split(lower(text), ' '), lambda x: x <> ''), lambda x: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(x) + 2 - n + 2, 1)), lambda j: substr(' ' || x || ' ', CAST(j AS INTEGER), CAST(n AS INTEGER)))))))"
    return (
        f"{name}0 AS (SELECT {key}, 'w' AS space, unnest(list_concat(ws, {pairs})) AS term FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS ws FROM {table}) UNION ALL SELECT {key}, 'c', unnest({runs}) FROM {table}), "
        f"{name} AS (SELECT {key}, space, term, count(*) AS tf FROM {name}0 GROUP BY 1, 2, 3)"
    )


_UNITLEN = lambda name, source, key: (
    f"{name}1 AS (SELECT {key}, space, term, (1e0 + ln(CAST(tf AS DOUBLE))) * (ln((1e0 + n_docs) / (1e0 + df)) + 1e0) AS w FROM {source} JOIN df USING (space, term), nd), "
    f"{name}2 AS (SELECT {key}, space, sqrt(CAST(sum(CAST(floor(w * w * 1e6 + 0.5e0) AS BIGINT)) AS BIGINT) / 1e6) AS size FROM {name}1 GROUP BY 1, 2), {name} AS (SELECT {key}, space, term, w / size AS w FROM {name}1 JOIN {name}2 USING ({key}, space))"
)
_HYBRID = f"""WITH nm AS (SELECT DISTINCT p_name FROM part), dc AS (SELECT p_name AS doc_id, p_name AS text FROM nm), nd AS (SELECT count(*) AS n_docs FROM dc),
qy AS (SELECT p_name AS query_id, CASE WHEN length(p_name) % 2 = 0 THEN substr(p_name, 1, 2) || substr(p_name, 4, 40) ELSE p_name END AS text FROM nm),
{_tf("dt", "dc", "doc_id")}, {_tf("qt", "qy", "query_id")}, df AS (SELECT space, term, count(*) AS df FROM dt GROUP BY 1, 2), {_UNITLEN("dw", "dt", "doc_id")}, {_UNITLEN("qw", "qt", "query_id")},
sc AS (SELECT query_id, doc_id, CAST(sum(CAST(floor(CASE space WHEN 'w' THEN 0.65e0 ELSE 0.35e0 END * qw.w * dw.w * 1e9 + 0.5e0) AS BIGINT)) AS BIGINT) AS points FROM qw JOIN dw USING (space, term) GROUP BY 1, 2),
ex AS (SELECT query_id, doc_id FROM qy JOIN dc ON trim(regexp_replace(lower(qy.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(dc.text), '[^a-z0-9]+', ' ', 'g'))),
al AS (SELECT query_id, doc_id, ex.query_id IS NOT NULL AS exact, points, CASE WHEN ex.query_id IS NOT NULL THEN 1e0 ELSE floor(points / 1e5 + 0.5e0) / 1e4 END AS score FROM sc FULL JOIN ex USING (query_id, doc_id)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, doc_id) AS INTEGER) AS rank FROM al WHERE exact OR points > 2e8)
SELECT query_id, doc_id, score, exact, rank FROM rk WHERE rank <= 3"""

_N_LOV = sum(len(a.values) for leaf in PACK.leaves for a in leaf.attributes)
_CENTRE = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM v), c0 AS (SELECT label, i, CAST(sum(x) AS BIGINT) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM c0 GROUP BY 1),
s AS (SELECT vec_id, c.label, CAST(floor(CAST(list_sum(list_transform(list_zip(v, c), lambda p: p[1] * p[2])) AS BIGINT) / sqrt(CAST(list_sum(list_transform(v, lambda x: x * x)) AS DOUBLE)) / sqrt(CAST(list_sum(list_transform(c, lambda x: x * x)) AS DOUBLE)) * 1e6 + 0.5e0) AS BIGINT) AS score FROM v, c)
SELECT vec_id, arg_max(label, struct_pack(a := score, b := -label)) AS label, max(score) AS score FROM s GROUP BY 1"""

QUERIES = {
    "asset_plan": (asset_plan, f"WITH {_PLAN} SELECT * FROM pl"),
    "delivery_rows": (delivery_rows, _delivery_sql()),
    "benchmark_inputs": (benchmark_inputs, f"WITH {FEED_SQL} SELECT 'gold' AS source, {', '.join(FIELDS)} FROM feed WHERE row_index % 7 = 0 UNION ALL SELECT 'corpus', {', '.join(FIELDS)} FROM feed WHERE lower(trim(Mfg_Part_Num)) NOT IN (SELECT lower(trim(Mfg_Part_Num)) FROM feed WHERE row_index % 7 = 0)"),
    "evaluation_fields": (evaluation_fields, f"WITH {_EVAL} SELECT * FROM fm"),
    "quality_ratios": (quality_ratios, f"WITH {REVIEWED}, {_QUALITY} SELECT * FROM rq"),
    "evaluation_overall": (
        evaluation_overall,
        f"""WITH {_EVAL}, {_QUALITY}, mq AS (SELECT coalesce(sum(correct) FILTER (WHERE kind = 'exact') / CAST(sum(comparable) FILTER (WHERE kind = 'exact') AS DOUBLE), 0e0) AS micro, coalesce(avg(correct / CAST(comparable AS DOUBLE)) FILTER (WHERE kind = 'exact' AND comparable > 0), 0e0) AS macro,
        coalesce(avg(similarity / 1e6 / comparable) FILTER (WHERE kind = 'semantic' AND comparable > 0), 0e0) AS semantic FROM fm)
        SELECT {round_half_up("micro", 4)} AS micro, {round_half_up("macro", 4)} AS macro, {round_half_up("semantic", 4)} AS semantic,
               {round_half_up("0.3e0 * micro + 0.15e0 * semantic + 0.15e0 * lov_compliance + 0.1e0 * char_compliance + 0.15e0 * validation_pass_rate + 0.15e0", 4)} AS overall FROM mq, rq""",
    ),
    "profile_warnings": (profile_warnings, _WARN),
    "fuzzy_names": (fuzzy_names, None),
    "collection_stats": (
        collection_stats,
        f"WITH {ROWS}, n AS (SELECT 'manufacturer_brand' AS collection, (SELECT count(*) FROM mf) + (SELECT count(*) FROM bm) AS n UNION ALL SELECT 'lov', {_N_LOV} UNION ALL SELECT 'uom', {len(UNITS)} UNION ALL SELECT unnest(['fittings', 'faucets', 'guidelines', 'examples']), 0) SELECT * FROM n",
    ),
    "hybrid_search": (hybrid_search, _HYBRID),
    "lov_rescue": (lov_rescue, None),
    "nearest_centre": (nearest_centre, _CENTRE),
}
