"""Queries over the product record, with SQL that derives it another way: joins of rows
with slots and phrases where the engine works on arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import packs
from ..functions.measures import ALIASES, UNITS
from ..operators import mentions as named
from ..operators import product, resolve
from ..operators.feed import feed
from ..storage import settled
from .scalars import fraction_sql
from .sqltext import ROWS, clean, match_key, quoted, round_half_up, title_sql, trimmed

PACK = packs.OWN


def _rows(spark, d):
    return settled(resolve.mentions(feed(spark, d)), "feed")


def _record(spark, d):
    return product.enriched(feed(spark, d))


def _upto(spark, d, *stages):
    return product.enriched(feed(spark, d), stages=("inference", *stages))


def enriched_feed(spark, d):
    """The whole enrichment: brand, manufacturer, leaf, confidence, flags, status."""
    flags = F.array_join(F.transform("flags", lambda f: F.concat(f["reason"], F.lit("@"), f["field"])), "; ")
    return _record(spark, d).select("row_index", "brand", "brand_method", "manufacturer", "leaf", "confidence", "band", "n_errors", "n_warnings", flags.alias("flags"), "status")


def lexicon_mentions(spark, d):
    rows = feed(spark, d).select("row_index", "Part_Desc")
    return named.mentions(rows, packs.aliases(spark)).select("row_index", F.explode("mentions").alias("m")).select("row_index", "m.canonical", "m.alias", F.col("m.start").cast("long").alias("start"), "m.confidence")


def brand_sources(spark, d):
    """Which step of the cascade gave each row its brand, and the manufacturer of record."""
    return product.resolved(_rows(spark, d)).select("row_index", "brand", "brand_method", "brand_confidence", "manufacturer", "manufacturer_method", "manufacturer_confidence")


def widened_fan_out(spark, d):
    return product.widened_fan_out(_rows(spark, d))


def leaf_candidates(spark, d):
    """Leaves by phrases and words, the best five, with what matched."""
    p = settled(product.classified(product.resolved(_rows(spark, d))), "classified")
    return p.select("row_index", F.posexplode("candidates").alias("nth", "c")).select("row_index", (F.col("nth") + 1).alias("rank"), "c.leaf", "c.score", F.col("c.why").alias("why"))


def scoped_prefix_infer(spark, d):
    p = settled(product.classified(product.resolved(_rows(spark, d))), "classified")
    return product.inferred(p).where("brand_method = 'mpn_prefix_inference'").select("row_index", "brand", "brand_confidence")


def attr_extract(spark, d):
    one = _upto(spark, d, "extraction").select("row_index", "leaf", F.explode("attributes").alias("a"))
    return one.select("row_index", "leaf", "a.pos", "a.label", "a.value", "a.uom", "a.method", "a.confidence", "a.approved")


def attr_extract_once(spark, d):
    """The feed and a copy of it, each leaf and description read once for all rows that have it."""
    p = _upto(spark, d, "inference")
    p = p.unionByName(p.withColumn("row_index", F.col("row_index") + 10_000_000))
    one = product.extracted_once(p, PACK).select("row_index", "leaf", F.explode("attributes").alias("a"))
    return one.select("row_index", "leaf", "a.pos", "a.label", "a.value", "a.uom", "a.method", "a.confidence", "a.approved")


def attr_slots(spark, d):
    """Attributes spread over numbered columns by position; labels stay where values are blank."""
    p = _upto(spark, d, "extraction")
    a = lambda i, part: F.coalesce(F.get("attributes", F.lit(i - 1))[part], F.lit("")).alias(f"ATTRIBUTE_{part.upper()}_{i}")
    return p.select("row_index", *[a(i, part) for i in range(1, 7) for part in ("label", "value", "uom")])


def descriptions(spark, d):
    return _upto(spark, d, "extraction", "descriptions").select("row_index", "descriptions.*", "with_clause", "description_confidence")


def validate_issues(spark, d):
    """Issues that are left after the repairs."""
    p = _upto(spark, d, "extraction", "descriptions", "validation")
    return p.select("row_index", F.explode("issues").alias("i")).select("row_index", "i.*")


def repair_passes(spark, d):
    """What the first check found, what was repaired, and how often a product was checked."""
    p = _upto(spark, d, "extraction", "descriptions", "validation")
    n = F.size(F.filter("first_issues", lambda i: i["severity"] == "error"))
    return p.select("row_index", n.alias("first_errors"), F.array_join("repairs", "; ").alias("repairs"), F.size(product.errors()).alias("errors"), "passes", "checks_run")


def score_parts(spark, d):
    return _record(spark, d).select("row_index", "parts.*", "confidence", "band")


def review_flags(spark, d):
    return _record(spark, d).select("row_index", F.explode("flags").alias("f")).select("row_index", "f.reason", "f.field")


def review_queue(spark, d):
    """Flagged products with the evidence for the field in question."""
    p = _record(spark, d).where("size(flags) > 0").select("row_index", "brand_method", "manufacturer_method", "leaf", F.explode("flags").alias("f"))
    of = F.when(F.col("f.field") == "BRAND_NAME", F.col("brand_method")).when(F.col("f.field") == "MANUFACTURER_NAME", F.col("manufacturer_method")).when(F.col("f.field") == "Classpath", F.col("leaf"))
    return p.select("row_index", "f.reason", "f.field", of.alias("evidence"))


def status_counts(spark, d):
    return _record(spark, d).groupBy("status", "band").agg(F.count("*").alias("n"))


def run_stats(spark, d):
    return product.with_run_stats(_record(spark, d))


def flag_reasons(spark, d):
    """The commonest reasons of flags, twelve at most."""
    by = _record(spark, d).select(F.explode("flags").alias("f")).groupBy("f.reason").agg(F.count("*").alias("n"))
    return by.orderBy(F.col("n").desc(), "reason").limit(12)


def scale_report(spark, d):
    c = F.floor(F.col("confidence") * 10000 + 0.5).cast("long")
    slots = F.sum(F.size("attributes"))
    return _record(spark, d).agg(F.count("*").alias("n"), F.sum(c).alias("points"), F.percentile(c, F.lit(0.5)).alias("median_points"), F.count_if(F.col("status") == "SUCCESS").alias("n_success"), slots.alias("slots"), F.sum(F.size(product.present())).alias("filled"))


def products_page(spark, d):
    """Products in review whose part number, description or brand hold a text, a page of them."""
    told = F.lower(F.concat_ws(" ", "Mfg_Part_Num", "Part_Desc", "brand"))
    p = _record(spark, d).where((F.col("status") == "NEEDS_REVIEW") & F.contains(told, F.lit("bolt")))
    return p.orderBy("row_index").offset(5).limit(20).select("row_index", "leaf", "brand", "status")


def review_override(spark, d):
    """The newest decision on a row clears its brand flags; it succeeds if none is left and
    nothing is wrong with it.  Decisions are derived from the events."""
    events = spark.read.parquet(f"{d}/events.parquet").where("event_type IN ('signup', 'error')")
    decided = product.newest(events, "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("u"), F.col("event_type").alias("decision"))
    p = _record(spark, d).join(decided, F.col("row_index") == F.col("u"), "left")
    left = F.filter("flags", lambda f: ~((f["field"] == "BRAND_NAME") & F.col("decision").isNotNull()))
    status = F.when(F.col("decision").isNotNull() & (F.size(left) == 0) & (F.col("n_errors") == 0), "SUCCESS").otherwise(F.col("status"))
    return p.select("row_index", "decision", status.alias("status"), F.size(left).alias("n_flags"))


def parsed_products(spark, d):
    p = _upto(spark, d, "parsing")
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return p.select("row_index", "product_type", "series", joined("dimensions"), joined("specs"), joined("materials"), joined("features"), "residual", "parse_confidence", "thin")


def evidence_nodes(spark, d):
    """Nodes of each product's evidence: the product, its fields, its attributes."""
    p = _upto(spark, d, "extraction")
    product_node = F.concat(F.lit("product:"), F.col("row_index").cast("string"))
    own = p.select(product_node.alias("node"), F.lit("product").alias("kind"))
    fields = p.select(F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("v")), F.struct(F.lit("manufacturer").alias("kind"), F.col("manufacturer").alias("v")), F.struct(F.lit("leaf").alias("kind"), F.col("leaf").alias("v")))).alias("x"))
    fields = fields.where("x.v IS NOT NULL").select(F.concat_ws(":", "x.kind", "x.v").alias("node"), "x.kind")
    attributes = p.select(F.explode(product.present()).alias("a")).select(F.concat_ws(":", F.lit("attribute"), "a.label", "a.value").alias("node"), F.lit("attribute").alias("kind"))
    return own.unionByName(fields).unionByName(attributes).distinct()


# --- the SQL -----------------------------------------------------------------------


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
        return quoted(v) if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def short_sql(c: str) -> str:
    out = trimmed(c)
    for phrase in sorted(PACK.abbreviations, key=len, reverse=True):
        # a boundary is put back, so neighbours can share it after a second pass
        one = f"'(?i)(^|[^A-Za-z0-9]){phrase}([^A-Za-z0-9]|$)', '\\1{PACK.abbreviations[phrase]}\\2', 'g'"
        out = f"regexp_replace(regexp_replace({out}, {one}), {one})"
    return trimmed(out)


_ALIAS = [(c, a, nth, req, rej) for c, a, _, nth, req, rej, _ in packs.alias_rows(PACK)]
_T = clean("r.Part_Desc")
MENTIONS = f"""{_values("al", "canonical, alias, nth, req, rej", _ALIAS)},
ax AS (SELECT row_index, {{text}} AS t FROM {{rows}} r),
mc0 AS (SELECT row_index, canonical, alias, nth, req, rej, t, unnest(range(0, length(t) - length(alias) + 1)) AS start FROM ax, al WHERE length(t) >= length(alias)),
mc1 AS (SELECT *, start + length(alias) AS stop, lower(regexp_extract(ltrim(substr(t, CAST(start + length(alias) + 1 AS INTEGER), 40), ' -,/'), '^([A-Za-z]+)', 1)) AS follows FROM mc0
        WHERE lower(substr(t, CAST(start + 1 AS INTEGER), length(alias))) = alias AND (start = 0 OR NOT regexp_matches(substr(t, CAST(start AS INTEGER), 1), '[A-Za-z0-9]'))
          AND NOT regexp_matches(substr(t, CAST(start + length(alias) + 1 AS INTEGER), 1), '[A-Za-z0-9]')),
mc AS (SELECT row_index, struct_pack(nth := nth, s := start, e := stop, c := canonical, a := alias) AS m FROM mc1
       WHERE CASE WHEN len(req) > 0 THEN list_contains(req, follows) ELSE NOT (follows <> '' AND list_contains(rej, follows)) END),
ml AS (SELECT row_index, list(struct_pack(m := m, taken := [m][2:1]) ORDER BY m.nth, m.s) AS found FROM mc GROUP BY 1),
mt AS (SELECT row_index, unnest(list_reduce(list_prepend(struct_pack(m := found[1].m, taken := [found[1].m][2:1]), found),
         lambda acc, x: struct_pack(m := acc.m, taken := CASE WHEN len(list_filter(acc.taken, lambda y: x.m.e > y.s AND x.m.s < y.e)) = 0 THEN list_append(acc.taken, x.m) ELSE acc.taken END)).taken) AS m FROM ml),
mm AS (SELECT row_index, m.c AS canonical, m.a AS alias, m.s AS start, CASE WHEN length(m.a) >= 4 THEN 0.9e0 ELSE 0.75e0 END AS confidence FROM mt),
mb AS (SELECT row_index, arg_min(canonical, struct_pack(a := -confidence, b := start)) AS mentioned FROM mm GROUP BY 1)"""
_MENTIONS = MENTIONS.format(text="r.Part_Desc", rows="rws")
_CLEAN_MENTIONS = MENTIONS.format(text=_T, rows="rws")

RESOLVED = f"""{ROWS}, {_CLEAN_MENTIONS},
rz0 AS (SELECT r.row_index, {clean("r.Mfg_Part_Num")} AS mpn, {_T} AS t, rs.manufacturer AS supplied, rs.confidence AS sconf, mk.name AS maker, mk.supplier_key AS maker_key, mk.distributor AS dist,
               rb.brand AS told, rb.method AS told_method, rb.confidence AS told_conf, CASE WHEN rb.brand IS NULL THEN mentioned END AS mentioned
        FROM rws r JOIN rs USING (row_index) JOIN rb USING (row_index) LEFT JOIN mb USING (row_index) LEFT JOIN mf mk ON mk.supplier_key = {match_key("rs.manufacturer")}),
rz1 AS (SELECT *, coalesce({match_key("coalesce(told, mentioned)")}, CASE WHEN NOT dist THEN maker_key END) AS asked_key FROM rz0),
rz2 AS (SELECT z.*, bm.name AS known, o.name AS owner, o.distributor AS odist FROM rz1 z LEFT JOIN bm ON bm.brand_key = asked_key LEFT JOIN ow o ON o.brand_key = asked_key AND o.rank = 1),
rz3 AS (SELECT *, coalesce(told, mentioned, known) AS brand,
               CASE WHEN told IS NOT NULL THEN told_method WHEN mentioned IS NOT NULL THEN 'description_mention' WHEN known IS NOT NULL THEN 'supplier_is_brand' ELSE 'unresolved' END AS bmethod,
               CASE WHEN told IS NOT NULL THEN told_conf WHEN mentioned IS NOT NULL THEN CASE WHEN known IS NOT NULL THEN 0.8e0 ELSE 0.68e0 END WHEN known IS NOT NULL THEN 0.72e0 ELSE 0e0 END AS bconf FROM rz2),
rz4 AS (SELECT *, CASE WHEN brand IS NOT NULL AND owner IS NOT NULL AND NOT odist THEN 'brand_owner' WHEN maker IS NOT NULL AND NOT dist THEN 'supplier_direct'
                       WHEN maker IS NOT NULL THEN 'distributor_only' ELSE 'unresolved' END AS mmethod FROM rz3),
rz AS (SELECT *, CASE mmethod WHEN 'brand_owner' THEN owner WHEN 'supplier_direct' THEN maker END AS manufacturer,
              {round_half_up("CASE mmethod WHEN 'brand_owner' THEN least(0.95e0, bconf + 0.05e0) WHEN 'supplier_direct' THEN sconf * 0.95e0 ELSE 0e0 END", 4)} AS mconf FROM rz4)"""

# The keywords in the SQL's own words: leaf, then keyword and weight (10 strong, 4 the product's name, 3 weak, 0 excluding).
_WORDS = {
    "fasteners": [("bolt", 10), ("Bolt", 4), ("rod", 3), ("steel", 3)],
    "gears": [("gear", 10), ("Gear", 4), ("large", 3), ("heavy duty", 3)],
    "rings": [("ring", 10), ("Ring", 4), ("small", 3)],
    "plates": [("plate", 10), ("Plate", 4), ("steel", 3), ("stainless steel", 3)],
    "anvils": [("anvil", 10), ("Anvil", 4), ("old", 3)],
    "gadgets": [("widget", 10), ("Multi-Purpose Widget", 4), ("gizmo", 3), ("hot", 0)],
}
_KH = " UNION ALL ".join(
    f"SELECT row_index, '{leaf}' AS leaf, '{k}' AS keyword, {w}e0 AS weight FROM rz WHERE regexp_matches(t, '(?i)(^|[^A-Za-z0-9])" + k.replace(" ", "[ \\t/-]*") + "([^A-Za-z0-9]|$)')"
    for leaf, words in _WORDS.items()
    for k, w in words
)
CLASSED = f"""{RESOLVED},
kh AS (SELECT row_index, leaf, sum(weight) + 0.5e0 * (count(*) - 1) AS score, min(weight) AS least, string_agg(keyword, ', ' ORDER BY keyword) AS matched FROM ({_KH}) GROUP BY 1, 2),
kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_index ORDER BY score DESC, leaf) AS INTEGER) AS rank FROM kh WHERE least > 0),
k2 AS (SELECT row_index, max(leaf) FILTER (WHERE rank = 1) AS leaf, max(score) FILTER (WHERE rank = 1) AS score, coalesce(max(score) FILTER (WHERE rank = 2), 0e0) AS second FROM kr GROUP BY 1),
k3 AS (SELECT *, second / score AS ratio, least(0.97e0, 0.55e0 * least(1e0, score / 16e0) + 0.45e0 * (0.35e0 + 0.65e0 * (1e0 - second / score))) AS sure FROM k2),
cz AS (SELECT rz.*, coalesce(leaf, '{packs.FALLBACK}') AS leaf, coalesce(ratio >= 0.8e0, false) AS close,
              coalesce({round_half_up("CASE WHEN ratio >= 0.8e0 THEN least(0.55e0, sure) ELSE sure END", 4)}, 0e0) AS lconf FROM rz LEFT JOIN k3 USING (row_index))"""

_PREFIXES = " UNION ALL ".join(f"SELECT row_index, upper(substr(mpn, 1, {n})) AS prefix, {n} AS n FROM cz WHERE length(mpn) >= {n} AND regexp_matches(substr(mpn, 1, {n}), '^[A-Za-z]+$')" for n in (3, 4, 5))
INFERRED = f"""{CLASSED},
px AS ({_PREFIXES}),
pr AS (SELECT prefix, min(brand) AS learned, count(*) AS support, list(DISTINCT leaf) AS leaves, list(DISTINCT supplied) FILTER (WHERE supplied IS NOT NULL) AS suppliers
       FROM px JOIN cz USING (row_index) WHERE bconf >= 0.65e0 AND brand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT brand) = 1 AND count(*) >= 2),
pi AS (SELECT row_index, max(n) AS n FROM px JOIN cz USING (row_index) JOIN pr USING (prefix)
       WHERE brand IS NULL AND (list_contains(leaves, leaf) OR coalesce(list_contains(suppliers, supplied), false)) GROUP BY 1),
pj AS (SELECT row_index, learned, {round_half_up("least(0.55e0, 0.3e0 + 0.06e0 * support + 0.03e0 * n)", 4)} AS pconf FROM pi JOIN px USING (row_index, n) JOIN pr USING (prefix)),
iz AS (SELECT cz.* EXCLUDE (brand, bmethod, bconf), coalesce(brand, learned) AS brand, CASE WHEN learned IS NOT NULL THEN 'mpn_prefix_inference' ELSE bmethod END AS bmethod,
              CASE WHEN learned IS NOT NULL THEN pconf ELSE bconf END AS bconf FROM cz LEFT JOIN pj USING (row_index))"""

_SLOTS = [(leaf, pos, label, uom, render, rx[0][0] if rx else "", scan, at, has) for leaf, pos, label, uom, render, rx, scan, at, has in packs.attribute_rows(PACK)]
_SURFACES = [(leaf, pos, value, kind, nth, "(?i)" + packs.bounded(surface)) for leaf, pos, _, value, surface, kind, nth in packs.surface_rows(PACK)]
_SPLIT = quoted(product.SPLIT)
_LIT = quoted(product.SERIES)
_UNIT = "CASE WHEN x IN (" + ", ".join(map(quoted, UNITS)) + ") THEN x ELSE MAP {" + ", ".join(f"{quoted(a)}: {quoted(u)}" for a, u in ALIASES.items()) + "}[trim(regexp_replace(replace(lower(trim(x)), '°', 'deg '), '[\\s._]+', ' ', 'g'))] END"
_CHAINED = quoted(product.CHAIN)
_SH = " UNION ALL ".join(f"SELECT row_index, {pos} AS pos, {quoted(v)} AS svalue, {quoted(kind)} AS kind, {nth} AS snth FROM iz WHERE leaf = {quoted(leaf)} AND regexp_matches(t, {quoted(rx)})" for leaf, pos, v, kind, nth, rx in _SURFACES)
_BY_PATTERN = "CASE pattern " + " ".join(f"WHEN {quoted(rx)} THEN nullif(regexp_extract(t, {quoted(rx)}, 1), '')" for rx in sorted({x[5] for x in _SLOTS} - {""})) + " END"
_BY_SCAN = "CASE scan " + " ".join(f"WHEN {quoted(rx)} THEN nullif(regexp_extract(t, {quoted(rx)}, 2), '')" for rx in sorted({x[6] for x in _SLOTS} - {""})) + " END"
EXTRACTED = f"""{INFERRED}, {_values("sl", "leaf, pos, label, uom, render, pattern, scan, chain_at, listed", _SLOTS)},
{_values("sf", "leaf, pos, svalue", sorted({x[:3] for x in _SURFACES}))},
ch AS (SELECT row_index, [regexp_replace(regexp_extract(t, {_CHAINED}, 1), '\\s+', '', 'g'), regexp_replace(regexp_extract(t, {_CHAINED}, 2), '\\s+', '', 'g'), regexp_replace(regexp_extract(t, {_CHAINED}, 3), '\\s+', '', 'g')] AS chain,
              regexp_extract(t, {_LIT}, 1) AS sname FROM iz),
sh AS (SELECT row_index, pos, arg_min(svalue, snth) AS lov, arg_min(kind, snth) AS lkind FROM ({_SH}) GROUP BY 1, 2),
e0 AS (SELECT iz.row_index, iz.leaf, mpn, sl.* EXCLUDE (leaf), lov, lkind, sname, {_BY_PATTERN} AS byrx, nullif(chain[chain_at + 1], '') AS bychain,
              {_BY_SCAN} AS byscan
       FROM iz JOIN sl USING (leaf) JOIN ch USING (row_index) LEFT JOIN sh USING (row_index, pos)),
e1 AS (SELECT *, trim(coalesce(lov, byrx, bychain, byscan)) AS hit, CASE WHEN lov IS NOT NULL THEN lkind WHEN byrx IS NOT NULL THEN 'regex' WHEN bychain IS NOT NULL THEN 'dimension_chain' WHEN byscan IS NOT NULL THEN 'uom_scan' END AS how FROM e0),
e2 AS (SELECT *, CASE WHEN lov IS NOT NULL OR hit IS NULL THEN hit ELSE regexp_replace(CASE WHEN regexp_extract(hit, {_SPLIT}, 1) = '' THEN hit ELSE regexp_replace(regexp_extract(hit, {_SPLIT}, 1), '\\s*/\\s*', '/', 'g') END, '^\\.([0-9]+)$', '0.\\1') END AS tidy,
              CASE WHEN lov IS NULL AND hit IS NOT NULL THEN CASE WHEN uom <> '' THEN uom ELSE nullif(trim(regexp_extract(hit, {_SPLIT}, 2)), '') END END AS x FROM e1),
e3 AS (SELECT *, CASE WHEN lov IS NULL AND regexp_matches(tidy, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST(tidy AS DOUBLE) END AS number, {_UNIT} AS unit FROM e2),
e4 AS (SELECT *, CASE WHEN number IS NOT NULL THEN coalesce({fraction_sql("number")}, tidy) WHEN lov IS NULL AND regexp_matches(tidy, '^(?:[0-9]+[- ]+)?[0-9]+/[1-9][0-9]*$') THEN regexp_replace(tidy, '^([0-9]+)[- ]+([0-9])', '\\1-\\2') ELSE tidy END AS own,
              CASE WHEN lower(label) = 'model' THEN mpn WHEN lower(label) = 'series' AND sname <> '' THEN {title_sql(trimmed("sname"))} || ' Series' END AS restated FROM e3),
ez AS (SELECT row_index, leaf, CAST(pos AS INTEGER) AS pos, label, render, coalesce(own, restated) AS value, CASE WHEN own IS NOT NULL THEN unit END AS uom,
              CASE WHEN own IS NOT NULL THEN how WHEN restated IS NOT NULL THEN CASE lower(label) WHEN 'model' THEN 'input_restatement' ELSE 'regex' END ELSE 'not_found' END AS method,
              CASE WHEN own IS NOT NULL THEN CASE how WHEN 'lov_exact' THEN 0.96e0 WHEN 'lov_synonym' THEN 0.94e0 WHEN 'regex' THEN 0.88e0 WHEN 'dimension_chain' THEN 0.82e0 ELSE 0.8e0 END
                   WHEN restated IS NOT NULL THEN CASE lower(label) WHEN 'model' THEN 0.95e0 ELSE 0.9e0 END ELSE 0e0 END AS confidence,
              CASE WHEN own IS NOT NULL AND listed THEN EXISTS (SELECT 1 FROM sf WHERE sf.leaf = e4.leaf AND sf.pos = e4.pos AND lower(svalue) = lower(own)) END AS approved FROM e4)"""

_LEAVES = [(x.id, x.classpath or None, x.name) for x in PACK.leaves]
_SHORTS = [(x.id, i, label) for x in PACK.leaves for i, label in enumerate(x.short, 1)]
_INVOICES = [(x.id, i, label) for x in PACK.leaves for i, label in enumerate(x.invoice or [a.label for a in x.attributes], 1)]
_RENDERED = trimmed("replace(replace(replace(render, '{value}', value), '{uom}', coalesce(uom, '')), '{label}', label)")
_NOUN = "trim(replace(replace(render, '{value} ', ''), '{uom}', ''))"
_SYMBOL = "CASE " + " ".join(f"WHEN brand = {quoted(b.canonical)} THEN {quoted(b.symbol)}" for b in PACK.brands if b.symbol) + " ELSE '' END"


def _fold(start: str, parts: str, limit: int, sep: str, skips: bool) -> str:
    longer = f"(s.text || '{sep}' || p.text)"
    said = f"(p.text = '' OR ({start if skips else 's.text'} <> '' AND contains(lower(trim({start if skips else 's.text'})), lower(trim(p.text)))))"
    fits = f"(NOT {said} AND NOT s.gone AND length({longer}) <= {limit})"
    gone = "false" if skips else f"(s.gone OR (NOT {said} AND NOT {fits}))"
    states = f"list_prepend(struct_pack(text := {start}, gone := false), list_transform({parts}, lambda q: struct_pack(text := q, gone := false)))"
    return trimmed(f"list_reduce({states}, lambda s, p: struct_pack(text := CASE WHEN {fits} THEN {longer} ELSE s.text END, gone := {gone})).text")


def _joined(head: str, parts: str) -> str:
    return trimmed(f"array_to_string(list_prepend({head}, list_filter({parts}, lambda x: x <> '' AND NOT contains(lower(trim({head})), lower(trim(x))))), ', ')")


DESCRIBED = f"""{EXTRACTED}, {_values("lv", "leaf, classpath, name", _LEAVES)}, {_values("ss", "leaf, nth, label", _SHORTS)}, {_values("iv", "leaf, nth, label", _INVOICES)},
ep AS (SELECT *, {_RENDERED} AS said, CASE WHEN regexp_matches(value, '^[0-9]+$') AND contains(render, '{{value}} ') AND {_NOUN} <> '' AND NOT contains({_NOUN}, '{{') AND uom IS NULL
                    THEN value || '-' || trim(regexp_replace({_NOUN}, 's\\b', '', 'g')) ELSE {_RENDERED} END AS brief,
              upper(CASE WHEN uom IS NOT NULL THEN value || replace(upper(uom), ' ', '') ELSE {short_sql("value")} END) AS tight FROM ez WHERE value IS NOT NULL AND trim(value) <> ''),
d0 AS (SELECT row_index, list(said ORDER BY pos) FILTER (WHERE lower(label) NOT IN ('model', 'additional information')) AS longs, sum(CAST(floor(confidence * 100 + 0.5e0) AS BIGINT)) / 100e0 / count(*) AS mean,
              max(value) FILTER (WHERE lower(label) = 'series') AS series FROM ep GROUP BY 1),
d1 AS (SELECT row_index, list(brief ORDER BY nth) AS briefs, list(said ORDER BY nth) AS saids FROM ep JOIN ss USING (leaf, label) GROUP BY 1),
d2 AS (SELECT row_index, list(tight ORDER BY nth) AS tights FROM ep JOIN iv USING (leaf, label) GROUP BY 1),
d3 AS (SELECT iz.*, lv.name, lv.classpath, coalesce(longs, []::VARCHAR[]) AS longs, coalesce(briefs, []::VARCHAR[]) AS briefs, coalesce(saids, []::VARCHAR[]) AS saids, coalesce(tights, []::VARCHAR[]) AS tights,
              coalesce(mean, 0e0) AS mean, series, brand || {_SYMBOL} AS shown, {trimmed("regexp_extract(t, '(?i)(?:^|[^A-Za-z0-9])w/\\s*(.+)$', 1)")} AS w0
       FROM iz JOIN lv USING (leaf) LEFT JOIN d0 USING (row_index) LEFT JOIN d1 USING (row_index) LEFT JOIN d2 USING (row_index)),
d4 AS (SELECT *, trim(w0, ' -,') AS w1, trim(regexp_replace(coalesce(shown, ''), '[®™©]', '', 'g')) AS plain, trim(coalesce(manufacturer, '')) AS mkr FROM d3),
d5 AS (SELECT *, CASE WHEN length(w1) >= 3 THEN 'With ' || {title_sql("w1")} END AS with_clause,
              CASE WHEN plain <> '' AND mkr <> '' AND contains(lower(mkr), lower(plain)) THEN plain ELSE {trimmed("concat_ws(' ', mkr, plain)")} END AS lead FROM d4),
d6 AS (SELECT *, {trimmed("concat_ws(' ', shown, series, mpn, name, with_clause)")} AS shead, {trimmed("concat_ws(' ', series, name)")} AS rhead, concat_ws(' ', shown, name, with_clause) AS lhead,
              array_to_string(list_filter([lead, name, series, mpn], lambda x: x <> ''), ', ') AS mhead, upper({short_sql("name")}) AS ihead FROM d5),
dz AS (SELECT *, {_fold("mhead", "saids", 80, ", ", False)} AS MOBILE_DESC, {_fold("ihead", "tights", 40, " ", True)} AS INVOICE_DESC, {_joined("shead", "briefs")} AS SHORT_DESC,
              {_joined("lhead", "longs")} AS LONG_DESC1, {_joined("rhead", "briefs")} AS RETAIL_DESC,
              {round_half_up("greatest(0e0, least(1e0, 0.65e0 * mean + 0.35e0 * (1e0 - CASE WHEN brand IS NULL THEN 0.25e0 ELSE 0e0 END - CASE WHEN name = '' THEN 0.35e0 ELSE 0e0 END)))", 4)} AS description_confidence FROM d6)"""

_FIELDS = {"MOBILE_DESC": "MOBILE_DESC", "INVOICE_DESC": "INVOICE_DESC", "SHORT_DESC": "SHORT_DESC", "LONG_DESC1": "LONG_DESC1", "RETAIL_DESC": "RETAIL_DESC"}
_SHOWN = _FIELDS | {"Product Name": "name", "MANUFACTURER_NAME": "manufacturer", "BRAND_NAME": "brand"}
_BAD = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted('(?i)' + rx)}) THEN '{code}'" for rx, code in product.FORBIDDEN) + " " + " ".join(f"WHEN regexp_matches(trim({c}), {quoted(f'(?i)^(?:{rx})$')}) THEN '{code}'" for rx, code in product.FORBIDDEN_WHOLE) + " END"


def _checks(name: str, attributes: str) -> str:
    """Issues of the products in dz with the attributes of a table."""
    parts = [f"SELECT row_index, '{f}' AS field, 'error' AS severity, 'char_limit_exceeded' AS code FROM dz WHERE length({c}) > {product.LIMITS[f]}" for f, c in _FIELDS.items()]
    parts += [f"SELECT row_index, '{f}', 'error', {_BAD(f'coalesce({c}, chr(32))')} FROM dz WHERE {_BAD(f'coalesce({c}, chr(32))')} IS NOT NULL" for f, c in _SHOWN.items()]
    parts.append(f"SELECT row_index, 'ATTRIBUTE:' || label, 'warning', 'uom_spacing' FROM {attributes} WHERE regexp_matches(value, '^[0-9]+(?:[-.][0-9]+(?:/[0-9]+)?)?[A-Za-z]{{1,4}}$')")
    parts.append(f"SELECT row_index, 'ATTRIBUTE:' || label, 'error', 'lov_violation' FROM {attributes} WHERE value IS NOT NULL AND NOT approved")
    required = {"MANUFACTURER_PART_NUMBER": "mpn", "Classpath": "classpath", "Product Name": "name", "SHORT_DESC": "SHORT_DESC"}
    parts += [f"SELECT row_index, '{f}', 'error', 'required_field_missing' FROM dz WHERE trim(coalesce({c}, '')) = ''" for f, c in required.items()]
    known = f"SELECT row_index, lower(value) AS k FROM {attributes} WHERE value IS NOT NULL" + "".join(f" UNION ALL SELECT row_index, lower({c}) FROM dz WHERE {c} IS NOT NULL" for c in ("brand", "mpn", "name", "with_clause"))
    parts.append(
        f"SELECT DISTINCT row_index, 'SHORT_DESC', 'warning', 'unverified_clause' FROM (SELECT row_index, unnest(string_split(SHORT_DESC, ',')[2:]) AS clause FROM dz) c "
        f"WHERE NOT EXISTS (SELECT 1 FROM ({known}) kn WHERE kn.row_index = c.row_index AND kn.k <> '' AND contains(lower(trim(c.clause)), kn.k))"
    )
    return f"{name} AS ({' UNION ALL '.join(parts)})"


CHECKED = f"""{DESCRIBED},
{_checks("i1", "ez")},
er AS (SELECT * REPLACE (CASE WHEN approved = false THEN NULL ELSE value END AS value, CASE WHEN approved = false THEN NULL ELSE uom END AS uom, CASE WHEN approved = false THEN 0e0 ELSE confidence END AS confidence,
              CASE WHEN approved = false THEN 'cleared_lov_violation' ELSE method END AS method, CASE WHEN approved = false THEN NULL ELSE approved END AS approved) FROM ez),
rp AS (SELECT row_index, string_agg(label || ': cleared unapproved value ''' || value || '''', '; ' ORDER BY pos) AS repairs FROM ez WHERE approved = false GROUP BY 1),
{_checks("i2", "er")}"""

SCORED = f"""{CHECKED},
ec AS (SELECT row_index, count(*) AS slots, count(value) AS n, sum(CASE WHEN value IS NOT NULL THEN CAST(floor(confidence * 100 + 0.5e0) AS BIGINT) ELSE 0 END) / 100e0 AS total, count(*) FILTER (WHERE value IS NOT NULL AND method LIKE 'lov%') AS lovs,
              count(approved) FILTER (WHERE value IS NOT NULL) AS judged, count(uom) FILTER (WHERE value IS NOT NULL) AS uoms FROM er GROUP BY 1),
ie AS (SELECT row_index, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
              count(*) FILTER (WHERE severity = 'error' AND field IN ({", ".join(map(quoted, _FIELDS))})) AS on_text FROM i2 GROUP BY 1),
s0 AS (SELECT dz.*, slots, n, lovs, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings,
              {round_half_up("CASE WHEN manufacturer IS NOT NULL THEN mconf ELSE 0e0 END", 6)} AS p_manufacturer, {round_half_up("CASE WHEN brand IS NOT NULL THEN bconf ELSE 0e0 END", 6)} AS p_brand,
              {round_half_up("CASE WHEN classpath IS NOT NULL THEN lconf ELSE 0e0 END", 6)} AS p_classification,
              {round_half_up("CASE WHEN n > 0 THEN total / n * (0.45e0 + 0.55e0 * (n / CAST(slots AS DOUBLE))) ELSE 0e0 END", 6)} AS p_attributes,
              {round_half_up("greatest(0e0, description_confidence - 0.25e0 * coalesce(on_text, 0))", 6)} AS p_descriptions,
              {round_half_up("((manufacturer IS NOT NULL)::INT + (brand IS NOT NULL AND bmethod <> 'mpn_prefix_inference')::INT + (classpath IS NOT NULL)::INT + lovs) / CAST((manufacturer IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (classpath IS NOT NULL)::INT + (mpn IS NOT NULL)::INT + n AS DOUBLE)", 6)} AS p_evidence
       FROM dz JOIN ec USING (row_index) LEFT JOIN ie USING (row_index)),
s1 AS (SELECT *, 0.22e0 * p_manufacturer + 0.15e0 * p_brand + 0.22e0 * p_classification + 0.24e0 * p_attributes + 0.1e0 * p_descriptions + 0.07e0 * p_evidence AS base FROM s0),
s2 AS (SELECT *, {round_half_up("greatest(0e0, least(1e0, CASE WHEN n_errors > 0 THEN least(base, 0.45e0) ELSE base END))", 4)} AS confidence FROM s1),
sz AS (SELECT *, CASE WHEN confidence >= 0.85e0 THEN 'HIGH' WHEN confidence >= 0.65e0 THEN 'MEDIUM' WHEN confidence >= 0.35e0 THEN 'LOW' ELSE 'UNKNOWN' END AS band FROM s2)"""


def _flag(nth: int, cond: str, reason: str, field: str, table: str = "sz") -> str:
    return f"SELECT row_index, {nth} AS nth, '{reason}' AS reason, {field} AS field FROM {table} WHERE {cond}"


_PAIRS = [("manufacturer", "mconf", "Manufacturer unresolved", "Manufacturer confidence below threshold", "MANUFACTURER_NAME"), ("brand", "bconf", "Brand unresolved", "Brand confidence below threshold", "BRAND_NAME"), ("classpath", "lconf", "Product could not be classified", "Classification confidence below threshold", "Classpath")]
_RULES = [_flag(0, "bmethod = 'mpn_prefix_inference'", "Brand inferred from part-number prefix", "'BRAND_NAME'")]
for _i, (_c, _v, _none, _low, _f) in enumerate(_PAIRS, 1):
    _RULES += [_flag(_i, f"{_c} IS NULL", _none, f"'{_f}'"), _flag(_i, f"{_c} IS NOT NULL AND {_v} < 0.6e0", _low, f"'{_f}'")]
_RULES += [
    _flag(4, "close", "Multiple taxonomy candidates scored similarly", "'Classpath'"),
    _flag(5, "n / CAST(slots AS DOUBLE) < 0.25e0", "Attribute coverage below threshold", "'__attributes__'"),
    _flag(6, "value IS NOT NULL AND approved = false", "Attribute value outside the controlled vocabulary", "'ATTRIBUTE:' || label", "er"),
    _flag(7, "severity = 'error'", "Validation error", "field", "(SELECT DISTINCT row_index, field, severity FROM i2)"),
    _flag(8, "coalesce(MOBILE_DESC, '') = '' AND coalesce(INVOICE_DESC, '') = '' AND coalesce(SHORT_DESC, '') = '' AND coalesce(LONG_DESC1, '') = '' AND coalesce(RETAIL_DESC, '') = ''", "No description could be generated", "'SHORT_DESC'"),
    _flag(9, "confidence < 0.62e0", "Product confidence below publication threshold", "''"),
]
REVIEWED = f"""{SCORED},
fl AS ({" UNION ALL ".join(_RULES)}),
fc AS (SELECT row_index, count(*) AS n_flags, string_agg(reason || '@' || field, '; ' ORDER BY nth, field) AS flags FROM fl GROUP BY 1),
vz AS (SELECT sz.*, coalesce(n_flags, 0) AS n_flags, coalesce(flags, '') AS flags, CASE WHEN n_errors > 0 OR n_flags > 0 THEN 'NEEDS_REVIEW' WHEN n_warnings > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM sz LEFT JOIN fc USING (row_index))"""

_RX = {k: quoted(v) for k, v in {"measure": product.ANY_MEASURE, "pack": product.PACK, "noise": product.NOISE}.items()}
_APART = "regexp_replace(regexp_replace({x}, '([0-9\"''])\\s*[xX]\\s*([0-9.])', '\\1 \\2', 'g'), '([0-9\"''])\\s*[xX]\\s*([0-9.])', '\\1 \\2', 'g')"
_BARE = lambda x: f"regexp_replace(regexp_replace(replace({_APART.format(x=x)}, ' ', '  '), {_RX['measure']}, ' ', 'g'), {_RX['pack']}, ' ', 'g')"
_HOUSE = f"CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN coalesce({fraction_sql('CAST(v AS DOUBLE)')}, v) ELSE regexp_replace(v, '^([0-9]+)[- ]+([0-9])', '\\1-\\2') END"
_KINDS = "MAP {" + ", ".join(f"{quoted(u)}: {quoted(k)}" for u, k in product.TYPES.items()) + "}"
_MATERIALS = ", ".join(f"CASE WHEN regexp_matches(body, {quoted(f'(?i)\\b(?:{rx})\\b')}) THEN {quoted(name)} END" for rx, name in product.MATERIALS)
PARSED = f"""{INFERRED},
b0 AS (SELECT row_index, CASE WHEN starts_with(lower(t), lower(mpn)) THEN ltrim(substr(t, CAST(length(mpn) + 1 AS INTEGER)), ' -,:') ELSE t END AS body FROM iz),
b1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, ' +[-–] +'), lambda x: trim(x)), lambda x: x <> '') AS segs, replace({_APART.format(x="body")}, ' ', '  ') AS wide FROM b0),
b2 AS (SELECT row_index, unnest(list_zip(regexp_extract_all(wide, {_RX["measure"]}, 1), regexp_extract_all(wide, {_RX["measure"]}, 2), range(1, 100)[:len(regexp_extract_all(wide, {_RX["measure"]}, 1))])) AS m FROM b1),
b3 AS (SELECT row_index, m[3] AS nth, regexp_replace(regexp_replace(m[1], '\\s+', '', 'g'), '^\\.([0-9]+)$', '0.\\1') AS v, m[2] AS x FROM b2),
b4 AS (SELECT row_index, nth, {_HOUSE} AS v, {_UNIT} AS u FROM b3),
b5 AS (SELECT *, {_KINDS}[u] AS kind FROM b4 WHERE u IS NOT NULL AND v IS NOT NULL),
b6 AS (SELECT row_index, string_agg('dim_' || k || ': ' || v || ' ' || u, '; ' ORDER BY nth) AS dimensions FROM (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY nth) AS k FROM b5 WHERE kind = 'Length') GROUP BY 1),
b7 AS (SELECT row_index, string_agg(kind || ': ' || v || ' ' || u, '; ' ORDER BY nth) AS specs FROM (SELECT *, row_number() OVER (PARTITION BY row_index, kind ORDER BY nth) AS k FROM b5 WHERE kind <> 'Length') WHERE k = 1 GROUP BY 1),
b8 AS (SELECT *, {trimmed(f"regexp_replace(regexp_replace({_BARE('coalesce(segs[1], body)')}, {_RX['noise']}, ' ', 'g'), '[^A-Za-z0-9_\\s/-]', ' ', 'g')")} AS head,
              list_filter(list_transform(segs[2:], lambda s: trim({trimmed(f"regexp_replace(s, {_RX['noise']}, '', 'g')")}, ' -,/')), lambda s: length(s) >= 3) AS kept, list_filter([{_MATERIALS}], lambda x: x IS NOT NULL) AS mats,
              regexp_extract(body, {_RX["pack"]}, 1) AS pack, {trimmed(_BARE("body"))} AS residual, regexp_extract(body, {_LIT}, 1) AS sname FROM b1),
b9 AS (SELECT *, list_filter(string_split(head, ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS ws, list_filter(kept, lambda s, i: list_position(list_transform(kept, lambda y: lower(y)), lower(s)) = i)[1:10] AS feats FROM b8),
ba AS (SELECT *, array_to_string(ws[greatest(1, len(ws) - 2):], ' ') AS words FROM b9),
bb AS (SELECT row_index, {title_sql("words")} AS product_type, CASE WHEN sname <> '' THEN {title_sql(trimmed("sname"))} || ' Series' END AS series, coalesce(dimensions, '') AS dimensions,
              concat_ws('; ', specs, CASE WHEN pack <> '' THEN 'Package Quantity: ' || pack END) AS specs, array_to_string(mats, '; ') AS materials, array_to_string(feats, '; ') AS features, residual
       FROM ba LEFT JOIN b6 USING (row_index) LEFT JOIN b7 USING (row_index)),
bz AS (SELECT *, (product_type <> '')::INT + (materials <> '')::INT + (dimensions <> '')::INT + (specs <> '')::INT AS signal FROM bb)"""

QUERIES = {
    "enriched_feed": (enriched_feed, f"WITH {REVIEWED} SELECT row_index, brand, bmethod AS brand_method, manufacturer, leaf, confidence, band, CAST(n_errors AS INTEGER) AS n_errors, CAST(n_warnings AS INTEGER) AS n_warnings, flags, status FROM vz"),
    "lexicon_mentions": (lexicon_mentions, f"WITH {ROWS}, {_MENTIONS} SELECT * FROM mm"),
    "brand_sources": (brand_sources, f"WITH {RESOLVED} SELECT row_index, brand, bmethod AS brand_method, bconf AS brand_confidence, manufacturer, mmethod AS manufacturer_method, mconf AS manufacturer_confidence FROM rz"),
    "widened_fan_out": (widened_fan_out, f"WITH {ROWS}, {_MENTIONS}, w AS (SELECT supplier_key, brand_key FROM br UNION ALL SELECT supplier_key, {match_key('mentioned')} FROM rws JOIN mb USING (row_index)) SELECT supplier_key, count(DISTINCT brand_key) AS fan_out, count(DISTINCT brand_key) >= 3 AS distributor FROM w WHERE supplier_key IS NOT NULL GROUP BY 1"),
    "leaf_candidates": (leaf_candidates, f"WITH {CLASSED} SELECT row_index, rank, leaf, score, 'matched: ' || matched AS why FROM kr WHERE rank <= 5"),
    "scoped_prefix_infer": (scoped_prefix_infer, f"WITH {INFERRED} SELECT row_index, brand, bconf AS brand_confidence FROM iz WHERE bmethod = 'mpn_prefix_inference'"),
    "attr_extract": (attr_extract, f"WITH {EXTRACTED} SELECT row_index, leaf, pos, label, value, uom, method, confidence, approved FROM ez"),
    "attr_extract_once": (attr_extract_once, f"WITH {EXTRACTED} SELECT row_index + k AS row_index, leaf, pos, label, value, uom, method, confidence, approved FROM ez, (VALUES (CAST(0 AS BIGINT)), (CAST(10000000 AS BIGINT))) v(k)"),
    "attr_slots_pivot": (attr_slots, f"WITH {EXTRACTED} SELECT row_index, " + ", ".join(f"coalesce(max(CASE WHEN pos = {i} THEN coalesce({part}, '') END), '') AS ATTRIBUTE_{part.upper()}_{i}" for i in range(1, 7) for part in ("label", "value", "uom")) + " FROM ez GROUP BY 1"),
    "descriptions": (descriptions, f"WITH {DESCRIBED} SELECT row_index, MOBILE_DESC, INVOICE_DESC, SHORT_DESC, LONG_DESC1, RETAIL_DESC, with_clause, description_confidence FROM dz"),
    "validate_issues": (validate_issues, f"WITH {CHECKED} SELECT * FROM i2"),
    "repair_passes": (
        repair_passes,
        f"""WITH {SCORED}, f AS (SELECT row_index, count(*) FILTER (WHERE severity = 'error') AS n FROM i1 GROUP BY 1)
        SELECT s.row_index, CAST(coalesce(f.n, 0) AS INTEGER) AS first_errors, coalesce(repairs, '') AS repairs, CAST(n_errors AS INTEGER) AS errors, CASE WHEN repairs IS NULL THEN 1 ELSE 2 END AS passes,
               CAST(2 + 5 + 8 + uoms + s.n + judged + 4 + 5 + (manufacturer IS NOT NULL)::INT + (brand IS NOT NULL)::INT + 1 AS INTEGER) AS checks_run
        FROM sz s JOIN ec USING (row_index) LEFT JOIN f USING (row_index) LEFT JOIN rp USING (row_index)""",
    ),
    "score_parts": (score_parts, f"WITH {SCORED} SELECT row_index, p_manufacturer AS manufacturer, p_brand AS brand, p_classification AS classification, p_attributes AS attributes, p_descriptions AS descriptions, p_evidence AS evidence, confidence, band FROM sz"),
    "review_flags": (review_flags, f"WITH {REVIEWED} SELECT row_index, reason, field FROM fl"),
    "review_queue": (review_queue, f"WITH {REVIEWED} SELECT row_index, reason, field, CASE field WHEN 'BRAND_NAME' THEN bmethod WHEN 'MANUFACTURER_NAME' THEN mmethod WHEN 'Classpath' THEN leaf END AS evidence FROM fl JOIN vz USING (row_index)"),
    "status_counts": (status_counts, f"WITH {REVIEWED} SELECT status, band, count(*) AS n FROM vz GROUP BY 1, 2"),
    "run_stats": (run_stats, f"WITH {REVIEWED} SELECT count(*) AS n_products, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("SUCCESS", "PARTIAL", "NEEDS_REVIEW", "FAILED")) + ", CAST(sum(n_errors) AS BIGINT) AS n_errors, CAST(sum(n_warnings) AS BIGINT) AS n_warnings, CAST(sum(floor(confidence * 10000 + 0.5e0)) AS BIGINT) AS points FROM vz"),
    "flag_reasons": (flag_reasons, f"WITH {REVIEWED} SELECT reason, count(*) AS n FROM fl GROUP BY 1 ORDER BY n DESC, reason LIMIT 12"),
    "scale_report": (scale_report, f"WITH {REVIEWED}, q AS (SELECT *, CAST(floor(confidence * 10000e0 + 0.5e0) AS BIGINT) AS p FROM vz) SELECT count(*) AS n, CAST(sum(p) AS BIGINT) AS points, quantile_cont(p, 0.5) AS median_points, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, CAST(sum(slots) AS BIGINT) AS slots, CAST(sum(q.n) AS BIGINT) AS filled FROM q"),
    "products_page": (products_page, f"WITH {REVIEWED} SELECT row_index, leaf, brand, status FROM vz WHERE status = 'NEEDS_REVIEW' AND contains(lower(concat_ws(' ', mpn, t, brand)), 'bolt') ORDER BY row_index LIMIT 20 OFFSET 5"),
    "review_override": (
        review_override,
        f"""WITH {REVIEWED}, dc AS (SELECT user_id AS u, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS decision FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1),
        lf AS (SELECT row_index, count(*) AS n FROM fl WHERE field <> 'BRAND_NAME' GROUP BY 1)
        SELECT row_index, decision, CASE WHEN decision IS NOT NULL AND coalesce(lf.n, 0) = 0 AND n_errors = 0 THEN 'SUCCESS' ELSE status END AS status,
               CAST(CASE WHEN decision IS NULL THEN n_flags ELSE coalesce(lf.n, 0) END AS INTEGER) AS n_flags FROM vz LEFT JOIN dc ON u = row_index LEFT JOIN lf USING (row_index)""",
    ),
    "parsed_products": (parsed_products, f"WITH {PARSED} SELECT * EXCLUDE (signal), least(0.9e0, {round_half_up('0.25e0 + 0.13e0 * (signal + (features <> %s%s)::INT)' % (chr(39), chr(39)), 4)}) AS parse_confidence, signal <= 1 AS thin FROM bz"),
    "evidence_nodes": (evidence_nodes, f"WITH {EXTRACTED} SELECT 'product:' || row_index AS node, 'product' AS kind FROM iz UNION SELECT 'brand:' || brand, 'brand' FROM iz WHERE brand IS NOT NULL UNION SELECT 'manufacturer:' || manufacturer, 'manufacturer' FROM iz WHERE manufacturer IS NOT NULL UNION SELECT 'leaf:' || leaf, 'leaf' FROM iz UNION SELECT 'attribute:' || label || ':' || value, 'attribute' FROM ez WHERE value IS NOT NULL AND trim(value) <> ''"),
}
