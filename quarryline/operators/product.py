"""The product record: every stage adds columns to one row per product.

``enriched`` runs the stages in order over a settled feed: resolve, parse, classify,
extract, describe, validate and repair, score, review.  Masters, learned prefixes and
the best leaf are joins; everything else is an expression on the row, so a product's
attributes, issues and flags are arrays on it and nothing is shuffled for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ANY_MEASURE, NUMBER, PACK, TYPES, UNITS, measure, to_fraction, typed_measures, unchained, unit
from ..functions.text import abbreviated, alpha_prefix, clean, match_key, redundant, round_half_up, segments, title_case, trimmed, truncated, with_clause, without_leading
from ..packs import FALLBACK, OWN, Pack, aliases, keywords, templates
from ..storage import settled
from . import resolve
from .mentions import best

# Weights, thresholds and confidences of scoring, review and extraction.
WEIGHTS = {"manufacturer": 0.22, "brand": 0.15, "classification": 0.22, "attributes": 0.24, "descriptions": 0.10, "evidence": 0.07}
SURE = 0.60  # manufacturer, brand and classification below it need review
PUBLISH, LEAST_COVERAGE, INVALID_CAP, CLOSE = 0.62, 0.25, 0.45, 0.80
METHODS = {"lov_exact": 0.96, "lov_synonym": 0.94, "regex": 0.88, "dimension_chain": 0.82, "uom_scan": 0.80}
LIMITS = {"MOBILE_DESC": 80, "INVOICE_DESC": 40, "SHORT_DESC": 240, "LONG_DESC1": 4000, "RETAIL_DESC": 240}
TEACHES = 0.65  # brands at least this sure teach part-number prefixes

# Words that name a material, in order.
MATERIALS = [
    (r"stainless(?:\s+steel)?|sst|ss", "Stainless Steel"), ("aluminum|alum|alm", "Aluminum"), ("pvc", "PVC"), ("vinyl", "Vinyl"), ("composite", "Composite"), ("steel", "Steel"),
    ("brass", "Brass"), ("copper", "Copper"), ("plastic|poly", "Plastic"), ("cedar", "Cedar"), (r"fiber\s*cement|hardie", "Fiber Cement"),
]
# What says how an article is sold, not what it is.
NOISE = r"(?i)\b(display only|display|bare tool|bare|tool only|linear foot|bdl|replacement)\b"
SERIES = r"([A-Z][A-Za-z0-9+.]*(?:\s+[A-Z][A-Za-z0-9+.]*)?)\s+Series\b"
CHAIN = rf"({NUMBER})\s*(?:\"|in)?\s*[xX]\s*({NUMBER})\s*(?:\"|in)?(?:\s*[xX]\s*({NUMBER})\s*(?:\"|in)?)?"
# Text that generated fields must not hold, or not be as a whole.
FORBIDDEN = [(r"\bN/A\b", "placeholder_text"), (r"\blorem ipsum\b", "filler_text"), (r"\bundefined\b", "placeholder_text"), (r"\bnot found\b", "placeholder_text"), (r"--\s*(?:no\s+)?\w+(?:\s+\w+)?\s*--", "sentinel_text"), (r"\{\w+\}", "unrendered_template_token")]
FORBIDDEN_WHOLE = [("n/?a", "placeholder_text"), ("tbd", "placeholder_text"), ("null", "placeholder_text"), ("none", "placeholder_text"), ("unknown", "placeholder_text"), ("-+", "sentinel_text")]


# --- resolve -----------------------------------------------------------------------


def resolved(rows: DataFrame, pack: Pack = OWN) -> DataFrame:
    """``rows`` (``resolve.mentions``) with supplier, brand and manufacturer of record.

    A brand comes from the first filled brand column, else from a name in the
    description, else from a supplier that is itself one brand's maker.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"Part_Desc": clean(F.col("Part_Desc")), "Mfg_Part_Num": clean(F.col("Mfg_Part_Num"))})
    makers, known, owners = resolve.manufacturers(rows), resolve.brands(rows), resolve.owners(rows)
    supplied = resolve.resolve_suppliers(rows, makers).select("row_index", F.col("manufacturer").alias("supplied"), F.col("method").alias("supplier_method"), F.col("confidence").alias("supplier_confidence"))
    told = resolve.resolve_brands(rows, known).select("row_index", F.col("brand").alias("told"), F.col("method").alias("told_method"), F.col("confidence").alias("told_confidence"))
    found = best(rows.where("size(brands) = 0"), aliases(spark, pack)).select("row_index", F.col("brand").alias("mentioned"))
    named = known.select("brand_key", F.col("name").alias("known_brand"))
    top = owners.where("rank = 1").select(F.col("brand_key").alias("owned"), F.col("name").alias("owner"), F.col("distributor").alias("owner_distributes"))
    own = makers.select(F.col("name").alias("maker"), F.col("supplier_key").alias("maker_key"), F.col("distributor").alias("distributes"))
    p = rows.join(supplied, "row_index").join(told, "row_index").join(found, "row_index", "left")
    p = p.withColumn("supplied_key", match_key(F.col("supplied"))).join(own, F.col("supplied_key") == F.col("maker_key"), "left")
    p = p.withColumn("asked_key", F.coalesce(match_key(F.coalesce("told", "mentioned")), F.when(~F.col("distributes"), F.col("maker_key"))))
    p = p.join(named, F.col("asked_key") == F.col("brand_key"), "left").join(top, F.col("asked_key") == F.col("owned"), "left")
    itself = F.col("told").isNull() & F.col("mentioned").isNull() & F.col("known_brand").isNotNull()
    method = F.when(F.col("told").isNotNull(), F.col("told_method")).when(F.col("mentioned").isNotNull(), "description_mention").when(itself, "supplier_is_brand").otherwise("unresolved")
    sure = F.when(method == "description_mention", F.when(F.col("known_brand").isNotNull(), 0.80).otherwise(0.68)).when(method == "supplier_is_brand", 0.72).otherwise(F.coalesce("told_confidence", F.lit(0.0)))
    p = p.withColumns({"brand": F.coalesce("told", "mentioned", F.when(itself, F.col("known_brand"))), "brand_method": method, "brand_confidence": sure})
    owned = F.col("brand").isNotNull() & F.col("owner").isNotNull() & ~F.col("owner_distributes")
    direct = F.col("maker").isNotNull() & ~F.col("distributes")
    how = F.when(owned, "brand_owner").when(direct, "supplier_direct").when(F.col("maker").isNotNull(), "distributor_only").otherwise("unresolved")
    trust = F.when(how == "brand_owner", F.least(F.lit(0.95), F.col("brand_confidence") + 0.05)).when(how == "supplier_direct", F.col("supplier_confidence") * 0.95).otherwise(0.0)
    p = p.withColumns({"manufacturer": F.when(owned, F.col("owner")).when(direct, F.col("maker")), "manufacturer_method": how, "manufacturer_confidence": round_half_up(trust, 4)})
    return p.select("row_index", "Mfg_Part_Num", "Part_Desc", "supplier", "supplied", "supplier_method", "supplier_confidence", "distributes", "brand", "brand_method", "brand_confidence", "manufacturer", "manufacturer_method", "manufacturer_confidence")


def widened_fan_out(rows: DataFrame, pack: Pack = OWN) -> DataFrame:
    """``supplier_key, fan_out, distributor``: brands of a supplier, those named in its
    descriptions included."""
    listed = resolve.brand_rows(rows).select("supplier_key", "brand_key")
    said = best(rows, aliases(rows.sparkSession, pack), also=("supplier_key",)).select("supplier_key", match_key(F.col("brand")).alias("brand_key"))
    both = listed.unionByName(said)
    by = both.where("supplier_key IS NOT NULL").groupBy("supplier_key").agg(F.count_distinct("brand_key").alias("fan_out"))
    return by.withColumn("distributor", F.col("fan_out") >= resolve.DISTRIBUTOR_FROM)


# --- parse -------------------------------------------------------------------------


def parsed(p: DataFrame) -> DataFrame:
    """``body, segments, product_type, series, dimensions, specs, materials, features, residual,
    parse_confidence, thin``: what the description literally says."""
    p = p.withColumn("body", without_leading(F.col("Part_Desc"), F.coalesce("Mfg_Part_Num", F.lit("")))).withColumn("segments", segments(F.col("body")))
    p = p.withColumn("measures", typed_measures(F.col("body")))
    bare = lambda c: F.regexp_replace(F.regexp_replace(unchained(c), ANY_MEASURE, " "), PACK, " ")
    head = F.regexp_replace(F.regexp_replace(bare(F.coalesce(F.get("segments", F.lit(0)), F.col("body"))), NOISE, " "), r"[^A-Za-z0-9_\s/-]", " ")
    words = F.filter(F.split(trimmed(head), " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    last = F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3)
    kept = F.filter(F.transform(F.slice("segments", 2, 1000), lambda x: F.trim(trimmed(F.regexp_replace(x, NOISE, "")), F.lit(" -,/"))), lambda x: F.length(x) >= 3)
    lows = lambda: F.transform("kept", lambda x: F.lower(x))
    materials = F.array_compact(F.array(*[F.when(F.col("body").rlike(rf"(?i)\b(?:{rx})\b"), name) for rx, name in MATERIALS]))
    length = F.filter("measures", lambda m: m["kind"] == "Length")
    other = F.filter("measures", lambda m: m["kind"] != "Length")
    said = lambda m: F.concat_ws(" ", m["value"], m["unit"])
    firsts = F.filter(other, lambda m, i: F.size(F.filter(F.slice(other, 1, i), lambda x: x["kind"] == m["kind"])) == 0)
    packed = F.regexp_extract("body", PACK, 1)
    specs = F.concat(F.transform(firsts, lambda m: F.concat(m["kind"], F.lit(": "), said(m))), F.when(packed != "", F.array(F.concat(F.lit("Package Quantity: "), packed))).otherwise(F.array().cast("array<string>")))
    p = p.withColumn("kept", kept).withColumns(
        {
            "product_type": title_case(F.array_join(last, " ")),
            "series": F.when(F.regexp_extract("body", SERIES, 1) != "", F.concat(title_case(F.regexp_extract("body", SERIES, 1)), F.lit(" Series"))),
            "dimensions": F.transform(length, lambda m, i: F.concat(F.lit("dim_"), (i + 1).cast("string"), F.lit(": "), said(m))),
            "specs": specs,
            "materials": materials,
            "features": F.slice(F.filter("kept", lambda x, i: F.array_position(lows(), F.lower(x)) == i + 1), 1, 10),
            "residual": trimmed(bare(F.col("body"))),
        }
    )
    filled = [F.col("product_type") != "", F.size("materials") > 0, F.size("dimensions") > 0, F.size("specs") > 0]
    n = lambda cs: reduce(lambda a, b: a + b, [c.cast("int") for c in cs])
    return p.withColumns({"parse_confidence": F.least(F.lit(0.9), round_half_up(0.25 + 0.13 * n([*filled, F.size("features") > 0]), 4)), "thin": n(filled) <= 1}).drop("measures", "kept")


def grounded(claim: Column, source: Column) -> Column:
    """Does the source hold every longer word of the claim?"""
    words = F.filter(F.split(F.lower(claim), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.forall(words, lambda w: F.contains(F.lower(source), w))


# --- classify ----------------------------------------------------------------------


def leaf_hits(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``row_index, leaf, classpath, keyword, weight`` of every keyword in a description.

    A row's words meet the beginnings of the keywords, one word or several joined ("multitool"),
    then the whole phrase is looked for.
    """
    tokens = rows.select("row_index", "Part_Desc", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("Part_Desc"), F.lit("[a-z0-9]+"), 0))).alias("word"))
    parts = F.regexp_extract_all(F.lower("keyword"), F.lit("[a-z0-9]+"), 0)
    begins = F.array_distinct(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "")))
    dim = words.withColumn("begins", F.explode(begins))
    met = tokens.join(dim, F.col("word") == F.col("begins"))
    return met.where(F.rlike("Part_Desc", F.col("pattern"))).select("row_index", "leaf", "classpath", "keyword", "weight")


def classified(p: DataFrame, pack: Pack = OWN) -> DataFrame:
    """``leaf, leaf_score, leaf_ambiguous, leaf_confidence, candidates``: up to five leaves, the
    best first; one with an excluding keyword is none."""
    hits = leaf_hits(p, keywords(p.sparkSession, pack)).groupBy("row_index", "leaf").agg(F.array_sort(F.collect_set(F.struct("keyword", "weight"))).alias("hits"))  # a leaf's keywords at most
    by = hits.select(
        "row_index", "leaf", F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["weight"]).alias("total"), F.size("hits").alias("n"),
        F.array_min(F.transform("hits", lambda h: h["weight"])).alias("least"), F.transform("hits", lambda h: h["keyword"]).alias("matched"),
    )
    scored = by.where("least > 0").withColumn("score", F.col("total") + 0.5 * (F.col("n") - 1))
    listed = scored.groupBy("row_index").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "leaf", "matched"))).alias("found"))  # a row's leaves: at most the pack's
    top = listed.select("row_index", F.transform(F.slice("found", 1, 5), lambda x: F.struct(x["leaf"].alias("leaf"), (-x["minus"]).alias("score"), F.concat(F.lit("matched: "), F.array_join(x["matched"], ", ")).alias("why"))).alias("candidates"))
    p = p.join(top, "row_index", "left")
    score = F.get("candidates", F.lit(0))["score"]
    ratio = F.coalesce(F.get("candidates", F.lit(1))["score"], F.lit(0.0)) / score
    sure = F.least(F.lit(0.97), 0.55 * F.least(F.lit(1.0), score / 16.0) + 0.45 * (0.35 + 0.65 * (1.0 - ratio)))
    return p.withColumns(
        {
            "leaf": F.coalesce(F.get("candidates", F.lit(0))["leaf"], F.lit(FALLBACK)),
            "leaf_ambiguous": F.coalesce(ratio >= CLOSE, F.lit(False)),
            "leaf_confidence": F.coalesce(round_half_up(F.when(ratio >= CLOSE, F.least(F.lit(0.55), sure)).otherwise(sure), 4), F.lit(0.0)),
        }
    )


# --- brands from part numbers ------------------------------------------------------


def prefix_rules(p: DataFrame) -> DataFrame:
    """``prefix, learned, support, leaves, suppliers, examples``: prefixes that sure brands of
    the corpus have alone, seen twice or more."""
    sure = p.where((F.col("brand_confidence") >= TEACHES) & F.col("brand").isNotNull())
    each = sure.select("brand", "Mfg_Part_Num", "leaf", "supplied", F.explode(F.array(*[alpha_prefix(F.col("Mfg_Part_Num"), n) for n in (5, 4, 3)])).alias("prefix")).where("prefix IS NOT NULL")
    by = each.groupBy("prefix").agg(
        F.count("*").alias("support"), F.count_distinct("brand").alias("n"), F.min("brand").alias("learned"), F.array_sort(F.collect_set("leaf")).alias("leaves"),
        F.array_sort(F.collect_set("supplied")).alias("suppliers"), F.min("Mfg_Part_Num").alias("first_part"),
    )
    return by.where("n = 1 AND support >= 2").drop("n")


def inferred(p: DataFrame) -> DataFrame:
    """Rows without a brand get the one of the longest learned prefix in the same leaf or of
    the same supplier; a row never teaches itself, as it has no brand."""
    rules = prefix_rules(p)
    bare = p.where("brand IS NULL").select("row_index", "leaf", "supplied", F.explode(F.array(*[alpha_prefix(F.col("Mfg_Part_Num"), n) for n in (5, 4, 3)])).alias("prefix")).where("prefix IS NOT NULL")
    met = bare.join(rules, "prefix").where(F.array_contains("leaves", F.col("leaf")) | F.coalesce(F.array_contains("suppliers", F.col("supplied")), F.lit(False)))
    got = met.groupBy("row_index").agg(F.max_by(F.struct("learned", "prefix", "support"), F.length("prefix")).alias("rule"))
    p = p.join(got, "row_index", "left")
    sure = round_half_up(F.least(F.lit(0.55), 0.30 + 0.06 * F.col("rule.support") + 0.03 * F.length("rule.prefix")), 4)
    took = F.col("rule").isNotNull()
    return p.withColumns(
        {
            "brand_method": F.when(took, "mpn_prefix_inference").otherwise(F.col("brand_method")),
            "brand_confidence": F.when(took, sure).otherwise(F.col("brand_confidence")),
            "brand": F.coalesce("brand", "rule.learned"),
        }
    ).drop("rule")


# --- extract -----------------------------------------------------------------------


SPLIT = r"^\s*([+-]?(?:[0-9]+[-\s])?[0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+)?)\s*([A-Za-z\"'°][A-Za-z\s.\"'°-]*)?\s*$"


def _hit(a: Column, text: Column, low: Column, chain: Column) -> Column:
    """What a slot finds first: an approved value's surface, a declared pattern, its place in the
    chain, a number before its unit; the later ones are looked for only if the earlier ones fail.
    ``low`` is the text in lower case: without a surface's letters no pattern is tried on it."""
    one = lambda value, method: F.struct(F.trim(value).alias("value"), method.alias("method"))
    group = lambda pattern, n: F.call_function("regexp_extract", text, pattern, n)
    told = lambda hits: F.get(F.filter(hits, lambda h: h["value"] != ""), F.lit(0))
    surfaces = F.slice(F.filter(a["surfaces"], lambda s: F.contains(low, s["probe"]) & F.rlike(text, s["pattern"])), 1, 1)
    return F.coalesce(
        F.get(F.transform(surfaces, lambda s: one(s["value"], s["kind"])), F.lit(0)),
        told(F.transform(a["patterns"], lambda x: one(group(x["pattern"], x["group"]), F.lit("regex")))),
        told(F.array(one(F.coalesce(F.get(chain, a["chain_at"]), F.lit("")), F.lit("dimension_chain")))),
        told(F.array(one(F.when(a["uom_pattern"] != "", group(a["uom_pattern"], F.lit(2))).otherwise(""), F.lit("uom_scan")))),
    )


def _staged(p: DataFrame, column: str, *steps) -> DataFrame:
    """Each step gives new fields for every element, by the element; one column a step, so
    that no step's work is done twice."""


    def told(step):
        return lambda x: reduce(lambda y, kv: y.withField(kv[0], kv[1]), step(x).items(), x)

    for step in steps:
        p = p.withColumn(column, F.transform(column, told(step)))
    return p


def extracted(p: DataFrame, pack: Pack = OWN, more_text: tuple[str, ...] = ()) -> DataFrame:
    """``attributes``: a value or a blank for each of the leaf's template slots, in its order.

    The description is read first, then each of ``more_text``; a hit that comes to nothing
    leaves the slot to the next text.  Values are in house style with an approved unit, the
    template's own one first.  Series and model are filled afterwards.
    """
    return _filled(_read(p, pack, more_text))


def extracted_once(p: DataFrame, pack: Pack = OWN, more_text: tuple[str, ...] = ()) -> DataFrame:
    """As ``extracted``, but each leaf and text is read once, however many rows have it.

    What is read is joined back to the rows, whose own part numbers fill their slots then; a
    null text is a key of its own.
    """
    keys = ("leaf", "Part_Desc", *more_text)
    read = settled(_read(p.select(*keys).distinct(), pack, more_text), "read")
    of = read.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in read.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return _filled(p.join(of, same).drop(*[f"_{k}" for k in keys]))


def _read(p: DataFrame, pack: Pack, more_text: tuple[str, ...]) -> DataFrame:
    """``slots`` with what the texts say, and ``series_told``."""
    p = p.join(templates(p.sparkSession, pack).withColumnRenamed("attributes", "slots"), "leaf")
    tokens = F.array(*[F.regexp_replace(F.regexp_extract("Part_Desc", CHAIN, i), r"\s+", "") for i in (1, 2, 3)])
    told = F.regexp_extract("Part_Desc", SERIES, 1)
    p = p.withColumns({"chain": tokens, "series_told": F.when(told != "", F.concat(title_case(told), F.lit(" Series")))})
    texts = ("Part_Desc", *more_text)
    p = p.withColumns({f"_low_{t}": F.lower(F.coalesce(F.col(t), F.lit(""))) for t in texts})
    found = lambda a: F.coalesce(*[_hit(a, F.coalesce(F.col(t), F.lit("")), F.col(f"_low_{t}"), F.col("chain")) for t in texts])
    mixed = r"^(?:[0-9]+[- ]+)?[0-9]+/[1-9][0-9]*$"

    def unified(a: Column) -> dict[str, Column]:
        house = F.when(a["number"].isNotNull(), F.coalesce(to_fraction(a["number"]), a["tidy"])).when(a["tidy"].rlike(mixed), F.regexp_replace(a["tidy"], r"^([0-9]+)[- ]+([0-9])", "$1-$2"))
        return {"value": F.when(a["lov"], a["tidy"]).otherwise(F.coalesce(house, a["tidy"])), "unit": F.when(~a["lov"], unit(F.when(a["uom"] != "", a["uom"]).when(a["told"] != "", a["told"])))}

    p = _staged(
        p,
        "slots",
        lambda a: {"hit": found(a)},
        lambda a: {"method": a["hit"]["method"], "lov": F.coalesce(a["hit"]["method"].startswith("lov"), F.lit(False)), "plain": F.regexp_replace(F.regexp_extract(a["hit"]["value"], SPLIT, 1), r"\s*/\s*", "/"), "told": F.trim(F.regexp_extract(a["hit"]["value"], SPLIT, 2))},
        lambda a: {"tidy": F.when(a["lov"], a["hit"]["value"]).otherwise(F.regexp_replace(F.when(a["plain"] == "", a["hit"]["value"]).otherwise(a["plain"]), r"^\.([0-9]+)$", "0.$1"))},
        lambda a: {"number": F.when(~a["lov"] & a["tidy"].rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), a["tidy"].try_cast("double"))},
        unified,
    )
    return p.drop("chain", *[f"_low_{t}" for t in texts])


def _filled(p: DataFrame) -> DataFrame:
    """``attributes`` of the slots, a row's own part number and series where they are asked for."""
    sure = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), m), F.lit(0.0))

    def slot(a: Column) -> Column:
        low = F.lower(a["label"])
        restated = F.when(low == "model", F.col("Mfg_Part_Num")).when(low == "series", F.col("series_told"))
        empty = a["value"].isNull() & restated.isNotNull()
        method = F.when(empty, F.when(low == "model", "input_restatement").otherwise("regex")).when(a["value"].isNull(), "not_found").otherwise(a["method"])
        trust = F.when(empty, F.when(low == "model", 0.95).otherwise(0.90)).when(a["value"].isNull(), 0.0).otherwise(sure(a["method"]))
        approved = F.when((F.size(a["surfaces"]) > 0) & a["value"].isNotNull(), F.exists(a["surfaces"], lambda s: F.lower(s["value"]) == F.lower(a["value"])))
        return F.struct(a["pos"].alias("pos"), a["label"].alias("label"), F.when(a["value"].isNotNull(), a["unit"]).alias("uom"), a["render"].alias("render"), F.coalesce(a["value"], restated).alias("value"), method.alias("method"), trust.alias("confidence"), approved.alias("approved"))

    return p.withColumn("attributes", F.transform("slots", slot)).drop("slots", "series_told")


def present(attributes: Column | str = "attributes") -> Column:
    return F.filter(attributes, lambda a: a["value"].isNotNull() & (F.trim(a["value"]) != ""))


def by_label(attributes: Column, label: Column | str) -> Column:
    """The attribute of a label, whatever its case."""
    wanted = F.lower(F.lit(label)) if isinstance(label, str) else F.lower(label)
    return F.get(F.filter(attributes, lambda a: F.lower(a["label"]) == wanted), F.lit(0))


# --- describe ----------------------------------------------------------------------


def rendered(a: Column) -> Column:
    """An attribute by its own template: ``{value} {uom} {label}``."""
    fill = lambda text, name, value: F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return trimmed(fill(fill(fill(a["render"], "value", a["value"]), "uom", a["uom"]), "label", a["label"]))


def short_form(a: Column) -> Column:
    """A count as ``5-Wash Cycle``, anything else by its template."""
    noun = F.trim(F.replace(F.replace(a["render"], F.lit("{value} "), F.lit("")), F.lit("{uom}"), F.lit("")))
    counted = a["value"].rlike("^[0-9]+$") & F.contains(a["render"], F.lit("{value} ")) & (noun != "") & ~F.contains(noun, F.lit("{")) & a["uom"].isNull()
    return F.when(counted, F.concat(a["value"], F.lit("-"), F.trim(F.regexp_replace(noun, r"s\b", "")))).otherwise(rendered(a))


def _listed(head: Column, parts: Column) -> Column:
    """The head, and the parts that it doesn't say already."""
    fresh = F.filter(parts, lambda x: (x != "") & ~redundant(x, head))
    return trimmed(F.array_join(F.concat(F.array(head), fresh), ", "))


def _packed(start: Column, parts: Column, limit: int, sep: str, skips: bool) -> Column:
    """Parts appended while they fit: the first that doesn't ends it, or is skipped."""
    state = F.struct(start.alias("text"), F.lit(False).alias("full"))

    def step(s: Column, part: Column) -> Column:
        longer = F.concat(s["text"], F.lit(sep), part)
        said = redundant(part, start if skips else s["text"]) | (part == "")
        fits = ~said & ~s["full"] & (F.length(longer) <= limit)
        over = F.lit(False) if skips else (s["full"] | (~said & ~fits))
        return F.struct(F.when(fits, longer).otherwise(s["text"]).alias("text"), over.alias("full"))

    return trimmed(F.aggregate(parts, state, step)["text"])


def described(p: DataFrame, pack: Pack = OWN) -> DataFrame:
    """``with_clause, descriptions, description_confidence``: long, short, retail, mobile (80
    characters, ends at the first overflow) and invoice (40, capitals, skips it)."""
    p = p.withColumn("with_clause", with_clause(F.col("Part_Desc")))
    symbols = {b.canonical: b.symbol for b in pack.brands if b.symbol}
    shown = F.col("brand")
    if symbols:
        shown = F.concat(F.col("brand"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv]), F.col("brand")), F.lit("")))
    p = p.withColumns({"brand_shown": shown, "filled": present()})
    p = p.withColumns(
        {
            "short_slots": F.filter(F.transform("short", lambda x: by_label(F.col("filled"), x)), lambda a: a.isNotNull()),
            "invoice_slots": F.filter(F.transform("invoice", lambda x: by_label(F.col("filled"), x)), lambda a: a.isNotNull()),
            "series_said": by_label(F.col("filled"), "series")["value"],
        }
    )
    named = F.concat_ws(" ", "brand_shown", "name", "with_clause")
    long_parts = F.transform(F.filter("filled", lambda a: ~F.lower(a["label"]).isin("model", "additional information")), rendered)
    extra = by_label(F.col("filled"), "additional information")["value"]
    short_parts = F.transform("short_slots", short_form)
    short_head = trimmed(F.concat_ws(" ", "brand_shown", "series_said", "Mfg_Part_Num", "name", "with_clause"))
    retail_head = trimmed(F.concat_ws(" ", "series_said", "name"))
    plain = F.trim(F.regexp_replace(F.coalesce("brand_shown", F.lit("")), "[®™©]", ""))
    maker = F.trim(F.coalesce("manufacturer", F.lit("")))
    lead = F.when((plain != "") & (maker != "") & F.contains(F.lower(maker), F.lower(plain)), plain).otherwise(trimmed(F.concat_ws(" ", maker, plain)))
    mobile_head = F.array_join(F.filter(F.array(lead, "name", "series_said", "Mfg_Part_Num"), lambda x: x != ""), ", ")
    tight = lambda a: F.upper(F.when(a["uom"].isNotNull(), measure(a["value"], a["uom"], compact=True)).otherwise(abbreviated(a["value"], pack.abbreviations)))
    invoice_head = F.upper(abbreviated(F.col("name"), pack.abbreviations))
    p = p.withColumns({"short_head": short_head, "mobile_head": mobile_head, "invoice_head": invoice_head, "long_head": named, "retail_head": retail_head})
    mean = F.when(F.size("filled") > 0, F.aggregate("filled", F.lit(0.0), lambda s, a: s + a["confidence"]) / F.size("filled")).otherwise(0.0)
    head = 1.0 - F.when(F.col("brand").isNull(), 0.25).otherwise(0.0) - F.when(F.col("name") == "", 0.35).otherwise(0.0)
    said = F.struct(
        _packed(F.col("mobile_head"), F.transform("short_slots", rendered), LIMITS["MOBILE_DESC"], ", ", skips=False).alias("MOBILE_DESC"),
        _packed(F.col("invoice_head"), F.transform("invoice_slots", tight), LIMITS["INVOICE_DESC"], " ", skips=True).alias("INVOICE_DESC"),
        _listed(F.col("short_head"), short_parts).alias("SHORT_DESC"),
        trimmed(F.concat(_listed(F.col("long_head"), long_parts), F.when(extra.isNotNull(), F.concat(F.lit(", Additional Information: "), extra)).otherwise(""))).alias("LONG_DESC1"),
        _listed(F.col("retail_head"), short_parts).alias("RETAIL_DESC"),
    )
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * mean + 0.35 * head))
    p = p.withColumns({"descriptions": said, "description_confidence": round_half_up(base, 4)})
    return p.drop("short_slots", "invoice_slots", "series_said", "short_head", "mobile_head", "invoice_head", "long_head", "retail_head", "filled")


# --- validate and repair -----------------------------------------------------------


def _issue(cond: Column, field: Column | str, severity: str, code: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(cond, F.struct(lit(field).alias("field"), F.lit(severity).alias("severity"), lit(code).alias("code")))


def checked(p: DataFrame, slots: int = 50) -> DataFrame:
    """``issues, checks_run``: what is wrong with a product, in the order of the checks."""
    fields = list(LIMITS)
    text = {f: F.coalesce(F.col(f"descriptions.{f}"), F.lit("")) for f in fields}
    shown = text | {"Product Name": F.coalesce("name", F.lit("")), "MANUFACTURER_NAME": F.coalesce("manufacturer", F.lit("")), "BRAND_NAME": F.coalesce("brand", F.lit(""))}

    any_ = "(?i)" + "|".join([*[rx for rx, _ in FORBIDDEN], *[rf"^\s*(?:{rx})\s*$" for rx, _ in FORBIDDEN_WHOLE]])  # holds whatever one of them does

    def forbidden(c: Column) -> Column:
        inside = reduce(lambda out, x: out.when(c.rlike("(?i)" + x[0]), x[1]), FORBIDDEN[1:], F.when(c.rlike("(?i)" + FORBIDDEN[0][0]), FORBIDDEN[0][1]))
        return F.when(c.rlike(any_), reduce(lambda out, x: out.when(F.trim(c).rlike(f"(?i)^(?:{x[0]})$"), x[1]), FORBIDDEN_WHOLE, inside))

    checks = [_issue(F.size("attributes") > slots, "__attributes__", "warning", "attribute_overflow")]
    checks += [_issue(F.length(text[f]) > limit, f, "error", "char_limit_exceeded") for f, limit in LIMITS.items()]
    checks += [_issue(F.col(f"forbidden_{i}").isNotNull(), f, "error", F.col(f"forbidden_{i}")) for i, f in enumerate(shown)]
    filled = present()
    unapproved = F.filter("kept", lambda a: a["uom"].isNotNull() & ~a["uom"].isin(*UNITS))
    fused = F.filter("kept", lambda a: a["value"].rlike(r"^[0-9]+(?:[-.][0-9]+(?:/[0-9]+)?)?[A-Za-z]{1,4}$"))
    outside = F.filter("kept", lambda a: a["approved"] == F.lit(False))
    as_issues = lambda found, severity, code: F.transform(found, lambda a: F.struct(F.concat(F.lit("ATTRIBUTE:"), a["label"]).alias("field"), F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    required = {"MANUFACTURER_PART_NUMBER": F.col("Mfg_Part_Num"), "Classpath": F.col("classpath"), "Product Name": F.col("name"), "SHORT_DESC": text["SHORT_DESC"]}
    last = [_issue(F.trim(F.coalesce(c, F.lit(""))) == "", f, "error", "required_field_missing") for f, c in required.items()]
    known = F.transform(F.concat(F.transform(filled, lambda a: a["value"]), F.array_compact(F.array("brand", "Mfg_Part_Num", "name", "with_clause"))), lambda x: F.lower(x))
    clauses = F.transform(F.slice(F.split(text["SHORT_DESC"], ","), 2, 1000), lambda c: F.lower(F.trim(c)))
    p = p.withColumns({"known": known, "clauses": clauses, "kept": filled, **{f"forbidden_{i}": forbidden(c) for i, c in enumerate(shown.values())}})
    filled = F.col("kept")
    astray = F.exists("clauses", lambda c: ~F.exists("known", lambda k: (k != "") & F.contains(c, k)))
    last.append(_issue((text["SHORT_DESC"] != "") & astray, "SHORT_DESC", "warning", "unverified_clause"))
    issues = F.concat(
        F.array_compact(F.array(*checks)), as_issues(unapproved, "error", "uom_not_approved"), as_issues(fused, "warning", "uom_spacing"),
        as_issues(outside, "error", "lov_violation"), F.array_compact(F.array(*last)),
    )
    n_uom = F.size(F.filter(filled, lambda a: a["uom"].isNotNull()))
    n_lov = F.size(F.filter(filled, lambda a: a["approved"].isNotNull()))
    external = F.lit(len(fields)) + F.col("manufacturer").isNotNull().cast("int") + F.col("brand").isNotNull().cast("int")
    run = 2 + len(LIMITS) + len(shown) + n_uom + F.size(filled) + n_lov + len(required) + external + 1
    return p.withColumns({"issues": issues, "checks_run": run.cast("int")}).drop("known", "clauses", "kept", *[f"forbidden_{i}" for i in range(len(shown))])


def repaired(p: DataFrame) -> DataFrame:
    """One pass of repairs: overlong descriptions cut, values outside the list cleared."""
    over = lambda f: F.exists("issues", lambda i: (i["field"] == f) & (i["code"] == "char_limit_exceeded"))
    cut = lambda f, limit: F.when(over(f), truncated(F.col(f"descriptions.{f}"), limit)).otherwise(F.col(f"descriptions.{f}")).alias(f)
    bad = lambda a: a["approved"] == F.lit(False)
    cleared = F.transform(
        "attributes",
        lambda a: F.when(bad(a) & a["value"].isNotNull(), a.withField("value", F.lit(None).cast("string")).withField("uom", F.lit(None).cast("string")).withField("method", F.lit("cleared_lov_violation")).withField("confidence", F.lit(0.0)).withField("approved", F.lit(None).cast("boolean"))).otherwise(a),
    )
    trims = F.array_compact(F.array(*[F.when(over(f), F.concat(F.lit(f"{f}: trimmed to "), F.length(truncated(F.col(f"descriptions.{f}"), limit)).cast("string"), F.lit(" chars"))) for f, limit in LIMITS.items()]))
    clears = F.transform(F.filter(present(), bad), lambda a: F.concat(a["label"], F.lit(": cleared unapproved value '"), a["value"], F.lit("'")))
    n_cut = F.size(trims)
    return p.withColumns({"repairs": F.array_distinct(F.concat(trims, clears)), "n_trimmed": n_cut.cast("int"), "descriptions": F.struct(*[cut(f, limit) for f, limit in LIMITS.items()]), "attributes": cleared})


def validated(p: DataFrame) -> DataFrame:
    """Checks, one pass of repairs, the same checks again: ``issues``, ``repairs``, ``passes``.

    What the repairs left alone would be found again, so only the others are checked twice."""
    p = settled(repaired(checked(p)).withColumnRenamed("issues", "first_issues"), "repaired")
    changed = (F.size("repairs") > 0) | F.exists("attributes", lambda a: a["method"] == "cleared_lov_violation")
    same = p.where(~F.coalesce(changed, F.lit(True))).withColumn("issues", F.col("first_issues"))
    again = checked(p.where(F.coalesce(changed, F.lit(True))).drop("checks_run"))
    return same.unionByName(again).withColumn("passes", F.when(F.size("repairs") > 0, 2).otherwise(1))


def errors() -> Column:
    return F.filter("issues", lambda i: i["severity"] == "error")


# --- score and review --------------------------------------------------------------


def scored(p: DataFrame) -> DataFrame:
    """``parts, confidence, band``: six weighed components; an error caps the product."""
    p = p.withColumns({"filled": present(), "n_errors": F.size(errors()), "n_warnings": F.size(F.filter("issues", lambda i: i["severity"] == "warning"))})
    n, slots = F.size("filled"), F.size("attributes")
    mean = F.aggregate("filled", F.lit(0.0), lambda s, a: s + a["confidence"]) / n
    attributes = F.when(n > 0, mean * (0.45 + 0.55 * (n / slots))).otherwise(0.0)
    said = F.lit(len(LIMITS))
    on_text = F.size(F.filter(errors(), lambda i: i["field"].isin(*LIMITS)))
    descriptions = F.greatest(F.lit(0.0), F.col("description_confidence") - 0.05 * F.col("n_trimmed") / said - 0.25 * on_text)
    own = lambda c, strong: (F.col(c).isNotNull().cast("int"), (F.col(c).isNotNull() & strong).cast("int"))
    fields = [own("manufacturer", F.lit(True)), own("brand", F.col("brand_method") != "mpn_prefix_inference"), own("classpath", F.lit(True)), own("Mfg_Part_Num", F.lit(False))]
    weighed = reduce(lambda a, b: a + b, [x for x, _ in fields]) + n
    strong = reduce(lambda a, b: a + b, [y for _, y in fields]) + F.size(F.filter("filled", lambda a: a["method"].startswith("lov")))
    evidence = F.when(weighed > 0, strong / weighed).otherwise(0.0)
    when = lambda c, value: F.when(F.col(c).isNotNull(), F.col(value)).otherwise(0.0)
    parts = {
        "manufacturer": when("manufacturer", "manufacturer_confidence"), "brand": when("brand", "brand_confidence"), "classification": when("classpath", "leaf_confidence"),
        "attributes": attributes, "descriptions": descriptions, "evidence": evidence,
    }
    p = p.withColumn("parts", F.struct(*[round_half_up(c, 6).alias(k) for k, c in parts.items()]))
    total = reduce(lambda a, b: a + b, [w * F.col(f"parts.{k}") for k, w in WEIGHTS.items()])
    capped = F.when(F.col("n_errors") > 0, F.least(total, F.lit(INVALID_CAP))).otherwise(total)
    p = p.withColumn("confidence", round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 4))
    band = F.when(F.col("confidence") >= 0.85, "HIGH").when(F.col("confidence") >= 0.65, "MEDIUM").when(F.col("confidence") >= 0.35, "LOW").otherwise("UNKNOWN")
    return p.withColumn("band", band).drop("filled")


def reviewed(p: DataFrame, error: str | None = None) -> DataFrame:
    """``flags`` (reason, field), each once, and ``status``; ``error`` names a column with a
    row's own failure, which goes before everything."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    flag = lambda cond, reason, field: F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field")))
    filled = present()
    top, second = F.get("candidates", F.lit(0))["score"], F.get("candidates", F.lit(1))["score"]

    def missing_or_low(c: str, value: str, absent: str, low: str, field: str) -> list[Column]:
        return [flag(F.col(c).isNull(), absent, field), flag(F.col(c).isNotNull() & (F.col(value) < SURE), low, field)]

    first = [
        flag(F.col("brand_method") == "mpn_prefix_inference", "Brand inferred from part-number prefix", "BRAND_NAME"),
        *missing_or_low("manufacturer", "manufacturer_confidence", "Manufacturer unresolved", "Manufacturer confidence below threshold", "MANUFACTURER_NAME"),
        *missing_or_low("brand", "brand_confidence", "Brand unresolved", "Brand confidence below threshold", "BRAND_NAME"),
        *missing_or_low("classpath", "leaf_confidence", "Product could not be classified", "Classification confidence below threshold", "Classpath"),
        flag(F.coalesce(second >= CLOSE * top, F.lit(False)), "Multiple taxonomy candidates scored similarly", "Classpath"),
        flag(F.size(filled) / F.greatest(F.size("attributes"), F.lit(1)) < LEAST_COVERAGE, "Attribute coverage below threshold", "__attributes__"),
    ]
    outside = F.transform(F.filter(filled, lambda a: a["approved"] == F.lit(False)), lambda a: F.struct(F.lit("Attribute value outside the controlled vocabulary").alias("reason"), F.concat(F.lit("ATTRIBUTE:"), a["label"]).alias("field")))
    wrong = F.transform(errors(), lambda i: F.struct(F.lit("Validation error").alias("reason"), i["field"].alias("field")))
    silent = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"descriptions.{f}"), F.lit("")) == "" for f in LIMITS])
    last = [flag(silent, "No description could be generated", "SHORT_DESC"), flag(F.col("confidence") < PUBLISH, "Product confidence below publication threshold", "")]
    flags = F.array_distinct(F.concat(F.array_compact(F.array(*first)), outside, wrong, F.array_compact(F.array(*last))))
    flags = F.when(failed, F.array(F.struct(F.lit("Processing error").alias("reason"), F.lit("").alias("field")))).otherwise(flags)
    p = p.withColumn("flags", flags)
    status = F.when(failed, "FAILED").when((F.col("n_errors") > 0) | (F.size("flags") > 0), "NEEDS_REVIEW").when(F.col("n_warnings") > 0, "PARTIAL").otherwise("SUCCESS")
    return p.withColumn("status", status)


STAGES = ("inference", "parsing", "extraction", "descriptions", "validation", "scoring", "review")


def enriched(feed: DataFrame, pack: Pack = OWN, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The whole record of every product of a feed; ``stages`` names those that run.

    The feed is written once and read from there: masters, learned prefixes and the
    rows themselves come from that table.  Between the larger stages the rows are written
    too, so each plan stays small and a lost executor costs one stage.  Parsing comes last, as no
    stage reads it: whoever asks for none of its columns doesn't pay for them.
    """
    rows = settled(resolve.mentions(feed), "feed")
    p = settled(classified(resolved(rows, pack), pack), "classified")
    if "inference" in stages:
        p = inferred(p)
    parse = parsed if "parsing" in stages else lambda df: df
    if "extraction" not in stages:
        return parse(p)
    p = settled(extracted(p, pack), "extracted")
    if "descriptions" in stages:
        p = settled(described(p, pack), "described")
    if "validation" in stages:
        p = settled(validated(p), "validated")
    if "scoring" in stages:
        p = scored(p)
    return parse(reviewed(p) if "review" in stages else p)


def clean_record(feed: DataFrame, fields: list[str]) -> DataFrame:
    """``row_index, <fields>, placeholders, transforms``: cleaned values, which fields held a
    sentinel, and what was changed."""
    out = feed.select("row_index", *[F.col(f).alias(f"raw_{f}") for f in fields], *[clean(F.col(f)).alias(f) for f in fields])
    filled = lambda f: F.trim(F.coalesce(F.col(f"raw_{f}"), F.lit(""))) != ""
    held = F.array_compact(F.array(*[F.when(filled(f) & F.col(f).isNull(), f) for f in fields]))
    moved = F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"raw_{f}"), F.struct(F.lit(f).alias("field"), F.col(f"raw_{f}").alias("raw"), F.col(f).alias("value"))) for f in fields]))
    return out.select("row_index", *fields, held.alias("placeholders"), moved.alias("transforms"))


def with_run_stats(p: DataFrame) -> DataFrame:
    """One row: products by status, errors and warnings, mean confidence."""
    return p.agg(
        F.count("*").alias("n_products"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "PARTIAL", "NEEDS_REVIEW", "FAILED")],
        F.sum("n_errors").alias("n_errors"), F.sum("n_warnings").alias("n_warnings"), F.sum(F.floor(F.col("confidence") * 10000 + 0.5)).cast("long").alias("points"),
    )


def newest(decisions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last decision of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return decisions.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
