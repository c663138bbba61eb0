"""Packs: the taxonomy, its attribute templates and controlled values, brand names and
abbreviations, as plain rows that become small dimension tables.

``OWN`` is a small pack of our own for the derived feed.  ``load`` reads packs a user
brings as JSON files, by any path Spark can read; ``uom_table``, ``fraction_table``,
``master_table`` and ``taxonomy_rows`` read the tabular forms.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.measures import ALIASES, UNITS, alias_key
from .functions.text import bounded, match_key, trimmed

STRONG, NAMED, WEAK, EXCLUDES = 10.0, 4.0, 3.0, 0.0
# Which template labels an ``a x b x c`` chain fills, in order, by leaf.
CHAINS = {"cutting_grinding_wheels": ("Diameter", "Thickness", "Arbor Size"), "saw_blades": ("Diameter", "Arbor Size"), "fasteners": ("Length",)}
FALLBACK = "generic_product"


@dataclass(frozen=True)
class Attribute:
    label: str
    uom: str = ""
    render: str = "{value} {uom} {label}"
    patterns: tuple[str, ...] = ()  # declared patterns: the first group, or the whole, is the value
    values: tuple[tuple[str, tuple[str, ...]], ...] = ()  # approved values with further surfaces


@dataclass(frozen=True)
class Leaf:
    id: str
    classpath: str
    name: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    short: tuple[str, ...] = ()
    invoice: tuple[str, ...] = ()


@dataclass(frozen=True)
class Brand:
    canonical: str
    aliases: tuple[str, ...]
    require_after: tuple[str, ...] = ()
    reject_after: tuple[str, ...] = ()
    symbol: str = ""


@dataclass(frozen=True)
class Pack:
    leaves: tuple[Leaf, ...]
    brands: tuple[Brand, ...] = ()
    reject_after: tuple[str, ...] = ()
    abbreviations: dict[str, str] = field(default_factory=dict)
    chains: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CHAINS))


def uom_pattern(unit: str) -> str:
    """A number (group 2) before any spelling of a unit; empty without one."""
    if not unit:
        return ""
    names = sorted({unit, *UNITS.get(unit, "").split("|")} - {""}, key=lambda n: (-len(n), n))
    return r"(?i)(^|[^A-Za-z0-9])([0-9]+(?:-[0-9]+/[0-9]+)?(?:\.[0-9]+)?(?:/[0-9]+)?)\s*(?:" + "|".join(map(re.escape, names)) + r")([^A-Za-z0-9]|$)"


_MATERIAL = Attribute("Material", render="{value}", values=(("Stainless Steel", ("SS", "SST", "Stainless")), ("Steel", ())))
_COLOR = Attribute("Color", render="{value}", values=(("Blue", ()), ("Red", ("Crimson",))))
_MODEL = Attribute("Model", render="{value}")
_SIZE = Attribute("Size", "in", "{value} {uom}")

OWN = Pack(
    leaves=(
        Leaf("fasteners", "Hardware>Fasteners>Bolts", "Bolt", ("bolt",), ("rod", "steel"), (), (Attribute("Series", render="{value}"), Attribute("Length", "in"), _MATERIAL, _COLOR, _MODEL), ("Length", "Material"), ("Length", "Material")),
        Leaf("gears", "Hardware>Drive Parts>Gears", "Gear", ("gear",), ("large", "heavy duty"), (), (_SIZE, Attribute("Diameter", "in"), Attribute("Thickness", "in"), _MATERIAL, Attribute("Duty", patterns=(r"\b(heavy|light)\s+duty\b",)), _MODEL), ("Diameter", "Material", "Duty"), ()),
        Leaf("rings", "Hardware>Seals>Rings", "Ring", ("ring",), ("small",), (), (Attribute("Diameter", "in"), _MATERIAL, _COLOR, _MODEL), ("Diameter", "Material", "Color"), ("Diameter", "Material")),
        Leaf("plates", "Building>Metal>Plates", "Plate", ("plate",), ("steel", "stainless steel"), (), (Attribute("Length", "in"), Attribute("Thickness", "in"), _MATERIAL, Attribute("Duty", render="{value} {label}", patterns=(r"\b(heavy|light)\s+duty\b",), values=(("Standard", ()), ("Light", ()))), _MODEL), ("Length", "Thickness", "Duty"), ("Material", "Length")),
        Leaf("anvils", "Tools>Forging>Anvils", "Anvil", ("anvil",), ("old",), (), (_SIZE, _MATERIAL, Attribute("Number of Horns", render="{value} Horns", patterns=(r"\b([0-9]) horns\b",)), _MODEL), ("Size", "Number of Horns", "Material"), ("Size", "Material")),
        Leaf("gadgets", "Tools>Gadgets>Widgets", "Multi-Purpose Widget", ("widget",), ("gizmo",), ("hot",), (_SIZE, Attribute("Voltage Rating", "V", "{value} {uom}"), _COLOR, Attribute("Series", render="{value}"), _MODEL), ("Voltage Rating", "Size", "Color"), ("Voltage Rating", "Size")),
        Leaf(FALLBACK, "", "Product", attributes=(_SIZE, _MATERIAL, _MODEL), short=("Size", "Material"), invoice=("Size",)),
    ),
    brands=(
        Brand("Ironclad", ("ironclad", "iron clad"), symbol="®"),
        Brand("Iron", ("iron",), require_after=("widget", "gizmo")),
        Brand("Torque", ("torque",), reject_after=("wrench",)),
        Brand("GT", ("gt",), require_after=("gear", "ring", "plate")),
    ),
    reject_after=("drive", "head", "recess", "bit", "bits", "screw", "screws", "point", "tip"),
    abbreviations={"Stainless Steel": "SST", "Steel": "STL", "Heavy": "HVY", "Multi-Purpose": "MP", "Widget": "WDGT", "Plate": "PLT", "Blue": "BLU", "Anvil": "ANV"},
    chains={"fasteners": ("Length",), "gears": ("Diameter", "Thickness"), "rings": ("Diameter",), "plates": ("Length", "Thickness")},
)


# --- as tables ---------------------------------------------------------------------


def keyword_rows(pack: Pack) -> list[tuple[str, str, str, float, str]]:
    """``leaf, classpath, keyword, weight, pattern``: each keyword, and the product's name, with its
    bounded pattern; words of a phrase may stand joined, or apart by blanks, hyphens or slashes."""
    each = [(x, k.lower(), w) for x in pack.leaves for ks, w in ((x.strong, STRONG), (x.weak, WEAK), (x.excludes, EXCLUDES)) for k in ks]
    each += [(x, x.name, NAMED) for x in pack.leaves if x.name and x.id != FALLBACK]
    return [(x.id, x.classpath, k, w, "(?i)" + bounded(k, r"[\s/-]*")) for x, k, w in each]


def keywords(spark: SparkSession, pack: Pack = OWN) -> DataFrame:
    return spark.createDataFrame(keyword_rows(pack), "leaf string, classpath string, keyword string, weight double, pattern string")


def surface_rows(pack: Pack) -> list[tuple[str, int, str, str, str, str, int]]:
    """``leaf, pos, label, value, surface, kind, nth``: approved values and their surfaces, the
    longest first, ties as declared."""
    out = []
    for leaf in pack.leaves:
        for pos, a in enumerate(leaf.attributes, 1):
            each = [(v, s, "lov_exact" if s == v else "lov_synonym") for v, more in a.values for s in (v, *more)]
            each = sorted(each, key=lambda x: -len(x[1]))
            out += [(leaf.id, pos, a.label, v, s, kind, nth) for nth, (v, s, kind) in enumerate(each, 1)]
    return out


def usable(patterns: tuple[str, ...]) -> list[tuple[str, int]]:
    """Patterns that compile, any case, and the group that is their value."""
    out = []
    for p in patterns:
        try:
            out.append(("(?i)" + p, min(1, re.compile(p).groups)))
        except re.error:
            continue
    return out


def attribute_rows(pack: Pack) -> list[tuple[str, int, str, str, str, list[tuple[str, int]], str, int | None, bool]]:
    """``leaf, pos, label, uom, render, patterns, uom_pattern, chain_at, has_values``."""
    out = []
    for leaf in pack.leaves:
        chain = pack.chains.get(leaf.id, ())
        out += [(leaf.id, pos, a.label, a.uom, a.render, usable(a.patterns), uom_pattern(a.uom), chain.index(a.label) if a.label in chain else None, bool(a.values)) for pos, a in enumerate(leaf.attributes, 1)]
    return out


_SURFACE = "struct<pattern:string,value:string,kind:string,probe:string>"
_ATTRIBUTE = f"struct<pos:int,label:string,uom:string,render:string,patterns:array<struct<pattern:string,group:int>>,uom_pattern:string,chain_at:int,surfaces:array<{_SURFACE}>>"


def probe(surface: str) -> str:
    """Letters and digits that a text in lower case must hold for the surface to be in it."""
    return max(re.findall("[A-Za-z0-9]+", surface), key=len, default="").lower()


def templates(spark: SparkSession, pack: Pack = OWN) -> DataFrame:
    """A row per leaf: ``leaf, classpath, name, attributes, short, invoice``; bounded by the pack."""
    by: dict[tuple[str, int], list] = {}
    for leaf, pos, _, value, surface, kind, _nth in surface_rows(pack):
        by.setdefault((leaf, pos), []).append(("(?i)" + bounded(surface), value, kind, probe(surface)))
    rows = []
    for leaf in pack.leaves:
        own = [(pos, label, uom, render, pattern, scan, at, by.get((leaf.id, pos), [])) for x, pos, label, uom, render, pattern, scan, at, _ in attribute_rows(pack) if x == leaf.id]
        rows.append((leaf.id, leaf.classpath or None, leaf.name, own, list(leaf.short), list(leaf.invoice) or [a.label for a in leaf.attributes]))
    return spark.createDataFrame(rows, f"leaf string, classpath string, name string, attributes array<{_ATTRIBUTE}>, short array<string>, invoice array<string>")


def alias_rows(pack: Pack) -> list[tuple[str, str, str, int, list[str], list[str], str]]:
    """``canonical, alias, first_word, nth, require_after, reject_after, symbol``: longest alias first."""
    each = [(b, a.strip().lower()) for b in pack.brands for a in b.aliases if a.strip()]
    each = sorted(each, key=lambda x: -len(x[1]))
    low = lambda ws: [w.lower() for w in ws]
    return [(b.canonical, a, re.match(r"[a-z0-9]*", a)[0], nth, low(b.require_after), low((*pack.reject_after, *b.reject_after)), b.symbol) for nth, (b, a) in enumerate(each, 1)]


def aliases(spark: SparkSession, pack: Pack = OWN) -> DataFrame:
    return spark.createDataFrame(alias_rows(pack), "canonical string, alias string, first_word string, nth int, require_after array<string>, reject_after array<string>, symbol string")


def extended(pack: Pack, names: list[str]) -> Pack:
    """The pack with further brand names, such as a master's; known ones stay as they are."""
    known = {b.canonical.lower() for b in pack.brands}
    more = [Brand(n, (n,)) for n in dict.fromkeys(names) if n and n.lower() not in known]
    return Pack(pack.leaves, (*pack.brands, *more), pack.reject_after, pack.abbreviations, pack.chains)


# --- packs from files --------------------------------------------------------------


def _document(spark: SparkSession, path: str) -> dict:
    """One small JSON file, read by Spark so that any store will do."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load(spark: SparkSession, taxonomy: str | None = None, brands: str | None = None, abbreviations: str | None = None) -> Pack:
    """A pack from JSON files; what is not given comes from ``OWN``."""
    leaves, names, guards, short = OWN.leaves, OWN.brands, OWN.reject_after, OWN.abbreviations
    if taxonomy:
        leaves = tuple(_leaf(x) for x in _document(spark, taxonomy).get("leaf_nodes", []))
    if brands:
        data = _document(spark, brands)
        names = tuple(
            Brand(b["canonical"], tuple(b.get("aliases") or (b["canonical"],)), tuple(b.get("require_after") or ()), tuple(b.get("reject_after") or ()), b.get("symbol", "")) for b in data.get("brands", [])
        )
        guards = tuple((data.get("guards") or {}).get("global_reject_after") or ())
    if abbreviations:
        short = dict(_document(spark, abbreviations).get("abbreviations") or {})
    return Pack(leaves, names, guards, short, dict(CHAINS) if taxonomy else OWN.chains)


def _leaf(x: dict) -> Leaf:
    made = tuple(
        Attribute(a["label"], a.get("uom") or "", a.get("render") or "{value} {uom} {label}", tuple(a.get("extract_patterns") or ()), tuple((v["value"], tuple(v.get("synonyms") or ())) for v in a.get("values") or ()))
        for a in x.get("attributes") or ()
    )
    words = [tuple(x.get(k) or ()) for k in ("strong_keywords", "keywords", "exclude_keywords")]
    fallback = x["id"] if not x.get("is_fallback") else FALLBACK
    return Leaf(fallback, x.get("classpath") or "", x.get("product_name") or "", *words, made, tuple(x.get("short_desc_attributes") or ()), tuple(x.get("invoice_attributes") or ()))


# --- dimension tables from rows ----------------------------------------------------


def uom_table(rows: DataFrame, abbreviation: str, term: str, kind: str, order: str) -> DataFrame:
    """``abbr, kind, aliases`` from a unit list with a row per spelling: the first row's kind."""
    clean = rows.select(trimmed(F.col(f"`{abbreviation}`")).alias("abbr"), trimmed(F.col(f"`{term}`")).alias("term"), F.col(f"`{kind}`").alias("kind"), F.col(order).alias("nth")).where("abbr <> ''")
    return clean.groupBy("abbr").agg(F.min_by("kind", "nth").alias("kind"), F.array_sort(F.collect_set(F.lower("term"))).alias("aliases"))


def override_table(rows: DataFrame, decimal: str, fraction: str, order: str) -> DataFrame:
    """``decimal_key, fraction``: a house's own fractions, the last row of a number wins."""
    key = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.col(f"`{decimal}`").try_cast("double")), "0+$", ""), r"\.$", "")
    return rows.where(F.col(f"`{decimal}`").try_cast("double").isNotNull()).groupBy(key.alias("decimal_key")).agg(F.max_by(F.col(f"`{fraction}`"), order).alias("fraction"))


def master_table(rows: DataFrame, manufacturer: str, brand: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Manufacturers and brands of an official list: the first spelling of each key, and a
    brand's distinct owners in the order they came."""
    named = rows.select(trimmed(F.col(f"`{manufacturer}`")).alias("name"), trimmed(F.col(f"`{brand}`")).alias("brand"), F.col(order).alias("nth"))
    named = named.withColumns({"supplier_key": match_key(F.col("name")), "brand_key": match_key(F.col("brand"))})
    makers = named.where("name <> ''").groupBy("supplier_key").agg(F.min_by("name", "nth").alias("name"))
    pairs = named.where("brand <> ''").groupBy("brand_key", "name").agg(F.min("nth").alias("nth"), F.min_by("brand", "nth").alias("brand"))
    brands = pairs.groupBy("brand_key").agg(F.min_by("brand", "nth").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("owners"))
    return makers, brands


def taxonomy_rows(rows: DataFrame, classpath: str, label: str, value: str, order: str) -> DataFrame:
    """``classpath, levels, attributes``: a leaf's labels with their values, both as they came."""
    first = rows.select(trimmed(F.col(f"`{classpath}`")).alias("path"), trimmed(F.col(f"`{label}`")).alias("label"), trimmed(F.col(f"`{value}`")).alias("value"), F.col(order).alias("nth")).where("path <> ''")
    values = first.groupBy("path", "label", "value").agg(F.min("nth").alias("nth"))
    labels = values.groupBy("path", "label").agg(F.min("nth").alias("nth"), F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("nth", "value")))), lambda x: x["value"]).alias("values"))
    leaves = labels.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("label") != "", F.struct("nth", "label", "values")))).alias("found"))
    return leaves.select(
        F.col("path").alias("classpath"), F.transform(F.split("path", ">"), lambda x: F.trim(x)).alias("levels"),
        F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["values"].alias("values"))).alias("attributes"),
    )


def unions_first(frames: list[DataFrame], name: str) -> DataFrame:
    """Distinct names of several lists, case aside: of equal ones that of the earlier list,
    then the earlier row (``pos``)."""
    each = [df.select(F.col(name), "pos", F.lit(i).alias("source")) for i, df in enumerate(frames)]
    every = each[0]
    for df in each[1:]:
        every = every.unionByName(df)
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("source", "pos", name))
    return every.withColumn("nth", nth).where("nth = 1").drop("nth")


def known_alias(name: str) -> str | None:
    """The approved unit of a spelling, at plan time."""
    return name if name in UNITS else ALIASES.get(alias_key(name))
