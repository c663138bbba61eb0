"""The product record on small feeds: mentions, fuzzy names, templates, repairs, packs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from quarryline import packs
from quarryline.functions.text import token_set_ratio
from quarryline.operators import fuzzy, mentions, product, resolve
from quarryline.operators.feed import feed as part_feed

SF = "/root/testdata/sf0.001"
FEED = "row_index long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, DIB_Brand string, Part_Manuf string"


def feed(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FEED)


def found(spark, text):
    rows = spark.createDataFrame([(0, text)], "row_index long, Part_Desc string")
    got = mentions.best(rows, packs.aliases(spark)).collect()
    return got[0]["brand"] if got else None


def test_guarded_mentions(spark):
    assert found(spark, "kit by Iron Clad, large") == "Ironclad"
    assert found(spark, "ironclad head bolt") is None  # a word that rules brands out follows
    assert found(spark, "iron widget") == "Iron" and found(spark, "iron bolt") is None
    assert found(spark, "gt gear") == "GT" and found(spark, "GT") is None
    assert found(spark, "torque wrench") is None and found(spark, "Torque - set") == "Torque"
    assert found(spark, "ironclads") is None and found(spark, "") is None
    rows = spark.createDataFrame([(0, "iron clad widget, torque")], "row_index long, Part_Desc string")
    assert [m["alias"] for m in mentions.mentions(rows, packs.aliases(spark)).first()["mentions"]] == ["iron clad", "torque"]


def test_fuzzy_filter_loses_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(3, 9))) for _ in range(40)] + ["trading", "nation"]
    known = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) + rng.choice(["", " trading"]) for _ in range(120)})

    def spoilt(n):
        i = rng.randrange(len(n))
        return rng.choice([n[:i] + n[i + 1 :], n[:i] + "x" + n[i:], n + " co", n.split(" ")[0]])

    asked = sorted({spoilt(n) for n in known} | {"bosh", "zzz"})
    names = spark.createDataFrame([(n,) for n in [*known, "bosch"]], "name string")
    query = spark.createDataFrame([(a,) for a in asked], "asked string")
    pairs = spark.createDataFrame(list(itertools.product(asked, [*known, "bosch"])), "asked string, name string").withColumn("score", token_set_ratio("asked", "name"))
    best = {}
    for r in pairs.where("score >= 84").collect():
        best.setdefault(r["asked"], []).append((-r["score"], r["name"]))
    got = {r["asked"]: (r["name"], r["verdict"]) for r in fuzzy.matched(query, names).collect()}
    assert set(got) == set(asked) and got["bosh"] == ("bosch", "fuzzy") and got["zzz"] == (None, "unresolved")
    for a in asked:
        top = sorted(best.get(a, []))
        if not top or -top[0][0] < 88:
            assert got[a] == (None, "unresolved")
        else:
            rival = len(top) > 1 and top[1][0] - top[0][0] < 4
            assert got[a] == (top[0][1], "ambiguous" if rival else "fuzzy")


@pytest.fixture(scope="module")
def record(spark):
    return product.enriched(
        feed(
            spark,
            ("PL1", "PL1 old plate 12 in - Steel  Heavy Duty", "Acme", None, "Orla Inc (77)"),
            ("GE2", "GE2 large gear 4x.5x2 SS 3 1/2 inches", "Acme", "", "Orla Inc"),
            ("W3", "W3 red widget 8in 120V - Ultra Series w/ clip", None, "-- Unbranded --", "-"),
            ("W4", "W4 iron clad widget 8in", "N/A", None, "Dist Co"),
            ("", "", None, None, None),
            ("Q5", "Q5 nothing known", "Zed", "Zed", "Dist Co"),
        )
    ).cache()


def slots(record, i):
    return {a["label"]: (a["value"], a["uom"], a["method"]) for a in record.where(f"row_index = {i}").first()["attributes"]}


def test_extraction_cascade(record):
    gear = slots(record, 1)
    assert gear["Material"] == ("Stainless Steel", None, "lov_synonym")
    assert gear["Diameter"][:1] == ("4",) and gear["Thickness"] == ("1/2", "in", "dimension_chain")
    widget = slots(record, 2)
    assert widget["Series"] == ("Ultra Series", None, "regex") and widget["Voltage Rating"] == ("120", "V", "uom_scan")
    assert widget["Color"] == ("Red", None, "lov_exact") and widget["Model"] == ("W3", None, "input_restatement")


def test_unapproved_values_are_cleared(record):
    r = record.where("row_index = 0").first()
    assert [i["code"] for i in r["first_issues"] if i["severity"] == "error"] == ["lov_violation"]
    assert r["repairs"] == ["Duty: cleared unapproved value 'Heavy'"] and r["passes"] == 2
    assert slots(record, 0)["Duty"] == (None, None, "cleared_lov_violation")
    assert "unverified_clause" in [i["code"] for i in r["issues"]] and r["n_errors"] == 0


def test_brands_and_status(record):
    rows = {r["row_index"]: r for r in record.collect()}
    assert (rows[0]["brand"], rows[0]["brand_method"]) == ("Acme", "exact") and rows[0]["manufacturer"] == "Orla Inc"
    assert (rows[3]["brand"], rows[3]["brand_method"]) == ("Ironclad", "description_mention")
    assert rows[3]["descriptions"]["SHORT_DESC"].startswith("Ironclad® W4")
    assert rows[4]["status"] == "NEEDS_REVIEW" and rows[4]["leaf"] == packs.FALLBACK
    assert {"Brand unresolved", "Manufacturer unresolved", "Product could not be classified"} <= {f["reason"] for f in rows[4]["flags"]}
    for r in rows.values():
        assert len(r["descriptions"]["MOBILE_DESC"] or "") <= 80 and len(r["descriptions"]["INVOICE_DESC"] or "") <= 40
        assert 0 <= r["confidence"] <= 1 and len({(f["reason"], f["field"]) for f in r["flags"]}) == len(r["flags"])
    failed = product.reviewed(record.drop("flags", "status").withColumn("failure", F.lit("boom")), "failure").first()
    assert failed["status"] == "FAILED" and failed["flags"][0]["reason"] == "Processing error"


def test_the_feed_is_scanned_once(spark):
    from quarryline.plans.product import enriched_feed

    plan = enriched_feed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and plan.count("FileScan") <= 3


def test_empty_feed(spark):
    assert product.enriched(feed(spark, ("a", "b", "c", "d", "e")).where("false")).isEmpty()


def test_packs_from_files(spark, tmp_path):
    taxonomy = {"leaf_nodes": [{"id": "saw", "classpath": "Tools>Saws>Blades", "product_name": "Blade", "strong_keywords": ["saw blade"], "keywords": ["teeth"], "exclude_keywords": ["handle"], "attributes": [{"label": "Teeth", "extract_patterns": [r"(\d+) teeth", "("], "values": [{"value": "24", "synonyms": ["two dozen"]}]}]}, {"id": "any", "is_fallback": True}]}
    brands = {"brands": [{"canonical": "Orla", "aliases": ["orla", "or la"], "require_after": ["saw"]}], "guards": {"global_reject_after": ["tip"]}}
    for name, data in (("t", taxonomy), ("b", brands), ("a", {"abbreviations": {"Blade": "BLD"}})):
        (tmp_path / name).write_text(json.dumps(data))
    pack = packs.load(spark, f"file://{tmp_path}/t", f"file://{tmp_path}/b", f"file://{tmp_path}/a")
    assert pack.leaves[1].id == packs.FALLBACK and pack.brands[0].require_after == ("saw",) and pack.abbreviations == {"Blade": "BLD"}
    rows = feed(spark, ("S1", "S1 saw blade two dozen", None, None, None), ("S2", "S2 saw blade 60 teeth", None, None, None), ("S3", "S3 saw blade handle", None, None, None))
    p = product.extracted(product.classified(product.resolved(resolve.mentions(rows), pack), pack), pack).orderBy("row_index").collect()
    assert [r["leaf"] for r in p] == ["saw", "saw", packs.FALLBACK]
    assert [(r["attributes"][0]["value"], r["attributes"][0]["approved"]) for r in p[:2]] == [("24", True), ("60", False)]
    assert len(packs.extended(pack, ["orla", "New"]).brands) == 2


def test_dimension_tables(spark):
    units = spark.createDataFrame([(0, "in", "inch", "Length"), (1, "in", "Inches", "Size"), (2, "V", "volt", "Voltage")], "nth int, abbr string, term string, kind string")
    got = {r["abbr"]: r for r in packs.uom_table(units, "abbr", "term", "kind", "nth").collect()}
    assert got["in"]["kind"] == "Length" and got["in"]["aliases"] == ["inch", "inches"]
    fractions = spark.createDataFrame([(0, "0.1", "1/10"), (1, "0.10", "one tenth"), (2, "x", "y")], "nth int, d string, f string")
    assert [tuple(r) for r in packs.override_table(fractions, "d", "f", "nth").collect()] == [("0.1", "one tenth")]
    master = spark.createDataFrame([(0, "Orla Inc", "Zed"), (1, "Borun", "ZED"), (2, "ORLA", "Kay")], "nth int, m string, b string")
    makers, brands = packs.master_table(master, "m", "b", "nth")
    assert {r["supplier_key"]: r["name"] for r in makers.collect()} == {"orla": "Orla Inc", "borun": "Borun"}
    assert {r["brand_key"]: r["owners"] for r in brands.collect()} == {"zed": ["Orla Inc", "Borun"], "kay": ["ORLA"]}
    tree = spark.createDataFrame([(0, "A > B", "Color", "Red"), (1, "A > B", "Size", ""), (2, "A > B", "Color", "Blue"), (3, "A > B", "Color", "Red")], "nth int, c string, l string, v string")
    leaf = packs.taxonomy_rows(tree, "c", "l", "v", "nth").first()
    assert leaf["levels"] == ["A", "B"] and [a["label"] for a in leaf["attributes"]] == ["Color", "Size"] and leaf["attributes"][0]["values"][:2] == ["Red", "Blue"]


def test_joined_phrases_and_product_names(spark):
    leaves = (
        packs.Leaf("tools", "A>B>C", "Multi Tool Kit", ("multi tool",), ("kit",)),
        packs.Leaf("covers", "A>B>D", "Cover", ("cloth",), (), ("drop cloth",)),
        packs.Leaf(packs.FALLBACK, "", "Product"),
    )
    texts = ["Multitool red", "a multi/tool", "multi - tool", "multitoolkit", "multi toolkit", "MULTI-TOOL KIT", "multitools", "dropcloth cloth", "drop/cloth", "soft cloth", "cover", "multi"]
    p = spark.createDataFrame(list(enumerate(texts)), "row_index long, Part_Desc string")
    got = {texts[r["row_index"]]: {c["leaf"]: c["score"] for c in r["candidates"] or []} for r in product.classified(p, packs.Pack(leaves)).select("row_index", "candidates").collect()}
    assert got["Multitool red"] == got["a multi/tool"] == got["multi - tool"] == {"tools": 10.0}
    assert got["multitoolkit"] == got["multi toolkit"] == {"tools": 4.0}
    assert got["MULTI-TOOL KIT"] == {"tools": 10.0 + 3.0 + 4.0 + 1.0}
    assert got["dropcloth cloth"] == got["drop/cloth"] == got["multitools"] == got["multi"] == {}
    assert got["soft cloth"] == {"covers": 10.0} and got["cover"] == {"covers": 4.0}


def test_copies_are_read_once(spark, monkeypatch):
    texts = ["steel bolt 2 in", "ring 1-1/2 in SS Ultra Series", None, "", "heavy duty gear 4x2x1"]
    rows = [(i, f"AB{i}", texts[i % 5], ("fasteners", "rings", "gears")[i % 3]) for i in range(150)]
    p = spark.createDataFrame(rows, "row_index long, Mfg_Part_Num string, Part_Desc string, leaf string")
    row_wise = product.extracted(p)
    plain = {r["row_index"]: r["attributes"] for r in row_wise.collect()}
    real, seen = product._read, []
    monkeypatch.setattr(product, "_read", lambda keys, *rest: seen.append(keys.count()) or real(keys, *rest))
    once = product.extracted_once(p)
    assert {r["row_index"]: r["attributes"] for r in once.collect()} == plain and len(plain) == 150
    assert seen == [15] and sorted(once.columns) == sorted(row_wise.columns)


def test_fan_out_joins_no_row_to_itself(spark):
    rows = spark.createDataFrame([(1, "k", "Ironclad bolt", []), (2, "k", "bolt", [("0", "Acme")]), (3, None, "Ironclad bolt", [])], "row_index long, supplier_key string, Part_Desc string, brands array<struct<nth:string,brand:string>>")
    fan = product.widened_fan_out(rows)
    assert [tuple(r) for r in fan.collect()] == [("k", 2, False)]
    assert fan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the lexicon, never rows with rows


def test_only_repaired_products_are_checked_twice(spark, monkeypatch):
    seen, check = [], product.checked

    def counted(p, *args):
        seen.append(p.count())
        return check(p, *args)

    monkeypatch.setattr(product, "checked", counted)
    p = product.enriched(part_feed(spark, "/root/testdata/sf0.001"), stages=("inference", "extraction", "descriptions", "validation"))
    again = p.where("passes = 2").count()
    assert seen == [p.count(), again] and again < seen[0]
    assert p.where("passes = 1 AND first_issues <> issues").isEmpty()
