import pytest
from pyspark.sql import functions as F
from quarryline.functions import links, measures, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)


def applied(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_fractions(spark):
    given = [0.5, 0.25, 0.015625, 50.25, 33.4375, 22.625, 23.875, 50.1875, 10.375, 7.0, 0.0, 3.14159, 0.333, -0.5, None]
    wanted = ["1/2", "1/4", "1/64", "50-1/4", "33-7/16", "22-5/8", "23-7/8", "50-3/16", "10-3/8", "7", "0", None, None, "-1/2", None]
    assert applied(spark, given, measures.to_fraction, "double") == wanted
    assert applied(spark, ["50-1/4", "33 7/16", "1/2", "7", "Leg", "1/0", None], measures.from_fraction) == [50.25, 33.4375, 0.5, 7.0, None, None, None]


def test_units(spark):
    given = ["inches", "IN.", "in", "VOLTS", "amp", "dba", "kwh", "Hours", "lumens", "flurbles", None]
    assert applied(spark, given, measures.unit) == ["in", "in", "in", "V", "A", "dBA", "kW-hr", "hr", "lm", None, None]
    assert applied(spark, ["24"], lambda c: measures.measure(c, F.lit("inches"))) == ["24 in"]
    assert applied(spark, ["50-1/4"], lambda c: measures.measure(c, F.lit("in"), compact=True)) == ["50-1/4IN"]


def test_sentinels(spark):
    absent = ["xxx", "0", "see notes", "empty", "-- anything --", "not found", "-- Unbranded --", "-- No DIB Brand --", "-", "N/A", "", "   ", "COMMODITY - UNBRANDED", "TBD", "null", None]
    assert all(applied(spark, absent, text.is_placeholder))
    assert not any(applied(spark, ["ORLA", "Borun Inc (7711)", "see map"], text.is_placeholder))
    once = applied(spark, [" a  b c ", "y"], text.clean)
    assert once == ["a b c", "y"] and applied(spark, once, text.clean) == once


def test_company_keys(spark):
    keys = applied(spark, ["Borun Inc (7711)", "BORUN, INC.", "Borun Systems LLP", "borun", "Inc"], text.match_key)
    assert keys == ["borun", "borun", "borun", "borun", "inc"]
    assert applied(spark, keys, text.match_key) == keys
    assert applied(spark, ["Borun Inc (7711)", "Plain"], text.name_of) == ["Borun Inc", "Plain"]
    assert applied(spark, ["Borun Inc (7711)", "Plain"], text.code_of) == ["7711", None]


def test_text(spark):
    assert applied(spark, ["CafÃ©", "Café", "plain", None], text.repaired) == ["Café", "Café", "plain", None]
    assert applied(spark, ["CafÃ©", "Boostâ„¢ Â®", "Ã alone", "Café", None], text.mended) == ["Café", "Boost™ ®", "Ã alone", "Café", None]
    assert applied(spark, ["Sheet A100 - Red - 20 a Box"], text.segments)[0] == ["Sheet A100", "Red", "20 a Box"]
    assert applied(spark, ["A-B 1: Saw", "AB1X Saw"], lambda c: text.without_leading(c, F.lit("A-B"))) == ["1: Saw", "AB1X Saw"]
    assert applied(spark, ["AB1 - Saw", "Saw"], lambda c: text.without_leading(c, F.lit("AB1"))) == ["Saw", "Saw"]
    assert applied(spark, ["short", "a" * 90 + " tail words", "b" * 200], lambda c: text.truncated(c, 100)) == ["short", "a" * 90 + " tail", "b" * 100]
    assert applied(spark, ["Kit Wide - w/round oak Posts", "none"], text.with_clause) == ["With Round Oak Posts", None]
    titles = applied(spark, ["the built-in 5wash of LEDs", "led/usb hub", "CleanBoost", ""], text.title_case)
    assert titles == ["The Built-In 5Wash of LEDs", "LED/USB Hub", "CleanBoost", ""]
    brief = applied(spark, ["Black Stainless Steel steelcase", "steel"], lambda c: text.abbreviated(c, {"Steel": "STL", "Stainless Steel": "SST", "Black Stainless Steel": "BSST"}))
    assert brief == ["BSST steelcase", "STL"]


def test_measures_in_text(spark):
    found = applied(spark, ['5"x.045"x7/8" wheel 120V 6pc', "4-1/2 x 1/8 in", "plain"], measures.typed_measures)
    assert [(m["value"], m["unit"]) for m in found[0]] == [("5", "in"), ("0.045", "in"), ("7/8", "in"), ("120", "V"), ("6", "pc")]
    assert [(m["value"], m["kind"]) for m in found[1]] == [("1/8", "Length")] and found[2] == []
    assert applied(spark, [".045", "0.5", "33 7/16", "2.3", "leg"], measures.house_measure) == ["0.045", "1/2", "33-7/16", "2.3", None]
    assert applied(spark, [0.1], lambda c: measures.to_fraction(c, F.lit("1/10")), "double") == ["1/10"]
    table = measures.fraction_table(spark).collect()
    assert len(table) == 63 and all(r["numerator"] % 2 and r["value"] == r["numerator"] / r["denominator"] for r in table)


def test_links(spark):
    urls = ["https://www.amazon.com/x", "https://www.whirlpool.com/p/W1", "https://www.grainger.com/a", "https://www.trex.com/", "https://whirlpool.com/m.pdf", None]
    kinds = applied(spark, ["user manual.pdf", "sds sheet", "x.pdf", "y"], links.document_kind)
    assert kinds == ["Owners/User Manual", "SDS", "Technical Bulletin", None]
    tiers = applied(spark, urls, lambda c: links.tier(c, F.lit("Whirlpool")))
    assert tiers[:5] == ["blocked", "product_page", "distributor", "other", "manufacturer_doc"]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("borun inc", "inc borun", 100, 100), ("borun", "borun tools", 100, 100), ("bosh", "bosch", 88, 89), ("abc", "xyz", 0, 40)])
def test_word_set_similarity(spark, a, b, low, high):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.token_set_ratio("a", "b")).first()[0]
    assert low <= got <= high


def test_cleaning_stays_small_in_plans(spark):
    from quarryline import registry

    plan = registry.queries()["brand_owner_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
