"""Fractions, units and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENOMINATORS = [2, 4, 8, 16, 32, 64]

# Approved units, what each measures, and its spellings; of equal spellings the first counts.
_UNITS = """
in;Length;in|in.|inch|inches|"|''
ft;Length;ft|ft.|foot|feet|'
yd;Length;yd|yard|yards
mm;Length;mm|millimeter|millimetre|millimeters|millimetres
cm;Length;cm|centimeter|centimetre|centimeters|centimetres
m;Length;m|meter|metre|meters|metres
mil;Length;mil|mils|thou
sq ft;Area;sq ft|sqft|ft2|square foot|square feet
sq in;Area;sq in|sqin|in2|square inch|square inches
cu ft;Volume;cu ft|cuft|ft3|cubic foot|cubic feet|cf
gal;Volume;gal|gallon|gallons
qt;Volume;qt|quart|quarts
fl oz;Volume;fl oz|floz|fluid ounce|fluid ounces
L;Volume;l|liter|litre|liters|litres
mL;Volume;ml|milliliter|millilitre|milliliters
lb;Weight;lb|lbs|lb.|pound|pounds
oz;Weight;oz|oz.|ounce|ounces
kg;Weight;kg|kilogram|kilograms
g;Weight;g|gram|grams
V;Voltage;v|volt|volts|vac|vdc|v ac|v dc
A;Amperage;a|amp|amps|ampere|amperes
mA;Amperage;ma|milliamp|milliamps|milliampere
W;Power;w|watt|watts
kW;Power;kw|kilowatt|kilowatts
hp;Power;hp|horsepower
kW-hr;Energy;kw-hr|kwh|kw hr|kilowatt hour|kilowatt-hour|kwhr
Hz;Frequency;hz|hertz|cycles per second
Ah;Charge;ah|amp hour|amp-hour|amp hours|ampere hour
ohm;Resistance;ohm|ohms
VA;Apparent Power;va|volt-ampere|volt ampere
lm;Luminous Flux;lm|lumen|lumens
K;Color Temperature;k|kelvin
CRI;Color Rendering;cri
fc;Illuminance;fc|footcandle|foot-candle|footcandles
dBA;Sound Level;dba|db(a)|decibel a
dB;Sound Level;db|decibel|decibels
rpm;Rotational Speed;rpm|revolutions per minute|r/min
spm;Stroke Rate;spm|strokes per minute
bpm;Blow Rate;bpm|blows per minute
fpm;Linear Speed;fpm|feet per minute|ft/min|sfpm
mph;Speed;mph|miles per hour
cfm;Air Flow;cfm|cubic feet per minute|ft3/min
gpm;Flow Rate;gpm|gallons per minute|gal/min
psi;Pressure;psi|pounds per square inch|lb/in2
bar;Pressure;bar|bars
in-lb;Torque;in-lb|in lb|inch pound|inch-pounds|in.lbs
ft-lb;Torque;ft-lb|ft lb|foot pound|foot-pounds|ft.lbs
Nm;Torque;nm|newton meter|newton-meter|n-m
lbf;Force;lbf|pound force|pound-force
deg F;Temperature;deg f|degf|fahrenheit
deg C;Temperature;deg c|degc|celsius|centigrade
hr;Time;hr|hrs|hour|hours|h
min;Time;min|mins|minute|minutes
sec;Time;sec|secs|second|seconds|s
yr;Time;yr|yrs|year|years
ea;Count;ea|each
pk;Count;pk|pack|packs
pc;Count;pc|pcs|piece|pieces|ct|count
bx;Count;bx|box|boxes
rl;Count;rl|roll|rolls
bdl;Count;bdl|bundle|bundles
pr;Count;pr|pair|pairs
set;Count;set|sets
gr;Abrasive Grit;grit|gr
BTU;Heat;btu|btus|british thermal unit
gauge;Gauge;gauge|ga|ga.|gge
AWG;Wire Gauge;awg|american wire gauge
tooth;Tooth Count;tooth|teeth|tpi
"""
_ROWS = [line.split(";") for line in _UNITS.strip().splitlines()]
UNITS = {unit: names for unit, _, names in _ROWS}
TYPES = {unit: kind for unit, kind, _ in _ROWS}


def alias_key(name: str) -> str:
    """How a unit's spelling is looked up, as ``unit_key`` has it for columns."""
    import re

    return re.sub(r"[\s._]+", " ", name.strip().lower().replace("°", "deg ")).strip()


ALIASES = {alias_key(alias): unit for unit, names in reversed(UNITS.items()) for alias in names.split("|")}


def decimal_key(x: Column) -> Column:
    """A number as text without trailing zeros, to look overrides up by."""
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", ""))


def to_fraction(x: Column, override: Column | None = None) -> Column:
    """A decimal on the ladder of 64ths as ``7``, ``1/2`` or ``50-1/4``; else null.

    ``override`` is a house's own spelling of the number, which goes first.
    """
    v = F.abs(x)
    whole = F.floor(v)
    rest = v - whole
    out = F.when(F.abs(v - F.round(v)) <= 1e-6, F.format_string("%d", F.round(v).cast("long")))
    for d in DENOMINATORS:
        n = F.floor(rest * d + 0.5)
        text = F.format_string(f"%d/{d}", n.cast("long"))
        out = out.when(F.abs(rest * d - n) <= 1e-6, F.when(whole > 0, F.concat(F.format_string("%d-", whole.cast("long")), text)).otherwise(text))
    out = F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)
    return out if override is None else F.coalesce(override, out)


def house_measure(c: Column) -> Column:
    """A number in house style (``.5`` as ``1/2``); one off the ladder as it is, with a zero
    before its point; anything else null."""
    whole = F.regexp_replace(F.trim(c), r"^\.([0-9]+)$", "0.$1")
    number = F.when(whole.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), whole.try_cast("double"))
    return F.when(number.isNotNull(), F.coalesce(to_fraction(number), whole)).when(from_fraction(whole).isNotNull(), F.regexp_replace(whole, r"^([0-9]+)[- ]+([0-9])", "$1-$2"))


def decimals_in_text(c: Column) -> Column:
    """Each decimal number of a text in house style where it lies on the ladder."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]*\.?[0-9]+|[^0-9.]+|\.)"), 1)
    is_decimal = lambda p: p.rlike(r"^[0-9]*\.[0-9]+$")
    return F.array_join(F.transform(parts, lambda p: F.when(is_decimal(p), F.coalesce(to_fraction(p.try_cast("double")), p)).otherwise(p)), "")


def fraction_table(spark) -> DataFrame:
    """``fraction, numerator, denominator, value``: every fraction of the ladder below one."""
    n = spark.range(1, 64).select(F.col("id").alias("n64"))
    low = F.aggregate(F.array(*map(F.lit, (32, 16, 8, 4, 2))), F.lit(64), lambda d, k: F.when(F.col("n64") % F.floor(F.lit(64) / k) == 0, k).otherwise(d))
    return n.withColumn("denominator", low.cast("long")).select(
        F.format_string("%d/%d", F.floor(F.col("n64") * F.col("denominator") / 64).cast("long"), F.col("denominator")).alias("fraction"),
        F.floor(F.col("n64") * F.col("denominator") / 64).cast("long").alias("numerator"), "denominator", (F.col("n64") / 64.0).alias("value"),
    )


def from_fraction(c: Column) -> Column:
    """``50-1/4``, ``33 7/16``, ``1/2`` or ``7`` as a double; null for anything else."""
    mixed = r"^ *(?:([0-9]+)[- ]+)?([0-9]+)/([0-9]+) *$"
    whole = F.coalesce(F.try_to_number(F.regexp_extract(c, mixed, 1), F.lit("99999999")).cast("double"), F.lit(0.0))
    part = F.try_divide(F.expr("1.0D") * F.regexp_extract(c, mixed, 2).try_cast("double"), F.regexp_extract(c, mixed, 3).try_cast("double"))
    return F.when(c.rlike(mixed), whole + part).when(c.rlike(r"^ *[0-9]+(\.[0-9]+)? *$"), F.trim(c).try_cast("double"))


def unit_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("°"), F.lit("deg ")), r"[\s._]+", " "))


def _looked_up(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def unit(c: Column) -> Column:
    """The approved unit of a spelling; null for an unknown one."""
    return F.when(c.isin(*UNITS), c).otherwise(_looked_up(ALIASES, unit_key(c)))


def unit_type(c: Column) -> Column:
    """What an approved unit measures."""
    return _looked_up(TYPES, c)


def unit_confidence(c: Column) -> Column:
    """1 for an approved unit as it is, 0.95 for another spelling, 0 for an unknown one."""
    return F.when(c.isin(*UNITS), 1.0).when(unit(c).isNotNull(), 0.95).otherwise(0.0)


def measure(value: Column, u: Column, compact: bool = False) -> Column:
    """``24 in``, or ``24IN`` for tight places; an unknown unit as it is."""
    u = F.coalesce(unit(u), u)
    return F.concat(value, F.replace(F.upper(u), F.lit(" "), F.lit(""))) if compact else F.concat_ws(" ", value, u)


MEASURE = r"([0-9]+(?:\.[0-9]+)?) ?([A-Za-z\"']+)"


def measures(c: Column) -> Column:
    """All number-unit pairs with a known unit, as ``value, unit``, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(MEASURE), 1).alias("value"), F.regexp_extract_all(c, F.lit(MEASURE), 2).alias("unit"))
    named = F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), unit(p["unit"]).alias("unit")))
    return F.filter(named, lambda p: p["unit"].isNotNull())


CHAIN = r"([0-9]+(?:\.[0-9]+)?) ?[xX] ?([0-9]+(?:\.[0-9]+)?)(?: ?[xX] ?([0-9]+(?:\.[0-9]+)?))?"


def chain(c: Column) -> Column:
    """The first ``a x b [x c]`` as an array of its two or three numbers; empty without one."""
    got = F.array(*[F.regexp_extract(c, CHAIN, i) for i in (1, 2, 3)])
    return F.filter(got, lambda s: s != "")


# A measure anywhere in a text: the longest form of the number first.
NUMBER = r"(?:[0-9]+\s*-\s*[0-9]+\s*/\s*[0-9]+|[0-9]+\s*/\s*[0-9]+|[0-9]*\.[0-9]+|[0-9]+)"
ANY_MEASURE = rf"(?:^|[^A-Za-z0-9.])({NUMBER})\s*([A-Za-z\"']{{1,6}})(?:[^A-Za-z0-9]|$)"
PACK = r"(?i)(?:^|[^A-Za-z0-9])([0-9]{1,4})\s*(?:pc|pcs|pk|pack|ct|count|disc|sheets?|piece)s?(?:[^A-Za-z0-9_]|$)"


def unchained(c: Column) -> Column:
    """``5"x.045"`` as ``5"  .045"``, so that each number stands alone; every blank is
    doubled, as neighbouring measures must not share one."""
    apart = F.regexp_replace(F.regexp_replace(c, r"([0-9\"'])\s*[xX]\s*([0-9.])", "$1 $2"), r"([0-9\"'])\s*[xX]\s*([0-9.])", "$1 $2")
    return F.regexp_replace(apart, " ", "  ")


def typed_measures(c: Column) -> Column:
    """All measures with a known unit, as ``value, unit, kind``: values in house style."""
    text = unchained(c)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ANY_MEASURE), 1).alias("value"), F.regexp_extract_all(text, F.lit(ANY_MEASURE), 2).alias("unit"))
    named = F.transform(pairs, lambda p: F.struct(house_measure(F.regexp_replace(p["value"], r"\s+", "")).alias("value"), unit(p["unit"]).alias("unit"), unit_type(unit(p["unit"])).alias("kind")))
    return F.filter(named, lambda p: p["unit"].isNotNull() & p["value"].isNotNull())
