"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, measures, text
from ..operators.feed import feed
from .sqltext import FEED_SQL, UNIT_MAP, clean, match_key, placeholder, quoted, round_half_up, title_sql, trimmed


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def placeholder_filter(spark, d):
    return feed(spark, d).where(text.is_placeholder(F.col("E1_Brand"))).select("row_index", "E1_Brand")


def clean_values(spark, d):
    return feed(spark, d).select("row_index", *[text.clean(F.col(c)).alias(c) for c in ("Part_Desc", "E1_Brand", "DIB_Brand", "Part_Manuf")])


def match_keys(spark, d):
    return feed(spark, d).select("Part_Manuf", text.match_key(F.col("Part_Manuf")).alias("key")).distinct()


def name_codes(spark, d):
    return feed(spark, d).select("Part_Manuf", text.name_of(F.col("Part_Manuf")).alias("name"), text.code_of(F.col("Part_Manuf")).alias("code")).distinct()


def strip_part_number(spark, d):
    return feed(spark, d).select("row_index", text.without_leading(F.col("Part_Desc"), F.col("Mfg_Part_Num")).alias("rest"))


def desc_segments(spark, d):
    return feed(spark, d).select("row_index", F.posexplode(text.segments(F.col("Part_Desc"))).alias("nth", "segment"))


def truncate_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 120).alias("head"))


def with_clauses(spark, d):
    said = text.with_clause(F.col("Part_Desc"))
    return feed(spark, d).select("row_index", said.alias("said")).where("said IS NOT NULL")


def title_cases(spark, d):
    """Descriptions in title case, with slashes, hyphens, acronyms and small words put in."""
    odd = F.concat_ws(" ", F.lower("p_name"), F.lit("of the led/usb"), F.concat(F.lower("p_type"), F.lit("-built")), F.concat(F.col("p_size").cast("string"), F.lit("v")), F.lit("CleanBoost kit"))
    return _t(spark, d, "part").select("p_partkey", text.title_case(odd).alias("title"), text.sentence_case(odd).alias("sentence"))


def canonical_forms(spark, d):
    """The ways a name is brought to one form: header, slug, file name, exact term, comparison."""
    odd = F.concat(F.lit("  "), F.col("p_name"), F.lit(" (No. "), F.col("p_size").cast("string"), F.lit(") ®; "))
    forms = {"header": text.column_form, "slug": text.slug, "file": text.file_form, "term": text.exact_form, "compared": text.compared}
    return _t(spark, d, "part").select("p_partkey", *[f(odd).alias(n) for n, f in forms.items()], F.array_join(text.compared_tokens(odd), ",").alias("tokens"))


def mended_text(spark, d):
    """Names spoilt as UTF-8 read in Windows-1252, mended; the whole ones stay."""
    odd = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " cafÃ©").when(F.col("p_partkey") % 4 == 1, " Boostâ„¢").when(F.col("p_partkey") % 4 == 2, " Ã alone").otherwise(" café"))
    return _t(spark, d, "part").select("p_partkey", text.mended(odd).alias("mended"))


def house_measures(spark, d):
    """Numbers in house style, keys of overrides, decimals inside a text."""
    odd = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), F.lpad((F.col("p_size") * 125).cast("string"), 4, "0"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" 3/8"))).otherwise((F.col("p_size") / 16).cast("string"))
    number = F.col("p_size") / 16
    line = F.concat_ws(" ", F.lit("about"), (F.col("p_size") / 8).cast("string"), F.lit("in wide"))
    return _t(spark, d, "part").select("p_partkey", measures.house_measure(odd).alias("house"), measures.decimal_key(number).alias("key"), measures.decimals_in_text(line).alias("line"))


def fraction_table(spark, d):
    return measures.fraction_table(spark)


def unit_spellings(spark, d):
    """Units in several spellings: approved unit, what it measures, how sure, in a measure."""
    said = ["in", "Inches", "IN.", '"', "FT.", "kWh", "V", "volts", "°F", "sq  ft", "dB(A)", "zz", "lbs", "Ah", "teeth"]
    named = F.get(F.array(*map(F.lit, said)), (F.col("p_partkey") % len(said)).cast("int"))
    u = _t(spark, d, "part").select("p_partkey", named.alias("said"), F.col("p_size").cast("string").alias("n"))
    full = measures.measure(F.col("n"), F.col("said"))
    return u.select("p_partkey", "said", measures.unit(F.col("said")).alias("unit"), measures.unit_type(measures.unit(F.col("said"))).alias("kind"), measures.unit_confidence(F.col("said")).alias("sure"), full.alias("measure"), measures.measure(F.col("n"), F.col("said"), compact=True).alias("tight"))


def abbreviated_names(spark, d):
    """Phrases by their abbreviations, whole words alone, the longest first."""
    odd = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " in Black Stainless Steel").otherwise(" steelcase, stainless steel"))
    return _t(spark, d, "part").select("p_partkey", text.abbreviated(odd, ABBREVIATIONS).alias("brief"))


def fractions_ladder(spark, d):
    return _t(spark, d, "part").select("p_partkey", measures.to_fraction(F.col("p_size") / 8).alias("fraction"))


def fraction_roundtrip(spark, d):
    f = measures.to_fraction(F.col("p_size") / 16)
    return _t(spark, d, "part").select("p_partkey", f.alias("fraction"), measures.from_fraction(f).alias("value"))


def uom_resolve(spark, d):
    words = _t(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    return words.distinct().select("word", measures.unit(F.col("word")).alias("unit")).where("unit IS NOT NULL")


def measure_extract(spark, d):
    m = measures.measures(F.col("Part_Desc"))
    return feed(spark, d).select("row_index", F.posexplode(m).alias("nth", "m")).select("row_index", "nth", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"), measures.measure(F.col("m.value"), F.col("m.unit"), compact=True).alias("compact"))


def dimension_chain(spark, d):
    c = measures.chain(F.col("Part_Desc"))
    return feed(spark, d).select("row_index", *[F.get(c, F.lit(i)).alias(f"d{i + 1}") for i in range(3)]).where("d1 IS NOT NULL")


def alpha_prefixes(spark, d):
    return feed(spark, d).select("row_index", *[text.alpha_prefix(F.col("Mfg_Part_Num"), n).alias(f"p{n}") for n in (3, 4, 5)])


def url_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", links.host(F.col("url")).alias("host"), F.try_parse_url(F.col("url"), F.lit("PATH")).alias("path"))


def url_classify(spark, d):
    brand = F.when(F.col("page_id") % 3 == 0, "ththth").otherwise("thther")
    tier = links.tier(F.col("url"), brand)
    score = F.element_at(F.create_map(*[x for k, v in links.TIER_SCORE.items() for x in (F.lit(k), F.lit(v))]), tier)
    return _t(spark, d, "pages").select("page_id", tier.alias("tier"), score.alias("score"))


def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def hash_key(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.substring(F.sha2(F.col("text"), 256), 1, 32).alias("key"))


_T = "(^|[^A-Za-z0-9])w/ *(.+)$"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"


def fraction_sql(x: str) -> str:
    v, whole = f"abs({x})", f"floor(abs({x}))"
    out = f"CASE WHEN abs({v} - round({v})) <= 1e-6 THEN CAST(CAST(round({v}) AS BIGINT) AS VARCHAR)"
    for n in measures.DENOMINATORS:
        k = f"floor(({v} - {whole}) * {n} + 0.5e0)"
        out += f" WHEN abs(({v} - {whole}) * {n} - {k}) <= 1e-6 THEN CASE WHEN {whole} > 0 THEN CAST(CAST({whole} AS BIGINT) AS VARCHAR) || '-' ELSE '' END || CAST(CAST({k} AS BIGINT) AS VARCHAR) || '/{n}'"
    return out + " END"


_MEASURE = measures.MEASURE.replace("'", "''")


def _tier() -> str:
    of = lambda ds: "(" + " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in ds) + ")"
    own = "contains(regexp_replace(h, '[^a-z0-9]', '', 'g'), brand)"
    return f"""
WITH a AS (SELECT page_id, url, {_HOST} AS h, CASE WHEN page_id % 3 = 0 THEN 'ththth' ELSE 'thther' END AS brand FROM pages),
b AS (SELECT page_id, CASE WHEN h = '' OR {of(links.BLOCKED)} THEN 'blocked' WHEN {own} AND regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'manufacturer_doc'
      WHEN {own} AND regexp_matches(lower(url), '/(p|product|products|item)/') THEN 'product_page' WHEN {own} THEN 'manufacturer_site'
      WHEN {of(links.RESELLERS)} THEN 'distributor' ELSE 'other' END AS tier FROM a)
SELECT page_id, tier, CASE tier {" ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in links.TIER_SCORE.items())} END AS score FROM b"""


_CHAIN = measures.CHAIN
ABBREVIATIONS = {"Stainless Steel": "SST", "Black Stainless Steel": "BSST", "Steel": "STL", "Large": "LRG", "Small": "SML", "Gear": "GR"}


def _brief(c: str) -> str:
    out = trimmed(c)
    for phrase in sorted(ABBREVIATIONS, key=len, reverse=True):
        out = f"regexp_replace({out}, '(?i)\\b{phrase}\\b', '{ABBREVIATIONS[phrase]}', 'g')"
    return out


_ODD_TITLE = "lower(p_name) || ' of the led/usb ' || lower(p_type) || '-built ' || CAST(p_size AS VARCHAR) || 'v CleanBoost kit'"
_ODD_NAME = "'  ' || p_name || ' (No. ' || CAST(p_size AS VARCHAR) || ') ®; '"
_SAID = ["in", "Inches", "IN.", '"', "FT.", "kWh", "V", "volts", "°F", "sq  ft", "dB(A)", "zz", "lbs", "Ah", "teeth"]
_UNITS_SQL = "CASE WHEN said IN (" + ", ".join(map(quoted, measures.UNITS)) + f") THEN said ELSE {UNIT_MAP}[trim(regexp_replace(replace(lower(trim(said)), '°', 'deg '), '[\\s._]+', ' ', 'g'))] END"
_TYPES_SQL = "MAP {" + ", ".join(f"{quoted(u)}: {quoted(k)}" for u, k in measures.TYPES.items()) + "}"
_NUMERIC = "CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN coalesce({f}, {x}) ELSE regexp_replace({x}, '^([0-9]+)[- ]+([0-9])', '\\1-\\2') END"

QUERIES = {
    "title_cases": (title_cases, f"SELECT p_partkey, {title_sql(f'({_ODD_TITLE})')} AS title, upper(substr(({_ODD_TITLE}), 1, 1)) || substr(({_ODD_TITLE}), 2) AS sentence FROM part"),
    "canonical_forms": (
        canonical_forms,
        f"""WITH o AS (SELECT p_partkey, {_ODD_NAME} AS x FROM part), c AS (SELECT *, trim(regexp_replace(translate(lower(trim(x)), '®™©', ''), '\\s+', ' ', 'g'), ' .,;') AS compared FROM o)
        SELECT p_partkey, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS header, trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(trim(x), '[^A-Za-z0-9.-]+', '-', 'g'), '-') AS file,
               trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS term, compared, array_to_string(list_filter(regexp_split_to_array(compared, '[^a-z0-9/.-]+'), lambda t: t <> '' AND t NOT IN ({", ".join(map(quoted, text.STOP))})), ',') AS tokens FROM c""",
    ),
    "mended_text": (mended_text, "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' café' WHEN 1 THEN ' Boost™' WHEN 2 THEN ' Ã alone' ELSE ' café' END AS mended FROM part"),
    "house_measures": (
        house_measures,
        f"""WITH o AS (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN '0.' || lpad(CAST(p_size * 125 AS VARCHAR), 4, '0') WHEN 1 THEN CAST(p_size AS VARCHAR) || ' 3/8' ELSE CAST(p_size / 16e0 AS VARCHAR) END AS x FROM part)
        SELECT p_partkey, {_NUMERIC.format(x="x", f=fraction_sql("TRY_CAST(x AS DOUBLE)"))} AS house, regexp_replace(regexp_replace(printf('%.10f', p_size / 16e0), '0+$', ''), '\\.$', '') AS key,
               'about ' || {fraction_sql("p_size / 8e0")} || ' in wide' AS line FROM o""".replace("' in wide' AS line", "' in wide' AS line"),
    ),
    "fraction_table": (fraction_table, "WITH n AS (SELECT unnest(range(1, 64)) AS k) SELECT CAST(k // gcd(k, 64) AS VARCHAR) || '/' || CAST(64 // gcd(k, 64) AS VARCHAR) AS fraction, k // gcd(k, 64) AS numerator, 64 // gcd(k, 64) AS denominator, k / 64e0 AS value FROM n"),
    "unit_spellings": (
        unit_spellings,
        f"""WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, [{", ".join(map(quoted, _SAID))}][p_partkey % {len(_SAID)} + 1] AS said FROM part), u AS (SELECT *, {_UNITS_SQL} AS unit FROM s)
        SELECT p_partkey, said, unit, {_TYPES_SQL}[unit] AS kind, CASE WHEN unit IS NULL THEN 0e0 WHEN unit = said THEN 1e0 ELSE 0.95e0 END AS sure, n || ' ' || coalesce(unit, said) AS measure, n || replace(upper(coalesce(unit, said)), ' ', '') AS tight FROM u""",
    ),
    "abbreviated_names": (abbreviated_names, "WITH o AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' in Black Stainless Steel' ELSE ' steelcase, stainless steel' END AS x FROM part) SELECT p_partkey, " + _brief("x") + " AS brief FROM o"),
    "placeholder_filter": (placeholder_filter, f"WITH {FEED_SQL} SELECT row_index, E1_Brand FROM feed WHERE {placeholder('E1_Brand')}"),
    "clean_values": (clean_values, f"WITH {FEED_SQL} SELECT row_index, {', '.join(f'{clean(c)} AS {c}' for c in ('Part_Desc', 'E1_Brand', 'DIB_Brand', 'Part_Manuf'))} FROM feed"),
    "match_keys": (match_keys, f"WITH {FEED_SQL} SELECT DISTINCT Part_Manuf, {match_key('Part_Manuf')} AS key FROM feed"),
    "name_codes": (
        name_codes,
        f"WITH {FEED_SQL} SELECT DISTINCT Part_Manuf, CASE WHEN regexp_matches(Part_Manuf, {quoted(text.NAME_CODE)}) THEN regexp_extract(Part_Manuf, {quoted(text.NAME_CODE)}, 1) ELSE Part_Manuf END AS name, CASE WHEN regexp_matches(Part_Manuf, {quoted(text.NAME_CODE)}) THEN regexp_extract(Part_Manuf, {quoted(text.NAME_CODE)}, 2) END AS code FROM feed",
    ),
    "strip_part_number": (strip_part_number, f"WITH {FEED_SQL} SELECT row_index, CASE WHEN starts_with(lower(Part_Desc), lower(Mfg_Part_Num)) THEN ltrim(substr(Part_Desc, length(Mfg_Part_Num) + 1), ' -,:') ELSE Part_Desc END AS rest FROM feed"),
    "desc_segments": (
        desc_segments,
        f"WITH {FEED_SQL}, s AS (SELECT row_index, list_filter(list_transform(regexp_split_to_array(Part_Desc, ' +[-–] +'), lambda x: trim(x)), lambda x: x <> '') AS l FROM feed) SELECT row_index, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nth, unnest(l) AS segment FROM s",
    ),
    "truncate_words": (
        truncate_words,
        "WITH c AS (SELECT doc_id, text, substr(text, 1, 120) AS cut FROM documents) SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN contains(substr(cut, 101, 20), ' ') THEN rtrim(regexp_extract(cut, '^(.*) [^ ]*$', 1), ' ,;-') ELSE cut END AS head FROM c",
    ),
    "with_clauses": (
        with_clauses,
        f"WITH {FEED_SQL}, s AS (SELECT row_index, trim({trimmed(f"regexp_extract(Part_Desc, '{_T}', 2)")}, ' -,') AS t FROM feed) SELECT row_index, 'With ' || {title_sql('t')} AS said FROM s WHERE length(t) >= 3",
    ),
    "fractions_ladder": (fractions_ladder, f"SELECT p_partkey, {fraction_sql('p_size / 8.0e0')} AS fraction FROM part"),
    "fraction_roundtrip": (fraction_roundtrip, f"SELECT p_partkey, {fraction_sql('p_size / 16.0e0')} AS fraction, p_size / 16.0e0 AS value FROM part"),
    "uom_resolve": (
        uom_resolve,
        f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), u AS (SELECT word, {UNIT_MAP}[word] AS unit FROM w) SELECT word, unit FROM u WHERE unit IS NOT NULL",
    ),
    "measure_extract": (
        measure_extract,
        f"WITH {FEED_SQL}, p AS (SELECT row_index, list_filter(list_transform(list_zip(regexp_extract_all(Part_Desc, '{_MEASURE}', 1), regexp_extract_all(Part_Desc, '{_MEASURE}', 2)), lambda x: struct_pack(v := x[1], u := {UNIT_MAP}[lower(x[2])])), lambda x: x.u IS NOT NULL) AS l FROM feed), q AS (SELECT row_index, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nth, unnest(l) AS m FROM p) SELECT row_index, nth, m.v AS value, m.u AS unit, m.v || upper(m.u) AS compact FROM q",
    ),
    "dimension_chain": (
        dimension_chain,
        f"WITH {FEED_SQL}, c AS (SELECT row_index, list_filter([regexp_extract(Part_Desc, '{_CHAIN}', 1), regexp_extract(Part_Desc, '{_CHAIN}', 2), regexp_extract(Part_Desc, '{_CHAIN}', 3)], lambda x: x <> '') AS l FROM feed) SELECT row_index, l[1] AS d1, l[2] AS d2, l[3] AS d3 FROM c WHERE len(l) > 0",
    ),
    "alpha_prefixes": (alpha_prefixes, f"WITH {FEED_SQL} SELECT row_index, " + ", ".join(f"nullif(upper(regexp_extract(Mfg_Part_Num, '^([A-Za-z]{{{n}}})', 1)), '') AS p{n}" for n in (3, 4, 5)) + " FROM feed"),
    "url_parts": (url_parts, f"SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages"),
    "url_classify": (url_classify, _tier()),
    "json_props": (json_props, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "hash_key": (hash_key, "SELECT item_id, substr(sha256(text), 1, 32) AS key FROM benchmark"),
}
