"""Pieces of SQL that several queries share: the twin of the functions package."""

from __future__ import annotations

from ..functions.measures import ALIASES
from ..functions.text import ACRONYMS, MINORS, SENTINEL, SUFFIXES
from ..operators.feed import FEED_SQL


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trimmed(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, chr(160) || chr(8203) || chr(65279), ' '), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


def placeholder(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '' OR regexp_matches(trim({c}), {quoted(SENTINEL)}))"


def clean(c: str) -> str:
    return f"CASE WHEN NOT {placeholder(trimmed(c))} THEN {trimmed(c)} END"


def match_key(c: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    bare = f"regexp_replace({s}, '( ({SUFFIXES}))+$', '')"
    return f"CASE WHEN {bare} = '' THEN {s} ELSE {bare} END"


def title_sql(c: str) -> str:
    """Title case of a trimmed text, word by word."""
    cap = (
        "CASE WHEN p IN ('/', '-') THEN p WHEN list_contains({acr}, lower(p)) THEN upper(p) WHEN regexp_matches(substr(p, 2), '\\p{{Lu}}') THEN p WHEN regexp_matches(p, '[0-9]') THEN "
        "array_to_string(list_transform(string_split(p, ''), lambda x, i: CASE WHEN i = 1 OR (regexp_matches(string_split(p, '')[i - 1], '[0-9]') AND regexp_matches(x, '[a-z]')) THEN upper(x) ELSE x END), '') "
        "ELSE upper(substr(p, 1, 1)) || substr(p, 2) END"
    ).format(acr="[" + ", ".join(map(quoted, ACRONYMS)) + "]")
    minors = "[" + ", ".join(map(quoted, MINORS)) + "]"
    word = f"CASE WHEN j > 1 AND list_contains({minors}, lower(w)) THEN lower(w) ELSE array_to_string(list_transform(regexp_extract_all(w, '([^/-]+|[/-])', 1), lambda p: {cap}), '') END"
    return f"CASE WHEN {c} = '' THEN '' ELSE array_to_string(list_transform(string_split({c}, ' '), lambda w, j: {word}), ' ') END"


NAME_CODE = r"'^(.+?) *\(([A-Za-z0-9-]{2,10})\) *$'"


def round_half_up(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5e0) / 1e{n}"


UNIT_MAP = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(u)}" for a, u in ALIASES.items()) + "}"

ROWS = f"""{FEED_SQL},
m0 AS (SELECT *, {clean('Part_Manuf')} AS sup FROM feed),
m1 AS (SELECT *, CASE WHEN regexp_matches(sup, {NAME_CODE}) THEN regexp_extract(sup, {NAME_CODE}, 1) ELSE sup END AS supplier,
              CASE WHEN regexp_matches(sup, {NAME_CODE}) THEN regexp_extract(sup, {NAME_CODE}, 2) END AS code,
              {clean('E1_Brand')} AS b0, {clean('DIB_Brand')} AS b1 FROM m0),
rws AS (SELECT *, {match_key('supplier')} AS supplier_key, coalesce(b0, b1) AS first_brand FROM m1),
br AS (SELECT row_index, supplier_key, 0 AS nth, b0 AS brand, {match_key('b0')} AS brand_key FROM rws WHERE b0 IS NOT NULL
       UNION ALL SELECT row_index, supplier_key, 1, b1, {match_key('b1')} FROM rws WHERE b1 IS NOT NULL),
fan AS (SELECT supplier_key, count(DISTINCT brand_key) AS fan_out FROM br WHERE supplier_key IS NOT NULL GROUP BY 1),
mf AS (SELECT r.supplier_key, arg_min(supplier, row_index) AS name, arg_min(code, row_index) FILTER (WHERE code IS NOT NULL) AS code,
              count(*) AS n_rows, coalesce(max(fan_out), 0) AS fan_out, coalesce(max(fan_out), 0) >= 3 AS distributor
       FROM rws r LEFT JOIN fan USING (supplier_key) WHERE r.supplier_key IS NOT NULL GROUP BY 1),
bm AS (SELECT brand_key, arg_min(brand, row_index * 2 + nth) AS name, count(*) AS n_mentions FROM br GROUP BY 1),
ed AS (SELECT brand_key, supplier_key, count(*) AS n, min(row_index) AS first_row FROM br WHERE supplier_key IS NOT NULL GROUP BY 1, 2),
ow AS (SELECT e.*, mf.name, distributor, CAST(row_number() OVER (PARTITION BY brand_key ORDER BY distributor, n DESC, first_row, e.supplier_key) AS INTEGER) AS rank
       FROM ed e JOIN mf USING (supplier_key)),
rb AS (SELECT row_index, CASE WHEN n_mentions > 1 THEN bm.name ELSE first_brand END AS brand,
              CASE WHEN first_brand IS NULL THEN 'none' WHEN n_mentions > 1 THEN 'exact' ELSE 'input_unverified' END AS method,
              CASE WHEN first_brand IS NULL THEN 0e0 WHEN n_mentions > 1 THEN 0.98e0 * 0.94e0 ELSE 0.55e0 END AS confidence
       FROM rws LEFT JOIN bm ON bm.brand_key = {match_key('first_brand')}),
rs AS (SELECT row_index, supplier, coalesce(c.name, k.name) AS manufacturer,
              CASE WHEN c.name IS NOT NULL THEN 'code' WHEN supplier = k.name THEN 'exact' WHEN k.name IS NOT NULL THEN 'normalized'
                   WHEN supplier IS NOT NULL THEN 'unresolved' END AS method,
              (CASE WHEN c.name IS NOT NULL THEN 0.99e0 WHEN supplier = k.name THEN 0.98e0 WHEN k.name IS NOT NULL THEN 0.95e0 ELSE 0e0 END) * 0.94e0 AS confidence
       FROM rws LEFT JOIN (SELECT upper(code) AS uc, arg_min(name, supplier_key) AS name FROM mf WHERE code IS NOT NULL GROUP BY 1) c ON upper(rws.code) = uc
       LEFT JOIN mf k ON k.supplier_key = rws.supplier_key)"""
