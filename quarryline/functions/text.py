"""Cleaning and cutting of catalogue text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What counts as an absent value, matched whole and in any case.
SENTINELS = [
    r"-+", r"n/?a", r"na", r"none", r"null", r"nil", r"unknown", r"tbd", r"t\.b\.d\.?", r"\.+", r"0+", r"x+", r"\?+", r"--\s*.*\s*--", r"no\s+\w+\s+brand",
    r"un-?branded", r"commodity\s*[-–]\s*unbranded", r"not\s+(applicable|available|found|specified)", r"see\s+(description|notes?)", r"blank", r"empty",
]
SENTINEL = "(?i)^(?:" + "|".join(SENTINELS) + ")$"

# Endings of company names that don't tell companies apart.
SUFFIXES = (
    "incorporated|corporation|corp|company|compagnie|co|inc|llc|ltd|limited|lp|llp|plc|gmbh|sa|nv|bv|ag|holdings|group|industries|industrial|international|intl|"
    "manufacturing|mfg|products|prod|brands|usa|us|na|enterprises|solutions|supply|systems"
)

# Words that stay small inside a title, and those always in capitals.
MINORS = "a an and as at but by for in nor of on or per the to vs via with".split()
ACRONYMS = (
    "led ul cul csa nsf asse cee gfci gfi afci usb pvc abs cpvc mdf osb hdpe epdm tpo ada nema ansi astm sae npt mnpt fnpt iso rohs sds mtr "
    "unspsc upc ean gtin cct cri hvac btu awg ip ss sst hp id od ac dc rv otr cf tpi"
).split()

# Signs of UTF-8 read as Windows-1252, and that code page's characters from 0x80 on.
MOJIBAKE = ("Ã", "Â", "â€", "â„")
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated and written into the plan once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def mended(c: Column) -> Column:
    """One layer of UTF-8 read as Windows-1252 undone, where the text shows it and it undoes
    without loss; any other text as it is."""
    odd = F.array(*map(F.lit, MOJIBAKE))
    single = F.translate(c, "".join(CP1252.values()), "".join(map(chr, CP1252)))
    able = F.exists(odd, lambda s: F.contains(c, s)) & ~c.rlike("[\u0080-\u009f]") & ~single.rlike("[^\u0000-\u00ff]")
    raw = F.encode(F.when(able, single), "ISO-8859-1")
    again = F.try_validate_utf8(raw.cast("string"))
    return F.when(again.isNotNull() & ~F.contains(again, F.lit("\ufffd")), again).otherwise(c)


def trimmed(c: Column) -> Column:
    """No-break spaces as spaces, zero-width ones gone, runs as one, ends bare."""
    c = F.translate(c, " ​﻿", " ")
    return F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))


def is_placeholder(c: Column) -> Column:
    """Null, blank or a sentinel."""
    return c.isNull() | (F.trim(c) == "") | F.trim(c).rlike(SENTINEL)


def clean(c: Column) -> Column:
    """The mended value with its white space in order, or null for an absent one."""
    plain = lambda x: ~x.rlike("[^\\x20-\\x7e]|  |^ | $")
    return once(once(c, lambda x: F.when(plain(x), x).otherwise(trimmed(mended(x)))), lambda whole: F.when(~is_placeholder(whole), whole))


def match_key(c: Column) -> Column:
    """Key that joins spellings of one company: no brackets, marks or legal endings."""
    s = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))

    def without_endings(s: Column) -> Column:
        bare = F.regexp_replace(s, f"( ({SUFFIXES}))+$", "")
        return F.when(bare == "", s).otherwise(bare)

    return once(s, without_endings)


def name_of(c: Column) -> Column:
    """``Name`` of ``Name (CODE)``, else the whole."""
    return once(c, lambda x: F.when(x.rlike(NAME_CODE), F.regexp_extract(x, NAME_CODE, 1)).otherwise(x))


def code_of(c: Column) -> Column:
    """``CODE`` of ``Name (CODE)``, else null."""
    return once(c, lambda x: F.when(x.rlike(NAME_CODE), F.regexp_extract(x, NAME_CODE, 2)))


NAME_CODE = r"^(.+?) *\(([A-Za-z0-9-]{2,10})\) *$"


def squashed(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def without_leading(c: Column, part: Column) -> Column:
    """Text without the part number it begins with, however that is punctuated."""
    led = F.lower(c).startswith(F.lower(part)) & (part != "")
    rest = lambda n: F.ltrim(F.substring(c, n + 1, F.length(c)), F.lit(" -,:"))
    first = F.regexp_extract(c, "^([^ ]*)", 1)
    same = (squashed(first) == squashed(part)) & (squashed(part) != "")
    return F.when(led, rest(F.length(part))).when(same, rest(F.length(first))).otherwise(c)


def segments(c: Column) -> Column:
    """Parts between spaced dashes."""
    return F.filter(F.transform(F.split(c, " +[-–] +"), lambda s: F.trim(s)), lambda s: s != "")


def truncated(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space of the last 20 if there is one."""
    cut = F.substring(c, 1, limit)
    tail = F.substring(cut, max(1, limit - 19), 20)
    whole = F.regexp_extract(cut, "^(.*) [^ ]*$", 1)
    short = F.when(F.instr(tail, " ") > 0, F.rtrim(whole, F.lit(" ,;-"))).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(short)


def _capped(token: Column) -> Column:
    """A capital first; acronyms and tokens with inner capitals keep theirs; after a digit too."""
    chars = F.filter(F.split(token, ""), lambda x: x != "")
    spread = F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | (F.get(chars, i - 1).rlike("[0-9]") & x.rlike("[a-z]")), F.upper(x)).otherwise(x)), "")
    inner = F.substring(token, 2, F.length(token))
    first = F.concat(F.upper(F.substring(token, 1, 1)), inner)
    return F.when(F.lower(token).isin(*ACRONYMS), F.upper(token)).when(inner.rlike(r"\p{Lu}"), token).when(token.rlike("[0-9]"), spread).otherwise(first)


def title_case(c: Column) -> Column:
    """Each word with a capital, also behind ``/`` and ``-``; small words inside stay small."""

    def word(w: Column, i: Column) -> Column:
        parts = F.regexp_extract_all(w, F.lit("([^/-]+|[/-])"), 1)
        rebuilt = F.array_join(F.transform(parts, lambda p: F.when(p.isin("/", "-"), p).otherwise(_capped(p))), "")
        return F.when((i > 0) & F.lower(w).isin(*MINORS), F.lower(w)).otherwise(rebuilt)

    return F.when(trimmed(c) == "", "").otherwise(F.array_join(F.transform(F.split(trimmed(c), " "), word), " "))


def sentence_case(c: Column) -> Column:
    """The first letter a capital, the rest untouched."""
    return F.concat(F.upper(F.substring(trimmed(c), 1, 1)), F.substring(trimmed(c), 2, F.length(c)))


def with_clause(c: Column) -> Column:
    """What follows ``w/``, as ``With ...`` in title case; null without one."""
    said = F.trim(trimmed(F.regexp_extract(c, r"(?i)(?:^|[^A-Za-z0-9])w/\s*(.+)$", 1)), F.lit(" -,"))
    return F.when(F.length(said) >= 3, F.concat(F.lit("With "), title_case(said)))


def bounded(phrase: str, gap: str = r"[\s-]*") -> str:
    """A pattern for a phrase that no letter or digit touches; its blanks match hyphens too, or ``gap``.

    It holds the character before and after, which are groups 1 and 3.
    """
    import re

    return r"(^|[^A-Za-z0-9])(" + gap.join(map(re.escape, phrase.split())) + r")([^A-Za-z0-9]|$)"


def abbreviated(c: Column, rules: dict[str, str]) -> Column:
    """Phrases replaced by their abbreviations, the longest first; one may feed the next."""
    import re

    if not rules:
        return trimmed(c)
    any_ = "(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(map(re.escape, rules)) + ")(?=[^A-Za-z0-9]|$)"

    def each(text: Column) -> Column:
        out = text
        for phrase in sorted(rules, key=len, reverse=True):
            alone = rf"(?i)(^|[^A-Za-z0-9]){re.escape(phrase)}(?=[^A-Za-z0-9]|$)"
            out = F.regexp_replace(out, alone, "$1" + rules[phrase].replace("$", r"\$"))
        return F.when(text.rlike(any_), trimmed(out)).otherwise(text)

    return once(trimmed(c), each)


def redundant(said: Column, head: Column) -> Column:
    """Does the head say it already?"""
    return (said != "") & (head != "") & F.contains(F.lower(F.trim(head)), F.lower(F.trim(said)))


def column_form(c: Column) -> Column:
    """A header as words of letters and digits, in lower case."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def file_form(c: Column) -> Column:
    """A name as part of a file name."""
    return F.trim(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9.-]+", "-"), F.lit("-"))


def exact_form(c: Column) -> Column:
    """How an exact term is looked up: lower case, marks and blanks as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def compared(c: Column) -> Column:
    """How evaluation compares: no case, no trade marks, blanks as one, no marks at the ends."""
    bare = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "®™©", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "), F.lit(" .,;"))


STOP = "a an the with and of for to in on by".split()  # Fixed values: words that don't count in comparisons


def compared_tokens(c: Column) -> Column:
    return F.filter(F.split(compared(c), r"[^a-z0-9/\-.]+"), lambda t: (t != "") & ~t.isin(*STOP))


def alpha_prefix(c: Column, n: int) -> Column:
    """The first ``n`` letters in capitals; null where the text begins otherwise."""
    got = F.upper(F.regexp_extract(c, f"^([A-Za-z]{{{n}}})", 1))
    return F.when(got != "", got)


def round_half_up(x: Column, n: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` in doubles."""
    return F.floor(x * F.lit(float(10**n)) + F.lit(0.5)) / F.lit(float(10**n))


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Mojibake undone and characters composed (NFC), where a text isn't plain ASCII.

    UTF-8 read as Windows-1252 is encoded back and read anew; whatever doesn't
    round-trip stays as it is.
    """
    import unicodedata

    def one(t):
        if t is None or t.isascii():
            return t
        if any(s in t for s in ("Ã", "Â", "â€", "â„")):
            try:
                again = t.encode("cp1252").decode("utf-8")
                t = t if "�" in again else again
            except UnicodeError:
                pass
        return unicodedata.normalize("NFC", t)

    return texts.map(one)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names as sets of words, 0 to 100; 100 if one holds the other."""

    def common(x: str, y: str) -> int:
        """Length of the longest common subsequence: equal ends, then a column of the table as bits of one number."""
        head = tail = 0
        for p, q in zip(x, y, strict=False):
            if p != q:
                break
            head += 1
        x, y = x[head:], y[head:]
        for p, q in zip(reversed(x), reversed(y), strict=False):
            if p != q:
                break
            tail += 1
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        full = v = (1 << len(x)) - 1
        for c in y:
            u = v & at.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return head + tail + len(x) - v.bit_count()

    def one(x, y):
        s, t = set((x or "").lower().split()), set((y or "").lower().split())
        if not s or not t:
            return 0.0
        both = s & t
        if both and (not s - t or not t - s):
            return 100.0
        base = " ".join(sorted(both))
        left, right = (" ".join(filter(None, [base, " ".join(sorted(d))])) for d in (s - t, t - s))
        best = 200.0 * common(left, right) / (len(left) + len(right))
        for whole in (left, right) if both else ():  # both begin with what they share
            best = max(best, 200.0 * len(base) / (len(base) + len(whole)))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
