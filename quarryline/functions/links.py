"""Links: hosts, source tiers, document kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose pages are never evidence, and resellers.
BLOCKED = ["amazon.com", "ebay.com", "reddit.com", "facebook.com", "pinterest.com", "youtube.com", "x.com", "twitter.com", "wikipedia.org"]
RESELLERS = ["grainger.com", "homedepot.com", "lowes.com", "zoro.com", "fastenal.com", "mscdirect.com", "ferguson.com"]

# Words in a link or its text and the document they name, in order.
DOCUMENTS = [
    ("sds", "SDS"), ("safety", "SDS"), ("warranty", "Warranty Information"), ("catalog", "Catalog"), ("spec", "Specification Sheet"), ("install", "Instruction/Installation Manual"),
    ("service", "Service Manual"), ("manual", "Owners/User Manual"), ("drawing", "Line Drawing"), ("rohs", "RoHS"), ("energy", "Energy Star Guide"),
]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _of(h: Column, domains: list[str]) -> Column:
    """Is the host one of the domains, or below one?"""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def tier(url: Column, brand: Column) -> Column:
    """``blocked, manufacturer_doc, product_page, manufacturer_site, distributor, other``."""
    h = host(url)
    own = F.contains(F.regexp_replace(h, "[^a-z0-9]", ""), F.regexp_replace(F.lower(brand), "[^a-z0-9]", "")) & (F.length(F.trim(brand)) > 2)
    return (
        F.when((h == "") | _of(h, BLOCKED), "blocked")
        .when(own & F.lower(url).rlike(r"\.pdf($|[?#])"), "manufacturer_doc")
        .when(own & F.lower(url).rlike("/(p|product|products|item)/"), "product_page")
        .when(own, "manufacturer_site")
        .when(_of(h, RESELLERS), "distributor")
        .otherwise("other")
    )


TIER_SCORE = {"blocked": 0.0, "manufacturer_doc": 0.98, "product_page": 1.0, "manufacturer_site": 0.9, "distributor": 0.35, "other": 0.15}


def document_kind(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for word, kind in DOCUMENTS:
        out = out.when(F.contains(F.lower(text), F.lit(word)), kind)
    return out.when(F.lower(text).rlike(r"\.pdf"), "Technical Bulletin")
