"""Enrich a feed from the command line: delivery rows, review queue and run report to a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import packs, session
from .operators import delivery, product
from .operators.feed import FIELDS
from .sources import readers, sinks

HEADERS = [*delivery.PASSTHROUGH, *delivery.SCALARS, *product.LIMITS, *[f"ATTRIBUTE_{part} {i}" for i in range(1, 51) for part in ("LABEL", "VALUE", "UOM")]]


def run(spark, args: argparse.Namespace) -> None:
    feed = readers.read_table(spark, args.input)
    if args.limit:
        feed = feed.orderBy("row_index").limit(args.limit)
    feed = feed.select("row_index", *[(F.col(c) if c in feed.columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    pack = packs.load(spark, args.taxonomy, args.brands, args.abbreviations)
    record = product.enriched(feed, pack)
    headers = readers.template_headers(spark, args.template) if args.template else HEADERS
    sinks.write_csv(delivery.delivery(record, headers, feed), f"{args.out}/delivery", headers, bom=args.bom)
    sinks.write_review(record, f"{args.out}/review")
    sinks.write_report(product.with_run_stats(record), f"{args.out}/report")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    p.add_argument("input", help="a feed: CSV, workbook, JSON or Parquet")
    p.add_argument("out", help="a folder for the results")
    p.add_argument("--limit", type=int, help="rows to take, the first ones")
    p.add_argument("--template", help="a delivery template, whose first line names the columns")
    p.add_argument("--bom", action="store_true", help="begin delivery files with a byte order mark")
    for name in ("taxonomy", "brands", "abbreviations"):
        p.add_argument(f"--{name}", help=f"a pack of {name} as JSON")
    run(session.build("quarryline"), p.parse_args(arguments))


if __name__ == "__main__":
    main()
