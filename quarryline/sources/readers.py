"""Feeds and reference tables from files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import CP1252


ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` that all lines of a file decode by: lines are looked at in
    tasks, and only counts come back."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("line string").csv(path)
    raw = lines.select(F.encode(F.coalesce("line", F.lit("")), "ISO-8859-1").alias("raw"))
    broken = F.count_if(F.try_validate_utf8(F.col("raw").cast("string")).isNull())
    undefined = F.count_if(F.regexp_count(F.hex("raw"), F.lit("^(..)*?(81|8D|8F|90|9D)")) > 0)
    r = raw.agg(broken.alias("broken"), undefined.alias("undefined")).first()
    return ENCODINGS[0] if not r["broken"] else ENCODINGS[1] if not r["undefined"] else ENCODINGS[2]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A feed as strings, headers trimmed, cells never null, blank rows dropped.

    The encoding is found out where none is given.  Carries ``row_index``: unique, and
    rising with the place in each file, though with gaps between its parts.
    """
    encoding = encoding or encoding_of(spark, path)
    western = encoding == ENCODINGS[1]  # no reader's own: ISO-8859-1 but for 27 characters
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", ENCODINGS[2] if western else encoding).csv(path)
    if western:
        df = df.select([F.translate(F.col(f"`{c}`"), "".join(map(chr, CP1252)), "".join(CP1252.values())).alias(c) for c in df.columns])
    named = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    named = named.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in named.columns if c and not c.startswith("_c")])
    return named.where(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in named.columns])) != "").withColumn("row_index", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A feed by the kind its name ends in: Parquet, JSON, a workbook, else CSV."""
    name = path.lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".json", ".jsonl")):
        return spark.read.option("multiLine", name.endswith(".json")).json(path)
    if name.endswith((".xlsx", ".xlsm")):
        return read_workbook(spark, path, sheet)
    return read_csv(spark, path)


class WorkbookSource(DataSource):
    """Rows of a workbook's sheets as ``sheet, row, cells``; a partition per sheet.

    The file is given as bytes in hex, which Spark's own reader has fetched, so any
    store Spark reads will do.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>"

    def reader(self, schema):
        return _WorkbookReader(bytes.fromhex(self.options["content"]))


class _WorkbookReader(DataSourceReader):
    def __init__(self, data: bytes):
        self.data = data

    def partitions(self):
        return [InputPartition(x) for x in sheet_parts(self.data)]

    def read(self, partition):
        name, part = partition.value
        for nth, cells in enumerate(_sheet_rows(self.data, part)):
            yield name, nth, cells


def sheet_parts(data: bytes) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and the parts they are in."""
    import io
    import zipfile
    from xml.etree import ElementTree as E

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, links = E.fromstring(z.read("xl/workbook.xml")), E.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    at = {r.get("Id"): r.get("Target") for r in links}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    return [(s.get("name"), "xl/" + at[s.get(rel)].removeprefix("/xl/")) for s in book.iter() if s.tag.endswith("}sheet")]


def _sheet_rows(data: bytes, part: str):
    import io
    import zipfile
    from xml.etree import ElementTree as E

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = E.fromstring(z.read(part))
    merged = [_corners(x.get("ref")) for x in sheet.iter() if x.tag.endswith("}mergeCell")]
    anchors: dict[tuple[int, int], str] = {}
    for nth, row in enumerate(x for x in sheet.iter() if x.tag.endswith("}row")):
        number = int(row.get("r", nth + 1))
        cells: dict[int, str] = {}
        at = -1
        for c in row:
            at = _place(c.get("r"))[0] if c.get("r") else at + 1
            text = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
        for left, top, right, bottom in merged:  # a merged range holds its first cell's text everywhere
            if top <= number <= bottom:
                if number == top:
                    anchors[left, top] = cells.get(left, "")
                for column in range(left, right + 1):
                    cells[column] = cells.get(column) or anchors.get((left, top), "")
        yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _place(ref: str) -> tuple[int, int]:
    """Column (from 0) and row of a cell's name."""
    letters, digits = re.match("([A-Z]+)([0-9]*)", ref).groups()
    return reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1, int(digits or 0)


def _corners(ref: str) -> tuple[int, int, int, int]:
    first, _, last = ref.partition(":")
    return (*_place(first), *_place(last or first))


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """All sheets' rows of one workbook (workbooks are small: its bytes pass the driver)."""
    spark.dataSource.register(WorkbookSource)
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    return spark.read.format("workbook").option("content", content.hex()).load()


def header_rows(rows: DataFrame, scan: int = 25) -> DataFrame:
    """``sheet, row, cells`` of the likeliest header among each sheet's first rows.

    Distinct, textual, filled and short cells speak for a header, and so do rows below that
    fill the same columns.
    """
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    n = F.greatest(F.size(filled), F.lit(1))
    text = F.size(F.filter(filled, lambda c: ~c.rlike(r"^[0-9.,]+$"))) / n
    brief = F.size(F.filter(filled, lambda c: F.length(c) <= 40)) / n
    below = F.collect_list("n_filled").over(Window.partitionBy("sheet").orderBy("row").rowsBetween(1, 5))
    few = rows.where(F.col("row") < scan + 5).withColumn("n_filled", F.size(filled)).withColumn("below", below).withColumn("width", F.max(F.size("cells")).over(Window.partitionBy("sheet")))
    support = F.when(F.size("below") > 0, F.size(F.filter("below", lambda k: k >= 0.5 * F.col("n_filled"))) / F.size("below")).otherwise(0.0)
    score = 0.30 * F.size(F.array_distinct(filled)) / n + 0.25 * text + 0.15 * F.size(filled) / F.greatest(F.col("width"), F.lit(1)) + 0.10 * brief + 0.20 * support
    rank = F.row_number().over(Window.partitionBy("sheet").orderBy(F.round(score, 6).desc(), "row"))
    return few.where((F.col("row") < scan) & (F.col("n_filled") > 0)).withColumn("nth", rank).where("nth = 1").select("sheet", "row", "cells")


def pick_sheet(rows: DataFrame, *keywords: str) -> str:
    """The first sheet whose name holds a keyword, in their order; else the largest."""
    sizes = {r["sheet"]: r["count"] for r in rows.groupBy("sheet").count().orderBy("sheet").collect()}  # a row a sheet
    named = next((s for k in keywords for s in sizes if k.lower() in s.lower()), None)
    return named or max(sizes, key=sizes.get)


def joined_headers(upper: list[str], lower: list[str]) -> list[str]:
    """Labels of a header in two rows: a group's name carries on to the columns behind it."""
    out, group = [], ""
    for i in range(max(len(upper), len(lower))):
        a, b = (x[i].strip() if i < len(x) else "" for x in (upper, lower))
        group = a or group
        out.append(" ".join(filter(None, (group, b))) if b and group != b else b or group)
    return out


def distinct_labels(labels: list[str]) -> list[str]:
    labels = [c.strip() or f"column_{i}" for i, c in enumerate(labels)]
    return [c if labels.index(c) == i else f"{c}_{i}" for i, c in enumerate(labels)]


def workbook_records(spark: SparkSession, path: str, two_rows: bool = False) -> DataFrame:
    """``sheet, row_index, record`` of all sheets, each under its own header; a sheet without
    one gives no rows."""
    rows = workbook_rows(spark, path)
    made = None
    for head in header_rows(rows).collect():  # a row a sheet
        after = rows.where((F.col("sheet") == head["sheet"]) & (F.col("row") > head["row"]))
        labels = head["cells"]
        if two_rows and (second := after.orderBy("row").first()):
            labels, after = joined_headers(labels, second["cells"]), after.where(F.col("row") > second["row"])
        pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias("v")) for i, c in enumerate(distinct_labels(labels))])
        one = after.select("sheet", F.col("row").cast("long").alias("row_index"), F.map_from_entries(pairs).alias("record"))
        made = one if made is None else made.unionByName(one)
    return made if made is not None else spark.createDataFrame([], "sheet string, row_index long, record map<string,string>")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """``nth, kind, text`` of a word-processor file's blocks: headings, paragraphs, table rows."""
    content = spark.read.format("binaryFile").load(path).select("content")

    def blocks(batches):
        import io
        import zipfile
        from xml.etree import ElementTree as E

        import pandas as pd

        for files in batches:
            for data in files["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    body = next(x for x in E.fromstring(z.read("word/document.xml")) if x.tag.endswith("}body"))
                said = lambda x: "".join(t.text or "" for t in x.iter() if t.tag.endswith("}t")).strip()
                out = []
                for x in body:
                    if x.tag.endswith("}p") and said(x):
                        style = next((v for s in x.iter() if s.tag.endswith("}pStyle") for k, v in s.attrib.items() if k.endswith("}val")), "")
                        out.append(("heading" if style.lower().startswith(("heading", "title")) else "paragraph", said(x)))
                    elif x.tag.endswith("}tbl"):
                        for row in (r for r in x.iter() if r.tag.endswith("}tr")):
                            out.append(("table", " | ".join(said(c) for c in row if c.tag.endswith("}tc"))))
                yield pd.DataFrame([(i, k, t) for i, (k, t) in enumerate(out)], columns=["nth", "kind", "text"])

    return content.mapInPandas(blocks, "nth int, kind string, text string")


def guideline_limits(blocks: DataFrame, limits: dict[str, int]) -> dict[str, int]:
    """Character limits that a guideline states (``SHORT_DESC ... 240 characters``); the
    others stay as given."""
    text = " ".join(r["text"] for r in blocks.orderBy("nth").select("text").collect())  # one document's text
    found = {f: re.search(re.escape(f).replace("_", r"[\s_]") + r"[^.]{0,80}?(\d{2,4})\s*(?:characters|chars|char)", text, re.I) for f in limits}
    return {f: int(m[1]) if (m := found[f]) else n for f, n in limits.items()}


# Words in the names of reference files, by what they hold.
REFERENCE_FILES = {"taxonomy": "taxonomy|classpath", "lov": r"\blov\b|list.of.values", "uom": "uom|unit", "fractions": "fraction|decimal", "manufacturer_brand": "manufacturer|brand", "guidelines": "guideline|content", "fittings": "fitting", "faucets": "faucet"}


def discover(names: list[str], wanted: dict[str, str] = REFERENCE_FILES) -> dict[str, str]:
    """The first file whose name fits each kind; a file serves once."""
    out: dict[str, str] = {}
    for kind, pattern in wanted.items():
        stem = lambda n: n.rsplit("/", 1)[-1].replace("_", " ")
        fit = next((n for n in sorted(names) if n not in out.values() and re.search(pattern, stem(n), re.I)), None)
        if fit:
            out[kind] = fit
    return out


def template_of(names: list[str]) -> str | None:
    """The delivery template among files: the first named for delivery or output."""
    return next((n for n in sorted(names) if re.search("delivery|output", n.rsplit("/", 1)[-1], re.I)), None)


def template_headers(spark: SparkSession, path: str) -> list[str]:
    """The columns of a delivery template: its first line alone."""
    return [c.strip() for c in spark.read.option("header", True).csv(path).columns]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name``: files known to exist, one a line of a listing."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first, or the named one) as a table under its header row."""
    rows = workbook_rows(spark, path)
    names = [r["sheet"] for r in rows.select("sheet").distinct().collect()]
    sheet = sheet if sheet in names else names[0] if len(names) == 1 else sheet or sorted(names)[0]
    head = header_rows(rows.where(F.col("sheet") == sheet)).first()
    labels = distinct_labels(head["cells"])
    body = rows.where((F.col("sheet") == sheet) & (F.col("row") > head["row"]))
    return body.select(F.col("row").cast("long").alias("row_index"), *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(labels)])


def find_column(columns: list[str], *wanted: str) -> str | None:
    """The column of the first name that fits: squeezed equal first, then contained."""
    squeeze = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    by = {squeeze(c): c for c in columns}
    for w in wanted:
        if squeeze(w) in by:
            return by[squeeze(w)]
    return next((c for w in wanted for s, c in by.items() if squeeze(w) in s), None)
