"""Delivery rows, review queues and reports to files."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, headers: list[str]) -> DataFrame:
    """Exactly ``headers`` in order; missing ones and nulls are empty."""
    return df.select([(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) if h in df.columns else F.lit("")).alias(h) for h in headers])


def write_csv(df: DataFrame, path: str, headers: list[str], order: str = "row_index", bom: bool = False) -> None:
    """Delivery files in row order: range-partitioned, so the parts in turn are the file.

    With ``bom`` each part begins with a byte order mark, before its first header.
    """
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order)
    out = ordered(sorted_, headers)
    if bom and headers:
        out = out.withColumnRenamed(headers[0], "\ufeff" + headers[0])
    out.write.option("header", True).option("escape", '"').csv(path)


def write_workbook(df: DataFrame, path: str, headers: list[str], sheet: str = "Sheet1", order: str = "row_index") -> None:
    """Workbooks under ``path``, a part each, in row order: every task writes its own rows.

    A workbook's rows are limited by the format, so large deliveries have many parts.
    """
    name = escape(sheet[:31], {'"': "&quot;"})
    rows = ordered(df.repartitionByRange(order).sortWithinPartitions(order), headers)

    def packed(batches):
        import io
        import zipfile

        import pandas as pd

        made = io.BytesIO()
        cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for at, text in _BOOK.items():
                z.writestr(at, text.replace("SHEET", name))
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                f.write(("<row>" + "".join(map(cell, headers)) + "</row>").encode())
                for batch in batches:
                    for row in batch.itertuples(index=False, name=None):
                        f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
        yield pd.DataFrame({"content": [made.getvalue()]})

    books = rows.mapInPandas(packed, "content binary")
    books.write.mode("overwrite").parquet(path)


def unpack_workbooks(df: DataFrame) -> list[bytes]:
    """The workbooks of a small delivery, in the order of their parts."""
    return [bytes(r["content"]) for r in df.select("content").collect()]


_BOOK = {
    "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="SHEET" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def write_review(df: DataFrame, path: str) -> None:
    """A row for each flag: descriptions cut to 120 characters, confidence to two places."""
    flags = df.select("row_index", F.explode("flags").alias("f"), F.substring("Part_Desc", 1, 120).alias("description"), F.format_string("%.2f", F.col("confidence")).alias("confidence"))
    flags.select("row_index", "f.reason", "f.field", "description", "confidence").write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
