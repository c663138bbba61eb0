import os
import tempfile
import zipfile

from quarryline.sources import readers, sinks


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_csv_feed(spark):
    path = os.path.join(folder(), "feed.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(' Part ,Desc\nA1,"two ""inch"" bolt"\n,\n,only\n')
    rows = readers.read_table(spark, path).orderBy("row_index").collect()
    assert [(r["Part"], r["Desc"]) for r in rows] == [("A1", 'two "inch" bolt'), ("", "only")]


def test_workbook(spark):
    path = os.path.join(folder(), "book.xlsx")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = [["Report", ""], ["Part", "Desc"], ["A1", "bolt"], ["A2", "7"]]
    rows = "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("AB", r, strict=True) if v) + "</row>" for i, r in enumerate(cells, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Parts" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    got = readers.read_table(spark, path)
    assert sorted((r["Part"], r["Desc"]) for r in got.collect()) == [("A1", "bolt"), ("A2", "7")]


def test_find_column():
    assert readers.find_column(["Brand Name", "MFR_Code"], "brand", "mfr code") == "MFR_Code"
    assert readers.find_column(["Brand Name"], "brand") == "Brand Name"
    assert readers.find_column(["x"], "brand") is None


def test_delivery_columns(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x y")], "row_index int, `A B` string, c string")
    path = folder() + "/out"
    sinks.write_csv(df, path, ["c", "A B", "missing"])
    back = spark.read.option("header", True).csv(path).na.fill("")
    assert back.columns == ["c", "A B", "missing"]
    assert sorted(tuple(r) for r in back.collect()) == [("", "b", ""), ("x y", "a", "")]


def test_encodings(spark):
    path = folder()
    for name, data in {"utf.csv": "a,b\ncafé,1\n".encode(), "win.csv": "a,b\ncafé ™,1\n".encode("cp1252"), "iso.csv": b"a,b\ncaf\xe9 \x81,1\n"}.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
    assert [readers.encoding_of(spark, os.path.join(path, n)) for n in ("utf.csv", "win.csv", "iso.csv")] == list(readers.ENCODINGS)
    assert [readers.read_csv(spark, os.path.join(path, n)).first()["a"][:6] for n in ("utf.csv", "win.csv", "iso.csv")] == ["café", "café ™", "café \x81"]


def test_workbook_round_trip(spark):
    rows = [(i, f"P{i}", f"desc <{i}> & more") for i in range(40)]
    df = spark.createDataFrame(rows, "row_index int, Part string, Desc string")
    path = folder()
    sinks.write_workbook(df.coalesce(1), path + "/books", ["Part", "Desc", "Gap"], sheet="A very long name for a sheet, cut at 31")
    books = sinks.unpack_workbooks(spark.read.parquet(path + "/books"))
    got = []
    for i, book in enumerate(books):
        with open(f"{path}/{i}.xlsx", "wb") as f:
            f.write(book)
        one = readers.workbook_records(spark, f"{path}/{i}.xlsx").collect()
        assert all(len(r["sheet"]) <= 31 for r in one)
        got += [(r["record"]["Part"], r["record"]["Desc"], r["record"]["Gap"]) for r in one]
    assert sorted(got) == sorted((p, d, "") for _, p, d in rows)


def test_merged_ranges_two_headers_and_documents(spark):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    path = folder()
    with zipfile.ZipFile(path + "/b.xlsx", "w") as z:
        for at, text in sinks._BOOK.items():
            z.writestr(at, text.replace("SHEET", "Lists"))
        cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        body = f'<row r="1">{cell("A1", "Size")}</row><row r="2">{cell("A2", "W")}{cell("B2", "H")}</row><row r="3">{cell("A3", "1")}{cell("B3", "2")}</row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    rows = {r["row"]: r["cells"] for r in readers.workbook_rows(spark, path + "/b.xlsx").collect()}
    assert rows[0] == ["Size", "Size"] and rows[2] == ["1", "2"]
    assert readers.joined_headers(["Size", "", "Name"], ["W", "H", ""]) == ["Size W", "Size H", "Name"]
    assert readers.pick_sheet(spark.createDataFrame([("a", 1), ("a", 2), ("Lists", 1)], "sheet string, row int"), "list") == "Lists"
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(path + "/g.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{para("Limits", "Heading1")}{para("SHORT DESC holds 120 characters at most")}<w:tbl><w:tr><w:tc>{para("a")}</w:tc><w:tc>{para("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    blocks = readers.read_document(spark, path + "/g.docx")
    assert [(r["kind"], r["text"]) for r in blocks.orderBy("nth").collect()] == [("heading", "Limits"), ("paragraph", "SHORT DESC holds 120 characters at most"), ("table", "a | b")]
    assert readers.guideline_limits(blocks, {"SHORT_DESC": 240, "MOBILE_DESC": 80}) == {"SHORT_DESC": 120, "MOBILE_DESC": 80}


def test_discovery():
    names = ["in/Brand_Manufacturer.xlsx", "in/UOM list.csv", "in/delivery_format.csv", "in/taxonomy.json"]
    found = readers.discover(names)
    assert found["uom"] == "in/UOM list.csv" and found["manufacturer_brand"] == "in/Brand_Manufacturer.xlsx" and found["taxonomy"] == "in/taxonomy.json"
    assert readers.template_of(names) == "in/delivery_format.csv"


def test_reports_and_marks(spark):
    df = spark.createDataFrame([(1, "d" * 200, 0.6789, [("why", "F")]), (2, "x", 0.5, [])], "row_index int, Part_Desc string, confidence double, flags array<struct<reason:string,field:string>>")
    path = folder()
    sinks.write_review(df, path + "/review")
    row = spark.read.option("header", True).csv(path + "/review").collect()
    assert [(r["reason"], r["field"], len(r["description"]), r["confidence"]) for r in row] == [("why", "F", 120, "0.68")]
    sinks.write_report(df, path + "/json")
    assert spark.read.json(path + "/json").count() == 2
    sinks.write_csv(df.coalesce(1), path + "/bom", ["row_index"], bom=True)
    first = next(f for f in sorted(os.listdir(path + "/bom")) if f.startswith("part"))
    with open(f"{path}/bom/{first}", "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"


def test_delivery_row(spark):
    from quarryline.operators import delivery

    headers = ["Part_Desc", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_VALUE 2", "ATTRIBUTE_UOM 1", "ATTRIBUTE_UOM 2", "Ref URL 2", "Ref URL 1", "MFR URL", "ITEM_FEATURES_1", "Product Image", "Alternate Image 1", "SDS", "Actual Image (Yes/No)"]
    assert delivery.families(headers)["attribute_label"] == ["ATTRIBUTE_LABEL 1", "ATTRIBUTE_LABEL 2"]
    assert delivery.unknown_columns(["a", "b"], ["b", "c"]) == (["a"], ["c"])
    schema = "row_index int, brand string, Mfg_Part_Num string, attributes array<struct<label:string,value:string,uom:string>>, features array<string>, urls map<string,string>"
    p = spark.createDataFrame([(1, "Orla®", "A 1", [("Size", "4", "in"), ("Color", None, None), ("Over", "x", None)], ["f"], {"mfr": "m", "ref2": "b", "ref1": "a"})], schema)
    raw = spark.createDataFrame([(1, " - ")], "row_index int, Part_Desc string")
    plan = delivery.confirmed(delivery.planned(p, ("sds",), 1), spark.createDataFrame([("Orla_A_1.jpg",)], "name string"), spark.createDataFrame([(1, "sds")], "row_index int, key string"))
    assets = delivery.asset_map(plan)
    assert assets.first()["unconfirmed"] == ["Orla_A_1_1.jpg"]
    row = delivery.delivery(p, headers, raw, assets, "urls").first().asDict()
    assert [row[h] for h in headers] == [" - ", "Color", "Size", "4", "", "in", "", "b", "a", "m", "f", "Orla_A_1.jpg", "", "Orla_A_1_SDS.pdf", "Yes"]
    assert delivery.as_json(p, ["brand"]).first()["product"] == '{"brand":"Orla®"}'


def test_search_rules(spark):
    from quarryline.operators import search

    docs = search.vocabulary(spark).unionByName(search.units(spark))
    q = spark.createDataFrame([("a", "uom", "inches"), ("b", "uom", "lumen output"), ("c", "lov", "zzqq")], "query_id string, collection string, text string")
    got = {(r["query_id"], r["rank"]): r for r in search.search(q, docs, 2).collect()}
    assert got["a", 1]["doc_id"] == "in" and got["a", 1]["exact"] and got["a", 1]["score"] == 1.0
    assert got["b", 1]["doc_id"] == "lm" and not got["b", 1]["exact"] and ("c", 1) not in got
    only = search.search(q, docs, 5, where={"kind": "Length"}).collect()
    assert {r["doc_id"] for r in only} <= {"in", "ft", "yd", "mm", "cm", "m", "mil"}
    raw = spark.createDataFrame([("1", "rings", "Color", "crimson"), ("2", "rings", "Color", "blu"), ("3", "rings", "Shape", "steel")], "query_id string, leaf string, label string, text string")
    out = {r["query_id"]: (r["rescue"], r["suggestion"]) for r in search.rescued(raw, search.vocabulary(spark)).collect()}
    assert out == {"1": ("Red", None), "2": (None, "Blue"), "3": (None, "Steel")}
    assert {r["collection"]: r["n"] for r in search.stats(docs).collect()}["guidelines"] == 0


def test_command_line(spark):
    from quarryline import __main__ as cli

    path = folder()
    with open(path + "/feed.csv", "w") as f:
        f.write("Mfg_Part_Num,Part_Desc,E1_Brand,Part_Manuf\nA1,A1 red bolt 4in,Orla,Orla Inc\nA2,A2 plate,,-\nA3,A3 ring,,-\n")
    cli.main([path + "/feed.csv", path + "/out", "--limit", "2"])
    rows = spark.read.option("header", True).csv(path + "/out/delivery").na.fill("").collect()
    assert sorted(r["MANUFACTURER_PART_NUMBER"] for r in rows) == ["A1", "A2"]
    bolt = next(r for r in rows if r["MANUFACTURER_PART_NUMBER"] == "A1")
    assert bolt["BRAND_NAME"] == "Orla" and "4" in [bolt[f"ATTRIBUTE_VALUE {i}"] for i in range(1, 6)]
    assert spark.read.json(path + "/out/report").first()["n_products"] == 2
    assert spark.read.option("header", True).csv(path + "/out/review").count() > 0
