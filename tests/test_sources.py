import io
import zipfile

from pyspark.sql import functions as F

from vaultlens.sources import archives, files


def office(members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return raw.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = office({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
PPTX = office({"ppt/presentation.xml": "<x/>"} | {f"ppt/slides/slide{i}.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p:sp></p:sld>' for i in (10, 2)} | {"ppt/notesSlides/notesSlide2.xml": f"<p:notes {A}><a:t>said</a:t></p:notes>"})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XLSX = office({
    "xl/workbook.xml": f'<workbook {S} xmlns:r="{R}"><sheets><sheet name="P&amp;L" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/></x>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Date</t></si><si><t>Amount</t></si></sst>", "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>45658</v></c><c r="B2"><v>12.5</v></c></row><row><c r="B4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
})
MAIL = b"From: Ann <a@x.com>\nTo: b@y.org\nSubject: Hi\nDate: Mon, 6 Jan 2025 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=z\n\n--z\nContent-Type: text/plain\n\nOne.\n\nTwo.\n--z\nContent-Type: text/csv\nContent-Disposition: attachment; filename=c.csv\n\na,b\n--z--\n"


def test_types_by_content_and_name():
    cases = {("x.bin", b"%PDF-1.7"): "pdf", ("x", b"\x89PNG\r\n\x1a\n"): "png", ("x.docx", DOCX): "docx", ("x.zip", XLSX): "xlsx", ("x.zip", office({"a.txt": "b"})): "zip", ("m", MAIL): "eml", ("a.csv", b"a,b"): "csv", ("a.txt", b"\xff\xfe\x00"): None, ("a.exe", b"MZ"): None, ("a.md", b"# x"): "md", ("x.zip", b"PK\x03\x04broken"): None}
    assert {k: files.detect(*k) for k in cases} == cases


def test_every_format_is_read_and_nothing_raises(spark, tmp_path):
    room = {"a.csv": b"\xef\xbb\xbfName,Arr\nX,\"1,000\"\nY\n", "t.tsv": b"a\tb\n", "n.md": b"# Head\n\nText here\nmore\n", "d.docx": DOCX, "s.pptx": PPTX, "w.xlsx": XLSX, "m.eml": MAIL, "p.pdf": b"%PDF-1.7", "i.png": b"\x89PNG\r\n\x1a\n", "x.exe": b"MZ", "z.zip": office({"in/q.txt": "hello", "../evil.txt": "x", "__MACOSX/y": "z"})}
    for name, raw in room.items():
        (tmp_path / name).write_bytes(raw)
    opened = files.unpacked(files.load(spark, str(tmp_path)))
    skipped = {r["reason"] for r in opened.filter("reason is not null").collect()}
    assert skipped == {"outside the archive", "junk"}
    docs = files.parsed(opened).cache()
    got = {r["filename"]: r for r in docs.collect()}
    assert got["x.exe"]["error"] == "unsupported" and got["p.pdf"]["error"]
    assert got["q.txt"]["pages"][0]["text"] == "hello"
    assert [(b["kind"], b["text"]) for b in got["d.docx"]["pages"][0]["blocks"]] == [("heading", "Title"), ("paragraph", "Some text"), ("table", "a, 1")]
    assert [(b["kind"], b["text"]) for p in got["s.pptx"]["pages"] for b in p["blocks"]] == [("heading", "Slide 2"), ("slide_note", "said"), ("heading", "Slide 10")]
    assert [(b["kind"], b["char_start"], b["char_end"]) for b in got["n.md"]["pages"][0]["blocks"]] == [("heading", 0, 6), ("paragraph", 7, 21)]
    assert got["m.eml"]["meta"]["subject"] == "Hi" and [b["text"] for b in got["m.eml"]["pages"][0]["blocks"]][1:] == ["One.", "Two."]
    child = files.parsed(files.children(docs)).first()
    assert child["ext"] == "csv" and child["pages"][0]["text"] == "a, b"
    cells = {(r["row"], r["col"]): (r["text"], r["value_num"], r["value_date"]) for r in files.cells(docs.filter("ext = 'xlsx'")).collect()}
    assert str(cells[1, 0][2]) == "2025-01-01" and float(cells[1, 1][1]) == 12.5 and cells[3, 1][0] == "x" and (2, 0) not in cells
    assert files.cells(docs.filter("filename = 'a.csv'")).count() == 5
    assert docs.select(files.blob_path(F.col("sha256")).alias("p")).first()["p"][2] == "/"


def test_documents_are_replaced_by_partition(spark, tmp_path):
    path = str(tmp_path / "pages")
    make = lambda rows: spark.createDataFrame(rows, "document_id string, text string")
    files.replace_documents(make([("a", "1"), ("b", "2")]), path)
    files.replace_documents(make([("a", "3")]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("document_id", "text").collect()) == [("a", "3"), ("b", "2")]


def test_archives_are_read_by_entry_in_many_tasks(spark, tmp_path):
    room = tmp_path / "room"
    room.mkdir()
    many = {f"in/{i}.txt": f"text {i} " * 200 for i in range(40)} | {"../evil.txt": "x", "__MACOSX/y": "z", "deep/a.csv": "a,b\n1,2\n"}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in many.items():
            z.writestr(name, text)
        z.writestr("stored.txt", "as it is", zipfile.ZIP_STORED)
        z.writestr("odd.txt", "by another method", zipfile.ZIP_BZIP2)
    (room / "big.zip").write_bytes(raw.getvalue())
    (room / "d.docx").write_bytes(DOCX)
    (room / "n.txt").write_bytes(b"plain")
    (room / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    spoiled = bytearray(office({"x.txt": "some text that is long enough"}))
    spoiled[40:44] = b"\x00\x01\x02\x03"
    (room / "spoiled.zip").write_bytes(bytes(spoiled))
    listed = archives.directory(spark, str(room))
    got = archives.inflated(listed, 200)
    tasks = got.filter("content is not null and path like '%big.zip!%'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 5
    rows = {r["path"].split("room/")[1]: (r["content"], r["reason"]) for r in got.collect()}
    old = {r["path"].split("room/")[1]: (r["content"], r["reason"]) for r in files.unpacked(files.load(spark, str(room)).filter("path not like '%spoiled%'")).collect()}
    differ = {k for k in old if old[k] != rows.get(k)}
    assert differ == {"big.zip!/odd.txt"} and rows["big.zip!/odd.txt"] == (None, "unknown compression")
    assert set(rows) - set(old) == {"spoiled.zip!/x.txt"} and rows["spoiled.zip!/x.txt"] == (None, "damaged")
    archives.register(spark)
    read = spark.read.format("room").option("partitionBytes", 300).load(str(room))
    assert read.rdd.getNumPartitions() > 5
    by_source = {r["path"].split("room/")[1]: r.asDict(True) for r in read.collect()}
    by_plan = {r["path"].split("room/")[1]: r.asDict(True) for r in files.parsed(got).collect()}
    assert set(by_source) == set(rows)
    for name, row in by_plan.items():
        assert {k: v for k, v in by_source[name].items() if k != "path"} == {k: v for k, v in row.items() if k != "path"}
    assert {r["error"] for n, r in by_source.items() if n not in by_plan} == {"outside the archive", "junk", "unknown compression", "damaged"}
    nothing = tmp_path / "empty"
    nothing.mkdir()
    assert spark.read.format("room").load(str(nothing)).count() == 0
