"""Uploaded files: what they are, and what is in them.

``parsed`` reads files with Spark's binaryFile source and gives one nested row a file; ``pages``, ``blocks``,
``tables`` and ``cells`` take that apart. A file that can't be read becomes a row with an error; it never fails the job.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readable extensions and their types; legacy workbooks and archives are known but have no parser.
MIME = {
    "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "md": "text/markdown",
    "eml": "message/rfc822", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "zip": "application/zip",
}
#: First bytes of the binary types.
MAGIC = ((b"%PDF", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"\xd0\xcf\x11\xe0", "xls"))
MEMBER = {"xl/workbook.xml": "xlsx", "word/document.xml": "docx", "ppt/presentation.xml": "pptx"}

CELL = "struct<row:int,col:int,text:string,value_num:decimal(24,6),value_date:date>"
TABLE = f"struct<n_rows:int,n_cols:int,header_row:int,sheet:string,cells:array<{CELL}>>"
BLOCK = "struct<kind:string,text:string,char_start:int,char_end:int>"
PAGE = f"struct<page_no:int,sheet:string,text:string,blocks:array<{BLOCK}>,tables:array<{TABLE}>>"
PARSED = f"path string, filename string, ext string, mime string, sha256 string, size long, pages array<{PAGE}>, meta map<string,string>, attachments array<struct<filename:string,content:binary>>, error string"


def suffix(filename: str) -> str:
    return posixpath.splitext(filename.lower())[1].lstrip(".")


def detect(filename: str, raw: bytes) -> str | None:
    """The type by content, then by name; null for what isn't readable."""
    for magic, ext in MAGIC:
        if raw.startswith(magic):
            return ext
    if raw.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except zipfile.BadZipFile:
            return None
        return next((ext for member, ext in MEMBER.items() if member in names), "zip")
    ext = suffix(filename)
    if re.match(rb"(?:[A-Za-z-]+:[^\n]*\n(?:[ \t][^\n]*\n)*)*?(?:From|Received|Return-Path|MIME-Version):", raw[:4096]):
        return "eml"
    if ext in ("csv", "tsv", "txt", "md"):
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return ext
    return ext if ext in MIME else None


DATES = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%b-%Y", "%Y/%m/%d")  #: Fixed values, in this order: the day comes first in 01/02/2025.


def number_of(text: str) -> str | None:
    plain = re.sub(r"[$€£,\s]", "", text).rstrip("%")
    return plain if re.fullmatch(r"-?\d+(\.\d+)?", plain) and len(plain) < 24 else None


def date_of(text: str) -> object:
    for f in DATES:
        try:
            return datetime.strptime(text.strip(), f).date()
        except ValueError:
            continue
    return None


def table(rows: list[list], sheet: str | None = None, header: int | None = 0) -> dict:
    """A table of rows of texts; None is no cell, "" is one."""
    cells = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if v is not None:
                n = number_of(v)
                cells.append({"row": r, "col": c, "text": v, "value_num": None if n is None else Decimal(n), "value_date": date_of(v) if n is None and v else None})
    return {"n_rows": len(rows), "n_cols": max(map(len, rows), default=0), "header_row": header if rows else None, "sheet": sheet, "cells": cells}


def page(no: int, blocks: list[tuple[str, str]], tables: list[dict] | None = None, sheet: str | None = None, text: str | None = None) -> dict:
    out, at = [], 0
    for kind, t in blocks:
        out.append({"kind": kind, "text": t, "char_start": at, "char_end": at + len(t)})
        at += len(t) + 1
    return {"page_no": no, "sheet": sheet, "text": text if text is not None else "\n".join(t for _, t in blocks), "blocks": out, "tables": tables or []}


def lines_of(rows: list[list]) -> str:
    return "\n".join(", ".join("" if v is None else v for v in row) for row in rows)


def read_csv(raw: bytes, dialect: str) -> list[dict]:
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig")), dialect=dialect))
    text = lines_of(rows)
    return [page(1, [("table", text)], [table(rows)], text=text)]


def read_text(raw: bytes, marked: bool) -> list[dict]:
    parts = [p.strip("\n") for p in re.split(r"\n\s*\n", raw.decode("utf-8", "replace"))]
    return [page(1, [("heading" if marked and p.startswith("#") else "paragraph", p) for p in parts if p.strip()])]


def read_email(raw: bytes) -> tuple[list[dict], dict, list[tuple[str, bytes]]]:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    meta = {k: str(message[k]) for k in ("From", "To", "Subject", "Date") if message[k]}
    blocks = [("email_header", "\n".join(f"{k}: {v}" for k, v in meta.items()))]
    files = []
    for part in message.walk():
        if part.get_filename():
            files.append((part.get_filename(), part.get_payload(decode=True) or b""))
        elif part.get_content_type() == "text/plain":
            blocks += [("paragraph", p) for p in re.split(r"\n\s*\n", part.get_content().strip()) if p.strip()]
    return [page(1, blocks)], {k.lower(): v for k, v in meta.items()}, files


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = z.read(name)
    if b"<!ENTITY" in raw:
        raise ValueError("entities in office files are not read")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _grid(e: ElementTree.Element) -> list[list]:
    return [["\n".join(_said(p) for p in c.iter() if _local(p) == "p") for c in row if _local(c) == "tc"] for row in e.iter() if _local(row) == "tr"]


def read_docx(raw: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(e for e in _xml(z, "word/document.xml") if _local(e) == "body")
    blocks, tables = [], []
    for e in body:
        if _local(e) == "tbl":
            rows = _grid(e)
            tables.append(table(rows))
            blocks.append(("table", lines_of(rows)))
        elif _local(e) == "p" and _said(e).strip():
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            blocks.append(("heading" if style.lower().startswith("heading") else "paragraph", _said(e)))
    return [page(1, blocks, tables)]


def read_pptx(raw: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for no, (i, name) in enumerate(slides, 1):
            blocks, tables = [], []
            for shape in _xml(z, name).iter():
                if _local(shape) == "sp":
                    titled = any(_local(x) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                    said = "\n".join(t for p in shape.iter() if _local(p) == "p" and (t := _said(p)))
                    if said.strip():
                        blocks.append(("heading" if titled else "paragraph", said))
                elif _local(shape) == "tbl":
                    rows = _grid(shape)
                    tables.append(table(rows))
                    blocks.append(("table", lines_of(rows)))
            notes = f"ppt/notesSlides/notesSlide{i}.xml"
            if notes in names and _said(_xml(z, notes)).strip():
                blocks.append(("slide_note", _said(_xml(z, notes))))
            out.append(page(no, blocks, tables))
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_xlsx(raw: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [_said(e) for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        dated = set()
        if "xl/styles.xml" in z.namelist():
            styles = _xml(z, "xl/styles.xml")
            own = {f.attrib["numFmtId"] for f in styles.iter() if _local(f) == "numFmt" and re.search("[ymd]", f.attrib.get("formatCode", ""))}
            for xfs in (e for e in styles if _local(e) == "cellXfs"):
                dated = {str(i) for i, xf in enumerate(xfs) if xf.attrib.get("numFmtId") in own | {"14", "15", "16", "17", "22"}}
        links = {r.attrib["Id"]: r.attrib["Target"] for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        sheets = [(s.attrib["name"], next(v for k, v in s.attrib.items() if k.endswith("}id"))) for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"]
        for no, (name, link) in enumerate(sheets, 1):
            rows: dict[int, dict[int, str]] = {}
            for c in _xml(z, links[link][1:] if links[link].startswith("/") else posixpath.normpath(f"xl/{links[link]}")).iter():
                if _local(c) != "c" or "r" not in c.attrib:
                    continue
                v = next((x.text for x in c if _local(x) == "v"), None)
                kind = c.attrib.get("t")
                said = _said(c) if kind == "inlineStr" else shared[int(v)] if kind == "s" and v is not None else v
                if said is None:
                    continue
                if kind is None and c.attrib.get("s") in dated:
                    said = (date(1899, 12, 30) + timedelta(days=int(float(said)))).isoformat()
                rows.setdefault(int(re.search(r"\d+", c.attrib["r"])[0]) - 1, {})[_column(c.attrib["r"])] = said
            wide = 1 + max((c for r in rows.values() for c in r), default=-1)
            grid = [[rows.get(r, {}).get(c) for c in range(wide)] for r in range(1 + max(rows, default=-1))]
            text = lines_of(grid)
            out.append(page(no, [("table", text)], [table(grid, name)], name, text))
    return out


def read(filename: str, raw: bytes) -> dict:
    """ext, pages, meta, attachments, error of one file."""
    ext = detect(filename, raw)
    out = {"ext": ext, "pages": [], "meta": {}, "attachments": [], "error": None}
    try:
        if ext in ("csv", "tsv"):
            out["pages"] = read_csv(raw, "excel" if ext == "csv" else "excel-tab")
        elif ext in ("txt", "md"):
            out["pages"] = read_text(raw, ext == "md")
        elif ext == "eml":
            pages, meta, files = read_email(raw)
            out |= {"pages": pages, "meta": meta, "attachments": [{"filename": n, "content": b} for n, b in files]}
        elif ext in ("docx", "pptx", "xlsx"):
            out["pages"] = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}[ext](raw)
        elif ext == "pdf":
            out["pages"] = read_pdf(raw)
        elif ext in ("png", "jpg", "jpeg"):
            out |= {"pages": [page(1, [])], "meta": {"ocr_skipped": "true"}}
        else:
            out["error"] = "unsupported"
    except Exception as e:
        out["error"] = f"{type(e).__name__}: {e}"[:500]
    return out


def read_pdf(raw: bytes) -> list[dict]:
    """Text of a PDF's pages, where a library for that is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF library is installed") from None
    return [page(i, [("paragraph", p.extract_text() or "")]) for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1)]


JUNK = re.compile(r"(^|/)(__MACOSX/|\.DS_Store$|Thumbs\.db$|\.)")


def judged(infos: list[zipfile.ZipInfo], most: int = 5000, total: int = 2 * 2**30, cap: int = 100 * 2**20) -> Iterator[tuple[zipfile.ZipInfo, str, str | None]]:
    """(entry, path, reason to skip it) of an archive's files."""
    held = 0
    for n, m in enumerate(x for x in infos if not x.is_dir()):
        held += m.file_size
        path = posixpath.normpath(m.filename.replace("\\", "/"))
        yield m, path, "too many files" if n >= most else "too large in all" if held > total else "outside the archive" if path.startswith(("/", "../")) or ":" in path else "junk" if JUNK.search(path) else "too large" if m.file_size > cap else None


def members(raw: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, reason) of an archive's files; what is skipped has a reason and no content."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for m, path, reason in judged(z.infolist()):
            yield path, None if reason else z.read(m), reason


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unpacked(files: DataFrame) -> DataFrame:
    """(path, content, reason): archives give way to their members."""

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                if detect(path, raw) != "zip":
                    yield pd.DataFrame({"path": [path], "content": [raw], "reason": [None]})
                    continue
                for name, content, reason in members(raw):
                    yield pd.DataFrame({"path": [f"{path}!/{name}"], "content": [content], "reason": [reason]})

    return files.mapInPandas(open_, "path string, content binary, reason string")


def described(path: str, raw: bytes) -> dict:
    """A row of ``PARSED`` for one file."""
    name = posixpath.basename(path)
    one = read(name, raw)
    return {"path": path, "filename": name, "ext": one["ext"], "mime": MIME.get(one["ext"], "application/octet-stream"), "sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw)} | {k: one[k] for k in ("pages", "meta", "attachments", "error")}


def parsed(files: DataFrame) -> DataFrame:
    """A nested row for each file of (path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                yield pd.DataFrame([described(path, raw)])

    return files.filter("content is not null").mapInPandas(parse, PARSED)


def pages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("sha256").alias("document_id"), "filename", F.explode("pages").alias("p")).select("document_id", "filename", "p.page_no", "p.sheet", "p.text", "p.blocks", "p.tables")


def blocks(docs: DataFrame) -> DataFrame:
    return pages(docs).select("document_id", "page_no", F.posexplode("blocks").alias("order", "b")).select("document_id", "page_no", "order", "b.*")


def tables(docs: DataFrame) -> DataFrame:
    out = pages(docs).select("document_id", "page_no", F.posexplode("tables").alias("order", "t"))
    return out.select("document_id", F.concat_ws("/", "document_id", "page_no", "order").alias("table_id"), "page_no", "t.*")


def cells(docs: DataFrame, deal_id: Column | None = None) -> DataFrame:
    """(deal_id, document_id, table_id, row, col, text, value_num, value_date), as the extractors read them."""
    return tables(docs).select((F.lit(1) if deal_id is None else deal_id).alias("deal_id"), "document_id", "table_id", F.explode("cells").alias("c")).select("deal_id", "document_id", "table_id", "c.*")


def children(docs: DataFrame) -> DataFrame:
    """(path, content, parent) of files attached to messages, to be parsed in their turn."""
    return docs.select("path", "sha256", F.explode("attachments").alias("a")).select(F.concat_ws("!/", "path", "a.filename").alias("path"), "a.content", F.col("sha256").alias("parent"))


def blob_path(sha256: Column) -> Column:
    """Content address: two characters of the hash as a folder."""
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 62))


def mime(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))


def replace_documents(rows: DataFrame, path: str) -> None:
    """Write rows partitioned by document_id in place of what these documents had; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def scanned(chars: Column, image_area: Column, page_area: Column) -> Column:
    """Whether a page is a picture of text: hardly any characters, and images over half of it."""
    return (chars < 50) & (page_area > 0) & (image_area / page_area > 0.5)
