"""Archives whose members are read in tasks of their own, and a data source of whole rooms.

An archive's directory is at its end and names the place of every member, so it is read once and nothing is inflated for it. The entries, a few numbers
each, are dealt out by bytes; each task then reads the byte ranges of its own members. An archive of any size is thus never in one row or task.

Files are opened with pyarrow's file systems (local, HDFS, S3 and others by URI). For stores that only Spark's readers can open there is ``files.unpacked``, which takes whole files.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

PARTITION = 64 * 2**20  #: bytes of files that a task reads, about
ENTRY = "path string, member string, offset long, packed long, size long, method int, crc long, reason string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def entries(path: str, size: int) -> list[tuple]:
    """Rows of ``ENTRY``: the file itself, or the members of an archive."""
    system, name = opened(path)
    whole = [(path, None, 0, size, size, 0, None, None)]
    with system.open_input_file(name) as f:
        if f.read(4) != b"PK\x03\x04":
            return whole
        try:
            with zipfile.ZipFile(f) as z:
                infos = z.infolist()
        except (zipfile.BadZipFile, ValueError, OSError):  # no archive after all; pyarrow says so by a ValueError
            return whole
    if {m.filename for m in infos} & set(files.MEMBER):  # documents that are archives by format
        return whole
    return [(path, inner, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, reason or ("encrypted" if m.flag_bits & 1 else None)) for m, inner, reason in files.judged(infos)]


def content(path: str, member: str | None, offset: int, packed: int, size: int, method: int, crc: int | None) -> tuple[bytes | None, str | None]:
    """The bytes of a file or member, or why there are none."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        if member is None:
            return f.read(), None
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            return None, "damaged"
        f.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        raw = f.read(packed)
    try:
        if method == zipfile.ZIP_DEFLATED:
            raw = zlib.decompressobj(-15).decompress(raw, size + 1)  # no more than it says
        elif method != zipfile.ZIP_STORED:
            return None, "unknown compression"
    except zlib.error:
        return None, "damaged"
    return (raw, None) if len(raw) == size and zlib.crc32(raw) == crc else (None, "damaged")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``ENTRY`` of all files below a folder; Spark lists them and reads no content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ENTRY.split(", ")]
        for b in batches:
            for p, n in zip(b["path"], b["length"], strict=True):
                yield pd.DataFrame(entries(p, int(n)), columns=names).astype({"crc": "Int64", "member": object, "reason": object})

    return listed.mapInPandas(look, ENTRY)


def inflated(listed: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(path, content, reason) of entries, dealt over as many tasks as their bytes take."""
    tasks = int((listed.filter("reason is null").agg(F.coalesce(F.sum(F.greatest("packed", F.lit(1))), F.lit(1)).alias("n")).first()["n"] + partition - 1) // partition)
    dealt = listed.repartition(max(1, tasks), "path", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                member = r.member if isinstance(r.member, str) else None
                raw, why = (None, r.reason) if isinstance(r.reason, str) else content(r.path, member, int(r.offset), int(r.packed), int(r.size), int(r.method), None if pd.isna(r.crc) else int(r.crc))
                yield pd.DataFrame({"path": [r.path if member is None else f"{r.path}!/{member}"], "content": [raw], "reason": [why]})

    return dealt.mapInPandas(read, "path string, content binary, reason string")


class Share(InputPartition):
    """Entries that one task reads."""

    def __init__(self, of: list[tuple]):
        self.of = of


class RoomReader(DataSourceReader):
    def __init__(self, path: str, partition: int):
        self.path, self.partition = path, partition

    def partitions(self) -> list[Share]:
        system, name = opened(self.path)
        scheme = re.match(r"[a-z0-9]+://[^/]*(?=/)", self.path) or re.match("", "")
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
        out, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if any(part.startswith((".", "_")) for part in f.path[len(name) :].split("/")):
                continue
            for e in entries(f"{scheme[0]}{f.path}" if scheme[0] and not f.path.startswith(scheme[0]) else f.path, f.size):
                if not out or held + e[3] > self.partition:
                    out.append(Share([]))
                    held = 0
                out[-1].of.append(e)
                held += e[3]
        return out or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        names = [c.split(" ")[0] for c in files.PARSED.split(", ")][:6]
        for path, member, offset, packed, size, method, crc, reason in partition.of:
            full = path if member is None else f"{path}!/{member}"
            raw, why = (None, reason) if reason else content(path, member, offset, packed, size, method, crc)
            if raw is None:
                yield (full, full.rsplit("/", 1)[-1], None, None, None, size, [], {}, [], why)
                continue
            one = files.described(full, raw)
            yield (*(one[n] for n in names), [_page(p) for p in one["pages"]], one["meta"], [(a["filename"], a["content"]) for a in one["attachments"]], one["error"])


def _page(p: dict[str, Any]) -> tuple:
    cell = lambda c: tuple(c[k] for k in ("row", "col", "text", "value_num", "value_date"))
    table = lambda t: (t["n_rows"], t["n_cols"], t["header_row"], t["sheet"], [cell(c) for c in t["cells"]])
    block = lambda b: tuple(b[k] for k in ("kind", "text", "char_start", "char_end"))
    return (p["page_no"], p["sheet"], p["text"], [block(b) for b in p["blocks"]], [table(t) for t in p["tables"]])


class Room(DataSource):
    """``spark.read.format("room").load(folder)``: a row of ``files.PARSED`` for each file and member; what can't be read is a row with its reason in ``error``.

    Options: ``path``, and ``partitionBytes`` for a task. Files and folders that begin with a dot or an underscore are left out, as Spark's own readers do.
    """

    @classmethod
    def name(cls) -> str:
        return "room"

    def schema(self) -> str:
        return files.PARSED

    def reader(self, schema: Any) -> RoomReader:
        return RoomReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Room)
