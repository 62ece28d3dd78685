"""Zipped bulk reports: an exchange's daily archive of CSV members, as rows.

Spark lists the archives and hands their bytes to tasks (`binaryFile`); one Arrow-batched step
unpacks each, member by member and in batches of lines, so memory follows the archive and
not its unpacked size. Files without a byte are no archives: Spark's scan passes over them.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per line of a member; an archive or member that can't be read is one row with a problem.
ROWS = "archive string, member string, line int, fields map<string,string>, problem string"
_BATCH = 10_000


def _lines(content: bytes, pattern: str) -> Iterator[tuple[str | None, int | None, dict | None, str | None]]:
    """(member, line, fields, problem) of every line of the members whose name fits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError):
        yield None, None, None, "unreadable archive"
        return
    for name in sorted(n for n in archive.namelist() if fnmatch.fnmatch(n.rsplit("/", 1)[-1].lower(), pattern.lower())):
        line = 0
        try:
            with archive.open(name) as file:
                for line, row in enumerate(csv.DictReader(io.TextIOWrapper(file, "utf-8-sig", newline="")), 1):
                    if None in row or None in row.values():
                        yield name, line, None, "wrong number of fields"
                    else:
                        yield name, line, {k.strip(): v.strip() for k, v in row.items()}, None
        except (zipfile.BadZipFile, UnicodeDecodeError, csv.Error, EOFError, NotImplementedError, RuntimeError, OSError):
            yield name, line + 1, None, "unreadable member"


def unpacked(archives: DataFrame, pattern: str = "*.csv") -> DataFrame:
    """The lines of archives given as (archive, content), with problems as rows of their own."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
        names = ["archive", "member", "line", "fields", "problem"]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out: list[tuple] = []
                for member, line, fields, problem in _lines(content.as_py() or b"", pattern):
                    out.append((name.as_py(), member, line, None if fields is None else list(fields.items()), problem))
                    if len(out) == _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return archives.select("archive", "content").mapInArrow(unpack, ROWS)


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All lines of the members that fit ``pattern`` in the zip files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return unpacked(files.select(name.alias("archive"), "content"), pattern)


def write_archives(rows: DataFrame, folder: str, cut_copies: bool = False) -> None:
    """Zip rows (archive, member, fields) into CSV members of archives below a shared folder.

    One archive is packed by one task. ``cut_copies`` writes each archive once more without its
    end, as a download that broke off leaves it.
    """
    columns = rows.schema["fields"].dataType.names

    def pack(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        (archive,) = set(group.column("archive").to_pylist())
        members: dict[str, list[dict]] = {}
        for member, fields in zip(group.column("member").to_pylist(), group.column("fields").to_pylist()):
            members.setdefault(member, []).append(fields)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as packed:
            packed.writestr("readme.txt", "Daily reports")
            for member in sorted(members):
                text = io.StringIO(newline="")
                writer = csv.DictWriter(text, columns)
                writer.writeheader()
                writer.writerows(members[member])
                packed.writestr(member, text.getvalue())
        content = buffer.getvalue()
        files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        files.create_dir(path)
        kept = {archive: content} | ({archive.replace(".zip", "-cut.zip"): content[: len(content) // 2]} if cut_copies else {})
        for name, data in kept.items():
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
        return pa.table({"archive": pa.array(list(kept)), "bytes": pa.array([len(x) for x in kept.values()], pa.int64())})

    rows.groupBy("archive").applyInArrow(pack, "archive string, bytes long").agg(F.sum("bytes")).collect()
