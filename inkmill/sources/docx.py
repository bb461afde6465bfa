"""DOCX bodies in order, with tables and images, as a data source: spark.read.format("docx") and spark.readStream.format("docx").

A row is a paragraph, a table row or an image. An image takes the place of the paragraph that holds it, whose text is its caption, and is named by
its number in the document and its own name. A file is read by one task; a task reads FILES files at most. The stream's offset is the
time and name of the last file taken, so each file is read once, whatever else is in the folder.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, pos int, kind string, style string, text string, bold boolean, size double, name string, content binary"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING, VECTOR = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{urn:schemas-microsoft-com:vml}"
#: Files a task reads, as a request takes.
FILES = 3


def _relations(z: zipfile.ZipFile) -> dict[str, str]:
    try:
        root = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
    except KeyError:
        return {}
    return {r.get("Id"): r.get("Target", "") for r in root}


def _images(z: zipfile.ZipFile, paragraph: ElementTree.Element, relations: dict[str, str]) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of a paragraph's images that the file holds, in order."""
    found = [(n.get(f"{RELATION}embed") or n.get(f"{RELATION}link")) for n in paragraph.iter(f"{DRAWING}blip")] + [n.get(f"{RELATION}id") for n in paragraph.iter(f"{VECTOR}imagedata")]
    for rid in found:
        target = relations.get(rid or "", "")
        for place in (target, f"word/{target}", target.lstrip("/")):
            if place in z.NameToInfo and (data := z.read(place)):
                yield posixpath.basename(target), data
                break


def _said(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORD}t"))


def _largest(node: ElementTree.Element) -> float:
    """The largest font size of a paragraph's runs in points, 0 if none is set."""
    marks = [m.get(f"{WORD}val", "") for r in node.iter(f"{WORD}r") for tag in ("sz", "szCs") for m in r.findall(f"{WORD}rPr/{WORD}{tag}")]
    return max((int(m) / 2 for m in marks if m.isdigit()), default=0.0)


def parts(data: bytes) -> Iterator[tuple[str, str, str, bool, float, str | None, bytes | None]]:
    """(kind, style, text, bold, size, name, content) of a DOCX file's body; kind is text, row or image."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, relations, n = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body"), _relations(z), 0
        for node in body if body is not None else ():
            if node.tag == f"{WORD}p":
                found, style = node.find(f"{WORD}pPr/{WORD}pStyle"), ""
                style = found.get(f"{WORD}val", "") if found is not None else ""
                bold = any(r.find(f"{WORD}rPr/{WORD}b") is not None and _said(r).strip() for r in node.iter(f"{WORD}r"))
                pictured = False
                for name, content in _images(z, node, relations):
                    n, pictured = n + 1, True
                    yield "image", style, _said(node), bold, _largest(node), f"{n}_{name}", content
                if not pictured:
                    yield "text", style, _said(node), bold, _largest(node), None, None
            elif node.tag == f"{WORD}tbl":
                for row in node.iter(f"{WORD}tr"):
                    yield "row", "", " | ".join(_said(cell) for cell in row.iter(f"{WORD}tc")), False, 0.0, None, None


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    """A file's rows; one that can't be read gives none."""
    try:
        made = list(parts(data))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    for k, (kind, style, text, bold, size, name, content) in enumerate(made):
        yield path, k, kind, style, text, bool(bold), size, name, content


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _listed(path: str) -> list[tuple[int, str]]:
    """(time, path) of a folder's DOCX files, in order."""
    from pyarrow import fs

    files, folder = _folder(path)
    found = files.get_file_info(fs.FileSelector(folder, recursive=False))
    return sorted((int(f.mtime_ns or 0), f.path) for f in found if f.is_file and f.path.lower().endswith(".docx"))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _dealt(paths: list[str], most: int) -> list[Files]:
    return [Files(tuple(paths[k : k + most])) for k in range(0, len(paths), most)] or [Files(())]


def _read(folder: str, part: Files) -> Iterator[tuple]:
    files, _ = _folder(folder)
    for path in part.paths:
        with files.open_input_file(path) as f:
            yield from _rows(path, f.read())


class DocxReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        return _dealt([p for _, p in _listed(self.folder)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.folder, partition)


class DocxStream(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = _listed(self.folder)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((x["time"], x["path"]) for x in (start, end))
        return _dealt([p for t, p in _listed(self.folder) if after < (t, p) <= upto], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def _most(self) -> int:
        return int(self.options.get("filesPerTask", FILES))

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"], self._most())

    def streamReader(self, schema) -> DocxStream:
        return DocxStream(self.options["path"], self._most())


def register(spark: SparkSession) -> None:
    """Make the format docx known to a session."""
    spark.dataSource.register(DocxSource)


def docx_parts(files: DataFrame) -> DataFrame:
    """The same rows from files(path, content) that Spark has read, of any store that it reads."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(_rows(path, data)), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def content_type(content: Column) -> Column:
    """What a file is by its first bytes: pdf, docx (a zip archive that names a Word body), doc, or null."""
    head = F.hex(F.substring(content, 1, 8))
    worded = F.contains(F.hex(content), F.hex(F.lit("word/document.xml").cast("binary")))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304") & worded, "docx").when(head == "D0CF11E0A1B11AE1", "doc")


def uploads(files: DataFrame, most_files: int = 3, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """files(request, path, length, content) with type and error: which uploads are taken, and why others aren't.

    A name's suffix tells the type, or the content if there is none. A request of more than ``most_files`` is refused whole.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.when(suffix != "", suffix).otherwise(content_type(F.col("content")))
    many = files.groupBy("request").agg(F.count("*").alias("_n")).where(F.col("_n") > most_files)
    error = (
        F.when(F.col("_n").isNotNull(), "too many files").when(~F.coalesce(kind.isin("pdf", "docx", "doc"), F.lit(False)), "unknown type")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > most_bytes, "too large")
    )
    return files.join(many, "request", "left").select(*files.columns, kind.alias("type"), error.alias("error"))
