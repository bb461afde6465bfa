"""Readers: files, content lists, DOCX bodies, marked texts, landing folders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = "{pdf,PDF,docx,DOCX,doc,DOC}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LANDING = "path string, modificationTime timestamp, length long, content binary"


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to the session's cores where their scan has fewer partitions, as of a file with one row group.

    A scan that is wide enough stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def discover(spark: SparkSession, path: str, suffixes: str = SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder, not of folders within it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").load(path)


def _file_name() -> Column:
    """The name of the file that a row comes from; Spark gives it percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(stem, raw) of content-list JSON files; a v2 file is preferred to a v1 file of the same stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*content_list*.json").select("value", _file_name().alias("file"))
    named = files.select(F.regexp_extract("file", r"^(.*?)_content_list(?:_v\d)?\.json$", 1).alias("stem"), F.col("file").contains("_v2").alias("v2"), F.col("value").alias("raw"))
    w = Window.partitionBy("stem").orderBy(F.desc("v2"))
    return named.withColumn("k", F.row_number().over(w)).where("k = 1").select("stem", "raw")


def middle_pages(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, width, height, n_blocks, raw) of the layout files beside content lists: a row a page, raw being the page's JSON."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*_middle.json").select("value", _file_name().alias("file"))
    stem = F.regexp_extract("file", r"^(.*)_middle\.json$", 1).alias("stem")
    pages = files.select(stem, F.posexplode(F.from_json(F.get_json_object("value", "$.pdf_info"), "array<string>")).alias("at", "raw"))
    page = F.from_json("raw", "struct<page_idx: int, page_size: array<double>, para_blocks: array<string>>")
    each = pages.withColumn("p", page).select("stem", (F.coalesce("p.page_idx", "at") + 1).alias("page"), F.get("p.page_size", F.lit(0)).alias("width"), F.get("p.page_size", F.lit(1)).alias("height"), F.coalesce(F.size("p.para_blocks"), F.lit(0)).alias("n_blocks"), "raw")
    return each


def content_blocks(lists: DataFrame) -> DataFrame:
    """(stem, page, pos, type, sub_type, text, has_text_level, text_level, bbox, img_path, table_body, raw) of content lists.

    A list of lists is pages of blocks; a list of blocks names each one's page in page_num or page_idx. raw is the block's JSON,
    for the functions of ``functions.content``.
    """
    block = "struct<type: string, sub_type: string, text: string, text_level: string, bbox: array<double>, img_path: string, table_body: string, page_num: int, page_idx: int>"
    paged = F.col("raw").rlike(r"^\s*\[\s*\[")
    pages = lists.where(paged).select("stem", F.posexplode(F.from_json("raw", "array<array<string>>")).alias("p", "bs")).select("stem", (F.col("p") + 1).alias("page"), F.posexplode("bs").alias("pos", "raw"))
    flat = lists.where(~paged).select("stem", F.posexplode(F.from_json("raw", "array<string>")).alias("pos", "raw")).select("stem", F.lit(None).cast("int").alias("page"), "pos", "raw")
    each = pages.unionByName(flat).withColumn("b", F.from_json("raw", block)).where("b IS NOT NULL")
    own = F.coalesce("page", F.nullif("b.page_num", F.lit(0)), "b.page_idx", F.lit(0)).alias("page")
    return each.select("stem", own, "pos", "b.type", "b.sub_type", "b.text", F.col("b.text_level").isNotNull().alias("has_text_level"), "b.text_level", "b.bbox", "b.img_path", "b.table_body", "raw")


def _body(data: bytes) -> Iterator[tuple[str, str, bool, bool]]:
    """(style, text, in_table, bold) of a DOCX body's paragraphs and table rows, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            yield (style.get(f"{W}val", "") if style is not None else ""), "".join(t.text or "" for t in node.iter(f"{W}t")), False, any(r.find(f"{W}rPr/{W}b") is not None and any((t.text or "").strip() for t in r.iter(f"{W}t")) for r in node.iter(f"{W}r"))
        elif node.tag == f"{W}tbl":
            for row in node.iter(f"{W}tr"):
                yield "", " | ".join("".join(t.text or "" for t in cell.iter(f"{W}t")) for cell in row.iter(f"{W}tc")), True, False


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, style, text, in_table, bold) of DOCX files; a file that can't be read gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows = list(_body(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame([(path, k, *r) for k, r in enumerate(rows)], columns=["path", "pos", "style", "text", "in_table", "bold"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, style string, text string, in_table boolean, bold boolean")


def marked_text(files: DataFrame) -> DataFrame:
    """(path, text) of marked DOCX files: stripped lines that aren't empty, tables left out."""
    p = docx_paragraphs(files).where("NOT in_table").withColumn("text", F.regexp_replace("text", F.lit(r"(?U)^\s+|\s+$"), F.lit(""))).where("text <> ''")
    return p.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\n").alias("text"))


def style_level(style: str = "style"):
    """0 for titles, n for headings, null for the rest."""
    s = F.lower(F.col(style))
    return F.when(s.rlike("^title$|^标题$"), 0).when(s.rlike(r"^heading\s*\d|^\d$"), F.regexp_extract(s, r"(\d)", 1).cast("int"))


def landing(spark: SparkSession, path: str, suffixes: str = SUFFIXES) -> DataFrame:
    """A stream of files that arrive in a folder."""
    return spark.readStream.format("binaryFile").schema(LANDING).option("pathGlobFilter", f"*.{suffixes}").load(path)


def accepted(files: DataFrame, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """Uploads that aren't empty and not too large."""
    return files.where((F.col("length") > 0) & (F.col("length") <= most_bytes))


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines store; corrupt lines and a missing schema's fields are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sql_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a SQL dump's INSERT lines as strings, NULL as null; columns name the values in order.

    A line holds one row. Quotes within a string are doubled, as SQL writes them.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*INSERT INTO "))
    values = F.regexp_extract("value", r"(?s)\bVALUES\s*\((.*)\)\s*;?\s*$", 1)
    each = F.regexp_extract_all(values, F.lit(r"'(?:[^']|'')*'|[^,\s']+"), F.lit(0))
    plain = lambda v: F.when(v.startswith("'"), F.replace(F.substring(v, 2, F.length(v) - 2), F.lit("''"), F.lit("'"))).when(F.upper(v) != "NULL", v)
    read = F.transform(each, plain)
    return lines.withColumn("_row", read).where(F.size("_row") == len(columns)).select(*(F.get("_row", F.lit(k)).alias(c) for k, c in enumerate(columns)))


def direct_jobs(files: DataFrame) -> DataFrame:
    """Jobs of files(path, length, modificationTime) that are marked already and skip parsing: completed at once."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.md5(F.concat_ws("|", "path", "length")).alias("id"), name.alias("filename"), F.col("length").alias("file_size"), F.lit("completed").alias("status"), F.unix_timestamp("modificationTime").cast("double").alias("created_at"))


def docx_images(files: DataFrame) -> DataFrame:
    """(path, name, content, image): images of DOCX files, image being named by its content (md5 and suffix; jpeg is jpg)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows = [(path, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/")]
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame(rows, columns=["path", "name", "content"])

    found = files.select("path", "content").mapInPandas(run, "path string, name string, content binary")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return found.withColumn("image", F.concat(F.md5("content"), F.lit("."), F.when(suffix == "jpeg", "jpg").otherwise(suffix)))
