"""WARC derivatives: linked metadata and plain-text conversion records from response records.

``responses`` turns pages(page_id, url, html) into response records, ``derive`` turns responses into one
metadata and one conversion record each; the metadata keep the source record's fields and its HTTP status and headers. ``write_warc`` writes records as WARC/1.1 files, a gzip member a record, with an index of
where each record is, so ``read_warc`` reads any of them alone and splits files between tasks. ``scan_warc`` reads
files that have no index.

Files are named by task attempt and the index names those of the attempts that ended well, so a task that is run again, after its
executor was lost or beside a slow one, leaves nothing wrong behind.

Nulls and odd input: a null html is an empty payload; a null url leaves WARC-Target-URI out. Record ids are
name-based digests of (page_id, url, html), so repeated rows give records with equal ids, and a rerun gives the
same ids. A null block is written as an empty one. Very long pages, and pages full of tags that never end, are scanned in time linear in their
length. Empty tables give empty tables. Extra columns of pages are ignored.
"""

from __future__ import annotations

import gzip
import html as htmllib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .subwords import in_slices

INDEX = "record_id string, warc_type string, file string, at long, size long"
#: Records that a task works on at a time.
ROWS = 500
#: The date of records whose pages have none.
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
FIELDS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, block string"


def sha1_base32(c: Column) -> Column:
    """sha1:<base32> as WARC files state it: five hex digits are 20 bits, so four base-32 digits."""
    hexed = F.sha1(c.cast("binary"))
    digit = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    parts = []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [digit(v, s) for s in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *parts)


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    cutout = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cutout(1, 8), cutout(9, 4), F.concat(F.lit("3"), cutout(14, 3)), F.concat(F.lit("8"), cutout(18, 3)), cutout(21, 12)), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload
    )
    return pages.select("page_id", "url", payload.alias("payload"), http.alias("block"), urn(F.col("page_id"), F.col("url"), payload).alias("rid")).select(
        "page_id",
        F.lit("response").alias("warc_type"),
        F.col("rid").alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.octet_length("block").cast("long").alias("content_length"),
        sha1_base32(F.col("block")).alias("block_digest"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        "block",
    )


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|main|aside|title|blockquote|pre|hr|dd|dt|form)\b[^>]*)>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_OPEN = {name: re.compile(rf"<{name}\b[^>]*>", re.I) for name in ("title", "a", "html")}
_TITLE_END = re.compile(r"</title", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)


def _tagged(source: str) -> int:
    """How far tags can reach: no expression looks for the end of a tag where none follows, so scans are linear in the text."""
    return source.rfind(">") + 1


def page_text(source: str) -> str:
    """Visible text: hidden elements and comments go, block tags break lines, entities are decoded."""
    shown = _HIDDEN.sub(" ", source)
    end = _tagged(shown)
    plain = _TAG.sub("", _BREAKS.sub("\n", shown[:end])) + shown[end:]
    return "\n".join(x for x in (" ".join(line.split()) for line in htmllib.unescape(plain).split("\n")) if x)


def _title(source: str) -> str | None:
    begin = _OPEN["title"].search(source, 0, _tagged(source))
    end = _TITLE_END.search(source, begin.end()) if begin else None
    return " ".join(htmllib.unescape(source[begin.end() : end.start()]).split()) if end else None


def _links(source: str) -> list[str]:
    found = []
    for tag in _OPEN["a"].finditer(source, 0, _tagged(source)):
        name = _HREF.search(source, tag.start(), tag.end())
        if name and (value := _VALUE.match(source, name.end())):
            found.append(htmllib.unescape(value[1] or value[2] or value[3] or ""))
    return found


def page_metadata(source: str, head: str = "") -> str:
    """What a page says of itself, and the status and header lines that it came with."""
    lang = next((m[1] for tag in _OPEN["html"].finditer(source, 0, _tagged(source)) if (m := _LANG.search(source, tag.start(), tag.end()))), None)
    links, lines = _links(_HIDDEN.sub(" ", source)), head.split("\r\n")
    headers = [[name.strip(), value.strip()] for name, colon, value in (x.partition(":") for x in lines[1:]) if colon]
    return json.dumps({"title": _title(source), "lang": lang, "n_links": len(links), "links": links, "http-status": lines[0] or None, "http-headers": headers}, ensure_ascii=False)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.StringType())]))
def _extract(blocks: pd.Series) -> pd.DataFrame:
    parts = [(b or "").partition("\r\n\r\n") for b in blocks]
    return pd.DataFrame({"text": [page_text(body) for _, _, body in parts], "meta": [page_metadata(body, head) for head, _, body in parts]})


def derive(records: DataFrame) -> DataFrame:
    """One metadata and one conversion record for each response record; other record types are passed over."""
    made = records.where("warc_type = 'response'").withColumn("x", _extract("block"))
    head = F.to_json(F.struct(F.col("record_id").alias("source-record"), F.col("content_type").alias("source-content-type"), F.col("content_length").alias("source-content-length"), F.col("block_digest").alias("source-block-digest"), F.col("payload_digest").alias("source-payload-digest")))
    meta = F.concat(F.lit('{"envelope":'), head, F.lit(',"page":'), F.col("x.meta"), F.lit("}"))
    both = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/json").alias("c"), meta.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("x.text").alias("b")),
    )
    return made.select("page_id", "record_id", "target_uri", "warc_date", F.explode(both).alias("d")).select(
        "page_id",
        F.col("d.t").alias("warc_type"),
        urn(F.col("record_id"), F.col("d.t")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("d.c").alias("content_type"),
        F.octet_length("d.b").cast("long").alias("content_length"),
        sha1_base32(F.col("d.b")).alias("block_digest"),
        sha1_base32(F.col("d.b")).alias("payload_digest"),
        F.col("d.b").alias("block"),
    )


def as_text(records: DataFrame, *keep: str) -> DataFrame:
    """value, one string a record: header lines, an empty line, the block and its closing line break; and the columns to keep."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))).otherwise("")
    return records.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.col("warc_type")),
            line("WARC-Record-ID", F.col("record_id")),
            line("WARC-Refers-To", F.col("refers_to")),
            line("WARC-Target-URI", F.regexp_replace("target_uri", r"[\r\n]", "")),
            line("WARC-Date", F.col("warc_date")),
            line("Content-Type", F.col("content_type")),
            line("WARC-Block-Digest", F.col("block_digest")),
            line("WARC-Payload-Digest", F.col("payload_digest")),
            line("X-Page-Id", F.col("page_id")),
            line("Content-Length", F.coalesce("content_length", F.lit(0))),
            F.lit(CRLF),
            F.coalesce("block", F.lit("")),
            F.lit(CRLF),
        ).alias("value"),
        *keep,
    )


def _folder(path: str):
    """The file system of a folder that all executors share, and the folder's path on it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/*", "file:///", path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_warc(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """WARC/1.1 files under path/files and their index (record_id, warc_type, file, at, size) under path/index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _folder(f"{path}/files")
        files.create_dir(folder, recursive=True)
        task, out, n, at = TaskContext.get(), None, 0, 0
        name = ""
        for b in in_slices(batches, ROWS):
            index: list[tuple] = []
            for value, record, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n % records_per_file == 0:
                    if out:
                        out.close()
                    name, at = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n // records_per_file}.warc.gz", 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress((value + CRLF).encode(), 5, mtime=0)
                out.write(member)
                index.append((record, kind, name, at, len(member)))
                n, at = n + 1, at + len(member)
            columns = list(zip(*index, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], ["record_id", "warc_type", "file", "at", "size"])
        if out:
            out.close()

    rows = as_text(records, "record_id", "warc_type")
    rows.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
        n = int(head["Content-Length"])
        yield head | {"block": data[end + 4 : end + 4 + n].decode()}
        at = end + 4 + n + 4


def _rows(found: Iterator[dict]) -> pd.DataFrame:
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
    rows = [{"page_id": int(r["X-Page-Id"]) if "X-Page-Id" in r else None, "content_length": int(r["Content-Length"]), "block": r["block"]} | {k: r.get(v) for k, v in names.items()} for r in found]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")]).astype({"page_id": "Int64"})


def read_warc(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """The records of write_warc's files that a condition on the index names, each read from its own place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = _folder(f"{path}/files")
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                for name, own in batch.iloc[k : k + ROWS].groupby("file", sort=False):
                    with files.open_input_file(f"{folder}/{name}") as f:
                        yield _rows(r for at, size in zip(own["at"], own["size"], strict=True) for r in _parse(gzip.decompress(f.read_at(size, at))))

    index = spark.read.schema(INDEX).parquet(f"{path}/index").where(where)
    return index.select("file", "at", "size").mapInPandas(run, FIELDS)


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, plain or gzipped; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield _rows(_parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content").mapInPandas(run, FIELDS)
