"""Knowledge-base, job and catalog queries over chunk, job and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimension rows up to this many are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
NO_REGION, UNSET = "000000", "未设置"
#: Statuses in which a file of the same name and size is a duplicate upload.
LIVE = ["processing", "queued", "ingesting", "uploaded", "completed", "ingested"]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def overview(kb: DataFrame, sort: str = "time") -> DataFrame:
    """Per source and file of kb(source, filename, region_code, created_at): chunks, last time, region; nulls last."""
    out = kb.groupBy("source", "filename").agg(F.count("*").alias("chunks"), F.max("created_at").alias("created_at"), F.max("region_code").alias("region_code"))
    key = {"name": F.col("filename").asc_nulls_last(), "chunks": F.col("chunks").desc_nulls_last()}.get(sort, F.col("created_at").desc_nulls_last())
    return out.orderBy(key, "source", "filename")


def totals(kb: DataFrame) -> DataFrame:
    return kb.where("source IS NOT NULL AND source <> ''").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("chunks"))


def overview_by_source(kb: DataFrame) -> DataFrame:
    return kb.groupBy("source").agg(F.count("*").alias("chunks"), F.max("created_at").alias("created_at"))


def filename_count(kb: DataFrame, filename: str) -> DataFrame:
    return kb.where(F.col("filename") == filename).agg(F.count("*").alias("n"))


def chunk_preview(kb: DataFrame, source: Column, rows: int = 20, chars: int = 2000) -> DataFrame:
    return kb.where(F.col("source") == source).orderBy("chunk_id").limit(rows).select("chunk_id", F.substring("document", 1, chars).alias("document"))


def region_of(kb: DataFrame, source: str) -> DataFrame:
    return kb.where(F.col("source") == source).orderBy("chunk_id").limit(1).select("region_code")


def region_list(regions: DataFrame, prefix: str = "13", level: int = 2) -> DataFrame:
    """Regions of a level under a code prefix, ordered by code. Deleted and disabled rows are not left out."""
    return regions.where((F.col("LEVEL_NO") == level) & F.col("MOF_DIV_CODE").startswith(prefix)).select("MOF_DIV_CODE", "MOF_DIV_NAME").orderBy("MOF_DIV_CODE", "MOF_DIV_NAME")


def region_names(regions: DataFrame) -> DataFrame:
    """(code, name), one row a code; a nine-digit code that ends in 000 is also known by its first seven digits."""
    own = regions.select(F.col("MOF_DIV_CODE").alias("code"), F.col("MOF_DIV_NAME").alias("name"))
    short = own.where((F.length("code") == 9) & F.col("code").endswith("000")).select(F.substring("code", 1, 7).alias("code"), "name")
    both = own.withColumn("k", F.lit(0)).unionByName(short.withColumn("k", F.lit(1)))
    return both.groupBy("code").agg(F.min(F.struct("k", "name")).alias("x")).select("code", F.col("x.name").alias("name"))


def with_region(rows: DataFrame, regions: DataFrame, code: str = "region_code", miss: str = "empty") -> DataFrame:
    """rows with region_label and region_name: the code's exact row, else the row of its first seven characters.

    An empty code or 000000 is labelled unset. A miss is empty (miss="empty") or the code itself (miss="code").
    """
    names = _small(region_names(regions))
    a, b = names.select(F.col("code").alias("_a"), F.col("name").alias("_an")), names.select(F.col("code").alias("_b"), F.col("name").alias("_bn"))
    c = F.col(code)
    none = c.isNull() | c.isin("", NO_REGION)
    other = F.lit("") if miss == "empty" else c
    out = rows.join(a, c == F.col("_a"), "left").join(b, F.substring(c, 1, 7) == F.col("_b"), "left")
    name = F.when(none, F.lit("")).otherwise(F.coalesce("_an", "_bn", other))
    return out.withColumns({"region_label": F.when(none, UNSET).otherwise(c), "region_name": name}).drop("_a", "_an", "_b", "_bn")


def region_code(job: Column, by_file: Column) -> Column:
    """The job's region unless it is unset, else the file map's, else 000000."""
    return F.coalesce(F.when(~job.isin("", NO_REGION), job), by_file, F.lit(NO_REGION))


def visible(rows: DataFrame, region: str, all_regions: list[str], code: str = "region_code") -> DataFrame:
    """Rows that a region may see: all for the regions listed, else its own."""
    return rows if region in all_regions else rows.where(F.col(code) == region)


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def job_count(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """How many jobs there are, or are in a status."""
    return (jobs if status is None else jobs.where(F.col("status") == status)).agg(F.count("*").alias("n"))


def job_page(jobs: DataFrame, page: int, size: int, status: str | None = None) -> DataFrame:
    """A page of jobs(id, status, created_at), newest first; ties by id."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)


def clamp_page(page: int, size: int, rows: int) -> int:
    """The page number within 1 and the last page."""
    return min(max(page, 1), max(-(-rows // size), 1))


def jobs_by_id(jobs: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """The jobs asked for, in the order asked; ids without a job are left out."""
    wanted = jobs.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)] or [], "id string, request_pos int")
    return jobs.join(F.broadcast(wanted), "id").orderBy("request_pos").select(*columns)


def duplicate_uploads(uploads: DataFrame, jobs: DataFrame, by: tuple[str, ...] = ("filename", "file_size")) -> DataFrame:
    """Uploads that a live job of the same name and size blocks. by=("file_md5",) compares content instead."""
    return uploads.join(jobs.where(F.col("status").isin(LIVE)).select(*by), list(by), "left_semi")


def new_uploads(uploads: DataFrame, known: DataFrame, by: str = "filename") -> DataFrame:
    return uploads.join(known.select(by), by, "left_anti")


def copy_numbers(rows: DataFrame, by: list[str], order: str, block: int = 1 << 16) -> DataFrame:
    """rows with copy_no: how many rows with the same values of by have a smaller order, a whole number that no two of them share.

    Numbers are given within blocks of order and led by the counts of the blocks before, so no task holds all of a large group.
    """
    cut = F.floor(F.col(order) / block).alias("_block")
    at = rows.select("*", cut)
    counts = at.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    # A group of one block needs no counts; the others have few blocks.
    led = counts.withColumn("_before", before).where("_before > 0").select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), F.col("_block").alias("_at"), "_before")
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    own = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - 1
    out = at.withColumn("copy_no", own).join(led, same & F.col("_block").eqNullSafe(F.col("_at")), "left")
    return out.select(*rows.columns, (F.col("copy_no") + F.coalesce("_before", F.lit(0))).cast("long").alias("copy_no"))


def download_names(files: DataFrame) -> DataFrame:
    """files(filename, request_pos) with name: a repeated name gets _1, _2 before its extension."""
    k = F.col("copy_no")
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    named = copy_numbers(files, ["filename"], "request_pos")
    return named.withColumn("name", F.when(k == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))).drop("copy_no")


def preview(text: Column, lines: int = 200, note: str = "...") -> Column:
    """The first lines that aren't blank, with a note as soon as that many are reached."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))), lambda x: x != "")
    return F.array_join(F.when(F.size(kept) >= lines, F.concat(F.slice(kept, 1, lines), F.array(F.lit(note)))).otherwise(kept), "\n")


def with_comments(tables: DataFrame, comments: DataFrame) -> DataFrame:
    """tables(owner, table_name, ...) with table_comment, empty where there is none."""
    return tables.join(comments, ["owner", "table_name"], "left").withColumn("table_comment", F.coalesce("comments", F.lit(""))).drop("comments")


def with_metadata_flag(tables: DataFrame, metadata: DataFrame) -> DataFrame:
    """tables(table_name, ...) with in_metadata: whether the metadata store has the name, in any case."""
    known = _small(metadata.select(F.upper(F.trim("table_name")).alias("_k")).distinct())
    return tables.join(known, F.upper(F.trim("table_name")) == F.col("_k"), "left").withColumn("in_metadata", F.col("_k").isNotNull()).drop("_k")


def catalog_tables(tables: DataFrame, comments: DataFrame, metadata: DataFrame, domains: DataFrame, owner: str) -> DataFrame:
    """Tables of an owner with comment, domain, whether they are in the metadata store (any case), and index."""
    own = with_comments(tables.where(F.col("owner") == owner), comments)
    own = with_metadata_flag(own.join(_small(domains.select("table_name", "business_domain")), "table_name", "left"), metadata)
    w = Window.partitionBy("owner").orderBy("table_name")
    return own.select(F.row_number().over(w).alias("index"), "table_name", "table_comment", F.coalesce("business_domain", F.lit("未归类")).alias("business_domain"), "in_metadata")


def search(rows: DataFrame, keyword: str, columns: list[str], **equal: str) -> DataFrame:
    """Rows one of whose columns holds the keyword in any case, and whose other columns equal what is given."""
    hit = F.lit(not keyword)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower()))
    for c, v in equal.items():
        hit = hit & (F.col(c) == v) if v else hit
    return rows.where(hit)


def vector_topk(vectors: DataFrame, column: str, k: int, query: str) -> DataFrame:
    """(vec_id, score): the k vectors of the largest cosine to the one that the condition query names; ties to the smaller id.

    The query is one vector; each task keeps its own k best, and these meet.
    """
    q = vectors.where(query).select(F.col(column).cast("array<double>").alias("_q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("_v")).join(F.broadcast(q), F.lit(True))
    score = dot(F.col("_v"), F.col("_q")) / F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_q"), F.col("_q")))
    return rows.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def check_name(name: str) -> str:
    """A schema name in capitals; ValueError for anything but letters, digits and underscores."""
    out = name.strip().upper()
    if not out or not all("A" <= c <= "Z" or c in "0123456789_" for c in out):
        raise ValueError(f"not a schema name: {name!r}")
    return out


def add_metadata(store: DataFrame, row: DataFrame) -> DataFrame:
    """store with row; ValueError if its table is there already."""
    key = F.upper(F.trim("table_name"))
    if not store.select(key.alias("k")).join(row.select(key.alias("k")), "k", "left_semi").isEmpty():
        raise ValueError("the table is in the metadata store")
    return store.unionByName(row)


def cancel_metadata(store: DataFrame, table_name: str) -> DataFrame:
    """store without the table; ValueError if it isn't there."""
    hit = F.upper(F.trim("table_name")) == table_name.strip().upper()
    if store.where(hit).isEmpty():
        raise ValueError("the table is not in the metadata store")
    return store.where(~hit)
