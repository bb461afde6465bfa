"""The engine's queries over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content
from ..functions import text as tx
from ..operators import blocks, checks, chunks, cleaning, knowledge, matcher, packing, sections, structure
from ..sources.documents import spread
from ..sources.versions import VersionedStore
from ..staging import staging_path
from ..streaming import jobs
from . import chunking, experiments, job_life


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk rows: the language stands in for a region, the length for a time."""
    d = _table(spark, sf_dir, "documents")
    return d.select("source", F.concat("source", F.lit("."), "lang").alias("filename"), F.col("lang").alias("region_code"), F.col("n_chars").alias("created_at"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, text), dealt to all cores before costly expressions."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def marker_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(f"\n{chunks.CHILD}\n")))
    return chunks.marker_explode(d)


def kb_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.overview(_kb(spark, sf_dir))


def kb_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.totals(_kb(spark, sf_dir))


def kb_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.overview_by_source(_kb(spark, sf_dir))


def check_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.filename_count(_kb(spark, sf_dir), "src0.en")


def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.chunk_preview(_kb(spark, sf_dir), F.lit("src0"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.status_counts(_table(spark, sf_dir, "events"), "event_type")


def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return knowledge.job_page(e, 3, 50).select("id", "status")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(_table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "status", "n_events")


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return jobs.changes(e, "user_id", "at", "event_type", F.date_trunc("hour", "ts")).groupBy("user_id").agg(F.count("*").alias("n_changes"))


def catalog_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.lit("main").alias("owner"), F.col("o_orderkey").cast("string").alias("table_name"))
    c = _table(spark, sf_dir, "customer").select(F.lit("main").alias("owner"), F.col("c_custkey").cast("string").alias("table_name"), F.col("c_name").alias("comments"))
    return knowledge.with_comments(o, c).select("table_name", "table_comment")


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables, regions as domains, suppliers' nations as the metadata store."""
    n = _table(spark, sf_dir, "nation").withColumn("owner", F.lit("MAIN"))
    tables = n.select("owner", F.col("n_name").alias("table_name"))
    comments = n.where("n_nationkey % 3 <> 0").select("owner", F.col("n_name").alias("table_name"), F.concat(F.lit("about "), "n_name").alias("comments"))
    domains = n.join(_table(spark, sf_dir, "region").where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("table_name"), F.col("r_name").alias("business_domain"))
    store = n.where("n_nationkey % 4 = 1").select(F.concat(F.lit(" "), F.lower("n_name")).alias("table_name"))
    return knowledge.catalog_tables(tables, comments, store, domains, knowledge.check_name(" main "))


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with codes made of their nations, and all nations but one as regions."""
    code = lambda c: F.concat(F.lit("13"), F.lpad(F.col(c).cast("string"), 5, "0"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "000000").otherwise(F.concat(code("c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "001").otherwise(""))).alias("region_code"))
    return c, _table(spark, sf_dir, "nation").where("n_nationkey <> 7").select(code("n_nationkey").alias("MOF_DIV_CODE"), F.col("n_name").alias("MOF_DIV_NAME"), (F.col("n_nationkey") % 3).alias("LEVEL_NO"))


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.with_region(*_regions(spark, sf_dir), miss="code")


def region_lookup_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.with_region(*_regions(spark, sf_dir), miss="empty")


def region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.region_list(_regions(spark, sf_dir)[1])


def region_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.region_of(_kb(spark, sf_dir), "src0")


def job_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.job_count(_table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "click")


def metadata_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _table(spark, sf_dir, "labels").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("table_name"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("table_name"))
    return knowledge.with_metadata_flag(d, store).select("doc_id", F.col("in_metadata").alias("has_label"))


def dup_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"), "n_chars")
    return knowledge.copy_numbers(d, ["hash", "n_chars"], "doc_id").select("doc_id", "copy_no")


def blocked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads that labelled ones, as jobs, block."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("filename"), F.col("n_chars").alias("file_size"))
    j = d.join(_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status")), "doc_id").drop("doc_id")
    return knowledge.duplicate_uploads(d, j).select("doc_id")


def zip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_pos"), F.concat("source", F.lit("."), "lang").alias("filename"))
    return knowledge.download_names(f).select("request_pos", "name")


def split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full stops stand for the sentence ends that the rules cut at."""
    d = _texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("."), F.lit("。")))
    return chunks.get_strategy("rules")(d)


def default_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as titles, lists, tables, images and captions, composed to parent and child chunks."""
    return chunking.default_chunk(_texts(spark, sf_dir))


def region_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, two in three with the name of a nation or region put in, matched with nations' names, their beginnings and codes."""
    nations = _table(spark, sf_dir, "nation")
    code = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    names = nations.select(F.col("n_name").alias("name"), code.alias("code")).unionByName(nations.select(F.substring("n_name", 1, 5).alias("name"), code.alias("code"))).unionByName(nations.select(code.alias("name"), code.alias("code")))
    names = names.unionByName(_table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("code")))
    planted = nations.select(F.col("n_nationkey").alias("k"), "n_name")
    docs = _table(spark, sf_dir, "documents").join(F.broadcast(planted), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 25) == F.col("k"), "left")
    name = F.when(F.col("doc_id") % 3 == 1, F.col("n_name")).when(F.col("doc_id") % 3 == 2, F.concat(F.substring("n_name", 1, 6), F.lit(" N0"), F.lpad(F.col("k").cast("string"), 2, "0"))).otherwise("")
    files = docs.select("doc_id", F.concat(F.substring("text", 1, 20), name, F.lit(" "), "text").alias("text"))
    return matcher.match_regions(files, names, "text").select("doc_id", "region_code", "matched", "n_names")


def section_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed by sections; short ones are headings."""
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("heading", F.length("text") <= 40)
    return packing.pack_sections(lines).select("doc_id", "pack", "parent", F.array_join("bodies", "|").alias("bodies"))


#: Tables of the star schema with their columns of whole numbers.
STAR = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: _table(spark, sf_dir, t).select(*c) for t, c in STAR.items()}


def star_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.table_keys(spark, _star(spark, sf_dir))


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.foreign_keys(spark, _star(spark, sf_dir)).withColumn("share", F.round("share", 6))


def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after five commits: two languages of chunks, a third that replaces one source, a source gone, regions set, the rest, one batch twice."""
    kb = _kb(spark, sf_dir).select("source", "chunk_id", "filename", "region_code")
    store = VersionedStore(spark, staging_path(spark, "versions"), "source string, chunk_id long, filename string, region_code string")
    en = F.col("region_code") == "en"
    store.commit("a", 0, kb.where(en))
    store.commit("a", 1, kb.where(~en & (F.col("source") == "src0")))
    store.commit("b", 7, gone=kb.where(F.col("source") == "src1").select("source"))
    store.commit("b", 7, kb.where(~en))
    store.commit("b", 8, kb.where(~en & ~F.col("source").isin("src0", "src2")), regions=kb.where(F.col("source").isin("src0", "src2")).select("source", F.lit("130000000").alias("region_code")))
    return store.snapshot()


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_life.job_history(_table(spark, sf_dir, "events"))


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, some of which are numbered, begin an article or go on."""
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lead = F.when(F.col("pos") % 5 == 1, F.concat(F.col("pos").cast("string"), F.lit(". "))).when(F.col("pos") % 11 == 3, "第三条 ").when(F.col("pos") % 7 == 2, "（1）").otherwise("")
    return lines.withColumn("text", F.concat(lead, "text"))


def merge_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.merge_lines(_numbered_lines(spark, sf_dir), ["doc_id"])


def list_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = chunks.runs(lines, ["doc_id"], "pos", F.length("line") <= 100)
    return found.groupBy("doc_id").agg(F.max("run").cast("long").alias("runs"), F.sum(F.col("flagged").cast("long")).alias("short_lines"))


def _sized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans; short ones are set large."""
    lines = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.withColumn("size", F.when(F.length("text") <= 60, 16.0 + F.length("text") % 5).otherwise(10.0 + F.col("pos") % 2))


def heading_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.carry_heading(_sized_lines(spark, sf_dir), 14.0).select("doc_id", "pos", "heading")


def span_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.threshold_stats(_sized_lines(spark, sf_dir))


def span_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.doc_title(_sized_lines(spark, sf_dir), 14.0)


def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lines a page, every fifth a title."""
    b = sections.line_blocks(_texts(spark, sf_dir), F.col("pos") % 5 == 2).withColumn("page", F.floor(F.col("pos") / 8).cast("int"))
    return blocks.fallback_chunks(b)


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(f"\n{chunks.CHILD}\n")))
    return d.select("doc_id", chunks.chunk_count(F.col("text")).alias("n_chunks"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small text functions side by side."""
    t, n = F.substring("text", 1, 60), F.col("doc_id")
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        tx.fix_percent_order(F.concat(F.lit("增长%约"), n.cast("string"), F.lit(".5元"))).alias("percent"),
        tx.title_level(F.when(n % 5 == 4, "x").otherwise((n % 5).cast("string"))).alias("level"),
        tx.drop_page_numbers(F.concat(t, F.lit(" — "), (n % 100).cast("string"), F.lit(" —"))).alias("unnumbered"),
        tx.xml_text(F.concat(F.lit("\x01 "), t)).alias("xml"),
        tx.canonical_name(F.concat(F.lit(" \t"), "source")).alias("name"),
        tx.format_size(n * n * 37).alias("size"),
        tx.is_page_number(F.when(n % 2 == 0, F.concat(F.lit("— "), n.cast("string"), F.lit(" —"))).otherwise(n.cast("string"))).alias("page_number"),
    )


def image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images with descriptions and captions in two scripts, and a judge's verdicts for some."""
    n = F.col("doc_id")
    d = _table(spark, sf_dir, "documents")
    images = d.select(
        "doc_id",
        F.lit(0).alias("pos"),
        F.when(n % 3 == 0, "text_image").when(n % 3 == 1, "flowchart").otherwise("photo").alias("sub_type"),
        F.concat(F.when(n % 4 == 0, "图中").otherwise(""), F.substring("text", 1, 5) , F.repeat(F.lit("x"), (n % 30).cast("int"))).alias("text"),
        F.when(n % 5 == 0, "名称").when(n % 5 == 1, "name").alias("caption"),
    )
    judge = d.where("doc_id % 7 < 2").select("doc_id", F.lit(0).alias("pos"), (n % 7 == 0).alias("keep"))
    return blocks.image_actions(images, "llm", judge).select("doc_id", "action", F.array_join("entries", "|").alias("entries"))


def spatial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images and three texts a document, on places that its id gives."""
    n = F.col("doc_id")
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    box = lambda *x: F.array(*(v.cast("double") for v in x))
    p = F.col("pos")
    x, y, w = (n * 37 + p * 113) % 500, (n * 53 + p * 71) % 300, 4 + (n * 7 + p * 5) % 200
    first, second = box(10 + n % 50, F.lit(10), 210 + n % 50, F.lit(210)), box(F.lit(300), 10 + n % 30, F.lit(460), 170 + n % 30)
    rows = d.select(
        "doc_id", F.lit(1).alias("page"), "pos", F.when(p < 2, "image").otherwise("text").alias("type"), F.when(p >= 2, F.concat(F.lit("t"), p.cast("string"), F.repeat(F.lit("x"), (n % 45).cast("int")))).alias("text"),
        F.when(p == 0, first).when(p == 1, second).otherwise(box(x, y, x + w, y + 20)).alias("bbox"), F.when(p < 2, "img.png").alias("img_path"), F.when(p == 0, "own").alias("caption"),
    )
    return blocks.merge_captions(rows).select("doc_id", "pos", "caption", "merged")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", content.visible_text(F.col("html")).alias("text"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each page's address, its parts as cells."""
    cells = F.array_join(F.transform(F.split("url", "/"), lambda c: F.concat(F.lit("<td class='a'> "), c, F.lit("</td>"))), "")
    html = F.concat(F.lit("<table><TR>"), cells, F.lit("</TR><tr></tr><tr><th>a &amp; <b>b</b></th><td>2</td></tr></table>"))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(content.table_rows(html)).alias("row", "text"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.vector_topk(_table(spark, sf_dir, "embeddings"), "embedding", 5, "vec_id = 0")


def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", knowledge.preview(F.col("text"), 3).alias("preview"))


def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.turn_chunks(_table(spark, sf_dir, "conversations"))


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.search(_table(spark, sf_dir, "documents"), "LICENSE", ["text", "source"], lang="en").select("doc_id")


def column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return checks.column_report(c, exact=c.columns)


def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    new = s.where("s_suppkey % 10 <> 1").withColumn("s_name", F.when(F.col("s_suppkey") % 7 == 0, F.lower("s_name")).otherwise(F.col("s_name")))
    return checks.sync_changes(s.where("s_suppkey % 10 <> 2"), new, "s_suppkey")


def range_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between orders and a copy in which one row in 97 is another, one in 101 is gone, and some are new."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    new = o.where(k % 101 != 7).withColumn("o_orderstatus", F.when(k % 97 == 5, "X").otherwise(F.col("o_orderstatus")))
    return checks.changes_by_ranges(o.where(k % 103 != 9), new, "o_orderkey")


def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with gaps and extreme balances put in, filled and told by market segment."""
    k, c = F.col("c_custkey"), _table(spark, sf_dir, "customer")
    odd = c.withColumns({"c_acctbal": F.when(k % 11 == 3, None).when(k % 53 == 7, F.col("c_acctbal") * 40).otherwise(F.col("c_acctbal")), "c_name": F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" \t ")), F.lit(" "))})
    made = cleaning.clean(odd, "c_mktsegment", ["c_acctbal"], ["c_name"])
    return made.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.size("filled").alias("n_filled"), F.size("outliers").alias("n_outliers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        token_estimate, clean_text, marker_explode, kb_overview, kb_totals, kb_by_source, check_filename, chunk_preview, status_counts, job_page, job_count, latest_state, state_changes,
        catalog_left_join, catalog_rows, region_lookup, region_lookup_empty, region_list, region_of_source, metadata_flag, dup_upload, blocked_uploads, zip_names, split_rules, default_chunk, merge_body, list_islands, heading_carry,
        span_sizes, span_title, page_fallback, chunk_counts, text_helpers, image_filter, spatial_merge, page_text, table_rows, vector_topk, preview_text, turn_chunks, document_search, column_report, sync_changes, job_history, store_snapshot, region_matches, section_packs, range_changes, clean_customers, star_keys, foreign_keys, experiments.hash_vectors, experiments.lexical_search, experiments.retrieval_metrics,
    )
    return {f.__name__: f for f in found}


# White space as the column functions take it; the other engine's \s is ASCII.
_S = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _tokens_sql(c: str) -> str:
    """Tokens of a text without wide characters of the second plane's extensions, as ``estimate_tokens`` counts them."""
    wide = f"regexp_replace({c}, '{tx.WIDE}', '', 'g')"
    return f"ceil(length({c}) - length({wide}) + length(regexp_replace({wide}, '{_S}', '', 'g')) / 4)"


def _clean_sql() -> str:
    c = "text"
    rules = [
        (tx.CONTROL, ""), (tx.FOREIGN, ""), (r"(^|[^\d])%" + _S + r"*([^%\d]{1,30}?)(\d+\.?\d*)", r"\1\3%\2"), (rf"([\d%]){_S}+({tx.CJK})", r"\1\2"), (rf"({tx.CJK}){_S}+([\d])", r"\1\2"),
        (rf"([a-zA-Z]){_S}+({tx.CJK})", r"\1\2"), (rf"({tx.CJK}){_S}+([a-zA-Z])", r"\1\2"), (rf"{_S}*,{_S}*({tx.CJK})", r"，\1"), (rf"({tx.CJK}){_S}*,{_S}*", r"\1，"),
        (_S + r"+([，。、；：！？》）])", r"\1"), (rf"([，。、；：！？]){_S}+({tx.CJK})", r"\1\2"), (r"[ \t]+", " "),
    ]
    for pattern, to in rules:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"SELECT doc_id, {_strip_sql(c)} AS text FROM documents"


_KB = "(SELECT source, source || '.' || lang AS filename, lang AS region_code, n_chars AS created_at, doc_id AS chunk_id, text AS document FROM documents)"
_LINES = "(SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


_SPANS = f"(SELECT *, CASE WHEN length(line) <= 60 THEN 16.0::DOUBLE + length(line) % 5 ELSE 10.0::DOUBLE + pos % 2 END AS size FROM {_LINES})"
_SPATIAL = """
WITH t AS (SELECT doc_id, unnest([2, 3, 4]) AS pos FROM documents),
tb AS (SELECT doc_id, pos, 't' || pos || repeat('x', CAST(doc_id % 45 AS INT)) AS text, (doc_id * 37 + pos * 113) % 500 AS x0, (doc_id * 53 + pos * 71) % 300 AS y0, 4 + (doc_id * 7 + pos * 5) % 200 AS tw FROM t),
im AS (SELECT doc_id, 0 AS ip, 10 + doc_id % 50 AS a0, 10 AS b0, 210 + doc_id % 50 AS a1, 210 AS b1 FROM documents UNION ALL SELECT doc_id, 1, 300, 10 + doc_id % 30, 460, 170 + doc_id % 30 FROM documents),
j AS (SELECT doc_id, pos, text, ip, a1 - a0 AS iw, tw, greatest(0, least(a1, x0 + tw) - greatest(a0, x0)) AS ox, greatest(0, least(b1, y0 + 20) - greatest(b0, y0)) AS oy,
  CASE WHEN x0 + tw <= a0 THEN a0 - x0 - tw WHEN x0 >= a1 THEN x0 - a1 END AS gx, CASE WHEN y0 + 20 <= b0 THEN b0 - y0 - 20 WHEN y0 >= b1 THEN y0 - b1 END AS gy,
  least(abs(x0 + tw - a0), abs(a1 - x0)) AS nx, least(abs(y0 + 20 - b0), abs(b1 - y0)) AS ny FROM tb JOIN im USING (doc_id) WHERE length(text) <= 40),
k AS (SELECT *, CASE WHEN tw < 8 OR tw > 2 * iw THEN NULL WHEN oy > 0 AND (ox > 0 OR gx <= 100) THEN CASE WHEN ox > 0 THEN 0 ELSE gx END WHEN ox > greatest(0.3 * iw, 30) AND (oy > 0 OR gy <= 40) THEN CASE WHEN oy > 0 THEN 0 ELSE gy END
  WHEN (ox > 0 OR nx <= 100) AND (oy > 0 OR ny <= 40) THEN sqrt(pow(CASE WHEN ox > 0 THEN 0 ELSE nx END, 2) + pow(CASE WHEN oy > 0 THEN 0 ELSE ny END, 2)) END AS d FROM j),
o AS (SELECT doc_id, pos, text, ip FROM k WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY d, ip) = 1),
c AS (SELECT doc_id, ip, string_agg(text, ' | ' ORDER BY pos) AS near FROM o GROUP BY 1, 2)
SELECT p.doc_id, CAST(p.pos AS INT) AS pos, CASE WHEN p.pos = 0 THEN 'own' || coalesce(' | ' || near, '') WHEN p.pos = 1 THEN near END AS caption, o.doc_id IS NOT NULL AS merged
FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS pos FROM documents) p LEFT JOIN c ON c.doc_id = p.doc_id AND c.ip = p.pos LEFT JOIN o ON o.doc_id = p.doc_id AND o.pos = p.pos
"""


def _region_sql(miss: str) -> str:
    return f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '000000' ELSE '13' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || CASE WHEN c_custkey % 3 = 0 THEN '001' ELSE '' END END AS region_code FROM customer),
n AS (SELECT '13' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_name FROM nation WHERE n_nationkey <> 7)
SELECT c_custkey, region_code, CASE WHEN region_code = '000000' THEN '未设置' ELSE region_code END AS region_label, CASE WHEN region_code = '000000' THEN '' ELSE coalesce(a.n_name, b.n_name, {miss}) END AS region_name
FROM c LEFT JOIN n a ON a.code = region_code LEFT JOIN n b ON b.code = substr(region_code, 1, 7)
"""


def _split_sql() -> str:
    """Each step cuts where the weight since the last cut would overflow: at the last sentence end, else there."""
    narrow = f"regexp_replace(text, '{tx.WIDE}', '', 'g')"
    tokens = f"ceil(length(text) - length({narrow}) + length(regexp_replace({narrow}, '{_S}', '', 'g')) / 4)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, replace(text, '.', '。') AS text FROM documents),
l AS (SELECT doc_id, text, length(text) AS n FROM d WHERE {tokens} > 512),
u AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(string_split(text, '')) AS ch, unnest(string_split(text, '')[2:] || ['']) AS nx FROM l),
w AS (SELECT doc_id, n, i, sum(CASE WHEN regexp_matches(ch, '{tx.WIDE}') THEN 4 WHEN regexp_matches(ch, '{_S}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS cw, contains('{chunks.SENTENCE_BREAKS}', ch) OR (ch = chr(10) AND nx = chr(10)) AS e FROM u),
s AS (SELECT doc_id, n, list(cw ORDER BY i) AS cw, list(CASE WHEN e THEN i END ORDER BY i) AS e FROM w GROUP BY 1, 2),
r AS (SELECT doc_id, n, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS b, cw, e FROM s
  UNION ALL SELECT doc_id, n, k + 1, b, CASE WHEN o IS NULL THEN n ELSE coalesce(list_max(e[b + 1:o - 1]), o - 1) END, cw, e
  FROM (SELECT *, (list_filter(range(b + 1, n + 1), lambda i: cw[i] - CASE WHEN b = 0 THEN 0 ELSE cw[b] END > {4 * chunks.MAX_TOKENS}))[1] AS o FROM r WHERE b < n)),
p AS (SELECT r.doc_id, k, {_strip_sql("substr(text, a + 1, b - a)")} AS chunk FROM r JOIN l ON l.doc_id = r.doc_id WHERE k > 0 UNION ALL SELECT doc_id, 1, {_strip_sql("text")} FROM d WHERE {tokens} <= 512)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_idx, chunk FROM p WHERE chunk <> ''
"""


def _merge_sql() -> str:
    """The three passes by running counts; the patterns are spelled without look-ahead."""
    start, item, chapter = (x.replace("\\s", _S).replace("(?=\\D)", "\\D") for x in (tx.LINE_START, tx.LINE_LIST_ITEM, tx.LINE_CHAPTER))
    starts, listed = f"regexp_matches(line, '{start}')", f"(NOT regexp_matches(line, '{chapter}') AND regexp_matches(line, '{item}'))"
    ends = "contains('{}', right(line, 1))".format(tx.LINE_ENDS.replace("'", "''"))
    return f"""
WITH l AS (SELECT doc_id, pos, {_strip_sql("CASE WHEN pos % 5 = 1 THEN pos || '. ' WHEN pos % 11 = 3 THEN '第三条 ' WHEN pos % 7 = 2 THEN '（1）' ELSE '' END || line")} AS line FROM {_LINES}),
a AS (SELECT *, sum(CASE WHEN {starts} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l WHERE line <> ''),
b AS (SELECT doc_id, min(pos) AS pos, string_agg(line, '' ORDER BY pos) AS line FROM a GROUP BY doc_id, g),
c AS (SELECT *, coalesce(lag({ends}) OVER (PARTITION BY doc_id ORDER BY pos), true) OR ({starts} AND NOT {listed}) AS fresh FROM b),
e AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM c),
f AS (SELECT doc_id, min(pos) AS pos, string_agg(line, '' ORDER BY pos) AS line FROM e GROUP BY doc_id, g),
h AS (SELECT *, {listed} AND length(line) <= 100 AS item FROM f),
i AS (SELECT *, NOT (item AND coalesce(lag(item) OVER (PARTITION BY doc_id ORDER BY pos), false)) AS fresh FROM h),
j AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM i)
SELECT doc_id, CAST(min(pos) AS INT) AS pos, string_agg(line, chr(10) ORDER BY pos) AS text FROM j GROUP BY doc_id, g
"""


def _keys_sql() -> str:
    """Whether each column or pair of columns repeats; pairs of two columns that are no keys."""
    one = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS a, count(*) = count(DISTINCT {c}) AS u FROM {t}" for t, cs in STAR.items() for c in cs)
    two = " UNION ALL ".join(f"SELECT '{t}', '{a}', '{b}', count(*) = count(DISTINCT ({a}, {b})) FROM {t}" for t, cs in STAR.items() for k, a in enumerate(cs) for b in cs[k + 1 :])
    return f"""
WITH o AS ({one}), p(t, a, b, u) AS ({two})
SELECT t AS table_name, a AS key FROM o WHERE u
UNION ALL SELECT t, a || ',' || b FROM p WHERE u AND (t, a) NOT IN (SELECT (t, a) FROM o WHERE u) AND (t, b) NOT IN (SELECT (t, a) FROM o WHERE u)
"""


def _foreign_keys_sql() -> str:
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v FROM {t}" for t, cs in STAR.items() for c in cs)
    keys = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count(*) = count(DISTINCT {c})" for t, cs in STAR.items() for c in cs)
    return f"""
WITH x AS ({values}), k AS ({keys}), n AS (SELECT t, c, count(*) AS n FROM x GROUP BY ALL),
j AS (SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS m FROM x a JOIN x b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT j.t AS table_name, j.c AS "column", rt AS ref_table, rc AS ref_column, round(n.n / r.n, 6) AS share, regexp_replace(j.c, '^[^_]*_', '') = regexp_replace(rc, '^[^_]*_', '') AS named
FROM j JOIN n ON n.t = j.t AND n.c = j.c AND n.n = m JOIN n r ON r.t = rt AND r.c = rc JOIN k ON k.t = rt AND k.c = rc
"""


def oracle_sql() -> dict[str, str]:
    wide = f"regexp_replace(text, '{tx.WIDE}', '', 'g')"
    return experiments.oracle_sql() | {
        "token_estimate": f"SELECT doc_id, CAST(ceil(length(text) - length({wide}) + length(regexp_replace({wide}, '{_S}', '', 'g')) / 4) AS BIGINT) AS tokens FROM documents",
        "clean_text": _clean_sql(),
        "marker_explode": f"""
WITH b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '<-split->' || chr(10)), chr(10)), lambda x: {_strip_sql("x")}), lambda x: x <> ''), chr(10)) AS body FROM documents),
p AS (SELECT doc_id, unnest(range(len(x))) AS p_idx, unnest(x) AS parent FROM (SELECT doc_id, string_split(body, '***') AS x FROM b)),
c AS (SELECT doc_id, p_idx, unnest(range(len(x))) AS c_idx, unnest(x) AS child FROM (SELECT doc_id, p_idx, string_split(parent, '<-split->') AS x FROM p))
SELECT doc_id AS source, CAST(p_idx AS INT) AS p_idx, CAST(c_idx AS INT) AS c_idx, CAST(doc_id AS VARCHAR) || chr(10) || {_strip_sql("child")} AS document FROM c WHERE {_strip_sql("child")} <> ''
""",
        "kb_overview": f"SELECT source, filename, count(*) AS chunks, max(created_at) AS created_at, max(region_code) AS region_code FROM {_KB} GROUP BY 1, 2",
        "kb_totals": f"SELECT count(DISTINCT source) AS sources, count(*) AS chunks FROM {_KB} WHERE source <> ''",
        "kb_by_source": f"SELECT source, count(*) AS chunks, max(created_at) AS created_at FROM {_KB} GROUP BY 1",
        "check_filename": f"SELECT count(*) AS n FROM {_KB} WHERE filename = 'src0.en'",
        "chunk_preview": f"SELECT chunk_id, substr(document, 1, 2000) AS document FROM {_KB} WHERE source = 'src0' ORDER BY chunk_id LIMIT 20",
        "status_counts": "SELECT coalesce(event_type, 'unknown') AS status, count(*) AS n FROM events GROUP BY 1",
        "job_page": "SELECT event_id AS id, event_type AS status FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100",
        "latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY 1",
        "state_changes": "SELECT user_id, count(*) AS n_changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b GROUP BY 1",
        "catalog_left_join": "SELECT CAST(o_orderkey AS VARCHAR) AS table_name, coalesce(c_name, '') AS table_comment FROM orders LEFT JOIN customer ON c_custkey = o_orderkey",
        "catalog_rows": """
SELECT CAST(row_number() OVER (ORDER BY n_name) AS INT) AS "index", n_name AS table_name, CASE WHEN n_nationkey % 3 <> 0 THEN 'about ' || n_name ELSE '' END AS table_comment, coalesce(r_name, '未归类') AS business_domain, n_nationkey % 4 = 1 AS in_metadata
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey
""",
        "region_lookup": _region_sql("region_code"),
        "region_lookup_empty": _region_sql("''"),
        "region_list": "SELECT '13' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS MOF_DIV_CODE, n_name AS MOF_DIV_NAME FROM nation WHERE n_nationkey <> 7 AND n_nationkey % 3 = 2",
        "region_of_source": f"SELECT region_code FROM {_KB} WHERE source = 'src0' ORDER BY chunk_id LIMIT 1",
        "job_count": "SELECT count(*) AS n FROM events WHERE event_type = 'click'",
        "metadata_flag": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label FROM documents",
        "dup_upload": "SELECT doc_id, row_number() OVER (PARTITION BY md5(text), n_chars ORDER BY doc_id) - 1 AS copy_no FROM documents",
        "blocked_uploads": "SELECT doc_id FROM documents WHERE (md5(text), n_chars) IN (SELECT (md5(text), n_chars) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)",
        "zip_names": """
SELECT request_pos, CASE WHEN k = 0 THEN filename ELSE source || '_' || k || '.' || lang END AS name
FROM (SELECT doc_id AS request_pos, source, lang, source || '.' || lang AS filename, row_number() OVER (PARTITION BY source || '.' || lang ORDER BY doc_id) - 1 AS k FROM documents)
""",
        "split_rules": _split_sql(),
        "merge_body": _merge_sql(),
        "list_islands": f"""
SELECT doc_id, CAST(sum(CASE WHEN s AND NOT coalesce(b, false) THEN 1 ELSE 0 END) AS BIGINT) AS runs, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT) AS short_lines
FROM (SELECT doc_id, length(line) <= 100 AS s, lag(length(line) <= 100) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {_LINES}) GROUP BY 1
""",
        "heading_carry": f"""
SELECT doc_id, CAST(pos AS INT) AS pos, last_value(CASE WHEN length(line) <= 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {_LINES}
""",
        "span_sizes": f"""
SELECT doc_id, max(size) AS largest, list_sort(list(size))[len(list(size)) // 2 + 1] AS median, greatest(14.0, max(size) * 0.85) AS threshold FROM {_SPANS} GROUP BY 1
""",
        "span_title": f"""
SELECT doc_id, arg_min({_strip_sql("line")}, pos) AS title FROM {_SPANS}
WHERE size >= 14 AND length({_strip_sql("line")}) > 3 AND NOT regexp_matches(replace(replace(line, ' ', ''), chr(9), ''), '目录|CONTENTS|前言|FOREWORD|序言|PREFACE') GROUP BY 1
""",
        "page_fallback": f"""
WITH l AS (SELECT doc_id, pos, {_strip_sql("line")} AS text FROM {_LINES} WHERE {_strip_sql("line")} <> '')
SELECT doc_id, CAST(pos // 8 AS INT) AS page, arg_min(text, pos) AS parent, array_to_string(list(text ORDER BY pos)[2:], chr(10)) AS child
FROM l LEFT JOIN (SELECT doc_id, min(pos) AS first FROM l WHERE pos % 5 = 2 GROUP BY 1) USING (doc_id) WHERE pos IS DISTINCT FROM first GROUP BY 1, 2
""",
        "section_packs": f"""
WITH RECURSIVE l AS (SELECT doc_id, pos, {_strip_sql("line")} AS text, length(line) <= 40 AS heading FROM {_LINES} WHERE {_strip_sql("line")} <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l),
a AS (SELECT doc_id, k, 0 AS section, length(text) AS size FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, section + (n.heading OR size >= 800 OR size + 2 + length(text) > 1000)::INT, CASE WHEN n.heading OR size >= 800 OR size + 2 + length(text) > 1000 THEN length(text) ELSE size + 2 + length(text) END FROM a JOIN n ON n.doc_id = a.doc_id AND n.k = a.k + 1),
s AS (SELECT doc_id, section, max(size) AS size FROM a GROUP BY ALL),
b AS (SELECT doc_id, section, 0 AS pack, size FROM s WHERE section = 0
  UNION ALL SELECT s.doc_id, s.section, pack + (NOT (b.size < 500 AND b.size + 2 + s.size <= 1000))::INT, CASE WHEN b.size < 500 AND b.size + 2 + s.size <= 1000 THEN b.size + 2 + s.size ELSE s.size END FROM b JOIN s ON s.doc_id = b.doc_id AND s.section = b.section + 1),
p AS (SELECT doc_id, pack, list(text ORDER BY k) FILTER (heading) AS h, list(text ORDER BY k) FILTER (NOT heading) AS t FROM n JOIN a USING (doc_id, k) JOIN b USING (doc_id, section) GROUP BY ALL)
SELECT doc_id, pack::INT AS pack, coalesce(h[1], t[1]) AS parent, array_to_string(CASE WHEN h IS NULL THEN t[2:] ELSE h[2:] || coalesce(t, []) END, '|') AS bodies FROM p
""",
        "range_changes": """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 103 <> 9), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 101 <> 7)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey <> b.o_custkey OR a.o_orderstatus <> b.o_orderstatus
""",
        "clean_customers": """
WITH c AS (SELECT c_custkey, trim(replace(c_name, '#', ' ')) AS c_name, c_mktsegment, CASE WHEN c_custkey % 11 = 3 THEN NULL WHEN c_custkey % 53 = 7 THEN c_acctbal * 40 ELSE c_acctbal END AS b FROM customer),
q AS (SELECT c_mktsegment, quantile_disc(b, [0.25, 0.5, 0.75]) AS q FROM c GROUP BY 1)
SELECT c_custkey, c_name, c_mktsegment, coalesce(b, q[2]) AS c_acctbal, (b IS NULL)::INT AS n_filled, coalesce(b < q[1] - 1.5::DOUBLE * (q[3] - q[1]) OR b > q[3] + 1.5::DOUBLE * (q[3] - q[1]), false)::INT AS n_outliers FROM c JOIN q USING (c_mktsegment)
""",
        "star_keys": _keys_sql(),
        "foreign_keys": _foreign_keys_sql(),
        "region_matches": """
WITH n AS (SELECT lower(n_name) AS name, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, n_nationkey AS k, n_name FROM nation),
c AS (SELECT name, min(code) AS code FROM (SELECT name, code FROM n UNION ALL SELECT substr(name, 1, 5), code FROM n UNION ALL SELECT code, code FROM n UNION ALL SELECT lower(r_name), 'r' || r_regionkey FROM region) GROUP BY name),
f AS (SELECT doc_id, lower(substr(text, 1, 20) || CASE doc_id % 3 WHEN 1 THEN n_name WHEN 2 THEN substr(n_name, 1, 6) || ' N0' || lpad(CAST(k AS VARCHAR), 2, '0') ELSE '' END || ' ' || text) AS t FROM documents LEFT JOIN n ON doc_id % 3 > 0 AND k = doc_id % 25),
m AS (SELECT doc_id, name, code, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, instr(t, name), name) AS nth, count(*) OVER (PARTITION BY doc_id) AS n_names FROM f JOIN c ON contains(t, name))
SELECT doc_id, code AS region_code, coalesce(name, 'manual_required') AS matched, CAST(coalesce(n_names, 0) AS INT) AS n_names FROM documents LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (doc_id)
""",
        "store_snapshot": f"""
SELECT source, chunk_id, filename, CASE WHEN source IN ('src0', 'src2') THEN '130000000' ELSE region_code END AS region_code FROM {_KB}
WHERE CASE source WHEN 'src0' THEN region_code <> 'en' WHEN 'src2' THEN region_code = 'en' ELSE region_code <> 'en' OR (source <> 'src1' AND source NOT IN (SELECT source FROM {_KB} WHERE region_code <> 'en')) END
""",
        "job_history": job_life.job_history_sql(),
        "default_chunk": chunking.default_chunk_sql(_LINES, _strip_sql, _tokens_sql),
        "chunk_counts": "SELECT doc_id, CAST(greatest(len(string_split(text, chr(10))) - 1, 1) AS INT) AS n_chunks FROM documents",
        "text_helpers": f"""
SELECT doc_id, '增长' || doc_id || '.5%约元' AS percent, CAST(CASE WHEN doc_id % 5 = 4 THEN 1 WHEN doc_id % 5 <= 1 THEN 0 WHEN doc_id % 5 = 2 THEN 1 ELSE 2 END AS INT) AS level,
  {_strip_sql("regexp_replace(substr(text, 1, 60) || ' — ' || doc_id % 100 || ' —', '[—－-]+' || '" + _S + "*[0-9]+" + _S + "*[—－-]+', '', 'g')")} AS unnumbered,
  {_strip_sql("regexp_replace(substr(text, 1, 60), '" + tx.CONTROL + "', '', 'g')")} AS xml, upper(source) AS name,
  CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) ELSE printf('%.1fMB', b / 1048576) END AS size, doc_id % 2 = 0 AS page_number
FROM (SELECT *, doc_id * doc_id * 37 AS b FROM documents)
""",
        "image_filter": """
WITH i AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text_image' WHEN 1 THEN 'flowchart' ELSE 'photo' END AS kind, CASE WHEN doc_id % 4 = 0 THEN '图中' ELSE '' END || substr(text, 1, 5) || repeat('x', CAST(doc_id % 30 AS INT)) AS said,
  CASE doc_id % 5 WHEN 0 THEN '名称' END AS name, CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM documents),
a AS (SELECT *, CASE WHEN doc_id % 4 <> 0 AND name IS NULL THEN 'discard' WHEN doc_id % 4 <> 0 THEN 'caption_only' WHEN kind <> 'text_image' THEN 'keep' WHEN length(said) < 20 OR verdict IS NOT DISTINCT FROM false THEN 'discard' ELSE 'text_only' END AS action FROM i)
SELECT doc_id, action, CASE action WHEN 'text_only' THEN said WHEN 'caption_only' THEN name ELSE '' END AS entries FROM a
""",
        "spatial_merge": _SPATIAL,
        "page_text": f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|title|section|article)\\b[^>]*>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS x FROM a)
SELECT page_id, coalesce(array_to_string(list_filter(list_transform(x, lambda l: regexp_replace({_strip_sql("l")}, '[ \\t]+', ' ', 'g')), lambda l: l <> ''), chr(10)), '') AS text FROM b
""",
        "table_rows": """
SELECT page_id, CAST(0 AS INT) AS "row", array_to_string(list_transform(string_split(url, '/'), lambda c: trim(c)), ' | ') AS text FROM pages UNION ALL SELECT page_id, CAST(1 AS INT), 'a & b | 2' FROM pages
""",
        "vector_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 5
""",
        "preview_text": f"""
SELECT doc_id, array_to_string(CASE WHEN len(x) >= 3 THEN list_concat(x[1:3], ['...']) ELSE x END, chr(10)) AS preview
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip_sql("l")}), lambda l: l <> '') AS x FROM documents)
""",
        "turn_chunks": """
SELECT conv_id, p_idx, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p_idx FROM conversations) GROUP BY 1, 2
""",
        "document_search": "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang = 'en'",
        "column_report": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
        "sync_changes": """
WITH a AS (SELECT * FROM supplier WHERE s_suppkey % 10 <> 2), b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 10 <> 1)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_name <> b.s_name
""",
    }
