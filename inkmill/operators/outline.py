"""Where a document's body begins and ends: titles, tables of contents, prefaces, covers and appendices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import TITLE_TYPES, block_type, is_skipped, is_substantial
from ..functions.text import NUMERALS, contains_keyword, is_chapter_heading, matches, strip

# Fixed values.
TOC, PREFACE, APPENDIX = ["目录", "CONTENTS"], ["前言", "FOREWORD", "序言", "PREFACE"], ["附录", "APPENDIX"]
TOC_WORDS, APPENDIX_WORD = ["目录", "目 录", "CONTENTS"], "附录"
TOC_HEADING = r"^(?:目\s*录|CONTENTS)$"
TOC_ENTRY = rf"\.{{2,}}\s*\d{{1,4}}$|\t\d{{1,4}}$|^\s*[IVX\d一二三四五六七八九十]+[、.]?\s*\.{{2,}}"
ARTICLE = rf"^\s*第[{NUMERALS}\d]+[条款项目]"
CHAPTER = rf"^第[{NUMERALS}\d]+[章编节]"
COVER_WORDS = ["国民经济", "社会发展", "五年规划", "纲要", "预算报告", "决算报告", "计划报告"]
NO_BODY = ["list", "text_list", "index", "image", "image_body", "image_caption", "chart", "table"]


def is_toc_entry(text: Column) -> Column:
    """Dots or a tab before a page number, or a number before dots."""
    return matches(strip(text), TOC_ENTRY)


def substantial(text: Column, keywords: list[str]) -> Column:
    """Whether a page has 80 characters or more, and 20 when any one keyword is taken out."""
    bare = strip(F.coalesce(text, F.lit("")))
    out = F.length(bare) >= 80
    for k in keywords:
        out = out & (F.length(strip(F.replace(bare, F.lit(k), F.lit("")))) >= 20)
    return out


def is_cover(text: Column) -> Column:
    """Whether a page is a cover: empty, or of fewer than 60 characters that name nothing of substance."""
    body = F.coalesce(text, F.lit(""))
    named = F.lit(False)
    for word in COVER_WORDS:
        named = named | F.contains(body, F.lit(word))
    return (body == "") | (~named & (F.length(body) < 60))


def is_docx_heading(style: Column, text: Column, bold: Column) -> Column:
    """A heading by its style, by bold letters in a plain one, or by its words."""
    plain = F.coalesce(style, F.lit("")).isin("", "Normal")
    return F.coalesce(style.startswith("Heading") | (style == "Title"), F.lit(False)) | (plain & F.coalesce(bold, F.lit(False))) | is_chapter_heading(text)


def docx_title(paragraphs: DataFrame) -> DataFrame:
    """(path, title): a Title before the first heading, else that heading, else the first bold short line, else the first short one."""
    rows = paragraphs.where(~F.col("in_table")).withColumn("text", strip(F.col("text"))).where("text <> ''")
    heading = rows.where(F.col("style").startswith("Heading")).groupBy("path").agg(F.min("pos").alias("at"), F.min_by("text", "pos").alias("heading"))
    before = rows.join(heading, "path", "left").where(F.col("at").isNull() | (F.col("pos") <= F.col("at")))
    short = F.col("style").isin("", "Normal") & (F.length("text") <= 30)
    first = lambda cond: F.min_by("text", F.when(cond, F.col("pos")))
    found = before.groupBy("path", "heading").agg(first(F.col("style") == "Title").alias("a"), first(short & F.col("bold")).alias("b"), first(short).alias("c"), F.max(F.col("style") == "Title").alias("ta"), F.max(short & F.col("bold")).alias("tb"), F.max(short).alias("tc"))
    return found.select("path", F.coalesce(F.when(F.col("ta"), F.col("a")), "heading", F.when(F.col("tb"), F.col("b")), F.when(F.col("tc"), F.col("c")), F.lit("")).alias("title"))


def toc_range(paragraphs: DataFrame) -> DataFrame:
    """(path, start, end) of a table of contents, end excluded.

    It begins at its heading and ends at the next title, or where three paragraphs in a row are no entries, or with
    the document.
    """
    rows = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    begins = rows.where(matches(F.col("text"), TOC_HEADING)).groupBy("path").agg(F.min("pos").alias("start"))
    after = rows.join(begins, "path").where(F.col("pos") > F.col("start"))
    w = Window.partitionBy("path").orderBy("pos")
    entry = is_toc_entry(F.col("text"))
    head = (F.col("style").startswith("Heading") | (F.col("style") == "Title") | F.col("bold")) & ~entry
    after = after.withColumns({"entry": entry, "head": head}).withColumn("run", F.sum(F.col("entry").cast("int")).over(w))
    after = after.withColumn("nth", F.sum((~F.col("entry")).cast("int")).over(Window.partitionBy("path", "run").orderBy("pos")))
    stop = F.min(F.when(F.col("head"), F.col("pos")).when(~F.col("entry") & (F.col("nth") == 3), F.col("pos") - 2))
    ends = after.groupBy("path").agg(stop.alias("stop"))
    last = paragraphs.groupBy("path").agg((F.max("pos") + 1).alias("n"))
    return begins.join(ends, "path", "left").join(last, "path").select("path", "start", F.coalesce("stop", "n").alias("end"))


def body_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, first_body, last_body) of pages(doc_id, page, text), pages counted from 1.

    The body begins after a table of contents on one of the first six pages, else after a preface, else with the first page of some
    length. Where none of these is found, and no appendix, covers among the first three pages are left out. It ends before an appendix
    on one of the last eight.
    """
    rows = pages.withColumns({"solid": substantial(F.col("text"), [*TOC, *PREFACE]), "preface": contains_keyword(F.col("text"), PREFACE)})
    total = F.max("page")
    base = rows.groupBy("doc_id").agg(
        total.alias("pages"),
        F.min(F.when((F.col("page") <= 6) & contains_keyword(F.col("text"), TOC), F.col("page"))).alias("toc"),
        F.min(F.when((F.col("page") <= 5) & ~F.col("preface") & F.col("solid"), F.col("page"))).alias("plain"),
        F.max(F.when((F.col("page") <= 5) & F.col("preface"), F.col("page"))).alias("last_preface"),
        F.min(F.when((F.col("page") <= 3) & ~is_cover(F.col("text")), F.col("page"))).alias("uncovered"),
        F.array_sort(F.collect_list(F.when(F.col("solid"), F.col("page")))).alias("solids"),
        F.array_sort(F.collect_list(F.when(contains_keyword(F.col("text"), APPENDIX), F.col("page")))).alias("appendices"),
    )
    next_solid = lambda after: F.coalesce(F.array_min(F.filter("solids", lambda p: p > after)), F.col("pages") + 1)
    late = F.filter("appendices", lambda p: p > F.col("pages") - 8)
    # Long documents give their first appendix among the last pages, short ones their last.
    appendix = F.when(F.col("pages") >= 8, F.array_min(late)).otherwise(F.array_max("appendices"))
    bare = F.when(appendix.isNotNull(), 1).otherwise(F.coalesce("uncovered", F.least(F.lit(3), F.col("pages")) + 1))
    first = F.when(F.col("toc").isNotNull(), next_solid(F.col("toc"))).when(F.col("plain").isNotNull(), F.col("plain")).when(F.col("last_preface").isNotNull(), next_solid(F.col("last_preface"))).otherwise(bare)
    return base.select("doc_id", first.cast("int").alias("first_body"), F.coalesce(appendix - 1, F.col("pages")).cast("int").alias("last_body"))


def drop_toc_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, pos, type, text) of a page without the entries of a table of contents on it.

    The entries run from the keyword to the first body text; the last title before that text stays with it. A page
    whose entries don't end is emptied.
    """
    text = strip(F.coalesce("text", F.lit("")))
    kind = block_type(F.col("type"))
    says = F.lit(False)
    for word in TOC_WORDS:
        says = says | F.contains(text, F.lit(word))
    begins = blocks.where((F.length(text) <= 15) & says).groupBy("doc_id").agg(F.min("pos").alias("start"))
    rows = blocks.join(begins, "doc_id", "left").withColumns({"_t": text, "_title": kind.isin(TITLE_TYPES)})
    entry = ((F.length("_t") < 30) & F.contains("_t", F.lit("…"))) | (matches(F.col("_t"), CHAPTER) & (F.length("_t") < 25)) | (F.col("_t") == "")
    is_body = ~F.col("_title") & ~is_skipped(F.col("type")) & ~kind.isin(NO_BODY) & ((F.length("_t") > 80) | matches(F.col("_t"), ARTICLE) | (~entry & (F.length("_t") > 15)))
    w = Window.partitionBy("doc_id")
    rows = rows.withColumn("_stop", F.min(F.when((F.col("pos") > F.col("start")) & is_body, F.col("pos"))).over(w))
    rows = rows.withColumn("_keep", F.max(F.when(F.col("_title") & (F.col("pos") > F.col("start")) & (F.col("pos") < F.col("_stop")), F.col("pos"))).over(w))
    outside = F.col("start").isNull() | (F.col("_stop").isNotNull() & ((F.col("pos") < F.col("start")) | (F.col("pos") >= F.col("_stop")) | (F.col("pos") == F.col("_keep"))))
    return rows.where(outside).select(*blocks.columns)


def body_blocks(blocks: DataFrame, front: int = 6, plain: int = 5, back: int = 8) -> DataFrame:
    """The blocks(doc_id, page, pos, type, text) of a document's body, with doc_title, the first page title among them.

    Entries of a table of contents on one of the first pages go, and what stands before it; a page of entries only goes
    whole. The body then begins with the first substantial page; without such a table, with the first substantial one of the first
    ``plain`` pages. It ends before the last of the last ``back`` pages that names an appendix. Where nothing would
    be left it begins with the second page. Pages without blocks aren't counted. An optional column table_body is a table's HTML.
    """
    html = F.col("table_body") if "table_body" in blocks.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    says = F.lit(False)
    for word in TOC_WORDS:
        says = says | F.contains(text, F.lit(word))
    pages = blocks.select("doc_id", "page").distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    rows = blocks.join(pages.select("doc_id", "page", number.alias("_nth")), ["doc_id", "page"])
    toc = rows.where((F.col("_nth") <= front) & says).groupBy("doc_id").agg(F.min("_nth").alias("_toc"))
    rows = rows.join(toc, "doc_id", "left")
    listed = F.col("_nth") == F.col("_toc")
    rest = drop_toc_blocks(rows.where(listed)).unionByName(rows.where(~F.coalesce(listed, F.lit(False))))
    page = rest.groupBy("doc_id", "_nth").agg(F.max(is_substantial(F.col("type"), text, html)).alias("solid"), F.max(F.contains(text, F.lit(APPENDIX_WORD))).alias("appendix"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).join(toc, "doc_id", "left")
    solid = lambda where: F.min(F.when(F.col("solid") & where, F.col("_nth")))
    late = F.max(F.when(F.col("appendix") & (F.col("_nth") > F.col("pages") - back), F.col("_nth")))
    found = total.join(page, "doc_id", "left").groupBy("doc_id", "pages", "_toc").agg(solid(F.col("_nth") >= F.col("_toc")).alias("after"), solid(F.col("_nth") <= plain).alias("early"), late.alias("late"))
    first = F.when(F.col("_toc").isNotNull(), F.coalesce("after", F.col("pages") + 1)).otherwise(F.coalesce("early", F.lit(1)))
    end = F.coalesce("late", F.col("pages") + 1)
    bounds = found.select("doc_id", F.when(first >= end, F.least(F.lit(2), F.col("pages") + 1)).otherwise(first).alias("_first"), end.alias("_end"))
    kept = rest.join(bounds, "doc_id").where((F.col("_nth") >= F.col("_first")) & (F.col("_nth") < F.col("_end")))
    titles = kept.where(block_type(F.col("type")).isin(TITLE_TYPES)).groupBy("doc_id", "_nth").agg(F.min_by(text, "pos").alias("t"))
    titles = titles.where("t <> ''").groupBy("doc_id").agg(F.min_by("t", "_nth").alias("doc_title"))
    return kept.join(titles, "doc_id", "left").select(*blocks.columns, F.coalesce("doc_title", F.lit("")).alias("doc_title"))


def merge_empty_headings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks(key, chunk_idx, parent, child): headings without a body lead the next body's text; those at the end stay."""
    w = Window.partitionBy(key).orderBy("chunk_idx")
    full = F.coalesce(strip(F.col("child")), F.lit("")) != ""
    rows = chunks.withColumn("full", full).withColumn("g", F.coalesce(F.sum(F.col("full").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    group = Window.partitionBy(key, "g")
    rows = rows.withColumn("closed", F.max("full").over(group))
    lead = F.array_sort(F.collect_list(F.when(~F.col("full"), F.struct("chunk_idx", "parent"))).over(group))["parent"]
    rows = rows.withColumn("lead_in", lead)
    child = F.when(F.col("full") & (F.size("lead_in") > 0), F.concat_ws("\n", F.array_join("lead_in", "\n"), "child")).otherwise(F.col("child"))
    return rows.where("full OR NOT closed").select(key, "chunk_idx", "parent", child.alias("child"))
