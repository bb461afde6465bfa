"""Chunks to marked text, repair of split texts, spans and DOCX paragraphs to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMERALS, estimate_tokens, is_fragment, is_list_item, is_sub_heading, strip
from .chunks import CHILD, LINE_BREAKS, MAX_TOKENS, PARENT, merge_lines, register_strategy, split_by_rules
from .compose import chunk_blocks
from .outline import docx_title, is_docx_heading, merge_empty_headings, toc_range

# Fixed values.
SECTION_START = (
    rf"(?:第[零{NUMERALS}\d]+[章节条款项部分编类目篇]|[零{NUMERALS}]+[、．.]|[（][零{NUMERALS}\d]+[）]|\d+[、．.]|[A-Za-z][、．.)]\s*)"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repair_splits(parts: Column, most: int = MAX_TOKENS) -> Column:
    """Parts of a split text put right where a cut fell inside a unit.

    Two neighbours that fit together are joined; else what follows the last boundary of a part moves into the next.
    A part that begins a section stays apart from the one before.
    """
    none = F.lit(None).cast("string")
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))

    def step(s: Column, p: Column) -> Column:
        held = s["held"]
        boundary = F.regexp_extract(held, rf"(?s)^(.*。[ \t\n]*)(?={SECTION_START})", 1)
        kept = F.when(boundary != "", boundary).otherwise(F.regexp_extract(held, r"(?s)^(.+。)", 1))
        moved = F.substr(held, F.length(kept) + 1)
        alone = state(F.concat(s["out"], F.array(held)), p)
        moves = (kept != "") & (F.length(strip(moved)) > 0) & (estimate_tokens(F.concat(moved, p)) <= most)
        return (
            F.when(held.isNull(), state(s["out"], p))
            .when(p.rlike(rf"^。[ \t\n]*{SECTION_START}"), alone)
            .when(estimate_tokens(F.concat(held, p)) <= most, state(F.concat(s["out"], F.array(F.concat(held, p))), none))
            .when(moves, state(F.concat(s["out"], F.array(strip(kept))), F.concat(moved, p)))
            .otherwise(alone)
        )

    return F.aggregate(parts, state(F.array().cast("array<string>"), none), step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def split_text(text: Column, most: int = MAX_TOKENS) -> Column:
    """Parts of at most ``most`` tokens: the rules' cuts, put right."""
    return _let(split_by_rules(text, most), lambda p: F.when(F.size(p) > 1, repair_splits(p, most)).otherwise(p))


def marked(chunks: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, text): chunks(doc_id, chunk_idx, parent, child) as one marked text a document.

    A child's lines are parted by markers, but for a sub-heading and the line after it and for runs of list items.
    """
    lines = F.filter(F.transform(F.split("child", "\n"), strip), lambda x: x != "")

    def shown(line: Column, i: Column, all_: Column) -> Column:
        following = F.get(all_, i + 1)
        together = following.isNotNull() & (is_sub_heading(line) | (is_list_item(line) & is_list_item(following)))
        return F.concat(F.array_join(split_text(line, most), f"\n{CHILD}\n"), F.when(together, "").otherwise(f"\n{CHILD}"))

    body = _let(lines, lambda a: F.array_join(F.transform(a, lambda x, i: shown(x, i, a)), "\n"))
    one = F.concat_ws("\n", F.when(F.col("parent") != "", F.concat(F.lit(f"{PARENT}\n"), "parent")), F.lit(CHILD), F.nullif(body, F.lit("")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_idx", one.alias("t"))))["t"], "\n").alias("text"))


def line_blocks(documents: DataFrame, title: Column | None = None) -> DataFrame:
    """documents(doc_id, text) as blocks, a line each, on one page; title tells which lines (column text) are titles."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("text", strip(F.col("text"))).where("text <> ''")
    kind = F.when(title, "title").otherwise("text") if title is not None else F.lit("text")
    return lines.select("doc_id", F.lit(1).alias("page"), "pos", kind.alias("type"), "text", F.lit(False).alias("has_text_level"), F.lit(None).cast("array<double>").alias("bbox"))


def default_strategy(rows: DataFrame) -> DataFrame:
    """(doc_id, text): blocks, or documents by their lines, cut into parents and children and written as marked texts."""
    return marked(chunk_blocks(rows if "type" in rows.columns else line_blocks(rows)))


register_strategy("default", default_strategy)


def span_chunks(spans: DataFrame, tables: DataFrame, title_first: bool = True, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, chunk_idx, parent, child) of spans(doc_id, page, pos, text, heading) and tables(doc_id, page, pos, rows).

    Headings begin chunks; the first of all is the document's title if title_first. A table is a chunk of its own, led by its first row,
    and stands behind the spans of its page; what follows it is under the heading before it again. Lines are joined to
    paragraphs, scraps left out and long paragraphs cut. Headings without a body lead the next body.
    """
    row = F.transform(F.col("rows"), lambda r: F.array_join(r, " | ", ""))
    each = spans.select("doc_id", "page", F.lit(0).alias("kind"), "pos", strip(F.col("text")).alias("text"), F.coalesce("heading", F.lit(False)).alias("heading"), F.lit(None).cast("array<string>").alias("rows")).where("text <> ''")
    for kind in (1, 2):  # the table, and the place behind it
        each = each.unionByName(tables.where(F.size("rows") > 0).select("doc_id", "page", F.lit(kind).alias("kind"), "pos", F.lit("").alias("text"), F.lit(False).alias("heading"), row.alias("rows")))
    # A table's two rows stand together, behind the page's spans and by its own position.
    w = Window.partitionBy("doc_id").orderBy("page", F.least("kind", F.lit(1)), "pos", "kind")
    each = each.withColumns({"n": F.row_number().over(w), "nth": F.sum(F.col("heading").cast("int")).over(w), "last": F.last(F.when(F.col("heading"), F.col("text")), ignorenulls=True).over(w)})
    title = F.col("heading") & (F.col("nth") == 1) & F.lit(title_first)
    begins = (F.col("heading") & ~title) | (F.col("kind") == 1) | ((F.col("kind") == 2) & F.col("last").isNotNull())
    each = each.withColumn("begins", begins).withColumn("chunk_idx", F.sum(F.col("begins").cast("int")).over(w)).where(~title)
    parents = each.where("begins").select("doc_id", "chunk_idx", F.when(F.col("kind") == 1, F.get("rows", F.lit(0))).otherwise(F.col("last")).alias("parent"))
    lines = merge_lines(each.where("kind = 0 AND NOT heading"), ["doc_id", "chunk_idx"], "n")
    parts = lines.where(~is_fragment(F.col("text"))).select("doc_id", "chunk_idx", "n", F.posexplode(split_by_rules(F.col("text"), most, LINE_BREAKS)).alias("k", "part"))
    body = parts.unionByName(each.where("kind = 1").select("doc_id", "chunk_idx", F.lit(0).alias("n"), F.posexplode("rows").alias("k", "part")))
    children = body.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "k", "part")))["part"], "\n").alias("child"))
    both = parents.join(children, ["doc_id", "chunk_idx"], "full_outer")
    return merge_empty_headings(both.select("doc_id", "chunk_idx", "parent", F.coalesce("child", F.lit("")).alias("child")))


def _docx_body(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(path, pos, style, text, in_table, bold) without those of a table of contents, with heading."""
    rows = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    rows = rows.join(toc_range(paragraphs), "path", "left").where(F.col("start").isNull() | (F.col("pos") < F.col("start")) | (F.col("pos") >= F.col("end"))).drop("start", "end")
    return rows.withColumn("heading", ~F.col("in_table") & is_docx_heading(F.col("style"), F.col("text"), F.col("bold")))


def docx_clean(paragraphs: DataFrame) -> DataFrame:
    """(path, pos, text, style, level): headings and table rows each on their own, body lines joined to paragraphs."""
    rows = _docx_body(paragraphs)
    w = Window.partitionBy("path").orderBy("pos")
    alone = F.col("heading") | F.col("in_table")
    rows = rows.withColumn("alone", alone).withColumn("run", F.sum((F.col("alone") | F.coalesce(F.lag("alone").over(w), F.lit(False))).cast("int")).over(w))
    own = F.regexp_extract("style", r"^Heading\s*(\d)", 1)
    level = F.when(~F.col("heading"), 0).when((own == "") | own.isin("1", "2"), 1).otherwise(2)
    style = F.when(~F.col("heading"), "Normal").when(F.col("style").rlike("^(Title|Heading)"), F.col("style")).otherwise("Heading 2")
    single = rows.where("alone").select("path", "pos", "text", style.alias("style"), level.alias("level"))
    body = merge_lines(rows.where("NOT alone"), ["path", "run"])
    return single.unionByName(body.select("path", "pos", "text", F.lit("Normal").alias("style"), F.lit(0).alias("level")))


def docx_chunks(paragraphs: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(path, title, chunk_idx, parent, child) of DOCX paragraphs: span_chunks by their headings and tables, in order."""
    rows = _docx_body(paragraphs)
    w = Window.partitionBy("path").orderBy("pos")
    # Each run of table rows ends a page, so tables stand where they were.
    rows = rows.withColumn("page", F.sum((~F.col("in_table") & F.coalesce(F.lag("in_table").over(w), F.lit(False))).cast("int")).over(w))
    spans = rows.where("NOT in_table").select(F.col("path").alias("doc_id"), "page", "pos", "text", "heading")
    cells = F.array_sort(F.collect_list(F.struct("pos", "text")))["text"]
    tables = rows.where("in_table").groupBy(F.col("path").alias("doc_id"), "page").agg(F.min("pos").alias("pos"), F.transform(cells, lambda x: F.array(x)).alias("rows"))
    made = span_chunks(spans, tables, False, most).withColumnRenamed("doc_id", "path")
    return made.join(docx_title(paragraphs), "path", "left").select("path", F.coalesce("title", F.lit("")).alias("title"), "chunk_idx", "parent", "child")
