"""The default chunker: blocks of a parsed document to parent and child chunks, with tables, images and captions.

A section runs from one tall title to the next. Its blocks are one array of items, folded by ``aggregate``: lists are buffered until something
else comes, body text runs on while it fits, a table gives a line for each row, and a caption on its own goes to the last image before it in
the section. What stands before the first tall title has its first text, list or table as parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import block_caption, block_text, image_description, image_path, table_html, table_rows
from ..functions.layout import FIGURE_TYPES, IMAGE_TYPES, TABLE_TYPES, TITLE_TYPES, block_type, image_action, is_skipped, is_title
from ..functions.text import fix_percent_order, quarter_tokens, strip
from ..staging import staged
from .blocks import CAPTION_JOIN, merge_captions, page_texts, rest_of
from .chunks import MAX_TOKENS, lead_ins, parent_threshold
from .outline import body_blocks

# Fixed values.
LIST_TYPES = ["list", "text_list"]
NO_DOC_TITLE = ["目录", "目 录", "CONTENTS", "附", "录"]
TABLE_LABEL, IMAGE_LABEL = "[表] ", "[图片] "
PART = "struct<kind: string, text: string, path: string, caption: string>"
#: Columns that blocks may have beside the needed ones.
OPTIONAL = {"text_level": "string", "img_path": "string", "caption": "string", "merged": "boolean", "rows": "array<string>", "has_table": "boolean", "action": "string", "entries": "array<string>", "doc_title": "string"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(c: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("kind"), c.alias("text"), none.alias("path"), none.alias("caption"))


def _image(path: Column, caption: Column) -> Column:
    return F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), path.alias("path"), caption.alias("caption"))


def _without_last(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _captioned(parts: Column, caption: Column) -> Column:
    """parts with a caption that stands alone given to the last image, or else as a text; before any part it has no place."""
    place = F.array_max(F.transform(parts, lambda p, i: F.when(p["kind"] == "image", i).otherwise(-1)))
    more = lambda p: F.when(F.coalesce(p["caption"], F.lit("")) != "", F.concat(p["caption"], F.lit(CAPTION_JOIN), caption)).otherwise(caption)
    given = F.transform(parts, lambda p, i: F.when(i == place, _image(p["path"], more(p))).otherwise(p))
    return F.when(F.size(parts) == 0, parts).when(place >= 0, given).otherwise(F.concat(parts, F.array(_text(caption))))


def _run_on(parts: Column, weight: Column, sub: Column, x: Column, most: int) -> Column:
    """struct(parts, weight): parts with a body text joined to the last text while both fit, on a new line below a sub-heading.

    weight is the last text's in quarter tokens, or null where it is not known; weights of joined texts add up, a line break having none.
    """
    run = lambda parts, weight: F.struct(parts.alias("parts"), weight.alias("weight"))
    last = F.try_element_at(parts, F.lit(-1))

    def joined(total: Column) -> Column:
        text = F.concat(last["text"], F.when(sub, "\n").otherwise(""), x["text"])
        return F.when(total <= 4 * most, run(F.concat(_without_last(parts), F.array(_text(text))), total)).otherwise(run(F.concat(parts, F.array(_text(x["text"]))), x["weight"]))

    # No total where there is no text to go on.
    total = F.when(F.coalesce(last["kind"] == "text", F.lit(False)), F.coalesce(weight, quarter_tokens(last["text"])) + x["weight"])
    return _let(total, joined)


def _fold(items: Column, heading: Column, most: int) -> Column:
    """A section's items to struct(parts, sub, lists, parent, kind, level, page); parent is null where nothing can be one."""
    none, no_list = F.array().cast(f"array<{PART}>"), F.array().cast("array<string>")

    unknown = F.lit(None).cast("long")

    def state(parts: Column, sub: Column, lists: Column, head: Column, weight: Column = unknown) -> Column:
        return F.struct(parts.alias("parts"), sub.alias("sub"), lists.alias("lists"), head.alias("head"), weight.alias("weight"))

    def flushed(s: Column) -> Column:
        return F.when(F.size(s["lists"]) > 0, F.concat(s["parts"], F.array(_text(F.array_join(s["lists"], "\n"))))).otherwise(s["parts"])

    def head(x: Column, text: Column, kind: str, level: Column) -> Column:
        return F.struct(text.alias("parent"), F.lit(kind).alias("kind"), level.alias("level"), x["page"].alias("page"))

    def step(s: Column, x: Column) -> Column:
        fresh, two = s["head"]["parent"].isNull(), F.lit(2)
        leads = lambda parts, text, kind, level=two: (F.when(fresh, none).otherwise(parts), F.when(fresh, head(x, text, kind, level)).otherwise(s["head"]))

        def others(parts: Column) -> Column:
            sub_parts, sub_head = leads(F.concat(parts, F.array(_text(x["text"]))), x["text"], "sub_title", x["level"])
            body_head = leads(parts, x["text"], "paragraph")[1]
            weight = F.when(F.size(s["lists"]) == 0, s["weight"])
            body = lambda run: state(F.when(fresh, none).otherwise(run["parts"]), F.lit(False), no_list, body_head, F.when(~fresh, run["weight"]))
            named = F.coalesce(x["caption"], F.lit("")) != ""
            lines = F.concat(F.when(named, F.array(F.concat(F.lit(TABLE_LABEL), x["caption"]))).otherwise(no_list), x["rows"])
            table_head = F.when(fresh, head(x, F.when(named, x["caption"]).otherwise(F.get(x["rows"], F.lit(0))), "table", two)).otherwise(s["head"])
            return (
                F.when(x["kind"] == "sub", state(sub_parts, ~fresh, no_list, sub_head))
                .when(x["kind"] == "image", state(F.concat(parts, F.array(_image(x["path"], x["caption"]))), s["sub"], no_list, s["head"]))
                .when(x["kind"] == "table", state(F.concat(parts, F.transform(lines, _text)), s["sub"], no_list, table_head))
                .when(x["kind"] == "note", state(_captioned(parts, x["caption"]), s["sub"], no_list, s["head"]))
                .when(x["kind"] == "texts", state(F.concat(parts, F.transform(x["rows"], _text)), s["sub"], no_list, s["head"]))
                .when(x["kind"] == "body", _let(_run_on(parts, weight, s["sub"], x, most), body))
                .otherwise(state(parts, s["sub"], no_list, s["head"], weight))
            )

        list_parts, list_head = leads(s["parts"], x["text"], "list")
        return F.when(x["kind"] == "list", state(list_parts, F.lit(False), F.concat(s["lists"], F.array(x["text"])), list_head)).otherwise(_let(flushed(s), others))

    shown = lambda p: (p["kind"] == "text") | (F.coalesce(p["path"], F.lit("")) != "") | (F.coalesce(p["caption"], F.lit("")) != "")
    return F.aggregate(items, state(none, F.lit(False), no_list, heading), step, lambda s: F.struct(F.filter(flushed(s), shown).alias("parts"), s["head"].alias("head")))


def _found_titles(rows: DataFrame) -> DataFrame:
    """(doc_id, own): a document's first title that isn't that of a table of contents."""
    named = block_type(F.col("type")).isin(TITLE_TYPES) & (F.col("text") != "") & ~F.col("text").isin(NO_DOC_TITLE)
    return rows.where(named).groupBy("doc_id").agg(F.min_by("text", F.struct("page", "pos")).alias("own"))


def _items(blocks: DataFrame) -> DataFrame:
    """The rows that make up sections, with kind, level, tall and the section's number; a document's own title is left out if only it tells the title."""
    title = is_title(F.col("type"), F.col("has_text_level"))
    box = F.col("bbox").isNotNull() & (F.size("bbox") == 4)
    height = F.when(box, F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))).otherwise(0.0)
    rows = blocks.where(~is_skipped(F.col("type")) & ~F.coalesce("merged", F.lit(False))).withColumns({"title": title, "height": height})
    # One-character titles are left out of the text, but count among the heights.
    limits = parent_threshold(blocks.where(title).select("doc_id", height.alias("height")))
    rows = rows.where(~F.col("title") | (F.length("text") != 1))
    rows = rows.join(limits, "doc_id", "left").join(_found_titles(blocks), "doc_id", "left")
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    known = F.coalesce(F.nullif("doc_title", F.lit("")), "own").isNotNull()
    # Where no title is known, the first that has a text is the document's, and blank ones before it go with it.
    named = F.coalesce(F.sum((F.col("title") & (F.col("text") != "")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", named).where(~F.col("title") | known | (F.col("before") > 0))
    threshold = F.coalesce("threshold", F.lit(-1.0))
    kind, figure = block_type(F.col("type")), block_type(F.col("type")).isin(FIGURE_TYPES)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    caption = F.when(blank("caption"), F.col("text")).otherwise(F.col("caption"))
    has_table = kind.isin(TABLE_TYPES) & F.coalesce("has_table", F.size("rows") > 0, F.lit(False))
    action = F.when(kind.isin(IMAGE_TYPES), F.coalesce("action", F.lit("keep"))).otherwise("keep")
    of_figure = (
        F.when(blank("img_path") & ~has_table, F.when(caption != "", "note").otherwise("gap"))
        .when(action == "discard", "gap").when(action.isin("text_only", "caption_only"), "texts")
        .when(kind.isin(TABLE_TYPES) & (F.coalesce(F.size("rows"), F.lit(0)) > 0), "table").otherwise("image")
    )
    of_text = F.when(F.col("title"), "sub").when(F.col("text") == "", "gap").when(kind.isin(LIST_TYPES), "list").otherwise("body")
    item = F.when(figure & ~F.col("title"), of_figure).otherwise(of_text)
    level = F.coalesce(F.col("text_level").try_cast("int"), F.lit(2))
    return rows.select(
        "doc_id", "page", "pos", "text", "title", (F.col("title") & ((threshold <= 0) | (F.col("height") >= threshold))).alias("tall"), item.alias("kind"),
        F.when(level <= 1, 0).when(level == 2, 1).otherwise(2).alias("level"), F.coalesce("img_path", F.lit("")).alias("path"),
        F.when(item == "note", caption).otherwise(F.coalesce("caption", F.lit(""))).alias("caption"), F.coalesce(F.when(item == "texts", F.col("entries")).otherwise(F.col("rows")), F.array().cast("array<string>")).alias("rows"), (figure & ~F.col("title")).alias("figure"),
        F.when(kind.isin(TABLE_TYPES), F.coalesce("caption", F.lit(""))).otherwise(F.coalesce(caption, F.lit(""))).alias("said"),
    )


def _completed(blocks: DataFrame) -> DataFrame:
    for name, kind in OPTIONAL.items():
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    return blocks.withColumn("text", F.coalesce("text", F.lit("")))


def clean_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, pos, line, text, style, level, image) of the same blocks as ``chunk_blocks``: paragraphs without chunks, for other strategies.

    Texts that follow each other are one paragraph, up to the next tall title or figure. A table gives a paragraph a row, an image one
    with struct(path, caption); a caption on its own goes to the last image before it in the document, or else is a text.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    rows = _items(_completed(blocks)).where(F.col("tall") | ~F.col("title") | (F.col("text") != ""))
    last = F.last(F.when(F.col("kind") == "image", F.struct("page", "pos")), ignorenulls=True).over(w)
    run = F.sum((F.col("tall") | F.col("figure")).cast("int")).over(w)
    rows = rows.withColumns({"last": last, "run": run}).withColumn("alone", (F.col("kind") == "note") & F.col("last").isNotNull())
    heading = rows.where("tall").select("doc_id", "page", "pos", F.lit(0).alias("line"), "text", F.when(F.col("level") == 0, "Title").when(F.col("level") == 1, "Heading 2").otherwise("Heading 3").alias("style"), "level", F.lit(None).cast("struct<path: string, caption: string>").alias("image"))
    no_image, normal = F.lit(None).cast("struct<path: string, caption: string>").alias("image"), [F.lit("Normal").alias("style"), F.lit(0).alias("level")]
    said = F.when(F.col("kind") == "texts", F.col("rows")).when(F.col("kind") == "note", F.array("caption")).otherwise(F.array("text"))
    loose = rows.where(~F.col("tall") & ~F.col("alone") & (F.col("kind").isin("sub", "list", "body", "texts", "note")))
    body = loose.groupBy("doc_id", "run").agg(F.min(F.struct("page", "pos")).alias("at"), F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("page", "pos", said.alias("t"))))["t"]), "\n").alias("text"))
    body = body.where("text <> ''").select("doc_id", "at.page", "at.pos", F.lit(0).alias("line"), "text", *normal, no_image)
    named = F.when(F.col("caption") != "", F.array(F.concat(F.lit(TABLE_LABEL), "caption"))).otherwise(F.array().cast("array<string>"))
    table = rows.where("NOT tall AND kind = 'table'").select("doc_id", "page", "pos", F.posexplode(F.concat(named, F.col("rows"))).alias("line", "text")).select("*", *normal, no_image)
    notes = rows.where("alone").groupBy("doc_id", F.col("last.page").alias("page"), F.col("last.pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), F.col("pos").alias("q"), "caption")))["caption"].alias("notes"))
    images = rows.where("NOT tall AND kind = 'image'").join(notes, ["doc_id", "page", "pos"], "left")
    text = F.array_join(F.concat(F.filter(F.array("said"), lambda t: t != ""), F.coalesce("notes", F.array().cast("array<string>"))), CAPTION_JOIN)
    images = images.select("doc_id", "page", "pos", F.lit(0).alias("line"), text.alias("text"), *normal, F.struct("path", "caption").alias("image"))
    return heading.unionByName(body).unionByName(table).unionByName(images)


def chunk_blocks(blocks: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, chunk_idx, parent, parent_type, level, page, child, parts) of blocks(doc_id, page, pos, type, text, has_text_level, bbox).

    parts are the child's texts and images in order, struct(kind, text, path, caption); child is the same as text, an image standing as its
    caption. A title of the threshold's height or more begins a chunk and is its parent; a lower one is a line of its own. Optional columns:
    img_path, caption, rows (a table's lines) and has_table of figures, action and entries of images (see ``image_action``), merged for texts that
    went into a caption, text_level of titles, doc_title if it is known. A document without chunks gets one a page; a chunk without children
    goes into the next.
    """
    blocks = _completed(blocks)
    rows = _items(blocks)
    rows = rows.withColumn("section", F.sum(F.col("tall").cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "pos")))
    item = F.struct("page", "pos", "kind", "text", "level", "path", "caption", "rows", F.when(F.col("kind") == "body", quarter_tokens(F.col("text"))).alias("weight"))
    head = F.struct(F.col("text").alias("parent"), F.lit("title").alias("kind"), "level", "page")
    no_head = F.struct(F.lit(None).cast("string").alias("parent"), F.lit("title").alias("kind"), F.lit(2).alias("level"), F.lit(None).cast("int").alias("page"))
    sections = rows.groupBy("doc_id", "section").agg(
        F.array_sort(F.collect_list(F.when(~F.col("tall") & (~F.col("title") | (F.col("text") != "")), item))).alias("items"),
        F.coalesce(F.max(F.when(F.col("tall"), head)), no_head).alias("head"),
    )
    made = sections.select("doc_id", F.col("section").alias("chunk_idx"), _fold(F.col("items"), F.col("head"), most).alias("x")).where("x.head.parent IS NOT NULL")
    pictured = F.exists("parts", lambda p: p["kind"] == "image")
    line = lambda p: F.when(p["kind"] == "image", F.concat(F.lit(IMAGE_LABEL), F.coalesce(p["caption"], F.lit("")))).otherwise(p["text"])
    made = made.select("doc_id", "chunk_idx", "x.head.*", "x.parts").withColumn("child", F.array_join(F.transform("parts", line), "\n"))
    made = made.withColumn("child", F.when(pictured, F.col("child")).otherwise(fix_percent_order(strip(F.col("child")))))
    # It is read twice: as chunks, and for the documents that have none.
    made = staged(made.where((strip(F.col("parent")) != "") | (strip(F.col("child")) != "")), "sections")
    bare = page_texts(blocks.join(made.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("rest", rest_of(F.col("texts")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    bare = bare.select("doc_id", number.alias("chunk_idx"), F.get("texts", F.lit(0)).alias("parent"), F.lit("paragraph").alias("kind"), F.lit(2).alias("level"), "page", F.transform("rest", _text).alias("parts"), F.array_join("rest", "\n").alias("child"))
    kept = lead_ins(made.unionByName(bare))
    led, empty = F.col("lead_in").isNotNull(), F.col("bare")
    child = F.when(~led, F.col("child")).when(empty, F.col("lead_in")).otherwise(F.concat("lead_in", F.lit("\n"), "child"))
    parts = F.when(~led, F.col("parts")).otherwise(F.concat(F.array(_text(F.col("lead_in"))), "parts"))
    return kept.select("doc_id", "chunk_idx", "parent", F.col("kind").alias("parent_type"), "level", "page", child.alias("child"), parts.alias("parts"))


def read_content(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, pos, type, sub_type, has_text_level, text_level, bbox, raw) with what their JSON holds, in place of raw.

    text, caption, img_path, table_body (HTML), rows (the table's lines) and said (what is said of an image). Write it as a table: it is
    read several times by what follows.
    """
    raw = F.col("raw")
    read = {"text": block_text(raw), "caption": block_caption(raw), "img_path": image_path(raw), "table_body": table_html(raw), "said": image_description(raw), "rows": table_rows(table_html(raw))}
    return blocks.select("doc_id", "page", "pos", "type", "sub_type", "has_text_level", "text_level", "bbox", *(c.alias(n) for n, c in read.items()))


def content_chunks(content: DataFrame, mode: str = "llm", decisions: DataFrame | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """``chunk_blocks`` of parsed documents, of content as ``read_content`` gives it.

    Front matter and appendices go, short texts beside figures become their captions, images are kept, dropped or put into words by
    ``mode`` (decisions(doc_id, page, pos, keep) are a judge's, where there is one), tables are read row by row.
    """
    kept = body_blocks(content).join(_found_titles(content), "doc_id", "left")
    kept = merge_captions(staged(kept.withColumn("doc_title", F.coalesce("own", F.nullif("doc_title", F.lit("")))).drop("own"), "body"))
    if decisions is not None:
        kept = kept.join(decisions.select("doc_id", "page", "pos", "keep"), ["doc_id", "page", "pos"], "left")
    else:
        kept = kept.withColumn("keep", F.lit(None).cast("boolean"))
    made = image_action(mode, F.col("sub_type"), F.col("said"), F.col("caption"), F.col("keep"))
    return chunk_blocks(staged(kept.withColumns({"action": made["action"], "entries": made["entries"], "has_table": strip(F.col("table_body")) != ""}), "captioned"), most)
