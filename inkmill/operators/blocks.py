"""Block lists of parsed documents: front and back matter, figures and captions, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import FIGURE_TYPES, INSIDE_SLACK, SIDE_GAP, STACK_GAP, block_type, box_distance, image_action, inside, is_skipped, is_title
from ..functions.text import contains_keyword, strip
from .geometry import meeting

# Fixed values.
TOC = ["目录", "CONTENTS"]
MIN_IMAGE_AREA, MAX_CAPTION, CAPTION_JOIN = 10_000, 40, " | "


def flatten_pages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """(doc_id, page, pos, block) of documents whose column is a list of pages of blocks; pages count from 1."""
    each = documents.select("doc_id", F.posexplode(pages).alias("page", "blocks"))
    return each.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode("blocks").alias("pos", "block"))


def pages_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks in order) of blocks(doc_id, page, pos, text)."""
    return blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("blocks"))


def merge_captions(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, pos, type, text, bbox, img_path, caption) with merged and the images' caption.

    A short text goes to the nearest image of its page, the earlier one if two are as near; an image's texts are joined
    in order behind its own caption.
    """
    kind = block_type(F.col("type"))
    box = (F.col("bbox").isNotNull()) & (F.size("bbox") == 4)
    area = (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) * (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1)))
    images = blocks.where(kind.isin(FIGURE_TYPES) & box & (area >= MIN_IMAGE_AREA) & (F.coalesce("img_path", F.lit("")) != ""))
    images = images.select("doc_id", "page", F.col("pos").alias("img_pos"), F.col("bbox").alias("img_bbox"))
    text = ~kind.isin(FIGURE_TYPES) & ~is_skipped(F.col("type")) & ~is_title(F.col("type"), F.lit(False)) & box
    texts = blocks.where(text & (F.coalesce("text", F.lit("")) != "") & (F.length("text") <= MAX_CAPTION)).select("doc_id", "page", "pos", "text", "bbox")
    # A text belongs to an image at most SIDE_GAP beside it and STACK_GAP above or below; boxes without a width or height belong to none.
    met = meeting(texts, images.withColumnRenamed("img_bbox", "bbox"), ["doc_id", "page"], SIDE_GAP, STACK_GAP)
    near = met.withColumn("d", box_distance(F.col("right_bbox"), F.col("bbox"))).where("d IS NOT NULL")
    owner = near.groupBy("doc_id", "page", "pos", "text").agg(F.min(F.struct("d", "img_pos")).alias("x"))
    owner = owner.select("doc_id", "page", F.col("x.img_pos").alias("img_pos"), "pos", "text")
    joined = owner.groupBy("doc_id", "page", F.col("img_pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("near"))
    out = blocks.join(joined, ["doc_id", "page", "pos"], "left").join(owner.select("doc_id", "page", "pos", F.lit(True).alias("merged")), ["doc_id", "page", "pos"], "left")
    own = F.filter(F.array("caption"), lambda c: c.isNotNull() & (c != ""))
    caption = F.when(F.col("near").isNotNull(), F.array_join(F.concat(own, F.col("near")["text"]), CAPTION_JOIN)).otherwise(F.col("caption"))
    return out.withColumn("caption", caption).withColumn("merged", F.coalesce("merged", F.lit(False))).drop("near")


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """lines(doc_id, page, bbox) that lie in no box of tables(doc_id, page, bbox)."""
    rows = lines.withColumn("_line", F.xxhash64("doc_id", "page", "bbox"))
    boxes = rows.select("doc_id", "page", "bbox", "_line").distinct()
    met = meeting(boxes, tables.select("doc_id", "page", "bbox"), ["doc_id", "page"], INSIDE_SLACK, INSIDE_SLACK)
    within = met.where(inside(F.col("bbox"), F.col("right_bbox"), INSIDE_SLACK)).select("doc_id", "page", "_line").distinct()
    return rows.join(within, ["doc_id", "page", "_line"], "left_anti").select(*lines.columns)


def image_actions(images: DataFrame, mode: str = "llm", decisions: DataFrame | None = None) -> DataFrame:
    """images(doc_id, pos, sub_type, text, caption) with action and entries; decisions(doc_id, pos, keep) of a judge where there is one."""
    judged = decisions.select("doc_id", "pos", F.col("keep").alias("_keep")) if decisions is not None else None
    rows = images.join(judged, ["doc_id", "pos"], "left") if judged is not None else images.withColumn("_keep", F.lit(None).cast("boolean"))
    made = image_action(mode, F.col("sub_type"), F.col("text"), F.col("caption"), F.col("_keep"))
    return rows.withColumn("_made", made).withColumns({"action": F.col("_made.action"), "entries": F.col("_made.entries")}).drop("_keep", "_made")


def carry_heading(spans: DataFrame, threshold: float) -> DataFrame:
    """spans(doc_id, pos, text, size) with the last heading at or before each: the text of a size over threshold."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("heading", F.last(F.when(F.col("size") >= threshold, strip(F.col("text"))), ignorenulls=True).over(w))


def threshold_stats(spans: DataFrame, least: float = 14.0, share: float = 0.85) -> DataFrame:
    """(doc_id, largest, median, threshold) of font sizes; the median is the upper one."""
    s = spans.groupBy("doc_id").agg(F.max("size").alias("largest"), F.array_sort(F.collect_list("size")).alias("x"))
    return s.select("doc_id", "largest", F.get("x", F.floor(F.size("x") / 2).cast("int")).alias("median"), F.greatest(F.lit(least), F.col("largest") * share).alias("threshold"))


def doc_title(spans: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, title): the first span at or over the size threshold that has more than three characters and isn't a page number."""
    number = strip(F.translate("text", "— ", "")).rlike(r"^\d+$")
    good = spans.where((F.col("size") >= threshold) & (F.length(strip(F.col("text"))) > 3) & ~number & ~contains_keyword(F.col("text"), [*TOC, "前言", "FOREWORD", "序言", "PREFACE"]))
    return good.groupBy("doc_id").agg(F.min_by(strip(F.col("text")), F.col("pos")).alias("title"))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, texts): the texts of each page in order; the document's first title is left out, other titles are texts."""
    rows = blocks.where(~is_skipped(F.col("type")) & (F.coalesce("text", F.lit("")) != ""))
    first = rows.where(is_title(F.col("type"), F.lit(False))).groupBy("doc_id").agg(F.min(F.struct("page", "pos")).alias("_title"))
    rows = rows.join(first, "doc_id", "left").where(F.col("_title").isNull() | (F.struct("page", "pos") != F.col("_title")))
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"].alias("texts"))


def rest_of(texts: Column) -> Column:
    """All but the first of an array."""
    return F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))


def fallback_chunks(blocks: DataFrame) -> DataFrame:
    """A chunk a page: its first paragraph is the parent, the rest the child; the document's first title and skipped types are left out."""
    return page_texts(blocks).select("doc_id", "page", F.get("texts", F.lit(0)).alias("parent"), F.array_join(rest_of(F.col("texts")), "\n").alias("child"))


def route(pages: DataFrame, force: str | None = None, sample: int = 5, least_chars: float = 100, documents: DataFrame | None = None, configured: str = "auto") -> DataFrame:
    """(doc_id, strategy) of pages(doc_id, page, n_chars, n_images): fast for text without images, else model.

    With documents(doc_id, path) each of them has a row: word-processor files are fast, files of unknown kinds and those without
    pages are for the model. force goes before configured, and that, unless it is auto, before what is found.
    """
    first = pages.where(F.col("page") <= sample).groupBy("doc_id").agg(F.max(F.col("n_images") > 0).alias("image"), F.avg("n_chars").alias("chars"))
    auto = F.when(F.col("image") | (F.col("chars") < least_chars), "model").otherwise("fast")
    chosen = force or (configured if configured != "auto" else None)
    if documents is None:
        return first.select("doc_id", (F.lit(chosen) if chosen else auto).alias("strategy"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1))
    found = F.when(suffix.isin("docx", "doc"), "fast").when((suffix != "pdf") | F.col("chars").isNull(), "model").otherwise(auto)
    return documents.join(first, "doc_id", "left").select("doc_id", (F.lit(chosen) if chosen else found).alias("strategy"))


def attach_captions(items: DataFrame) -> DataFrame:
    """items(doc_id, pos, text, image) without captions of no image: each goes to the last image before it, else stays as text.

    image is true for images, null for captions on their own, false for the rest. An image's captions are joined in order.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("_to", F.when(F.col("image").isNull(), F.last(F.when(F.col("image"), F.col("pos")), ignorenulls=True).over(w)))
    own = F.coalesce("_to", "pos").alias("pos")
    said = F.filter(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "text")))["text"], lambda t: t.isNotNull() & (t != ""))
    made = rows.groupBy("doc_id", own).agg(F.array_join(said, CAPTION_JOIN).alias("text"), F.coalesce(F.max("image"), F.lit(False)).alias("image"))
    return made.select("doc_id", "pos", "text", "image")
