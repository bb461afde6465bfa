"""Geometry and block predicates as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_chinese

# Fixed values.
SKIP_TYPES = ["page_header", "page_footer", "page_number", "page_footnote", "page_aside_text", "header", "footer", "footnote"]
TITLE_TYPES = ["title", "doc_title", "paragraph_title", "abstract"]
IMAGE_TYPES = ["image", "image_body", "image_caption"]
TABLE_TYPES = ["table", "table_body", "table_caption", "simple_table", "complex_table"]
CHART_TYPES = ["chart", "chart_body", "chart_caption"]
FIGURE_TYPES = [*IMAGE_TYPES, *TABLE_TYPES, *CHART_TYPES]
FRONT_TITLES = ["目录", "目 录", "CONTENTS", "前言", "FOREWORD"]
SIDE_GAP, STACK_GAP, INSIDE_SLACK = 100, 40, 2
LEAST_DESCRIPTION, LEAST_TABLE, LEAST_BODY = 20, 30, 30


def block_type(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), F.lit(r"(?U)^\s+|\s+$"), F.lit("")))


def is_skipped(kind: Column) -> Column:
    return block_type(kind).isin(SKIP_TYPES)


def is_title(kind: Column, has_level: Column) -> Column:
    return block_type(kind).isin(TITLE_TYPES) | ((block_type(kind) == "text") & F.coalesce(has_level, F.lit(False)))


def inside(inner: Column, outer: Column, slack: float = INSIDE_SLACK) -> Column:
    """Whether a box lies in another, give or take ``slack``."""
    low = F.get(inner, F.lit(0)) >= F.get(outer, F.lit(0)) - slack
    top = F.get(inner, F.lit(1)) >= F.get(outer, F.lit(1)) - slack
    return low & top & (F.get(inner, F.lit(2)) <= F.get(outer, F.lit(2)) + slack) & (F.get(inner, F.lit(3)) <= F.get(outer, F.lit(3)) + slack)


def box_distance(image: Column, text: Column) -> Column:
    """How far a text's box is from an image's, or null where they don't belong together.

    Texts beside the image (their heights overlap) come first, then those above or below it, then
    those near a corner.
    """
    i, t = ([F.get(b, F.lit(k)).cast("double") for k in range(4)] for b in (image, text))
    over = [F.greatest(F.lit(0.0), F.least(i[k + 2], t[k + 2]) - F.greatest(i[k], t[k])) for k in (0, 1)]
    iw, ih, tw, th = i[2] - i[0], i[3] - i[1], t[2] - t[0], t[3] - t[1]
    far = F.lit(float("inf"))

    def gap(k: int) -> Column:
        before, after = F.when(t[k + 2] <= i[k], F.abs(t[k + 2] - i[k])).otherwise(far), F.when(t[k] >= i[k + 2], F.abs(i[k + 2] - t[k])).otherwise(far)
        return F.when(over[k] > 0, 0.0).otherwise(F.least(before, after))

    def near(k: int) -> Column:
        return F.when(over[k] > 0, 0.0).otherwise(F.least(F.abs(t[k + 2] - i[k]), F.abs(i[k + 2] - t[k])))

    usable = (iw > 0) & (ih > 0) & (tw > 0) & (th > 0) & (tw <= 2 * iw) & (tw >= 8) & (th >= 8)
    beside = (over[1] > 0) & (gap(0) <= SIDE_GAP)
    stacked = (over[0] > F.greatest(0.3 * iw, F.lit(30.0))) & (gap(1) <= STACK_GAP)
    corner = (near(0) <= SIDE_GAP) & (near(1) <= STACK_GAP)
    return F.when(usable & beside, gap(0)).when(usable & stacked, gap(1)).when(usable & corner, F.sqrt(near(0) ** 2 + near(1) ** 2))


def is_substantial(kind: Column, text: Column, table_html: Column) -> Column:
    """Whether a block shows that its page is body: a longer text or table, or a title that names no front matter."""
    k, body = block_type(kind), F.coalesce(text, F.lit(""))
    front = F.lit(False)
    for word in FRONT_TITLES:
        front = front | F.contains(body, F.lit(word))
    titled, tabled = k.isin(TITLE_TYPES), k.isin(TABLE_TYPES)
    enough = F.when(titled, ~front & (F.length(body) >= 2)).when(tabled, F.length(F.coalesce(table_html, F.lit(""))) > LEAST_TABLE)
    return ~k.isin([*SKIP_TYPES, *IMAGE_TYPES]) & F.coalesce(enough, F.length(body) > LEAST_BODY)


def image_action(mode: str, sub_type: Column, description: Column, caption: Column, verdict: Column) -> Column:
    """What becomes of an image block, by filter mode (none, auto, content, llm, all): struct(action, entries).

    action is keep, discard, text_only or caption_only; entries are the texts that stand for the image in the last two. verdict is a
    judge's answer where there is one (false: discard), and is asked in mode llm alone. Other modes are taken as all.
    """
    said, named = (F.coalesce(c, F.lit("")) for c in (description, caption))
    none = F.array().cast("array<string>")
    result = lambda action, entries=none: F.struct(F.lit(action).alias("action"), entries.alias("entries"))
    keep, discard = result("keep"), result("discard")
    if mode == "none":
        return discard
    if mode == "auto":
        return F.when(named != "", keep).otherwise(discard)
    if mode not in ("content", "llm"):
        return keep
    dropped = (F.length(said) < LEAST_DESCRIPTION) | (F.lit(mode == "llm") & ~F.coalesce(verdict, F.lit(True)))
    lettered = F.coalesce(sub_type, F.lit("")) == "text_image"
    in_description = F.when(lettered & dropped, discard).when(lettered, result("text_only", F.array(said))).otherwise(keep)
    return F.when(has_chinese(said), in_description).when(has_chinese(named), result("caption_only", F.array(named))).otherwise(discard)
