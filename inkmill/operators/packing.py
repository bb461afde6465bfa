"""Sections packed by size: texts under their headings, cut at a soft and a hard limit, small ones put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .blocks import rest_of
from .chunks import register_strategy

#: Characters that a pack holds at most, beyond which nothing is added, and below which it takes up the next one; between two texts stand GAP.
HARD, SOFT, SMALL, GAP = 1000, 800, 500, 2
ITEM = "struct<text: string, heading: boolean>"


def _packed(items: Column, hard: int, soft: int, small: int) -> Column:
    """An array of items (text, heading) to an array of packs, each an array of items."""
    none = F.array().cast(f"array<{ITEM}>")
    state = lambda done, now, size: F.struct(done.alias("done"), now.alias("now"), size.alias("size"))
    start = lambda kind: state(F.array().cast(f"array<{kind}>"), none, F.lit(0))
    closed = lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    of = lambda texts: F.aggregate(texts, F.lit(0), lambda a, x: a + F.length(x["text"]) + F.when(a > 0, GAP).otherwise(0))

    def add(s: Column, x: Column) -> Column:
        size, full = F.length(x["text"]), s["size"] + GAP + F.length(x["text"])
        fresh = (F.size(s["now"]) == 0) | x["heading"] | (s["size"] >= soft) | (full > hard)
        return F.when(fresh, state(closed(s), F.array(x), size)).otherwise(state(s["done"], F.concat(s["now"], F.array(x)), full))

    def join(s: Column, pack: Column) -> Column:
        full = s["size"] + GAP + of(pack)
        fits = (F.size(s["now"]) > 0) & (s["size"] < small) & (full <= hard)
        return F.when(fits, state(s["done"], F.concat(s["now"], pack), full)).otherwise(state(closed(s), pack, of(pack)))

    sections = F.aggregate(items, start(f"array<{ITEM}>"), add, closed)
    return F.aggregate(sections, start(f"array<{ITEM}>"), join, closed)


def pack_sections(paragraphs: DataFrame, hard: int = HARD, soft: int = SOFT, small: int = SMALL) -> DataFrame:
    """(doc_id, pack, parent, bodies) of paragraphs(doc_id, pos, text, heading).

    A heading begins a section; a section is cut where it has ``soft`` characters or the next text would bring it over ``hard``. A pack of fewer than
    ``small`` takes up the next as long as both stay within ``hard``. A text beyond ``hard`` is a pack of its own. The first heading is the pack's
    parent, else its first text; further headings lead the bodies. A document's paragraphs are one array.
    """
    rows = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    item = F.struct("pos", "text", F.coalesce("heading", F.lit(False)).alias("heading"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    items = F.transform("x", lambda p: F.struct(p["text"].alias("text"), p["heading"].alias("heading")))
    packs = docs.select("doc_id", F.posexplode(_packed(items, hard, soft, small)).alias("pack", "x"))
    headings, texts = F.filter("x", lambda p: p["heading"])["text"], F.filter("x", lambda p: ~p["heading"])["text"]
    headed = F.size(headings) > 0
    parent = F.when(headed, F.get(headings, F.lit(0))).otherwise(F.get(texts, F.lit(0)))
    return packs.select("doc_id", "pack", parent.alias("parent"), F.when(headed, F.concat(rest_of(headings), texts)).otherwise(rest_of(texts)).alias("bodies"))


def by_sections(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs packed by sections and written as marked texts, a child a body."""
    from .sections import marked

    packs = pack_sections(paragraphs).select("doc_id", F.col("pack").alias("chunk_idx"), "parent", F.array_join("bodies", "\n").alias("child"))
    return marked(packs)


register_strategy("sections", by_sections)
