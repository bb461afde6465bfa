"""Texts, captions, paths and table rows of parsed blocks that are kept as JSON or HTML strings.

A block's JSON is read as a VARIANT, so its fields may be strings, lists or objects. Strings in nested items are
followed DEPTH levels down. JSON that can't be read is an empty block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import block_type
from .text import clean_text, strip

# Fixed values.
NOT_TEXT = ["level", "image_source", "list_type", "attribute"]
CAPTION_KEYS = ["image_caption", "chart_caption", "table_caption", "caption", "image_footnote", "chart_footnote", "table_footnote"]
LABELS = {"image": "[图]", "image_body": "[图]", "image_caption": "[图]", "table": "[表]", "table_body": "[表]", "table_caption": "[表]", "simple_table": "[表]", "complex_table": "[表]", "chart": "[图表]", "chart_body": "[图表]", "chart_caption": "[图表]"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

DEPTH = 4


def _kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, F.lit(path), "variant")


def _string(value: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, F.lit("$"), "string"))


def _said(value: Column, depth: int = DEPTH) -> Column:
    """The text of a string, of a list's elements in order, or of an object's content, text or nested items."""
    text = F.coalesce(F.nullif(_string(_at(value, "$.content")), F.lit("")), _string(_at(value, "$.text")))
    text = F.when(strip(text) != "", text)
    out = F.when(_kind(value) == "STRING", _string(value))
    if not depth:
        return F.coalesce(out, F.when(_kind(value) == "OBJECT", text), F.lit(""))
    elements = F.try_variant_get(value, F.lit("$"), "array<variant>")
    listed = F.array_join(F.transform(elements, lambda x: _said(x, depth - 1)), "")
    return F.coalesce(out.when(_kind(value) == "ARRAY", listed).when(_kind(value) == "OBJECT", F.coalesce(text, _said(_at(value, "$.item_content"), depth - 1))), F.lit(""))


def _first(found: list[Column]) -> Column:
    """The first text that isn't blank, or an empty one."""
    return F.coalesce(*(F.when(c != "", c) for c in map(strip, found)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_text(raw: Column) -> Column:
    """The cleaned text of a block's JSON: its text, else its content's strings in order."""

    def said(block: Column) -> Column:
        own, content = _string(_at(block, "$.text")), _at(block, "$.content")
        names = F.filter(F.map_keys(F.from_json(F.get_json_object(raw, "$.content"), "map<string, string>")), lambda k: ~k.isin(NOT_TEXT))
        part = lambda k: F.try_variant_get(content, F.concat(F.lit('$["'), k, F.lit('"]')), "variant")
        fields = F.array_join(F.transform(names, lambda k: F.when(_kind(part(k)).isin("STRING", "ARRAY"), _said(part(k))).otherwise("")), "")
        return F.when(strip(own) != "", own).when(_kind(content) == "OBJECT", fields).otherwise(_said(content))

    return clean_text(F.coalesce(_let(F.try_parse_json(raw), said), F.lit("")))


def block_caption(raw: Column) -> Column:
    """The first caption or footnote of a block's JSON that isn't empty, at the top or in its content."""
    return _let(F.try_parse_json(raw), lambda b: _first([_said(_at(b, f"$.{place}{key}"), 1) for place in ("", "content.") for key in CAPTION_KEYS]))


def caption_key(kind: Column) -> Column:
    """The key under which a figure of a type keeps its caption."""
    k = block_type(kind)
    return F.when(F.contains(k, F.lit("chart")), "chart_caption").when(F.contains(k, F.lit("table")), "table_caption").otherwise("image_caption")


def with_caption(raw: Column, kind: Column, caption: Column) -> Column:
    """A block's JSON with a caption in its content, under its type's key; content that is no object is replaced."""
    fields = lambda c: F.coalesce(F.from_json(c, "map<string, variant>"), F.create_map().cast("map<string, variant>"))
    without = lambda m, key: F.map_filter(m, lambda k, _: k != key)
    said = F.parse_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), caption.alias("content")))))
    key = caption_key(kind)
    content = F.map_concat(without(fields(F.get_json_object(raw, "$.content")), key), F.create_map(key, said))
    return F.to_json(F.map_concat(without(fields(raw), F.lit("content")), F.create_map(F.lit("content"), F.parse_json(F.to_json(content)))))


def image_path(raw: Column) -> Column:
    """Where a block's image is: its own path, else its content's source."""
    return _let(F.try_parse_json(raw), lambda b: _first([F.coalesce(_string(_at(b, p)), F.lit("")) for p in ("$.img_path", "$.content.image_source", "$.content.image_source.path")]))


def image_description(raw: Column) -> Column:
    """What a block's content says about its image."""
    return _let(F.try_parse_json(raw), lambda b: F.coalesce(_string(_at(b, "$.content.content")), F.lit("")))


def table_html(raw: Column) -> Column:
    """The HTML of a table block: its content's, else its body."""
    return _let(F.try_parse_json(raw), lambda b: F.coalesce(F.nullif(_string(_at(b, "$.content.html")), F.lit("")), _string(_at(b, "$.table_body")), F.lit("")))


def _plain(html: Column) -> Column:
    """A cell's text: tags go, entities are read."""
    c = F.regexp_replace(html, F.lit(r"(?s)<[^>]*>"), F.lit(""))
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return strip(c)


def table_rows(html: Column) -> Column:
    """The rows of an HTML table that have cells, their cells parted by bars; spans are not spread out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|\z)"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?:</t[dh]\s*>|(?=<t[dh]\b)|\z)"), F.lit(1))
    listed = F.transform(F.transform(rows, cells), lambda row: F.transform(row, _plain))
    return F.coalesce(F.transform(F.filter(listed, lambda row: F.size(row) > 0), lambda row: F.array_join(row, " | ")), F.array().cast("array<string>"))


def visible_text(html: Column) -> Column:
    """A page's visible text: scripts, styles and comments go, block tags break lines, lines are stripped and blank ones left out."""
    c = F.regexp_replace(html, F.lit(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"), F.lit(" "))
    c = F.regexp_replace(c, F.lit(r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|title|section|article)\b[^>]*>"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(_plain(x), F.lit(r"[ \t]+"), F.lit(" "))), lambda x: x != "")
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def figure_text(kind: Column, caption: Column) -> Column:
    """A figure's label and caption."""
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), block_type(kind)), F.concat(F.lit("["), block_type(kind), F.lit("]")))
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(label, F.lit(" "), caption)).otherwise(label)


def figure_entry(kind: Column, path: Column, caption: Column) -> Column:
    """A figure as struct(type, path, caption)."""
    return F.struct(block_type(kind).alias("type"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(caption, F.lit("")).alias("caption"))
