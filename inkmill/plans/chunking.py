"""The default chunker over documents as made-up pages of blocks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose
from ..operators.compose import IMAGE_LABEL, TABLE_LABEL
from ..operators.sections import line_blocks

#: Lines a page.
PAGE = 40


def documents_as_blocks(documents: DataFrame) -> DataFrame:
    """Lines as blocks of all kinds: short ones are titles of two heights, others by their place lists, tables, images and captions on their own."""
    pos, text = F.col("pos"), F.col("text")
    kind = (
        F.when(F.length(text) <= 40, "title").when(pos % 7 == 3, "text_list").when(pos % 11 == 5, "table")
        .when(pos % 13 == 6, "image").when(pos % 13 == 8, "image_caption").otherwise("text")
    )
    rows = line_blocks(documents).withColumn("type", kind)
    of = lambda name: F.col("type") == name
    return rows.withColumns(
        {
            "page": (F.floor(pos / PAGE) + 1).cast("int"),
            "bbox": F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), (20 + 20 * (pos % 2)).cast("double")),
            "img_path": F.when(of("image"), F.concat(F.lit("i"), pos.cast("string"))),
            "caption": F.when((of("image") | of("table")) & (pos % 2 == 0), F.concat(F.lit("c"), pos.cast("string"))),
            "rows": F.when(of("table"), F.array(text, F.concat(F.lit("row "), pos.cast("string")))),
        }
    )


def default_chunk(documents: DataFrame) -> DataFrame:
    made = compose.chunk_blocks(documents_as_blocks(documents))
    return made.select("doc_id", "chunk_idx", "parent", "parent_type", "level", "page", "child", F.size(F.filter("parts", lambda p: p["kind"] == "image")).alias("images"))


def default_chunk_sql(lines: str, strip, tokens) -> str:
    """SQL over lines(doc_id, pos, line); strip and tokens make expressions of a text. A recursive query goes through each section item by item."""
    part = lambda text: f"[{{'img': false, 't': {text}}}]"
    joined = "(f[-1].t || CASE WHEN s.sub THEN chr(10) ELSE '' END || i.text)"
    flushed = f"CASE WHEN len(lists) > 0 THEN parts || {part('array_to_string(lists, chr(10))')} ELSE parts END"
    shown = "array_to_string(list_transform(parts, lambda p: CASE WHEN p.img THEN '" + IMAGE_LABEL + "' || p.t ELSE p.t END), chr(10))"
    percent = f"regexp_replace({strip(shown)}, '([^0-9])%([\\x{{4E00}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]*)([0-9]+\\.?[0-9]*)', '\\1\\3%\\2', 'g')"
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, pos, {strip("line")} AS text FROM {lines} WHERE {strip("line")} <> ''),
b AS (SELECT doc_id, pos, text, CAST(pos // {PAGE} + 1 AS INT) AS page, 20 + 20 * (pos % 2) AS height,
    CASE WHEN length(text) <= 40 THEN 'title' WHEN pos % 7 = 3 THEN 'list' WHEN pos % 11 = 5 THEN 'table' WHEN pos % 13 = 6 THEN 'image' WHEN pos % 13 = 8 THEN 'note' ELSE 'body' END AS kind FROM l),
h AS (SELECT doc_id, list_sort(list(height)) AS h FROM b WHERE kind = 'title' GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN len(h) < 3 OR len(list_distinct(h)) <= 1 OR list_max(h) < greatest(h[len(h) // 2 + 1] * 1.5, 25) THEN -1 ELSE greatest(h[len(h) // 2 + 1] * 1.5, 25) END AS threshold FROM h),
r AS (SELECT b.*, kind = 'title' AND (coalesce(threshold, -1) <= 0 OR height >= threshold) AS tall FROM b LEFT JOIN t USING (doc_id) WHERE kind <> 'title' OR length(text) <> 1),
n AS (SELECT *, CAST(sum(tall::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM r),
i AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY pos) AS k, pos, page, text, CASE WHEN kind = 'title' THEN 'sub' ELSE kind END AS kind, CASE WHEN pos % 2 = 0 THEN 'c' || pos ELSE '' END AS caption FROM n WHERE NOT tall),
c AS (SELECT doc_id, section, max(text) FILTER (tall) AS parent, max(page) FILTER (tall) AS page, count(*) FILTER (NOT tall) AS size FROM n GROUP BY ALL),
s AS (SELECT doc_id, section, CAST(0 AS BIGINT) AS k, size, parent, 'title' AS ptype, 1 AS level, page, CAST([] AS STRUCT(img BOOLEAN, t VARCHAR)[]) AS parts, false AS sub, CAST([] AS VARCHAR[]) AS lists FROM c
  UNION ALL
  SELECT doc_id, section, k, size, CASE WHEN parent IS NULL AND kind IN ('sub', 'list', 'body') THEN text WHEN parent IS NULL AND kind = 'table' THEN CASE WHEN caption <> '' THEN caption ELSE text END ELSE parent END,
    CASE WHEN parent IS NULL THEN CASE kind WHEN 'sub' THEN 'sub_title' WHEN 'list' THEN 'list' WHEN 'body' THEN 'paragraph' WHEN 'table' THEN 'table' ELSE ptype END ELSE ptype END,
    CASE WHEN parent IS NULL AND kind IN ('list', 'body', 'table') THEN 2 ELSE level END, CASE WHEN parent IS NULL AND kind IN ('sub', 'list', 'body', 'table') THEN ipage ELSE page END,
    CASE WHEN parent IS NULL AND kind IN ('sub', 'list', 'body') THEN [] ELSE made END, CASE kind WHEN 'sub' THEN parent IS NOT NULL WHEN 'list' THEN false WHEN 'body' THEN false ELSE sub END, CASE WHEN kind = 'list' THEN lists || [text] ELSE [] END
  FROM (SELECT s.doc_id, s.section, i.k, s.size, s.parent, s.ptype, s.level, s.page, s.sub, s.lists, i.kind, i.text, i.caption, i.page AS ipage,
      CASE i.kind WHEN 'list' THEN s.parts WHEN 'sub' THEN f || {part("i.text")} WHEN 'image' THEN f || [{{'img': true, 't': i.caption}}]
        WHEN 'table' THEN f || CASE WHEN i.caption <> '' THEN {part("'" + TABLE_LABEL + "' || i.caption")} ELSE [] END || {part("i.text")} || {part("'row ' || i.pos")}
        WHEN 'note' THEN CASE WHEN len(f) = 0 THEN f WHEN spot > 0 THEN f[:spot - 1] || [{{'img': true, 't': CASE WHEN f[spot].t <> '' THEN f[spot].t || ' | ' ELSE '' END || i.text}}] || f[spot + 1:] ELSE f || {part("i.text")} END
        ELSE CASE WHEN len(f) > 0 AND NOT f[-1].img AND {tokens(joined)} <= 512 THEN f[:-2] || {part(joined)} ELSE f || {part("i.text")} END END AS made
    FROM (SELECT *, coalesce(list_max(list_transform(range(1, len(f) + 1), lambda x: CASE WHEN f[x].img THEN x ELSE 0 END)), 0) AS spot FROM (SELECT *, {flushed} AS f FROM s)) s JOIN i ON i.doc_id = s.doc_id AND i.section = s.section AND i.k = s.k + 1)),
e AS (SELECT doc_id, section AS chunk_idx, parent, ptype AS parent_type, level, page, {flushed} AS parts FROM s WHERE k = size AND parent IS NOT NULL),
m AS (SELECT doc_id, chunk_idx, parent, parent_type, level, page, CASE WHEN len(list_filter(parts, lambda p: p.img)) > 0 THEN {shown} ELSE {percent} END AS child, len(list_filter(parts, lambda p: p.img)) AS images FROM e),
g AS (SELECT doc_id, page, list(text ORDER BY pos) AS x FROM b WHERE doc_id NOT IN (SELECT doc_id FROM m)
  AND (doc_id, pos) NOT IN (SELECT (doc_id, min(pos)) FROM b WHERE kind = 'title' GROUP BY doc_id) GROUP BY doc_id, page),
u AS (SELECT * FROM m UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1, x[1], 'paragraph', 2, page, array_to_string(x[2:], chr(10)), 0 FROM g),
v AS (SELECT *, {strip("child")} = '' AS bare, coalesce(sum(({strip("child")} <> '')::INT) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, lead(chunk_idx) OVER (PARTITION BY doc_id ORDER BY chunk_idx) IS NULL AS final FROM u),
w AS (SELECT *, bare AND row_number() OVER (PARTITION BY doc_id, run ORDER BY chunk_idx) % 2 = 1 AND NOT final AS taken FROM v),
y AS (SELECT *, lag(CASE WHEN taken THEN parent END) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS lead_in FROM w)
SELECT doc_id, chunk_idx, parent, parent_type, CAST(level AS INT) AS level, page, CASE WHEN lead_in IS NULL THEN child WHEN bare THEN lead_in ELSE lead_in || chr(10) || child END AS child, CAST(images AS INT) AS images FROM y WHERE NOT taken
"""
