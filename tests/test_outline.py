"""Outline operators and block contents on small fixtures."""

import json

from pyspark.sql import functions as F

from inkmill.functions import content
from inkmill.operators import outline

PARAGRAPHS = "path string, pos int, style string, text string, in_table boolean, bold boolean"


def test_content(spark):
    def run(make, *values):
        d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in d.orderBy("i").select(make(F.col("v"))).collect()]

    assert run(content.table_rows, "<table><tr><td> a</td><th>b <i>c</i></th></tr><tr></tr><tr><td>1</td></tr></table>", None, "<td>x") == [["a | b c", "1"], [], []]
    blocks = [{"text": " 第 1 章 "}, {"content": "x  y"}, {"content": {"level": 2, "title_content": [{"content": "甲"}, "乙", {"item_content": [{"text": "丙"}, "丁"]}], "html": "<b>"}}, {"content": [{"text": "a"}, "b"]}, {"text": "  "}, []]
    assert run(content.block_text, *map(json.dumps, blocks), None, "{bad") == ["第1章", "x y", "甲乙丙丁<b>", "ab", "", "", "", ""]
    captions = [{"image_caption": [], "table_caption": [" t ", {"content": "u"}]}, {"content": {"chart_footnote": "f"}}, {"image_caption": "i"}, {}]
    assert run(content.block_caption, *map(json.dumps, captions)) == ["t u", "f", "i", ""]
    assert run(lambda c: content.figure_text(c, F.lit("说明")), "Image", "chart_body", "odd") == ["[图] 说明", "[图表] 说明", "[odd] 说明"]


def test_docx_titles_and_contents(spark):
    rows = [("a", 0, "", "粗", False, True), ("a", 1, "Heading 1", "一", False, False), ("a", 2, "Title", "晚", False, False), ("b", 0, "", "短", False, False), ("b", 1, "", "粗短", False, True), ("c", 0, "Title", "题", False, False), ("c", 1, "Heading 1", "一", False, False), ("d", 0, "", "x" * 31, False, False)]
    assert sorted(tuple(r) for r in outline.docx_title(spark.createDataFrame(rows, PARAGRAPHS)).collect()) == [("a", "一"), ("b", "粗短"), ("c", "题"), ("d", "")]
    toc = [("a", 0, "目 录"), ("a", 1, "总则....1"), ("a", 2, "附则\t3"), ("a", 3, "正文一"), ("a", 4, "说明....9"), ("a", 5, "甲"), ("a", 6, "乙"), ("a", 7, "丙"), ("b", 0, "目录"), ("b", 1, "x....1"), ("c", 0, "无")]
    d = spark.createDataFrame([(p, i, "", t, False, False) for p, i, t in toc] + [("d", 0, "", "目录", False, False), ("d", 1, "", "x..2", False, False), ("d", 2, "Heading 1", "章", False, False)], PARAGRAPHS)
    assert sorted(tuple(r) for r in outline.toc_range(d).collect()) == [("a", 0, 5), ("b", 0, 2), ("d", 0, 2)]


def test_body_pages(spark):
    long = "正文" * 60
    docs = {1: ["封面", "目  录", "续 1", long, long, "附 录 A"], 2: ["前言", "短", long], 3: [long, long], 4: ["短"], 5: [long] * 8 + ["附录 一", "附录 二"], 6: ["内部资料", "说明", "五年规划", "短"], 7: ["封", "面", "短", "短"], 8: ["封面", "短", "附录"]}
    d = spark.createDataFrame([(k, i + 1, t) for k, v in docs.items() for i, t in enumerate(v)], "doc_id int, page int, text string")
    assert sorted(tuple(r) for r in outline.body_pages(d).collect()) == [(1, 4, 5), (2, 3, 3), (3, 1, 2), (4, 2, 1), (5, 1, 8), (6, 3, 4), (7, 4, 4), (8, 1, 2)]


def test_toc_blocks_and_empty_headings(spark):
    b = [(1, 0, "text", "前文"), (1, 1, "title", "目录"), (1, 2, "text", "总则……1"), (1, 3, "title", "第一章"), (1, 4, "title", "第二章"), (1, 5, "text", "第一条 为了"), (1, 6, "text", "后文"), (2, 0, "text", "目录"), (2, 1, "text", "总则……1"), (3, 0, "text", "没有它的一页")]
    assert sorted(r.pos + 10 * r.doc_id for r in outline.drop_toc_blocks(spark.createDataFrame(b, "doc_id int, pos int, type string, text string")).collect()) == [10, 14, 15, 16, 30]
    c = spark.createDataFrame([(1, 0, "A", ""), (1, 1, "B", None), (1, 2, "C", "c"), (1, 3, "D", "d"), (1, 4, "E", "")], "doc_id int, chunk_idx int, parent string, child string")
    assert sorted(tuple(r) for r in outline.merge_empty_headings(c).collect()) == [(1, 2, "C", "A\nB\nc"), (1, 3, "D", "d"), (1, 4, "E", "")]
