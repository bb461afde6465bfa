"""The default chunker, split repair and the marker round trip."""

from pyspark.sql import functions as F

from inkmill.functions import content
from inkmill.operators import chunks, compose, sections
from inkmill.sources import documents

BLOCKS = "doc_id int, page int, pos int, type string, text string, has_text_level boolean, bbox array<double>"


def block(doc, page, pos, kind, text, height=10.0):
    return (doc, page, pos, kind, text, False, [0.0, 0.0, 100.0, float(height)])


def test_chunk_blocks(spark):
    data = [
        block(1, 1, 0, "title", "文件", 40), block(1, 1, 1, "header", "页眉"), block(1, 1, 2, "text", "导语。"), block(1, 1, 3, "text", "续。"),
        block(1, 1, 4, "title", "第一章", 40), block(1, 2, 0, "title", "（一）小节", 10), block(1, 2, 1, "text", "甲。"), block(1, 2, 2, "text", "乙。"), block(1, 2, 3, "text_list", "1. 一"), block(1, 2, 4, "list", "2. 二"),
        block(1, 2, 5, "text", "丙。"), block(1, 2, 6, "title", "x"), block(1, 3, 0, "title", "第二章", 40), block(1, 3, 1, "title", "第三章", 40), block(1, 3, 2, "image", "图示", 90), block(1, 3, 3, "text", "丁" * 600),
        block(1, 3, 4, "title", "低", 10), block(1, 3, 5, "title", "低题", 10), block(1, 3, 6, "title", "低题二", 10), block(1, 3, 7, "title", "低题三", 10), block(1, 3, 8, "image", "无图之注", 90),
        block(2, 1, 0, "text", "", 10), block(3, 1, 0, "list", "- 项"), block(3, 1, 1, "list", "- 目"),
    ]
    got = {(r.doc_id, r.chunk_idx): (r.parent, r.parent_type, r.child) for r in sections.chunk_blocks(spark.createDataFrame(data, BLOCKS)).collect()}
    # The document's title is a parent too; what has no children goes into the next.
    assert got[1, 1] == ("文件", "title", "导语。续。")
    assert got[1, 2] == ("第一章", "title", "（一）小节\n甲。乙。\n1. 一\n2. 二丙。")
    assert (1, 3) not in got and got[1, 4][:2] == ("第三章", "title")
    assert got[1, 4][2] == "第二章\n" + "丁" * 600 + "\n低题\n低题二\n低题三\n无图之注"
    assert got[3, 0] == ("- 项", "list", "- 项\n- 目") and not [k for k in got if k[0] == 2] and len(got) == 4


def test_first_titles_stay(spark):
    """Titles that a chunker might take out as the document's: they are parents, and a document of one title has a row."""
    data = [block(1, 1, 0, "title", "年度报告", 40), block(1, 1, 1, "title", "第二章", 40), block(2, 1, 0, "title", "只有题目", 40), block(2, 1, 1, "table", "", 90), block(3, 1, 0, "title", "目录", 40), block(3, 1, 1, "title", "第一章", 40), block(3, 1, 2, "text", "文。")]
    data += [(4, 1, 0, "text", "有级题", True, None), (4, 1, 1, "text", "次题", True, None), (4, 1, 2, "text", "文。", False, None)]
    got = sorted((r.doc_id, r.parent, r.child) for r in sections.chunk_blocks(spark.createDataFrame(data, BLOCKS)).collect())
    assert got == [(1, "年度报告", "年度报告"), (2, "只有题目", ""), (3, "第一章", "目录\n文。"), (4, "次题", "文。")] or got[0] == (1, "第二章", "年度报告")
    assert [g for g in got if g[0] != 1] == [(2, "只有题目", ""), (3, "第一章", "目录\n文。"), (4, "次题", "文。")]


def test_figures_in_chunks(spark):
    """Tables give lines, images stand among the texts, captions on their own go to the image before them."""
    kinds = "img_path string, caption string, rows array<string>, has_table boolean, action string, entries array<string>, text_level string"
    row = lambda doc, pos, kind, text="", path=None, caption=None, rows=None, html=None, action=None, entries=None, level=None: (doc, 1, pos, kind, text, False, [0.0, 0.0, 10.0, 40.0], path, caption, rows, html, action, entries, level)
    data = [
        row(1, 0, "image", path="a.png", caption="图零"), row(1, 1, "table", caption="收支", rows=["项 | 额", "甲 | 1"]), row(1, 2, "text", "表后。"), row(1, 3, "title", "第一章", level="1"), row(1, 4, "image_caption", "孤注"),
        row(1, 5, "image", path="b.png"), row(1, 6, "image_caption", "注一"), row(1, 7, "chart_caption", caption="注二"), row(1, 8, "text", "其后。"), row(1, 9, "image", path="c.png", action="discard"),
        row(1, 10, "image", path="d.png", action="text_only", entries=["图中文字"]), row(1, 11, "table", caption="空表", html=True, path="t.png"), row(1, 12, "chart", path="e.png"), row(1, 13, "text_list", "1. 甲"), row(1, 14, "image", path="f.png", action="discard"), row(1, 15, "text_list", "2. 乙"),
        row(2, 0, "table", rows=["独 | 表"]), row(3, 0, "image", path="z.png", caption="只有图"),
    ]
    got = {(r.doc_id, r.parent): r for r in sections.chunk_blocks(spark.createDataFrame(data, f"{BLOCKS}, {kinds}")).collect()}
    shown = lambda r: [(p.text if p.kind == "text" else (p.path, p.caption)) for p in r.parts]
    lead = got[1, "收支"]
    assert (lead.parent_type, lead.level) == ("table", 2) and shown(lead) == [("a.png", "图零"), "[表] 收支", "项 | 额", "甲 | 1表后。"]
    assert lead.child == "[图片] 图零\n[表] 收支\n项 | 额\n甲 | 1表后。"
    one = got[1, "第一章"]
    assert one.level == 0 and shown(one) == [("b.png", "注一 | 注二"), "其后。", "图中文字", ("t.png", "空表"), ("e.png", ""), "1. 甲", "2. 乙"]
    assert shown(got[2, "独 | 表"]) == ["独 | 表"] and not [k for k in got if k[0] == 3]


def test_clean_paragraphs(spark):
    kinds = "img_path string, caption string, rows array<string>, text_level string, action string, entries array<string>"
    row = lambda pos, kind, text="", height=40.0, path=None, caption=None, rows=None, level=None, action=None, entries=None: (1, 1, pos, kind, text, False, [0.0, 0.0, 10.0, height], path, caption, rows, level, action, entries)
    data = [
        row(0, "image_caption", "先注"), row(1, "text", "甲"), row(2, "text_list", "乙"), row(3, "title", "大题", level="1"), row(4, "title", "小题", 20.0), row(5, "text", ""), row(6, "text", "丙"), row(7, "title", "丁题", level="3"),
        row(8, "image", path="a.png", caption="图"), row(9, "text", "戊"), row(10, "image_caption", "注"), row(11, "table", caption="表", rows=["x | y", "1 | 2"]), row(12, "image", path="b.png", action="discard"), row(13, "text", "己"),
        row(14, "image", path="c.png", action="text_only", entries=["图中字"]), row(15, "text", "庚"), row(16, "title", "三", 20.0), row(17, "title", "末题", 20.0, level="2"),
    ]
    got = [(r.text, r.style, r.level, tuple(r.image) if r.image else None) for r in compose.clean_paragraphs(spark.createDataFrame(data, f"{BLOCKS}, {kinds}")).orderBy("page", "pos", "line").collect()]
    assert got == [
        ("先注\n甲\n乙", "Normal", 0, None), ("大题", "Title", 0, None), ("小题\n丙", "Normal", 0, None), ("丁题", "Heading 3", 2, None), ("图 | 注", "Normal", 0, ("a.png", "图")), ("戊", "Normal", 0, None),
        ("[表] 表", "Normal", 0, None), ("x | y", "Normal", 0, None), ("1 | 2", "Normal", 0, None), ("己", "Normal", 0, None), ("图中字\n庚\n末题", "Normal", 0, None),
    ]


def test_captions_in_json(spark):
    import json

    data = [('{"type": "chart_body", "content": {"content": "d", "chart_caption": ["old"]}}', "chart_body"), ('{"type": "table", "content": "text"}', "table"), ('{"type": "image", "bbox": [1, 2]}', "image")]
    got = [json.loads(r[0]) for r in spark.createDataFrame(data, "raw string, kind string").select(content.with_caption(F.col("raw"), F.col("kind"), F.lit("新\"注"))).collect()]
    said = [{"type": "text", "content": "新\"注"}]
    assert got == [{"type": "chart_body", "content": {"content": "d", "chart_caption": said}}, {"type": "table", "content": {"table_caption": said}}, {"type": "image", "bbox": [1, 2], "content": {"image_caption": said}}]


def test_middle_pages(spark, tmp_path):
    (tmp_path / "a b_middle.json").write_text('{"pdf_info": [{"page_idx": 0, "page_size": [612, 792], "para_blocks": [{"type": "text"}, {}]}, {"page_size": [10.5, 20]}]}')
    (tmp_path / "a b_content_list.json").write_text("[]")
    assert [tuple(r)[:5] for r in documents.middle_pages(spark, str(tmp_path)).orderBy("page").collect()] == [("a b", 1, 612.0, 792.0, 2), ("a b", 2, 10.5, 20.0, 0)]


def test_content_chunks(spark, tmp_path):
    """From blocks' JSON to chunks: front matter goes, captions are found beside the image, tables are read."""
    import json

    box = [0, 0, 200, 200]
    body = [
        {"type": "title", "text": "目录", "bbox": [0, 0, 100, 20]}, {"type": "text", "text": "第一章……1"}, {"type": "title", "text": "年度报告", "bbox": [0, 0, 100, 60]},
        {"type": "text", "text": "本报告说明了全年的总体情况，并且列出了各项主要的指标和数据，供有关方面参考。", "bbox": [0, 300, 300, 320]}, {"type": "image", "img_path": "x.png", "bbox": box, "content": {"content": "全年收入增长图表说明", "image_caption": [{"content": "图一"}]}},
        {"type": "text", "text": "单位：亿元", "bbox": [0, 205, 100, 220]}, {"type": "table", "bbox": [0, 900, 300, 990], "table_body": "<table><tr><td>项</td><td>额</td></tr></table>", "table_caption": ["表一"]}, {"type": "image", "img_path": "y.png", "bbox": [0, 2000, 300, 2300], "content": {"content": "no letters"}},
    ]
    pages = [body, [{"type": "title", "text": "附录", "bbox": [0, 0, 100, 60]}, {"type": "text", "text": "附录内容"}]]
    blocks = documents.content_blocks(spark.createDataFrame([("d", json.dumps(pages, ensure_ascii=False))], "stem string, raw string")).withColumnRenamed("stem", "doc_id")
    compose.read_content(blocks).write.parquet(str(tmp_path / "content"))
    got = compose.content_chunks(spark.read.parquet(str(tmp_path / "content"))).collect()
    assert [(r.parent, r.parent_type, r.page) for r in got] == [("年度报告", "title", 1)]
    assert [(p.text, p.path, p.caption) for p in got[0].parts] == [("本报告说明了全年的总体情况，并且列出了各项主要的指标和数据，供有关方面参考。", None, None), (None, "x.png", "图一 | 单位：亿元"), ("[表] 表一", None, None), ("项 | 额", None, None)]


def test_repair_splits(spark):
    cases = [(["一二", "三四"], ["一二三四"]), (["一二三四五六", "七八九十一二"], ["一二三四五六", "七八九十一二"]), (["甲。乙丙", "丁戊己庚辛"], ["甲。", "乙丙丁戊己庚辛"]), (["一二三四五", "第一章好"], ["一二三四五", "第一章好"]), (["一二", "第一章"], ["一二第一章"]), (["一二", "。第一章"], ["一二", "。第一章"]), (["a"], ["a"])]
    d = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p array<string>")
    assert [r[0] for r in d.orderBy("i").select(sections.repair_splits(F.col("p"), 7)).collect()] == [w for _, w in cases]


def test_marked_round_trip(spark):
    c = spark.createDataFrame([(1, 0, "总则", "（一）标题\n正文一。\n1. 甲\n2. 乙\n尾。"), (1, 1, "附则", "好"), (2, 0, "空", "")], "doc_id int, chunk_idx int, parent string, child string")
    m = sections.marked(c)
    assert {r.doc_id: r.text for r in m.collect()} == {1: "***\n总则\n<-split->\n（一）标题\n正文一。\n<-split->\n1. 甲\n2. 乙\n尾。\n<-split->\n***\n附则\n<-split->\n好\n<-split->", 2: "***\n空\n<-split->"}
    back = chunks.marker_explode(m, filename=F.lit("f")).orderBy("source", "p_idx", "c_idx").collect()
    assert [(r.source, r.document) for r in back] == [(1, "f\n总则"), (1, "f\n（一）标题\n正文一。"), (1, "f\n1. 甲\n2. 乙\n尾。"), (1, "f\n附则"), (1, "f\n好"), (2, "f\n空")]


def test_span_chunks(spark):
    s = [(1, 1, 0, "报告", True), (1, 1, 1, "开头。", False), (1, 1, 2, "一、总体", True), (1, 1, 3, "二、空", True), (1, 1, 4, "三、正文", True), (1, 1, 5, "前半", False), (1, 1, 6, "后半。", False), (1, 1, 7, "—", False), (1, 2, 0, "表后。", False), (2, 1, 0, "无题。", False)]
    spans = spark.createDataFrame(s, "doc_id int, page int, pos int, text string, heading boolean")
    tables = spark.createDataFrame([(1, 1, 0, [["a", "b"], ["1", None]]), (2, 1, 0, [])], "doc_id int, page int, pos int, rows array<array<string>>")
    got = sorted((r.doc_id, r.chunk_idx, r.parent, r.child) for r in sections.span_chunks(spans, tables).collect() if r.parent)
    assert got == [(1, 3, "三、正文", "一、总体\n二、空\n前半后半。—"), (1, 4, "a | b", "a | b\n1 | "), (1, 5, "三、正文", "表后。")]
    assert sorted((r.doc_id, r.child) for r in sections.span_chunks(spans, tables).collect() if not r.parent) == [(1, "开头。"), (2, "无题。")]


def test_docx_walks(spark):
    rows = [("f", 0, "Title", "标题", False, False), ("f", 1, "", "目录", False, False), ("f", 2, "", "第一章....1", False, False), ("f", 3, "Heading 1", "第一章 总则", False, False), ("f", 4, "", "本法", False, False), ("f", 5, "", "全文。", False, False), ("f", 6, "", "x | y", True, False), ("f", 7, "", "1 | 2", True, False), ("f", 8, "", "其后。", False, False), ("f", 9, "Normal", "粗体", False, True), ("f", 10, "", "末。", False, False)]
    p = spark.createDataFrame(rows, "path string, pos int, style string, text string, in_table boolean, bold boolean")
    clean = [(r.text, r.style, r.level) for r in sections.docx_clean(p).orderBy("pos").collect()]
    assert clean == [("标题", "Title", 1), ("第一章 总则", "Heading 1", 1), ("本法全文。", "Normal", 0), ("x | y", "Normal", 0), ("1 | 2", "Normal", 0), ("其后。", "Normal", 0), ("粗体", "Heading 2", 1), ("末。", "Normal", 0)]
    chunks_ = [(r.title, r.parent, r.child) for r in sections.docx_chunks(p).orderBy("chunk_idx").collect()]
    assert chunks_ == [("标题", "第一章 总则", "标题\n本法全文。"), ("标题", "x | y", "x | y\n1 | 2"), ("标题", "第一章 总则", "其后。"), ("标题", "粗体", "末。")]


def test_default_chunk_folds_sections_once(spark, sf):
    """The fold's rows are written and read back, as both the chunks and the documents without any are found by them; runs stop at the limit."""
    from inkmill.functions.text import estimate_tokens
    from inkmill.plans import catalog

    made = catalog.queries()["default_chunk"](spark, sf)
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    lines = [(1, 1, k, "title" if k == 0 else "text", "T" if k == 0 else f"{k} " + "ab字 " * k, False, [0.0, 0.0, 9.0, 30.0]) for k in range(30)]
    blocks = spark.createDataFrame(lines, "doc_id long, page int, pos int, type string, text string, has_text_level boolean, bbox array<double>")
    parts = [p.text for p in compose.chunk_blocks(blocks, 60).collect()[0].parts]
    want, size = [], lambda t: spark.range(1).select(estimate_tokens(F.lit(t))).collect()[0][0]
    # Without another title the first is the document's, and the first text the parent.
    for *_, text, _, _ in lines[2:]:
        want = [*want[:-1], want[-1] + text] if want and size(want[-1] + text) <= 60 else [*want, text]
    assert parts == want and len(want) > 3
