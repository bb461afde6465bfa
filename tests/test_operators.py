"""Block, chunk, knowledge-base, store, source and stream operators on small fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from inkmill.functions.layout import box_distance
from inkmill.operators import blocks, checks, chunks, knowledge, outline
from inkmill.plans import catalog
from inkmill.sources import documents, store
from inkmill.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_marker_explode(spark):
    d = spark.createDataFrame([(1, "文档名：A\nx***p<-split->q<-split->  "), (2, ""), (3, "****<-split->q"), (4, "<-split-><-split->a*** ***b"), (5, None)], "doc_id long, text string")
    assert rows(chunks.marker_explode(d)) == [(1, 0, 0, "A\n文档名：A\nx"), (1, 1, 0, "A\np"), (1, 1, 1, "A\nq"), (3, 1, 0, "3\n*"), (3, 1, 1, "3\nq"), (4, 0, 2, "4\na"), (4, 2, 0, "4\nb")]


def test_merge_lines(spark):
    lines = ["第一行", "接着写。", "1. 甲", "2. 乙", "", "第二章 总则", "正文没有完", "（1）收入完成100亿"]
    d = spark.createDataFrame([(7, i, t) for i, t in enumerate(lines)], "doc_id int, pos int, text string")
    assert rows(chunks.merge_lines(d, ["doc_id"]), "pos") == [(7, 0, "第一行接着写。"), (7, 2, "1. 甲2. 乙"), (7, 5, "第二章 总则正文没有完（1）收入完成100亿")]


def test_parent_threshold_takes_the_upper_median(spark):
    d = spark.createDataFrame([("a", h) for h in (10.0, 20.0, 20.0, 40.0)] + [("b", 5.0)] * 4 + [("c", 9.0)], "doc_id string, height double")
    assert dict(rows(chunks.parent_threshold(d))) == {"a": 30.0, "b": -1.0, "c": -1.0}


def test_merge_small_loses_no_parent(spark):
    d = spark.createDataFrame([(1, 0, "a", ""), (1, 1, "b", ""), (1, 2, "c", "x"), (1, 3, "d", ""), (1, 4, "e", "y"), (1, 5, "f", "")], "doc_id int, chunk_idx int, parent string, child string")
    assert rows(chunks.merge_small(d)) == [(1, 1, "b", "a"), (1, 2, "c", "x"), (1, 4, "e", "d\ny"), (1, 5, "f", "")]


def test_captions_go_to_the_nearer_then_the_earlier_image(spark):
    schema = "doc_id int, page int, pos int, type string, text string, bbox array<double>, img_path string, caption string"
    data = [
        (1, 1, 0, "image", None, [0.0, 0.0, 200.0, 200.0], "a.png", "own"),
        (1, 1, 1, "image", None, [300.0, 0.0, 500.0, 200.0], "b.png", None),
        (1, 1, 2, "text", "between", [230.0, 50.0, 270.0, 70.0], None, None),
        (1, 1, 3, "text", "second", [510.0, 50.0, 550.0, 70.0], None, None),
        (1, 1, 4, "text", "x" * 41, [510.0, 80.0, 550.0, 99.0], None, None),
        (1, 2, 0, "text", "other page", [230.0, 50.0, 270.0, 70.0], None, None),
    ]
    out = {(r.page, r.pos): (r.caption, r.merged) for r in blocks.merge_captions(spark.createDataFrame(data, schema)).collect()}
    assert out == {(1, 0): ("own | between", False), (1, 1): ("second", False), (1, 2): (None, True), (1, 3): (None, True), (1, 4): (None, False), (2, 0): (None, False)}


def test_box_distance(spark):
    def d(a, b):
        return spark.range(1).select(box_distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]

    image = [0.0, 0.0, 100.0, 100.0]
    assert d(image, [110.0, 10.0, 150.0, 30.0]) == 10 and d(image, [10.0, 130.0, 90.0, 150.0]) == 30
    assert d(image, [103.0, 104.0, 150.0, 120.0]) == 5 and d(image, [0.0, 10.0, 201.0, 30.0]) is None and d(image, [500.0, 500.0, 540.0, 520.0]) is None


def test_body_blocks(spark):
    long = "正文" * 20
    data = [
        (1, 1, 0, "text", "封面"), (1, 2, 0, "title", "目 录"), (1, 2, 1, "title", "第一章 总则"), (1, 2, 2, "text", "第二章 附则……2"), (1, 2, 3, "title", "第一章"), (1, 2, 4, "text", "第一条 本法"), (1, 3, 0, "text", long), (1, 4, 0, "text", "附录 A"),
        (2, 1, 0, "text", "封面"), (2, 2, 0, "title", "报告"), (2, 3, 0, "text", long),
        (3, 1, 0, "text", "目录"), (3, 1, 1, "list", "a……1"), (3, 2, 0, "page_header", long), (3, 3, 0, "table", ""), (3, 4, 0, "title", "前言"), (3, 5, 0, "text", long),
        (4, 1, 0, "text", "x"), (4, 2, 0, "text", "附录"), (5, 1, 0, "text", "附录"),
    ]
    b = spark.createDataFrame([(*r, "<table>" + "x" * 40 if r[3] == "table" else None) for r in data], "doc_id int, page int, pos int, type string, text string, table_body string")
    got = sorted((r.doc_id, r.page, r.pos, r.doc_title) for r in outline.body_blocks(b).collect())
    assert got == [(1, 2, 3, "第一章"), (1, 2, 4, "第一章"), (1, 3, 0, "第一章"), (2, 2, 0, "报告"), (2, 3, 0, "报告"), (3, 3, 0, "前言"), (3, 4, 0, "前言"), (3, 5, 0, "前言"), (4, 1, 0, "")]


def test_image_actions(spark):
    said, short, latin = "图中文字" * 6, "短标签", "only latin letters in here"
    data = [("text_image", said, None), ("text_image", short, None), ("flowchart", said, None), ("flowchart", short, "名"), ("photo", said, None), ("photo", latin, "名"), ("photo", latin, "name"), ("text_image", "", "名"), (None, None, None)]
    i = spark.createDataFrame([(1, k, *r) for k, r in enumerate(data)], "doc_id int, pos int, sub_type string, text string, caption string")
    run = lambda mode, judge=None: [(r.action, r.entries) for r in blocks.image_actions(i, mode, judge).orderBy("pos").collect()]
    keep, gone = ("keep", []), ("discard", [])
    content = [("text_only", [said]), gone, keep, keep, keep, ("caption_only", ["名"]), gone, ("caption_only", ["名"]), gone]
    assert run("all") == [keep] * 9 and run("none") == [gone] * 9 and run("content") == content and run("llm") == content
    assert run("auto") == [keep if r[2] else gone for r in data]
    judged = lambda verdict: spark.createDataFrame([(1, k, verdict) for k in range(9)], "doc_id int, pos int, keep boolean")
    assert run("llm", judged(True)) == content and run("content", judged(False)) == content
    assert run("llm", judged(False)) == [gone, *content[1:]]


def test_route_and_captions(spark):
    p = spark.createDataFrame([(1, 1, 500, 0), (2, 1, 500, 1), (3, 1, 5, 0)], "doc_id int, page int, n_chars int, n_images int")
    assert rows(blocks.route(p)) == [(1, "fast"), (2, "model"), (3, "model")]
    d = spark.createDataFrame([(1, "a/x.PDF"), (2, "x.pdf"), (4, "x.docx"), (5, "x.pdf"), (6, "x")], "doc_id int, path string")
    assert rows(blocks.route(p, documents=d)) == [(1, "fast"), (2, "model"), (4, "fast"), (5, "model"), (6, "model")]
    assert {r.strategy for r in blocks.route(p, documents=d, configured="fast").collect()} == {"fast"} and {r.strategy for r in blocks.route(p, "model", configured="fast").collect()} == {"model"}
    i = spark.createDataFrame([(1, 0, "early", None), (1, 1, "own", True), (1, 2, "a", None), (1, 3, "body", False), (1, 4, "b", None), (2, 0, "", True), (2, 1, "c", None)], "doc_id int, pos int, text string, image boolean")
    assert rows(blocks.attach_captions(i)) == [(1, 0, "early", False), (1, 1, "own | a | b", True), (1, 3, "body", False), (2, 0, "c", True)]


def test_region_lookup_defaults(spark):
    r = spark.createDataFrame([("130104000", "X"), ("130104000", "W"), ("1302", "Y")], "MOF_DIV_CODE string, MOF_DIV_NAME string")
    kb = spark.createDataFrame([(1, "130104000"), (2, "130104099"), (3, "999"), (4, ""), (5, "000000"), (6, None)], "id int, region_code string")
    empty = [(x.id, x.region_label, x.region_name) for x in knowledge.with_region(kb, r).orderBy("id").collect()]
    assert empty == [(1, "130104000", "W"), (2, "130104099", "W"), (3, "999", ""), (4, "未设置", ""), (5, "未设置", ""), (6, "未设置", "")]
    assert [x.region_name for x in knowledge.with_region(kb, r, miss="code").orderBy("id").collect()][2] == "999"


def test_uploads_names_preview_and_metadata(spark):
    up = spark.createDataFrame([("a.pdf", 1, "h"), ("b.pdf", 2, "h")], "filename string, file_size int, file_md5 string")
    j = spark.createDataFrame([("a.pdf", 1, "z", "queued"), ("b.pdf", 2, "h", "failed"), ("c.pdf", 3, "h", "completed")], "filename string, file_size int, file_md5 string, status string")
    assert [r.filename for r in knowledge.duplicate_uploads(up, j).collect()] == ["a.pdf"]
    assert sorted(r.filename for r in knowledge.duplicate_uploads(up, j, ("file_md5",)).collect()) == ["a.pdf", "b.pdf"]
    f = spark.createDataFrame([("a.x", 1), ("a.x", 2), ("b", 3), ("b", 4)], "filename string, request_pos int")
    assert [r.name for r in knowledge.download_names(f).orderBy("request_pos").collect()] == ["a.x", "a_1.x", "b", "b_1"]
    t = spark.createDataFrame([("x\n\ny",), ("x\ny\nz",)], "t string")
    assert [r[0] for r in t.select(knowledge.preview(F.col("t"), 2)).collect()] == ["x\ny\n...", "x\ny\n..."]
    m = spark.createDataFrame([("T1", "c", "d")], "table_name string, table_comment string, business_domain string")
    with pytest.raises(ValueError):
        knowledge.add_metadata(m, m)
    with pytest.raises(ValueError):
        knowledge.cancel_metadata(m, "T2")
    assert knowledge.cancel_metadata(m, " t1 ").count() == 0 and knowledge.check_name(" ab_1 ") == "AB_1"
    with pytest.raises(ValueError):
        knowledge.check_name("a;b")
    assert (knowledge.clamp_page(9, 10, 25), knowledge.clamp_page(0, 10, 0)) == (3, 1)


def test_store(spark, tmp_path):
    path = str(tmp_path / "kb")
    make = lambda data: spark.createDataFrame(data, "source string, document string, metadata struct<region_code: string>")
    store.write_chunks(make([("a", "1", ("0",)), ("a", "2", ("0",)), ("b b", "3", ("0",))]), path)
    store.write_chunks(make([("a", "9", ("0",))]), path)
    assert sorted((r.source, r.document) for r in store.read_chunks(spark, path).collect()) == [("a", "9"), ("b b", "3")]
    store.set_region(spark, path, "a", "13")
    assert {r.source: r.metadata.region_code for r in store.read_chunks(spark, path).collect()} == {"a": "13", "b b": "0"}
    assert store.delete_sources(spark, path, ["b b"]) == 1 and [r.source for r in store.read_chunks(spark, path).collect()] == ["a"]


def test_docx_and_content_lists(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{para('x')}</w:tc><w:tc>{para('y')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('T', 'Title')}{para(' ')}{para('***')}{table}{para('body', 'Heading 2')}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "a.txt").write_text("x")
    files = documents.discover(spark, str(tmp_path))
    p = documents.docx_paragraphs(files).orderBy("pos").collect()
    assert [(r.style, r.text, r.in_table) for r in p] == [("Title", "T", False), ("", " ", False), ("", "***", False), ("", "x | y", True), ("Heading 2", "body", False)]
    assert [r.text for r in documents.marked_text(files).collect()] == ["T\n***\nbody"]
    levels = documents.docx_paragraphs(files).orderBy("pos").select(documents.style_level()).collect()
    assert [r[0] for r in levels] == [0, None, None, None, 2]
    (tmp_path / "d_content_list.json").write_text('[{"type":"text","text":"v1","page_idx":3}]')
    (tmp_path / "d_content_list_v2.json").write_text('[[{"type":"title","text":"v2","text_level":1,"bbox":[0,0,1,2]}],[{"type":"text","text":"b"}]]')
    (tmp_path / "e_content_list.json").write_text('[{"type":"text","text":"v1","page_idx":3}]')
    b = documents.content_blocks(documents.content_lists(spark, str(tmp_path))).orderBy("stem", "page").collect()
    assert [(r.stem, r.page, r.text, r.has_text_level) for r in b] == [("d", 1, "v2", True), ("d", 2, "b", False), ("e", 3, "v1", False)]


def test_dump_images_and_direct_jobs(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO \"A\".\"B\" VALUES ('a''b', '1, 2', NULL, 3);\nCREATE TABLE x;\nINSERT INTO \"A\".\"B\" VALUES ('', 'NULL', 4, NULL);\n")
    assert rows(documents.sql_dump(spark, str(tmp_path / "d.sql"), ["a", "b", "c", "d"])) == [("", "NULL", "4", None), ("a'b", "1, 2", None, "3")]
    with zipfile.ZipFile(tmp_path / "p.docx", "w") as z:
        z.writestr("word/media/x.JPEG", b"abc")
        z.writestr("word/document.xml", "<x/>")
    files = documents.discover(spark, str(tmp_path))
    assert [(r.name, r.image) for r in documents.docx_images(files).collect()] == [("word/media/x.JPEG", "900150983cd24fb0d6963f7d28e17f72.jpg")]
    assert [(r.filename, r.status, r.file_size > 0) for r in documents.direct_jobs(files).collect()] == [("p.docx", "completed", True)]


def test_merge_jobs_and_steps(spark):
    old = spark.createDataFrame([("a", "queued", 5), ("b", "failed", 6)], "id string, status string, size int")
    new = spark.createDataFrame([("a", "completed"), ("c", None)], "id string, status string")
    assert rows(jobs.merge_jobs(old, new)) == [("a", "completed", 5, True), ("c", None, None, False)]
    e = spark.createDataFrame([("a", "uploaded", 1), ("a", "queued", 2), ("a", "ingested", 3), ("b", "failed", 1), ("b", "failed", 2)], "id string, status string, at int")
    assert rows(jobs.illegal_steps(e)) == [("a", 3, "queued", "ingested")]
    done = spark.createDataFrame([("f", "ingested"), ("g", "ingested"), ("f", "failed")], "filename string, status string")
    assert sorted(rows(jobs.completed_again(done, ["f"]))) == [("f", "completed"), ("f", "failed"), ("g", "ingested")]


def test_stream_ingest(spark, tmp_path):
    land, kb = tmp_path / "in", str(tmp_path / "kb")
    land.mkdir()
    (land / "a.pdf").write_bytes(b"hello")
    (land / "empty.pdf").write_bytes(b"")
    chunker = lambda d: d.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.decode("content", "UTF-8").alias("document"))
    for _ in range(2):
        jobs.ingest(documents.accepted(documents.landing(spark, str(land))), chunker, kb, str(tmp_path / "ck")).awaitTermination(120)
        (land / "b.pdf").write_bytes(b"more")
    assert sorted((r.source, r.document) for r in store.read_chunks(spark, kb).collect()) == [("a.pdf", "hello"), ("b.pdf", "more")]


def test_jobs(spark):
    j = spark.createDataFrame([("a", "ingested", 1), ("b", "failed", None)], "id string, status string, modify_count int")
    assert rows(jobs.replace_output(j, "a")) == [("a", "completed", 2), ("b", "failed", 0)]
    p = spark.createDataFrame([("正在识别",), ("x",)], "progress string")
    assert [r[0] for r in p.select(jobs.progress_percent()).collect()] == [25, 0]
    s = spark.createDataFrame([(0,), (5 << 20,), (1 << 40,)], "file_size long")
    assert [r[0] for r in s.select(jobs.timeout_seconds()).collect()] == [600, 3000, 10800]
    assert {r.column: (r.n_null, r.n_distinct) for r in checks.column_report(j).collect()} == {"id": (0, 2), "status": (0, 2), "modify_count": (1, 1)}


def test_every_query_runs(spark, sf):
    """The registered queries of the engine give rows, and entry() too."""
    for name, query in catalog.queries().items():
        assert query(spark, sf).count() >= 1, name
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
