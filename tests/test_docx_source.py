"""The DOCX data source: batch, stream and Spark's own reader give the same rows; images stand where their paragraphs are."""

import io
import zipfile

from pyspark.sql import functions as F

from inkmill.sources import docx

HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>'
PIC = '<w:r><w:drawing><a:blip r:embed="{}"/></w:drawing></w:r>'


def p(text, style="", inner=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r>{inner}</w:p>'


def made(body, images=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"{HEAD}{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<R>" + "".join(f'<Relationship Id="{rid}" Target="media/{name}"/>' for rid, name, _ in images) + "</R>")
        for _, name, data in images:
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


ONE = made(p("题", "Title") + p("图注", inner=PIC.format("r2") + PIC.format("r9") + PIC.format("r1")) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + p("", inner='<w:r><w:pict><v:imagedata r:id="r1"/></w:pict></w:r>') + p("末", inner='<w:r><w:rPr><w:sz w:val="32"/><w:szCs w:val="21"/></w:rPr></w:r>'), [("r1", "x.png", b"\x89x"), ("r2", "y.jpeg", b"jpeg")])


def rows(df):
    return sorted((r.path.split("/")[-1], r.pos, r.kind, r.style, r.text, r.name, bytes(r.content) if r.content is not None else None) for r in df.collect())


def test_batch_and_stream(spark, tmp_path):
    docx.register(spark)
    land = tmp_path / "land"
    land.mkdir()
    (land / "one.docx").write_bytes(ONE)
    for k in range(7):
        (land / f"f{k}.DOCX").write_bytes(made(p(f"文{k}")))
    (land / "bad.docx").write_bytes(b"no archive")
    (land / "other.txt").write_text("x")
    batch = spark.read.format("docx").load(str(land))
    want = [("one.docx", 0, "text", "Title", "题", None, None), ("one.docx", 1, "image", "", "图注", "1_y.jpeg", b"jpeg"), ("one.docx", 2, "image", "", "图注", "2_x.png", b"\x89x"), ("one.docx", 3, "row", "", "a | b", None, None), ("one.docx", 4, "image", "", "", "3_x.png", b"\x89x"), ("one.docx", 5, "text", "", "末", None, None)]
    assert [r for r in rows(batch) if r[0] == "one.docx"] == want and len(rows(batch)) == 13
    assert {r.text: r.size for r in batch.where("path LIKE '%one.docx' AND kind = 'text'").collect()} == {"题": 0.0, "末": 16.0}
    assert batch.select(F.spark_partition_id()).distinct().count() == 3  # nine files, three a task
    assert rows(docx.docx_parts(spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,DOCX}").load(str(land)))) == rows(batch)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    go = lambda: spark.readStream.format("docx").load(str(land)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(120)
    go()
    assert rows(spark.read.parquet(out)) == rows(batch)
    (land / "late.docx").write_bytes(made(p("后来")))
    go()
    go()
    assert rows(spark.read.parquet(out)) == rows(spark.read.format("docx").load(str(land)))


def test_uploads(spark):
    data = [(1, "a.pdf", b"%PDF-1"), (1, "b", ONE), (1, "c.txt", b"x"), (2, "d", b"%PDF"), (2, "e", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1."), (2, "f", b"zzz"), (3, "g.docx", b""), *((4, f"{k}.pdf", b"%PDF") for k in range(4))]
    files = spark.createDataFrame([(r, n, len(c), bytearray(c)) for r, n, c in data], "request int, path string, length long, content binary")
    got = {(r.request, r.path): (r.type, r.error) for r in docx.uploads(files, 3, 2000).collect()}
    assert got[1, "a.pdf"] == ("pdf", None) and got[1, "b"] == ("docx", None) and got[1, "c.txt"] == ("txt", "unknown type") and got[2, "d"] == ("pdf", None) and got[2, "e"] == ("doc", None)
    assert got[2, "f"] == (None, "unknown type") and got[3, "g.docx"] == ("docx", "empty") and {got[4, f"{k}.pdf"][1] for k in range(4)} == {"too many files"}
