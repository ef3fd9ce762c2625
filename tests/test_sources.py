import io
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur import models
from larkspur.operators import cache, memory
from larkspur.sources import files, generations, pdf, topics
from larkspur.streaming import pipelines
from tests import pdfs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"


def docx():
    para = lambda t, s=None: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = para("Title here", "Title") + para(" ") + para("Part one", "Heading2") + para("Text") + f"<w:tbl>{para('cell')}</w:tbl>" + para("Odd", "HeadingX")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pptx():
    shape = lambda t, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr sz="2400"/><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, s in ((10, shape("Ten")), (2, shape("Head", '<p:ph type="title"/>') + shape("Body"))):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="{P}" xmlns:a="{A}">{s}</p:sld>')
    return out.getvalue()


def test_scan_and_elements(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx())
    (tmp_path / "b.pptx").write_bytes(pptx())
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF")
    found = files.scan(spark, str(tmp_path))
    assert {(r.file_name, r.file_type) for r in found.select("file_name", "file_type").collect()} == {("a.DOCX", "docx"), ("b.pptx", "pptx")}
    assert files.scan(spark, str(tmp_path / "missing")).count() == 0
    e = files.elements(found.withColumnRenamed("file_name", "doc_id")).orderBy("doc_id", "ord").collect()
    assert [(x.text, x.element_type, x.heading_level) for x in e if x.doc_id == "a.DOCX"] == [("Title here", "heading", 1), ("Part one", "heading", 2), ("Text", "paragraph", None), ("Odd", "heading", None)]
    assert [(x.text, x.slide, x.heading_level) for x in e if x.doc_id == "b.pptx"] == [("Head", 1, 1), ("Body", 1, None), ("Ten", 2, None)]
    text = files.full_text(files.elements(found.withColumnRenamed("file_name", "doc_id")).where("slide is not null")).first()["text"]
    assert text == "Head\nBody\n\nTen"


def test_pdf_lines_and_headings(spark):
    seen = []
    found = pdf.elements(pdfs.pdf(pdfs.TWO_PAGES), lambda picture, before: seen.append((picture, before)) or "told")
    assert [(e["text"], e["page"], e.get("heading_level")) for e in found] == [
        ("Annual Report", 1, 1), ("First (body) line goes on", 1, None), ("Second line.", 1, None), ("told", 1, None), ("Café end", 1, None), ("Sub head", 2, 2), ("text", 2, None), ("Hello", 2, None), ("more.", 2, None),
    ]
    assert seen == [(b"JPEG", "Annual Report\nFirst (body) line goes on\nSecond line.")]  # the other picture is small
    assert pdf.elements(pdfs.pdf(pdfs.TWO_PAGES, compress=False)) == [e for e in found if e["text"] != "told"]
    # The same objects inside an object stream, with a character map.
    names = b"/CIDInit /ProcSet findresource begin 1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0009> <00480069> endbfchar end"
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 6 0 R /Resources << /Font << /F 4 0 R >> >> >>", b"<< /Type /Font /Subtype /Type0 /BaseFont /Odd /ToUnicode 5 0 R >>"]
    offsets, body = [], b""
    for i, o in enumerate(inner, 1):
        offsets.append(b"%d %d" % (i, len(body)))
        body += o + b" "
    head = b" ".join(offsets) + b" "
    packed = zlib.compress(head + body)
    data = b"%PDF-1.5\n" + b"7 0 obj\n<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    data += b"5 0 obj\n<< /Length %d >>\nstream\n" % len(names) + names + b"\nendstream\nendobj\n"
    shown = b"BT /F 9 Tf <000100020003> Tj 0 -20 Td <0009> Tj ET"
    data += b"6 0 obj\n<< /Length %d >>\nstream\n" % len(shown) + shown + b"\nendstream\nendobj\n"
    assert [e["text"] for e in pdf.elements(data)] == ["ABC", "Hi"]
    for bad in (b"", b"%PDF-1.4 nothing", data + b"trailer << /Encrypt 9 0 R /Root 1 0 R >>"):
        with pytest.raises(ValueError):
            pdf.elements(bad)


def test_a_bad_file_is_a_row_with_its_error(spark):
    rows = [("a", "pdf", bytearray(b"%PDF")), ("b", "txt", bytearray(b"x")), ("c", "docx", bytearray(b"no zip")), ("d", "pdf", bytearray(pdfs.pdf(["BT ET"]))), ("e", "pdf", bytearray(pdfs.pdf(pdfs.TWO_PAGES))), ("f", "pdf", None)]
    df = spark.createDataFrame(rows, "doc_id string, file_type string, content binary")
    found = files.elements(df)
    bad = {r.doc_id: r.error for r in found.where("error is not null").collect()}
    assert set(bad) == {"a", "b", "c", "d", "f"} and "no reader" in bad["b"] and bad["d"] == "no text"
    assert found.where("doc_id = 'e'").count() == 8 and files.full_text(found).first()["text"].split("\n\n")[1].startswith("Sub head\ntext")
    own = files.elements(df.where("doc_id = 'a'"), lambda content, see: [{"text": "t", "element_type": "paragraph", "page": 1}])
    assert own.first()["text"] == "t"


def test_pictures_in_documents(spark):
    picture = b"P" * 1000
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{}"/><Relationship Id="r2" Target="{}"/></Relationships>'
    blip = lambda r: f'<a:blip xmlns:a="{A}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="{r}"/>'
    one = io.BytesIO()
    with zipfile.ZipFile(one, "w") as z:
        para = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("one", "two", "three", "four"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{para}<w:p>{blip("r1")}{blip("r2")}</w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", rels.format("media/a.png", "media/b.png"))
        z.writestr("word/media/a.png", picture)
        z.writestr("word/media/b.png", b"small")
    see = models.vision(lambda content, before: f"{len(content)} after {before.split()}")
    assert [e["text"] for e in files.docx_elements(one.getvalue(), see)][4:] == ["\n[IMAGE ANALYSIS: 1000 after ['two', 'three', 'four']]\n"]
    assert len(files.docx_elements(one.getvalue())) == 4
    two = io.BytesIO()
    with zipfile.ZipFile(two, "w") as z:
        shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
        tree = lambda inner: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
        z.writestr("ppt/slides/slide1.xml", tree(shape.format("late")))
        z.writestr("ppt/slides/slide2.xml", tree(shape.format("first") + f"<p:grpSp>{shape.format('inside')}</p:grpSp><p:pic>{blip('r1')}</p:pic><p:pic>{blip('r2')}</p:pic>"))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels.format("../media/a.png", "../media/b.png"))
        z.writestr("ppt/media/a.png", picture)
        z.writestr("ppt/media/b.png", b"small")
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels.format("slides/slide1.xml", "slides/slide2.xml"))
    found = files.pptx_elements(two.getvalue(), see)
    assert [(e["text"], e["slide"], e["shape_index"]) for e in found] == [("first", 1, 1), ("\n[IMAGE ANALYSIS: 1000 after ['first']]\n", 1, 3), ("late", 2, 1)]


def test_questions(spark, tmp_path):
    (tmp_path / "q.txt").write_text("first\n\n# no\nsecond\n")
    assert [(r.id, r.input) for r in files.text_questions(files.numbered_lines(spark, str(tmp_path / "q.txt"))).collect()] == [("case-1", "first"), ("case-4", "second")]
    (tmp_path / "q.jsonl").write_text('{"input":"a","source_documents":["x"]}\n{"id":"k","input":"b"}\n')
    assert [(r.id, r.input, r.source_documents) for r in files.json_questions(files.numbered_lines(spark, str(tmp_path / "q.jsonl"))).collect()] == [("case-1", "a", ["x"]), ("k", "b", None)]
    (tmp_path / "c.jsonl").write_text('# note\n{"input":" a ","source_documents":[]}\n')
    assert [(r.id, r.input) for r in files.questions(spark, str(tmp_path / "c.jsonl")).collect()] == [("case-2", "a")]
    for line in ('{"input":" "}', "[1]", "none", '{"input":5}', '{"input":"a","expected_output":5}', '{"input":"a","expected_output":null}', '{"input":"a","source_documents":"x"}', '{"input":"a","source_documents":["x",1]}'):
        (tmp_path / "bad.jsonl").write_text(line + "\n")
        with pytest.raises(Exception, match="no valid case"):
            files.json_questions(files.numbered_lines(spark, str(tmp_path / "bad.jsonl"))).collect()
    (tmp_path / "none.txt").write_text("# only this\n\n")
    with pytest.raises(ValueError, match="no question"):
        files.questions(spark, str(tmp_path / "none.txt"))


def test_generations(spark, tmp_path):
    g = generations.Generations(spark, f"file://{tmp_path}/kb", "kb")
    assert g.live() is None and g.read() is None
    one = g.stage(spark.createDataFrame([("a", "r")], "chunk_id string, allowed_role string"), "allowed_role")
    g.publish(one, 1, 1)
    two = g.stage(spark.createDataFrame([("a", "r"), ("b", "s")], "chunk_id string, allowed_role string"))
    for wrong in ({"expected_rows": 3}, {"produced": 1}, {"failed": 1}):
        with pytest.raises(ValueError):
            g.publish(two, **wrong)
    assert g.live() == one
    g.publish(two, 2, 2)
    assert g.live() == two and g.read().count() == 2


def test_names_of_the_live_generation(spark, tmp_path):
    row = spark.createDataFrame([("a",)], "chunk_id string")
    g = generations.Generations(spark, f"file://{tmp_path}/old", "kb")
    row.write.parquet(f"file://{tmp_path}/old/kb")
    assert g.live() == "kb"  # a plain folder under the base name
    (tmp_path / "old" / "_LIVE-kb").write_text("kb-7")
    assert g.live() == "kb-7"  # a pointer of the base name
    (tmp_path / "old" / "_LIVE-kb").write_text("kb-7 kb-8")
    with pytest.raises(ValueError, match="several"):
        g.live()
    new = g.stage(row)
    g.publish(new, 1, 1)
    assert g.live() == new
    clash = generations.Generations(spark, f"file://{tmp_path}/clash", "kb")
    row.write.parquet(f"file://{tmp_path}/clash/kb_live")
    with pytest.raises(ValueError, match="of its own"):
        clash.live()
    assert generations.Generations(spark, f"file://{tmp_path}/clash", "kb", "other").live() is None


def test_messages_and_quarantine(spark):
    rows = [("t", 0, 1, '{"chunk_id":"a","content":"x"}'), ("t", 0, 2, "nonsense"), ("t", 0, 3, "[1]"), ("t", 0, 4, '{"chunk_id":"a","content":" "}'), ("t", 0, 5, '{"chunk_id":"","content":"x"}')]
    good, bad = generations.valid_messages(spark.createDataFrame(rows, "topic string, partition int, offset long, value string"), "chunk_id string, content string")
    assert [r.offset for r in good.collect()] == [1] and {r.offset for r in bad.collect()} == {2, 3, 4, 5}


def test_embed_and_index_stages_are_idempotent(spark, tmp_path):
    schema, root = "chunk_id string, content string", str(tmp_path / "topics")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(10)], schema)
    topics.produce(chunks, root, "chunks", "chunk_id")
    embed = models.embedder(dims=8)
    run = lambda: (pipelines.embed_phase(spark, root, str(tmp_path / "e"), schema, embed), pipelines.index_phase(spark, root, str(tmp_path / "i"), schema, str(tmp_path / "store")))
    assert run()[1] == 10
    topics.produce(chunks, root, "chunks", "chunk_id")  # redelivery
    assert run()[1] == 20
    assert pipelines.staged(spark, str(tmp_path / "store")).count() == 10
    assert run()[1] == 20  # nothing new


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i * 400), f"m{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, id long, s double, m string").withColumn("ts", F.timestamp_seconds(F.col("s") + 86_400))
    df.repartition(1).sortWithinPartitions("id").write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).json(str(tmp_path / "in"))

    def drain(s, name):
        q = s.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    hits = {(r.k, r.id): r.hit for r in drain(pipelines.ttl_hits(stream(), "k", "ts", "id"), "ttl").collect()}
    assert hits == {(r.k, r.id): r.hit for r in cache.lookups(df, "k", "ts", "id").collect()}
    got = {(r.k, r.id): (r.turn_no, r.history) for r in drain(pipelines.sliding_history(stream(), "k", "ts", "id", "m", 4), "hist").collect()}
    twin = memory.history_at(memory.numbered(df, ["k"], ["ts", "id"]), ["k"], ["ts", "id"], F.col("m"), 4)
    assert got == {(r.k, r.id): (r.turn_no, r.history) for r in twin.collect()}
    counts = drain(pipelines.windowed_counts(stream(), "ts", ["k"], 3600), "counts")
    assert {(r.window_start.timestamp(), r.k) for r in counts.collect()} <= {((r.s + 86_400) // 3600 * 3600, r.k) for r in df.collect()}


def test_state_ends_with_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "k string, id long, ts timestamp, m string"

    def send(*rows):
        spark.createDataFrame([(k, i, datetime(2024, 1, 1) + timedelta(seconds=s), f"m{i}") for k, i, s in rows], schema).coalesce(1).write.mode("append").json(str(folder))

    def run(make, name):
        q = make(spark.readStream.schema(schema).json(str(folder))).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    hits = lambda s: pipelines.ttl_hits(s, "k", "ts", "id", 900, "0 seconds")
    history = lambda s: pipelines.sliding_history(s, "k", "ts", "id", "m", 3, 3600, "0 seconds")
    send(("a", 1, 0), ("b", 2, 10))
    assert run(hits, "hits") == 2 and run(history, "hist") == 2
    send(("c", 3, 100_000))
    run(hits, "hits"), run(history, "hist")
    send(("c", 4, 100_010))
    assert run(hits, "hits") == 1 and run(history, "hist") == 1  # only c is left
    assert {(r.id, r.hit) for r in spark.read.parquet(str(tmp_path / "hits")).collect()} == {(1, False), (2, False), (3, False), (4, True)}
