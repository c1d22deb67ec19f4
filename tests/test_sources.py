"""Readers, converters, streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from marlspike.functions import vector
from marlspike.operators import events, lifecycle
from marlspike.sources import convert, sessions
from marlspike.streaming import pipelines


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_x_", "."), content)
    return out.getvalue()


W = 'xmlns:w="w"'


def test_docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert convert.docx(archive(word__document_x_xml=body)) == "## Head\n\none two\n\n| A |\n| --- |\n| 1 |"


def test_pptx_slides_go_by_name():
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:t>{t}</a:t></p:sld>'
    data = archive(ppt__slides__slide2_x_xml=slide("two"), ppt__slides__slide10_x_xml=slide("ten"), ppt__notesSlides__notesSlide2_x_xml=slide("note"))
    assert convert.pptx(data) == "## Slide 1\n\nten\n\n## Slide 2\n\ntwo\n> note"


def test_xlsx_with_equal_heads_is_one_table():
    sheet = lambda v: f'<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>{v}</v></c></row></sheetData></worksheet>'
    data = archive(
        xl__workbook_x_xml='<workbook xmlns="s" xmlns:r="r"><sheets><sheet name="P" r:id="a"/><sheet name="Q" r:id="b"/></sheets></workbook>',
        xl___rels__workbook_x_xml_x_rels='<Relationships xmlns="r"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
        xl__sharedStrings_x_xml='<sst xmlns="s"><si><t>H</t></si></sst>', xl__worksheets__sheet1_x_xml=sheet("1.0"), xl__worksheets__sheet2_x_xml=sheet("2.5"),
    )
    assert convert.xlsx(data) == "| Sheet | H |\n| --- | --- |\n| P | 1 |\n| Q | 2.5 |"


def test_rtf_html_epub_and_old_files():
    assert convert.rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9}") == "Hello bold\ncafé"
    assert convert.html(b"<html><head><title>T</title></head><body><p>a &amp; b</p></body></html>") == "# T\n\na & b"
    assert convert.epub(archive(b_x_xhtml="<p>two</p><script>no</script>", a_x_xhtml="<p>one</p>")) == "one\n\ntwo"
    assert convert.legacy(b"\x00\x01Some words here\x00\x02", convert.docx) == "Some words here"
    document = '<o:d xmlns:o="o" xmlns:t="t"><t:h t:outline-level="1">Head</t:h><t:p>para</t:p></o:d>'
    assert convert.open_document(archive(content_x_xml=document)) == "# Head\n\npara"


def test_pdf_takes_the_first_good_text():
    bad = lambda _: 1 / 0
    assert convert.pdf(b"", [bad, lambda _: "short", lambda _: "long enough " * 10], lambda t: True).startswith("long")
    assert convert.pdf(b"", [bad, lambda _: "short"], lambda t: True) == "short"


def test_pdf_cascade_over_files(spark):
    """The first good text, else what OCR adds to the first one, else the longest readable; OCR sees only files that need it."""
    asked = spark.sparkContext.accumulator(0)
    good, more = "Plenty of words that anyone can read in this text of ours. " * 3, "One two three four five six seven"
    table = {b"a": (good, ""), b"b": ("", good), b"c": (more, "x"), b"d": (more, ""), b"e": ("%%", ""), b"f": ("", "")}

    def first(data):
        if data == b"f":
            raise ValueError("broken")
        return table[data][0]

    def ocr(data):
        asked.add(1)
        return {b"c": "Something else altogether, seen by the camera", b"d": f"{more}\nand more"}.get(data, "")

    files = spark.createDataFrame([(f"/{k.decode()}.pdf", bytearray(k)) for k in table], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in convert.pdf_texts(files, [first, lambda d: table[d][1]], ocr).collect()}
    assert got["/a.pdf"] == got["/b.pdf"] == (good.strip() + "\n", None) or got["/a.pdf"][0].strip() == got["/b.pdf"][0].strip() == good.strip()
    assert got["/c.pdf"][0].split("\n\n")[0].strip() == more and "camera" in got["/c.pdf"][0] and got["/d.pdf"][0].strip() == f"{more}\nand more"
    assert got["/e.pdf"][1] == got["/f.pdf"][1] == "no extractor finds readable text" and asked.value == 4
    without = {r.path: r.text for r in convert.pdf_texts(files, [first, lambda d: table[d][1]]).collect()}
    assert without["/c.pdf"].strip() == more and without["/e.pdf"] is None


def test_old_office_files_lose_their_noise(spark):
    body = b"\xd0\xcf\x11\xe0\x00\x01" + b"\x00".join([b"The report of the year", b"w:rPr styles", b"Microsoft Office Word", "Zweite Zeile mit Umlaut ä".encode(), b"abcd", b"JFIF picture", b"\xff\xfe\xfd\xfc\xfb\xfa"]) + b"\x00"
    files = spark.createDataFrame([("/x.doc", bytearray(body)), ("/x.ppt", bytearray(body.replace(b"Microsoft Office Word", b"Current User here"))), ("/y.doc", bytearray(b"\x00\x01JFIF only\x00")), ("/z.doc", bytearray(archive(**{"word/document_x_xml": "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:body></w:document>"})))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in convert.convert(files).collect()}
    assert got["/x.doc"][0].strip() == "The report of the year\nZweite Zeile mit Umlaut ä"
    assert got["/x.ppt"][0].strip() == "The report of the year w:rPr styles Zweite Zeile mit Umlaut ä"
    assert got["/z.doc"][0].strip() == "inside"
    assert got["/y.doc"] == (None, "no readable text")


def test_files_that_fail_keep_their_reason(spark):
    rows = [("/a/x.docx", b"no zip"), ("/a/y.md", "é".encode()), ("/a/z.md", b"\xff"), ("/a/q.bin", b"")]
    got = {r.path: r for r in convert.convert(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got["/a/y.md"].text == "é" and got["/a/y.md"].error is None
    assert all(got[p].text is None and got[p].error for p in ("/a/x.docx", "/a/z.md", "/a/q.bin"))


def test_scan_skips_hidden_and_unknown_files(spark, tmp_path):
    for name in ("a.md", ".hidden/b.md", "c.bin", "memory.md", "sub/D.TXT"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in convert.scan(spark, str(tmp_path)).collect()) == ["D.TXT", "a.md"]


def as_lines(spark, *values):
    return spark.createDataFrame([("f", i, json.dumps(v)) for i, v in enumerate(values)], "file string, line_no int, line string")


def test_session_readers(spark):
    whole = {"session_id": "s", "model": "m", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"text": "a"}, {"content": "b"}]}, {"role": "tool", "content": "no"}, {"role": "assistant", "content": "tool_call: x"}]}
    got = sessions.message_lists(spark.createDataFrame([("f", json.dumps(whole))], "file string, content string")).first()
    assert (got.session_id, got.model, got.content, got.message_count) == ("s", "m", "user: hi\nassistant: a b", 2)
    got = sessions.typed_lines(as_lines(spark, {"type": "user", "content": "q"}, {"type": "gemini", "content": "r", "model": "g", "tokens": {"input": 3, "output": 4}, "thoughts": [{"text": "t"}]})).first()
    assert (got.content, got.model, got.tokens_in, got.tokens_out) == ("user: q\ngemini: [thoughts] t\nr", "g", 3, 4)
    got = sessions.payload_lines(as_lines(spark, {"type": "session_meta", "payload": {"cwd": "/x/proj"}}, {"type": "event_msg", "payload": {"message": "do"}}, {"type": "response_item", "payload": {"type": "message", "content": [{"type": "t", "text": "done"}]}})).first()
    assert (got.session_id, got.content) == ("proj", "user: do\ncodex: done")
    got = sessions.message_lines(as_lines(spark, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}}, {"type": "other"})).first()
    assert got.content == "user: a"
    kept = sessions.cleaned(sessions.message_lists(spark.createDataFrame([("/d/f.json", json.dumps(whole))], "file string, content string"))).first()
    assert kept.title == "s [m]"


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r.event_id for r in events.debounced(source.withColumn("key", F.col("user_id")), 3600).collect()}
    stream = pipelines.debounce(pipelines.read_events(spark, str(tmp_path / "in")), 3600, keep="400 days")
    query = stream.writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id for r in spark.sql("SELECT * FROM taken").collect()} == batch


def test_upload_retries_and_logs(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []

    def send(batch, epoch):
        calls.append(epoch)
        if len(calls) < 3:
            raise OSError("down")

    pipelines.upload(pipelines.read_events(spark, str(tmp_path / "in")), send, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    assert {(r.failures, r.status) for r in spark.read.parquet(str(tmp_path / "log")).select("failures", "status").distinct().collect()} == {(2, "uploaded")}


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, wanted double").select(vector.cosine(F.col("a"), F.col("b")).alias("c"), "wanted")
    assert all(abs(r.c - r.wanted) < 1e-9 for r in df.collect())


def test_top_k_is_the_largest(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector.top_k(df, [1.0, 0.0], 3).collect()] == [19, 18, 17]


def test_settings_keep_what_is_there(spark):
    rows = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"})], "a map<string,string>, b map<string,string>")
    assert rows.select(lifecycle.merge_settings(F.col("a"), F.col("b")).alias("m")).first().m == {"a": "1", "b": "3"}


def test_many_configs_are_matched_without_a_broadcast(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    configs = spark.createDataFrame([(1, "/a/b", "one"), (2, "/a", "two")], "place int, root string, config string")
    few, many = (sorted((r.path, r.config) for r in events.owners(paths, configs, most).collect()) for most in (10, 1))
    assert few == many == [("/a/b/c", "one")]
