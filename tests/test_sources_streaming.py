import io
import json
import re
import zipfile
from html.parser import HTMLParser

from pyspark.sql import functions as F

from quillspan.sources import files as S
from quillspan.streaming import logs as Z


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_files_and_formats(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("uno\r\ndos".encode())
    (tmp_path / "b.bin").write_bytes(b"?")
    (tmp_path / "c.csv").write_bytes("año;monto;\n1;2;x\n;;\n3;4;y\n".encode("cp1252"))
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2"><f>A2*2</f></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>otra</t></is></c></row></sheetData><mergeCells><mergeCell ref="A4:B4"/></mergeCells></worksheet>'
    (tmp_path / "d.xlsx").write_bytes(archive(xl__workbook='<workbook><sheets><sheet name="Ventas"/></sheets></workbook>', xl__sharedStrings="<sst><si><t>Mes</t></si><si><t>Total</t></si></sst>", xl__worksheets__sheet1=sheet))
    (tmp_path / "e.docx").write_bytes(archive(word__document='<document><body><p><pPr><pStyle val="Heading2"/></pPr><r><t>Tema</t></r></p><p><r><t>Texto</t></r></p><tbl><tr><tc><p><r><t>a</t></r></p></tc><tc><p><r><t>b</t></r></p></tc></tr></tbl></body></document>'))
    (tmp_path / "f.pptx").write_bytes(archive(ppt__slides__slide1="<sld><p><t>Título</t></p><p><t>punto</t></p></sld>", ppt__slides__slide2="<sld/>"))
    files = S.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    readers = {r.name: r.reader for r in files.collect()}
    assert readers == {"a.TXT": "plain", "b.bin": None, "c.csv": "csv", "d.xlsx": "xlsx", "e.docx": "docx", "f.pptx": "pptx"}
    pick = lambda n: files.where(F.col("name") == n)
    assert S.plain(pick("a.TXT")).first().text == "uno\ndos"
    rows = S.csv_rows(pick("c.csv")).orderBy("row").collect()
    assert rows[0].header == ["año", "monto", "col3"] and [r.cells[2] for r in rows] == ["x", "y"]
    cells = S.xlsx_cells(pick("d.xlsx"))
    assert S.uncached_formulas(cells).first().uncached == 1
    tables = S.sheet_tables(cells)
    assert {(r.row, r.table) for r in tables.collect()} == {(1, 0), (2, 0), (4, 1)}
    assert {(r.table, r.row) for r in S.header_rows(tables).collect()} == {(0, 1), (1, 4)}
    assert [(r.level, r.text) for r in S.docx_paragraphs(pick("e.docx")).orderBy("idx").collect()] == [(2, "1.1 Tema"), (0, "Texto"), (0, "a | b")]
    assert [(r.slide, r.title) for r in S.pptx_slides(pick("f.pptx")).collect()] == [(1, "Título")]


def test_windows_fold_in_order_and_columns_are_trimmed(spark):
    texts = ["x" * 700, "y" * 700, "z" * 1300] + ["w"] * 25
    rows = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "table string, row int, text string")
    got = [r.window for r in S.row_windows(rows, ["table"], "row", "text").orderBy("row").collect()]
    assert got == [0, 1, 2, *[3] * 20, *[4] * 5]
    cells = spark.createDataFrame([("p", "s", 0, 1, c, v) for c, v in [(1, None), (2, " "), (3, "a"), (4, None), (5, "b"), (6, "")]], "path string, sheet string, table int, row int, col int, value string")
    assert [(r.col, r.first_col) for r in S.trim_columns(cells).orderBy("col").collect()] == [(3, 3), (4, 3), (5, 3)]


def test_sheets_go_by_relationship(spark):
    sheet = lambda v: f'<worksheet><sheetData><row r="1"><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="one" r:id="rId2"/><sheet name="two" r:id="rId1"/></sheets></workbook>')
        f.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        f.writestr("xl/worksheets/sheet1.xml", sheet(1))
        f.writestr("xl/worksheets/sheet2.xml", sheet(2))
    cells = S.xlsx_cells(spark.createDataFrame([("p", bytearray(z.getvalue()))], "path string, content binary"))
    assert {(r.sheet, r.value) for r in cells.collect()} == {("one", "2"), ("two", "1")}


def test_layout(spark):
    rows = [("b", 1, y, 0.0, t, 100.0) for y, t in [(10.0, "a"), (12.0, "b"), (14.0, "c"), (20.0, "d"), (50.0, "7"), (98.0, "pie")]] + [("b", 2, 10.0, 0.0, "e", 100.0)]
    df = spark.createDataFrame(rows, "path string, page int, y0 double, x0 double, text string, height double")
    assert [r.text for r in S.layout_paragraphs(df).orderBy("para").collect()] == ["a\nb\nc", "d", "e"]
    assert {r.page for r in S.textless_pages(df).collect()} == {1, 2}


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE x\n\n00:00:01.500 --> 00:00:02.000 align:start\n<c>hola</c> &amp;\nmundo\n\n01:00:00.000 --> 01:00:01.000\n\n\n2\n00:05,250 --> 00:06,000\nfin"
    got = S.vtt_cues(spark.createDataFrame([("v", vtt)], "path string, text string")).orderBy("seq").collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(1.5, 2.0, "hola & mundo"), (5.25, 6.0, "fin")]
    item = lambda w, s=None: {"type": "x", "start_time": s, "end_time": s, "alternatives": [{"content": w}]}
    payload = json.dumps({"results": {"items": [item("Hola", "0.5"), item(","), item("tú", "0.9")]}})
    got = S.transcript_words(spark.createDataFrame([("v", payload)], "path string, text string")).orderBy("seq").collect()
    assert [(r.text, r.start_s) for r in got] == [("Hola,", 0.5), ("tú", 0.9)]


def test_videos(spark):
    urls = ["https://www.youtube.com/watch?a=1&v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk?x", "https://youtube.com/shorts/abcdefghijk", "https://youtube.com/playlist?list=abcdefghijk", "https://evil.com/youtu.be/abcdefghijk", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(S.video_id(F.col("u"))).collect()
    assert [r[0] for r in got] == ["abcdefghijk"] * 3 + [None] * 3
    tracks = spark.createDataFrame([("v", "en", "manual", "en", "vtt", 0), ("v", "es", "auto", "es", "vtt", 1), ("v", "es", "auto", "es-orig", "vtt", 2), ("v", "es", "manual", "es", "srt", 3)], "video_id string, lang string, kind string, name string, ext string, position int")
    assert S.choose_track(tracks, ["es", "en"]).first().name == "es-orig"


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams_equal_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = batch.unionByName(batch)
    twice.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = run_stream(spark, Z.ordered_log(stream(), ["event_id"], lateness="1000 days"), "log")
    assert len(got) == batch.count()
    assert len(run_stream(spark, Z.tail(stream(), 10, "event_id"), "tail")) == 2 * batch.where("event_id > 10").count()
    counted = {(r.event_type, r.start): r.events for r in run_stream(spark, Z.windows(stream(), "1 hour", lateness="1000 days"), "win", "complete")}
    want = {(r.event_type, r.start): r.events for r in Z.windows(twice, "1 hour").collect()}
    assert counted == want
    gaps = {(r.user_id, r.start): r.events for r in Z.sessions(batch, "user_id", "2 hours").collect()}
    assert sum(gaps.values()) == batch.count()
    runs = batch.select("user_id").distinct().limit(3)
    assert len(run_stream(spark, Z.attach_runs(stream(), runs, "user_id"), "runs")) == twice.join(runs, "user_id").count()


class Reader(HTMLParser):
    """Text outside scripts and styles, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.said, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.said.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.said.append(" ")

    def handle_comment(self, data):
        self.said.append(" ")

    def handle_data(self, data):
        self.said.append("" if self.hidden else data)


def test_page_text(spark, sf):
    rows = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect() if r.html]
    rows += ["<p>a &lt;b&gt; &amp;amp; c</p><script>var x = '<p>no</p>';</script><!-- <i>no</i> -->d<style>p{}</style>\n\n e", "", "plain"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(rows)), "i int, h string").select("i", S.page_text(F.col("h")).alias("t")).orderBy("i").collect()]
    for page, text in zip(rows, got, strict=True):
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert text == re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(reader.said).replace("\xa0", " ")).strip(" ")
