"""Documents from files: format dispatch and one small reader per format.

Every reader starts from ``spark.read.format("binaryFile")`` rows (path, content) and returns
long DataFrames; zip-and-XML formats are unpacked row by row with the standard library.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffix -> reader, table window sizes and layout thresholds.
FORMATS = {"pdf": "pdf", "txt": "plain", "md": "plain", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx", "csv": "csv"}
WINDOW_ROWS, WINDOW_CHARS, HEADER_TEXT_SHARE, HEADER_DEPTH = 20, 1200, 0.6, 10
SNIFF_CHARS = 16 << 10
FOOTER_SHARE, GAP_FACTOR, TEXTLESS_CHARS = 0.06, 1.5, 40
VIDEO_ID = r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|live/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})(?:[?&#/]|$)"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256, bytes and reader of every file; reader is null if unsupported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    reader = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[suffix]
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), reader.alias("reader"))


def plain(files: DataFrame) -> DataFrame:
    """path and text; line ends become \\n."""
    return files.select("path", F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n").alias("text"))


def csv_rows(files: DataFrame) -> DataFrame:
    """path, window, row, header and cells of CSV files.

    Encodings are tried in order of strictness; delimiter and header are sniffed from the
    first 16 KiB (else: the most frequent candidate of the first line, and a header); blank
    rows go, missing names become ``colN``; windows hold 20 rows.
    """
    import csv

    def sniff(text):
        sample, first = text[:SNIFF_CHARS], text.split("\n", 1)[0]
        try:
            sep = csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
        except csv.Error:
            sep = max(",;\t|", key=first.count)
        held = "\n".join(line for line in sample.splitlines() if line.strip(sep + " "))
        try:
            return sep, csv.Sniffer().has_header(held)
        except (csv.Error, StopIteration):
            return sep, True

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for enc in ("utf-8-sig", "cp1252", "latin-1"):
                    try:
                        text = bytes(content).decode(enc)
                        break
                    except UnicodeDecodeError:
                        continue
                sep, named = sniff(text)
                rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if any(c.strip() for c in r)]
                if rows:
                    names = [(c.strip() if named else "") or f"col{i}" for i, c in enumerate(rows[0], 1)]
                    out += [(path, i // WINDOW_ROWS, i, names, r) for i, r in enumerate(rows[named:])]
            yield pd.DataFrame(out, columns=["path", "window", "row", "header", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, window int, row int, header array<string>, cells array<string>")


_NS = re.compile(r"\{[^}]*\}")


def _xml(archive: zipfile.ZipFile, name: str):
    root = ElementTree.fromstring(archive.read(name))
    for e in root.iter():
        e.tag = _NS.sub("", e.tag)
        e.attrib = {_NS.sub("", k): v for k, v in e.attrib.items()}
    return root


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, value, is_formula; merged areas repeat their first value."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    shared = ["".join(t.text or "" for t in si.iter("t")) for si in _xml(z, "xl/sharedStrings.xml").iter("si")]
                rels = "xl/_rels/workbook.xml.rels"
                parts = {r.get("Id"): "xl/" + r.get("Target").removeprefix("/xl/") for r in _xml(z, rels).iter("Relationship")} if rels in z.namelist() else {}
                for i, sheet in enumerate(_xml(z, "xl/workbook.xml").iter("sheet"), 1):
                    # The sheet's relationship names its part; files without relationships go by position.
                    root, grid = _xml(z, parts.get(sheet.get("id"), f"xl/worksheets/sheet{i}.xml")), {}
                    for c in root.iter("c"):
                        v = c.find("v")
                        raw = v.text if v is not None else "".join(t.text or "" for t in c.iter("t")) or None
                        value = shared[int(raw)] if c.get("t") == "s" and raw is not None else raw
                        grid[int(re.search(r"\d+", c.get("r"))[0]), _column(c.get("r"))] = (value, c.find("f") is not None)
                    for m in root.iter("mergeCell"):
                        a, b = m.get("ref").split(":")
                        (r0, c0), (r1, c1) = [(int(re.search(r"\d+", x)[0]), _column(x)) for x in (a, b)]
                        for r in range(r0, r1 + 1):
                            for col in range(c0, c1 + 1):
                                grid[r, col] = grid.get((r0, c0), (None, False))
                    out += [(path, sheet.get("name"), r, c, v, f) for (r, c), (v, f) in sorted(grid.items())]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "value", "is_formula"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, col int, value string, is_formula boolean")


def uncached_formulas(cells: DataFrame) -> DataFrame:
    """Formulas without a stored value, by sheet: data that reading would silently lose."""
    return cells.groupBy("path", "sheet").agg(F.count_if(F.col("is_formula") & F.col("value").isNull()).alias("uncached"))


def sheet_tables(cells: DataFrame) -> DataFrame:
    """Cells with ``table``: blank rows part the tables of a sheet."""
    rows = cells.where(F.trim("value") != "").groupBy("path", "sheet", "row").agg(F.count("*").alias("n"))
    w = Window.partitionBy("path", "sheet").orderBy("row")
    cut = F.coalesce((F.col("row") - F.lag("row").over(w) > 1).cast("int"), F.lit(0))
    tables = rows.withColumn("_cut", cut).withColumn("table", F.sum("_cut").over(w).cast("int"))
    return cells.join(tables.select("path", "sheet", "row", "table"), ["path", "sheet", "row"])


def header_rows(tables: DataFrame) -> DataFrame:
    """Leading rows of each table that are mostly text: its header."""
    text = (~F.coalesce(F.regexp_replace("value", "[,%]", "").try_cast("double").isNotNull(), F.lit(False))).cast("int")
    w = Window.partitionBy("path", "sheet", "table").orderBy("row")
    share = tables.where("value is not null").groupBy("path", "sheet", "table", "row").agg(F.avg(text).alias("share"))
    ranked = share.withColumn("k", F.row_number().over(w)).withColumn("bad", F.sum((F.col("share") < HEADER_TEXT_SHARE).cast("int")).over(w))
    return ranked.where((F.col("bad") == 0) & (F.col("k") <= HEADER_DEPTH)).select("path", "sheet", "table", "row")


def trim_columns(tables: DataFrame) -> DataFrame:
    """Cells between the first and last column of their table that hold anything, with ``first_col`` (from 1)."""
    w = Window.partitionBy("path", "sheet", "table")
    held = F.when(F.coalesce(F.trim("value"), F.lit("")) != "", F.col("col"))
    placed = tables.withColumn("first_col", F.min(held).over(w)).withColumn("_last", F.max(held).over(w))
    return placed.where((F.col("col") >= F.col("first_col")) & (F.col("col") <= F.col("_last"))).drop("_last")


def row_windows(rows: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Rows with ``window``, from 0: up to 20 rows and 1200 characters, or one longer row.

    A window that is cut early is followed by the next row, and its count starts anew, so no
    row is skipped; where one ends depends on all before it, so a table is folded in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, text], kind="stable")
        out, window, n, size = [], 0, 0, 0
        for value in pdf[text]:
            chars = len(value or "")
            if n and (n == WINDOW_ROWS or size + chars > WINDOW_CHARS):
                window, n, size = window + 1, 0, 0
            n, size = n + 1, size + chars
            out.append(window)
        return pdf.assign(window=pd.Series(out, index=pdf.index, dtype="int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", window int"
    return rows.groupBy(*key).applyInPandas(run, schema)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """path, idx, level, text of Word documents.

    Headings without a number get a dotted one by their place. Tables come after all
    paragraphs, each row as ``name: value | name: value`` by the table's first row.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                body = _xml(zipfile.ZipFile(io.BytesIO(bytes(content))), "word/document.xml").find("body")
                say = lambda e: "".join(t.text or "" for t in e.iter("t")).strip()
                found, counts = [], []
                for p in body.findall("p"):
                    style = next((s.get("val", "") for s in p.iter("pStyle")), "")
                    match, body_text = re.search(r"(?:Heading|Ttulo|Título)\s*(\d)", style), say(p)
                    level = int(match[1]) if match else 0
                    if level and body_text:
                        counts = [*counts[:level], *[0] * (level - len(counts))]
                        counts[level - 1] += 1
                        if not re.match(r"\d+(\.\d+)*\.?\s", body_text):
                            body_text = ".".join(str(n or 1) for n in counts) + " " + body_text
                    found.append((level, body_text))
                for t in body.findall("tbl"):
                    names, *rest = [[say(c) for c in r.findall("tc")] for r in t.findall("tr")] or [[]]
                    found += [(0, " | ".join(f"{n}: {v}" for n, v in zip(names, r, strict=False))) for r in rest] or [(0, " | ".join(names))]
                out += [(path, i, lv, tx) for i, (lv, tx) in enumerate(x for x in found if x[1])]
            yield pd.DataFrame(out, columns=["path", "idx", "level", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, idx int, level int, text string")


def pptx_slides(files: DataFrame) -> DataFrame:
    """path, slide, title, text of presentations; empty slides are skipped."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
                for name in sorted(names, key=lambda n: int(re.search(r"(\d+)\.xml", n)[1])):
                    n = int(re.search(r"(\d+)\.xml", name)[1])
                    lines = ["".join(t.text or "" for t in p.iter("t")) for p in _xml(z, name).iter("p")]
                    notes = f"ppt/notesSlides/notesSlide{n}.xml"
                    if notes in z.namelist():
                        lines += ["".join(t.text or "" for t in p.iter("t")) for p in _xml(z, notes).iter("p")]
                    lines = [x.strip() for x in lines if x.strip()]
                    if lines:
                        out.append((path, n, lines[0], "\n".join(lines)))
            yield pd.DataFrame(out, columns=["path", "slide", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, slide int, title string, text string")


def layout_paragraphs(rows: DataFrame, height: str = "height") -> DataFrame:
    """Paragraphs from layout rows (path, page, y0, x0, text, height).

    Footer zone and bare page numbers go; a pitch above 1.5 times the page's upper median, or
    the end of a page, closes a paragraph.
    """
    from quillspan.functions.text import upper_median

    kept = rows.where((F.col("y0") < F.col(height) * (1 - FOOTER_SHARE)) & ~F.col("text").rlike(r"^\s*\d{1,4}\s*$"))
    page = Window.partitionBy("path", "page").orderBy("y0", "x0")
    book = Window.partitionBy("path").orderBy("page", "y0", "x0")
    pitched = kept.withColumn("pitch", F.col("y0") - F.lag("y0").over(page))
    medians = pitched.where("pitch is not null").groupBy("path", "page").agg(upper_median(F.collect_list("pitch")).alias("median"))  # one page of lines
    new = F.col("pitch").isNull() | (F.col("pitch") > GAP_FACTOR * F.col("median"))
    p = pitched.join(medians, ["path", "page"], "left").withColumn("para", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(book) - 1)
    return p.groupBy("path", "para").agg(F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "text"))), lambda r: r["text"]), "\n").alias("text"))


def textless_pages(rows: DataFrame) -> DataFrame:
    """Pages with fewer than 40 characters: candidates for recognition."""
    return rows.groupBy("path", "page").agg(F.sum(F.char_length(F.trim("text"))).alias("chars")).where(F.col("chars") < TEXTLESS_CHARS)


def _seconds(stamp: Column) -> Column:
    part = lambda i: F.regexp_extract(stamp, r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)", i)
    return F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + F.concat(F.lit("0."), part(4)).cast("double")


def vtt_cues(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, seq, start_s, end_s, text of WebVTT and SRT; markup goes, empty cues are dropped."""
    blocks = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n")).alias("seq", "b")).where(F.col("b").contains("-->"))
    timing = F.regexp_extract("b", r"(?m)^(.*-->.*)$", 1)
    body = F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]*>", "")
    for name, sign in ENTITIES:
        body = F.replace(body, F.lit(name), F.lit(sign))
    said = F.trim(F.regexp_replace(body, r"\s+", " "))
    return blocks.select(key, "seq", _seconds(F.split(timing, "-->")[0]).alias("start_s"), _seconds(F.split(timing, "-->")[1]).alias("end_s"), said.alias("text")).where("text <> ''")


def transcript_words(payloads: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, seq, start_s, end_s, text: one cue a word, punctuation joined to the word before."""
    item = "struct<type:string,start_time:string,end_time:string,alternatives:array<struct<content:string>>>"
    items = payloads.select(key, F.posexplode(F.from_json(text, f"results struct<items:array<{item}>>").results.items).alias("i", "it"))
    w = Window.partitionBy(key).orderBy("i")
    timed = items.select(key, "i", F.col("it.start_time").cast("double").alias("s"), F.col("it.end_time").cast("double").alias("e"), F.col("it.alternatives")[0]["content"].alias("word"))
    grouped = timed.withColumn("seq", F.sum(F.col("s").isNotNull().cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda r: r["word"])
    return grouped.groupBy(key, "seq").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.array_join(parts, "").alias("text"))


def video_id(url: Column) -> Column:
    """11-character id of a supported video url; null for playlists, channels and other hosts."""
    found = F.regexp_extract(url, VIDEO_ID, 1)
    host = F.regexp_extract(url, r"^https?://(?:www\.|m\.)?([^/]+)", 1)
    return F.when(host.isin("youtube.com", "youtu.be") & (found != ""), found)


def choose_track(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """One VTT caption track for each video: language order, manual before automatic, originals first."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("lang")), F.lit(0))
    rank = F.when(order == 0, len(preferred) + 1).otherwise(order)
    w = Window.partitionBy("video_id").orderBy(rank, F.col("kind") != "manual", ~F.col("name").endswith("-orig"), "position")
    return tracks.where("ext = 'vtt'").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# The entities that are read; the ampersand's own comes last, so that nothing is read twice.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&iquest;", "¿"), ("&iexcl;", "¡"), ("&amp;", "&"),
)


def page_text(page: Column) -> Column:
    """Readable text of an HTML page: scripts, styles, comments and tags out."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unescape(text: str) -> str:
    """All HTML entities, for small driver-side values."""
    return html.unescape(text)
