"""Paragraphs, headings, kinds and chunks with exact byte spans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in bytes, caps in characters.
TARGET, HARD_CAP, OVERLAP, SHORTEST, EMBED_CAP = 1200, 2000, 150, 40, 2600
LEVEL1_CAP, LEVEL2_CAP, MARK_DENSITY, MIN_MARKS = 40, 120, 300, 2
# Patterns that tell headings, questions and notes apart.
HEADING = r"^\d+(\.\d+)*\.?\s+[\p{L}\p{N}_]"
LEADERS = r"(\.\s?){5,}"
ENDNOTE = r"(?i)\b(ib[ií]d(em)?\b|[ií]dem\b|op\.\s*cit|loc\.\s*cit|pp?\.\s*\d)"
CITATION_TAIL = r",\s*\d"
LOWER_TITLE = r"^\d+(\.\d+)*\.?\s+\p{Ll}"
NUMBERED = r"^\d+\.\s"
FOOTNOTE = r"^\d+\s"
IMPERATIVE = r"(?i)\b(defina|define|señale|senale|explique|mencione|indique|analice|compare|justifique|describa|enumere|argumente|comente|responda|complete)\b"
ABBREVIATIONS = """
gén gen ex lev núm dt sal pr ecl is jer ez mt mr mc lc jn ro co gá ef fil col
ts ti heb stg ap cf cfr etc p pp cap vol ed eds trad op cit ibid vs sr sra dr
dra st sta núms art fig no nro sig ss aa vv a d c
""".split()
#: White space as the expressions mean it.
BLANKS = " \t\n\x0b\f\r"
KIND_BODY, KIND_QUESTIONS, KIND_NOTE = "cuerpo", "preguntas", "nota"


def batches_of(rows, schema, most: int = 4096):
    """Record batches of up to ``most`` of the tuples that ``rows`` yields."""
    out: list[tuple] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pack()
            out = []
    if out:
        yield pack()


def split_paragraphs(text: str, delimiter: str):
    """(offset in bytes, text) of the paragraphs of a text, trimmed; blank ones are passed over."""
    at, step = 0, len(delimiter.encode())
    for raw in text.split(delimiter):
        body = raw.strip(BLANKS)
        if body:
            lead = len(raw) - len(raw.lstrip(BLANKS))
            yield at + len(raw[:lead].encode()), body
        at += len(raw.encode()) + step


def paragraphs(docs: DataFrame, delimiter: str = "\n\n", id_col: str = "doc_id", text_col: str = "text", also: tuple = (), whole: str | None = None) -> DataFrame:
    """id, idx, offset (bytes of the trimmed paragraph), text; blank paragraphs are dropped.

    One pass over each text, in the row, without a shuffle; a document's paragraphs stay
    together and in order. Columns named in ``also`` are repeated beside each paragraph; with
    ``whole`` a column of that name holds the document's text in its first row and null in
    others.
    """
    typed = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    kinds = ", ".join([typed(id_col), "idx int, offset int, text string", *map(typed, also), *([f"`{whole}` string"] if whole else [])])
    names = [id_col, "idx", "offset", "text", *also, *([whole] if whole else [])]

    def run(batches):
        for batch in batches:
            given = [batch.schema.field(i).type for i in range(batch.num_columns)]
            kind = pa.schema(list(zip(names, [given[0], pa.int32(), pa.int32(), pa.string(), *given[2:], *([pa.string()] if whole else [])], strict=True)))

            def rows(batch=batch):
                for key, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if text is not None:
                        for i, (offset, body) in enumerate(split_paragraphs(text, delimiter)):
                            yield (key, i, offset, body, *rest, *([None if i else text] if whole else []))

            yield from batches_of(rows(), kind)

    return docs.select(id_col, F.col(text_col), *also).mapInArrow(run, kinds)


def in_sequence(rows: DataFrame, key: str, order: list[str], schema: str, step) -> DataFrame:
    """Rows that ``step(key, rows)`` makes from each key's rows in order, one at a time.

    ``rows``: its first column is ``key``. Each key's rows are streamed in their order past
    ``step``, which may hold what it must, so that no key is gathered in memory.
    """
    fields = [f.strip() for f in schema.split(",")]
    names = [f.rpartition(" ")[0].strip("`") for f in fields]
    plain = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        types = {first.schema.field(i).name: first.schema.field(i).type for i in range(first.num_columns)}
        kind = pa.schema([(n, types[n] if n in types else plain[f.rpartition(" ")[2]]) for n, f in zip(names, fields, strict=True)])
        stream = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from batches_of((made for k, mine in groupby(stream, key=itemgetter(0)) for made in step(k, mine)), kind)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def is_endnote(text: Column) -> Column:
    """Whether a line reads as a citation."""
    return text.rlike(ENDNOTE) | (text.rlike(CITATION_TAIL) & F.regexp_replace(text, r"\s+$", "").endswith("."))


def is_question(text: Column) -> Column:
    """Whether a line asks or instructs."""
    return text.contains("¿") | text.contains("?") | text.rlike(IMPERATIVE)


def _starts(text: Column, pattern) -> Column:
    """Whether a text starts with a pattern, given as a string or a column; no pattern fits nothing."""
    if not isinstance(pattern, Column):
        return text.rlike(f"^(?:{pattern})")
    return F.coalesce(F.regexp_like(text, F.concat(F.lit("^(?:"), pattern, F.lit(")"))), F.lit(False))


def heading_level(text: Column, level1=None, level2=None, caps: tuple = (LEVEL1_CAP, LEVEL2_CAP), flat: int | None = None) -> Column:
    """Depth of a numbered heading, or of a learned pattern; 0 for anything else.

    Patterns may be strings or columns (null: none), caps numbers or columns; a cap of 0 turns
    its level off. With ``flat``, numbered headings of any depth are of level 1, up to that many
    characters; the caps hold for learned patterns alone then.
    """
    count = lambda rx: F.char_length(text) - F.char_length(F.regexp_replace(text, rx, ""))
    prefix = F.regexp_replace(F.regexp_extract(text, r"^(\S+)", 1), r"\.+$", "")
    depth = F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit("."), F.lit(""))) + 1
    most1, most2 = (c if isinstance(c, Column) else F.lit(c) for c in caps)
    cap = F.when(depth == 1, most1).otherwise(most2) if flat is None else F.lit(flat)
    out = F.when(text.rlike(LEADERS) | is_question(text) | is_endnote(text), 0)
    for pattern, level, most in ((level1, 1, most1), (level2, 2, most2)):
        if pattern is not None:
            out = out.when(_starts(text, pattern), F.when(F.char_length(text) <= most, level).otherwise(0))
    wrong = ~text.rlike(HEADING) | (count(r"\p{Nd}") > count(r"\p{L}")) | text.rlike(LOWER_TITLE) | (F.char_length(text) > cap)
    return out.when(wrong, 0).otherwise(depth if flat is None else 1)


def kind(text: Column, level: Column | None = None, question=None, footnote=None, cite: bool = True) -> Column:
    """Body, review questions or footnote, for a paragraph; learned patterns come before the rules.

    ``level``: the paragraph's heading level, where it is known already. Numbered paragraphs
    that cite are notes; without ``cite`` all numbered ones are questions.
    """
    marks = F.char_length(text) - F.char_length(F.replace(text, F.lit("¿"), F.lit("")))
    dense = (marks > 0) & (marks * MARK_DENSITY >= F.octet_length(text)) & ((marks >= MIN_MARKS) | text.rlike(r"(?m)^\d+\.\s"))
    cited = text.rlike(ENDNOTE) | (is_endnote(text) & ~is_question(text))
    out = F.when((heading_level(text) if level is None else level) > 0, KIND_BODY)
    for pattern, name in ((question, KIND_QUESTIONS), (footnote, KIND_NOTE)):
        if pattern is not None:
            out = out.when(_starts(text, pattern), name)
    return (
        out.when(text.rlike(LEADERS), KIND_BODY)
        .when(text.rlike(NUMBERED), F.when(cited & F.lit(cite), KIND_NOTE).otherwise(KIND_QUESTIONS))
        .when(dense, KIND_QUESTIONS).when(text.rlike(FOOTNOTE), KIND_NOTE).otherwise(KIND_BODY)
    )


def chapters(paras: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Paragraphs with level, kind, and the chapter carried forward from level-1 headings."""
    w = Window.partitionBy(id_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    p = paras.withColumn("level", heading_level(F.col("text"))).withColumn("kind", kind(F.col("text")))
    return p.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("text")), ignorenulls=True).over(w))


# The end of a sentence, and what the next one opens with.
_BOUNDARY = re.compile(r"[.!?][\"»'”’)\]]*\s+")
_OPENERS = "ÁÉÍÓÚÜÑ¿«—“\"'("


def sentences(text: str) -> list[str]:
    """Sentences of a text, with the white space that follows each; they join to the text.

    A boundary needs an opening character behind it, and before it no known abbreviation.
    """
    out, begin = [], 0
    for m in _BOUNDARY.finditer(text):
        following = text[m.end() : m.end() + 1]
        before = re.search(r"(\w+)$", text[begin : m.start()])
        short = text[m.start()] == "." and before and before[1].lower() in ABBREVIATIONS
        if not short and (not following or following.isupper() or following.isdigit() or following in _OPENERS):
            out.append(text[begin : m.end()])
            begin = m.end()
    return out + [text[begin:]] * (begin < len(text))


@dataclass
class _Chunk:
    kind: str
    chapter: str
    section: str
    begin: int
    end: int
    first: int
    last: int
    overlap: str = ""


def _units(par: tuple) -> list[tuple[int, int, int]]:
    """(paragraph, begin, end) byte pieces of a paragraph, none above the cap where avoidable."""
    idx, offset, text = par
    if len(text.encode()) <= HARD_CAP:
        return [(idx, offset, offset + len(text.encode()))]
    atoms: list[int] = []
    for s in sentences(text):
        atoms += [len(s.encode())] if len(s.encode()) <= HARD_CAP else [len(w.encode()) for w in re.findall(r"\S+\s*|\s+", s)]
    out, begin, size = [], offset, 0
    for n in atoms:
        if size and size + n > HARD_CAP:
            out.append((idx, begin, begin + size))
            begin, size = begin + size, 0
        size += n
    return out + [(idx, begin, begin + size)] * (size > 0)


def _tail(text: str) -> str:
    """Last whole sentences, or words, that fit the overlap."""
    for parts in (sentences(text), re.findall(r"\S+\s*", text)):
        size, kept = 0, []
        for s in reversed(parts):
            size += len(s.encode())
            if size > OVERLAP:
                break
            kept.append(s)
        if kept:
            return "".join(reversed(kept)).strip()
    return ""


def pack(text: str, paras: list[tuple]) -> list[dict]:
    """Chunks of one document from (idx, offset, text, level, kind) paragraphs in order.

    Headings and changes of kind end a run. A run is packed greedily to the target size under
    the cap; what is too short rides forward, or joins its predecessor in the run, or is
    dropped where there is none.
    """
    raw = text.encode()
    decode = lambda a, b: raw[a:b].decode(errors="replace").strip()
    runs: list[dict] = []
    chapter, path, closed = "", [], True
    for idx, offset, body, level, k in paras:
        if level > 0:
            closed = True
            if level == 1:
                chapter, path = body, []
            else:
                path = path[: level - 2] + [body]
            continue
        changed = not runs or runs[-1]["kind"] != k
        if changed and k == KIND_QUESTIONS:
            path = []
        if closed or changed:
            runs.append({"kind": k, "chapter": chapter, "section": " > ".join(path), "paras": []})
            closed = False
        runs[-1]["paras"].append((idx, offset, body))
    out: list[_Chunk] = []
    for run in runs:
        mine: list[_Chunk] = []
        groups: list[list[tuple]] = []
        size = 0
        for unit in (u for p in run["paras"] for u in _units(p)):
            n = unit[2] - unit[1]
            over = size + 2 + n
            if not groups or (over > TARGET and (size >= SHORTEST or over > HARD_CAP)):
                groups.append([])
                size = -2
            groups[-1].append(unit)
            size += n + 2
        for g in groups:
            c = _Chunk(run["kind"], run["chapter"], run["section"], g[0][1], g[-1][2], g[0][0], g[-1][0])
            body = decode(c.begin, c.end)
            crumb = " > ".join(x for x in (c.chapter, c.section) if x)
            if len(body.encode()) < SHORTEST:
                if mine and len(decode(mine[-1].begin, c.end).encode()) <= HARD_CAP:
                    mine[-1].end, mine[-1].last = c.end, c.last
                    if len(crumb) + len(mine[-1].overlap) + len(decode(mine[-1].begin, c.end)) + 10 > EMBED_CAP:
                        mine[-1].overlap = ""
                continue
            if mine:
                tail = _tail(decode(mine[-1].begin, mine[-1].end))
                if len(crumb) + len(tail) + len(body) + 10 <= EMBED_CAP:
                    c.overlap = tail
            mine.append(c)
        out += mine
    return [
        {"index": i, "kind": c.kind, "chapter": c.chapter, "section": c.section, "text": decode(c.begin, c.end), "char_from": c.begin, "char_to": c.end, "para_from": c.first, "para_to": c.last, "overlap": c.overlap}
        for i, c in enumerate(out)
    ]


CHUNK_SCHEMA = "index int, kind string, chapter string, section string, text string, char_from int, char_to int, para_from int, para_to int, overlap string"


def packed(paras: DataFrame, id_col: str = "doc_id", whole: str = "_whole") -> DataFrame:
    """Chunks of paragraphs (id, offset, text, level, kind and ``whole``) that lie in order.

    Only the greedy packing, which SQL windows can't express, runs in Python, on one document
    at a time and without a shuffle.
    """
    fields = [c.split(" ")[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches):
        kind_ = None

        def rows():
            nonlocal kind_
            key, text, held = None, None, []
            for batch in batches:
                kind_ = kind_ or pa.schema([(id_col, batch.schema.field(0).type), *((n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split(" ") for c in CHUNK_SCHEMA.split(", ")))])
                for k, idx, offset, body, level, name, document in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if document is not None:  # the first paragraph of the next document
                        yield from ((key, *(c[f] for f in fields)) for c in pack(text, held)) if held else ()
                        key, text, held = k, document, []
                    held.append((idx, offset, body, level, name))
            if held:
                yield from ((key, *(c[f] for f in fields)) for c in pack(text, held))

        made = rows()
        first = next(made, None)
        if first is not None:
            yield from batches_of(chain([first], made), kind_)

    ready = paras.select(id_col, "idx", "offset", "text", "level", "kind", whole)
    return ready.mapInArrow(run, f"`{id_col}` {paras.schema[id_col].dataType.simpleString()}, {CHUNK_SCHEMA}")


def chunks(docs: DataFrame, delimiter: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of every document by the built-in rules; levels and kinds are flat columns."""
    p = paragraphs(docs, delimiter, id_col, text_col, whole="_whole").withColumn("level", heading_level(F.col("text")))
    return packed(p.withColumn("kind", kind(F.col("text"), F.col("level"))), id_col)


# The kind of every chunk of a transcript, and the names of a profile's learned rules.
KIND_TRANSCRIPT = "transcripcion"
RULES = ("heading_l1_pattern", "heading_l2_pattern", "question_pattern", "footnote_pattern")
CAPS = {"heading_l1_max": LEVEL1_CAP, "heading_l2_max": LEVEL2_CAP}


def learned_paragraphs(docs: DataFrame, profiles: DataFrame, delimiter: str = "\n\n", id_col: str = "doc_id", text_col: str = "text", flat: int | None = None, cite: bool = True) -> DataFrame:
    """Paragraphs with level and kind by the rules of each document's profile.

    ``docs``: id, text, fingerprint; ``profiles``: fingerprint, learned_at, RULES and CAPS,
    any of them null. The newest profile of a fingerprint counts. A pattern is matched at the
    start of a paragraph, the kind patterns after headings and before the built-in rules,
    which hold wherever a document has no profile or its profile no such rule. ``flat`` and
    ``cite`` bound those, as in :func:`heading_level` and :func:`kind`.
    """
    rules = F.struct(*RULES, *CAPS)
    newest = profiles.groupBy("fingerprint").agg(F.max_by(rules, F.struct("learned_at", rules)).alias("rules")).select("fingerprint", "rules.*")
    ruled = docs.join(newest, "fingerprint", "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in CAPS.items()})
    p = paragraphs(ruled, delimiter, id_col, text_col, also=(*RULES, *CAPS), whole="_whole")
    p = p.withColumn("level", heading_level(F.col("text"), F.col(RULES[0]), F.col(RULES[1]), tuple(F.col(c) for c in CAPS), flat))
    return p.withColumn("kind", kind(F.col("text"), F.col("level"), F.col(RULES[2]), F.col(RULES[3]), cite))


def learned_chunks(docs: DataFrame, profiles: DataFrame, delimiter: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks by each document's learned rules; a change of kind ends a chunk, whoever decides it."""
    return packed(learned_paragraphs(docs, profiles, delimiter, id_col, text_col), id_col)


def transcript_chunks(videos: DataFrame, times: DataFrame, delimiter: str = "\n\n", key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with start_s and end_s, report) of timed transcripts.

    ``videos``: key, corrected, original; ``times``: key, idx, start_s, end_s, one row a
    paragraph. The corrected text counts where it has as many paragraphs as the times, else
    the original; where neither has, the video is left out, for a wrong time is worse than
    none. Transcripts have no headings, and all chunks one kind. The report has each video's
    ``stream`` (corrected, original or null), both counts of paragraphs, the timed ones, and
    ``uncovered``, those that no chunk covers.
    """
    count = lambda c: F.coalesce(F.size(F.filter(F.split(F.col(c), "\\Q" + delimiter + "\\E"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "") != "")), F.lit(0))
    timed = times.groupBy(key).agg(F.count("*").cast("int").alias("timed"))
    j = videos.join(timed, key, "left").withColumns({"timed": F.coalesce("timed", F.lit(0)), "n_corrected": count("corrected"), "n_original": count("original")})
    fits = lambda c: F.col(c).isNotNull() & (F.col(f"n_{c}") == F.col("timed")) & (F.col("timed") > 0)
    j = j.withColumn("stream", F.when(fits("corrected"), "corrected").when(fits("original"), "original"))
    chosen = j.where("stream is not null").select(key, F.when(F.col("stream") == "corrected", F.col("corrected")).otherwise(F.col("original")).alias("text"))
    p = paragraphs(chosen, delimiter, key, whole="_whole").withColumns({"level": F.lit(0), "kind": F.lit(KIND_TRANSCRIPT)})
    made = packed(p, key)
    first = times.select(key, F.col("idx").alias("para_from"), "start_s")
    last = times.select(key, F.col("idx").alias("para_to"), "end_s")
    spoken = made.join(first, [key, "para_from"]).join(last, [key, "para_to"]).select(*made.columns, "start_s", "end_s")
    covered = made.select(key, F.explode(F.sequence("para_from", "para_to")).alias("idx")).distinct().groupBy(key).agg(F.count("*").cast("int").alias("_covered"))
    report = j.join(covered, key, "left").select(key, "stream", "n_corrected", "n_original", "timed", F.when(F.col("stream").isNotNull(), F.col("timed") - F.coalesce("_covered", F.lit(0))).alias("uncovered"))
    return spoken, report


def verify_spans(chunked: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks with ``matches``: whether the bytes of the span, trimmed, are the chunk's text."""
    j = chunked.join(docs.select(id_col, F.encode(text_col, "UTF-8").alias("_raw")), id_col)
    piece = F.try_validate_utf8(F.expr("substring(_raw, char_from + 1, char_to - char_from)").cast("string"))
    return j.withColumn("matches", F.coalesce(F.regexp_replace(piece, r"^\s+|\s+$", "") == F.col("text"), F.lit(False))).drop("_raw")


def breadcrumb(chapter: Column, section: Column) -> Column:
    """Chapter and section joined; blank parts are left out."""
    return F.concat_ws(" > ", F.nullif(chapter, F.lit("")), F.nullif(section, F.lit("")))


def embed_text(chapter: Column, section: Column, overlap: Column, text: Column) -> Column:
    """What is embedded: breadcrumb, overlap and text, by blank lines."""
    crumb = F.nullif(breadcrumb(chapter, section), F.lit(""))
    return F.concat_ws("\n\n", crumb, F.when(overlap != "", F.concat(F.lit("[…] "), overlap)), text)


def drop_rolling(cues: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Cues without the words that repeat the end of the cue emitted before.

    Each cue's longest word prefix that equals the end of the last kept cue goes; a key's cues
    are streamed in sequence, and only the last kept one is held.
    """

    def step(k, rows):
        last: list[str] = []
        for _, at, said in rows:
            words = (said or "").split()
            n = next((n for n in range(min(len(words), len(last)), 0, -1) if last[-n:] == words[:n]), 0)
            if words[n:]:
                last = words
                yield k, at, " ".join(words[n:])

    schema = ", ".join(f"`{c}` {cues.schema[c].dataType.simpleString()}" for c in (key, order, text))
    return in_sequence(cues.select(key, order, text), key, [order, text], schema, step)


def gap_sessions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Events with ``session``: numbered from 0 within the key, a new one after every gap."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    at = F.col(ts).cast("timestamp")
    gap = F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)
    return events.withColumn("_new", F.coalesce((gap > int(gap_seconds * 1e6)).cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def group_cues(cues: DataFrame, key: str, target: int = 400, cap: int = 900, max_gap: float = 2.0) -> DataFrame:
    """Timed paragraphs from cues (key, seq, start_s, end_s, text).

    A paragraph ends before a gap, at a sentence end once it has ``target`` characters, or
    before it would exceed ``cap``.
    """

    def step(k, rows):
        held, para = None, 0
        for _, _, start, end, said in rows:
            if held and (start - held[1] > max_gap or len(held[2]) + 1 + len(said) > cap):
                yield (k, para, *held)
                held, para = None, para + 1
            held = (start, end, said, 1) if held is None else (held[0], end, f"{held[2]} {said}", held[3] + 1)
            if len(held[2]) >= target and held[2][-1:] in ".!?":
                yield (k, para, *held)
                held, para = None, para + 1
        if held:
            yield (k, para, *held)

    kind_ = cues.schema[key].dataType.simpleString()
    rows = cues.select(key, "seq", F.col("start_s").cast("double"), F.col("end_s").cast("double"), F.coalesce("text", F.lit("")).alias("text"))
    return in_sequence(rows, key, ["start_s", "seq"], f"`{key}` {kind_}, para int, start_s double, end_s double, text string, cues int", step)
