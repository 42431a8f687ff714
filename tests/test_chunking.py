import random

from pyspark.sql import functions as F

from quillspan.operators import chunking as C

KINDS = [
    ("2.1.1 Título de sección", "cuerpo", 3), ("1. Introducción", "preguntas", 1), ("11. Defina Arrianismo", "preguntas", 0), ("53 La palabra “nihilismo”", "nota", 1),
    ("1. Lazos familiares.. . . . 11", "cuerpo", 0), ("2. Ibídem.", "nota", 0), ("1. Tácito, Anales, 15, 44.", "nota", 0), ("12 13 14 15 16 v6 5 4 3 2 1", "nota", 0),
    ("1.\t la María humana,", "preguntas", 0), ("Freud\n27. ¿Hasta dónde llega?", "preguntas", 0), ("Prosa corriente sin números.", "cuerpo", 0), ("¿Quién? ¿Cuándo?", "preguntas", 0),
]


def test_headings_and_kinds(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in KINDS], "t string").select("t", C.heading_level(F.col("t")).alias("level"), C.kind(F.col("t")).alias("kind")).collect()
    for (text, kind, level), r in zip(KINDS, rows, strict=True):
        assert r.level == level, (text, r)
        if level == 0:
            assert r.kind == kind, (text, r)


def book(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrstdcñá") for _ in range(rnd.randint(2, 9)))
    sentence = lambda n: (" ".join(word() for _ in range(n)).capitalize() + ".")
    parts = []
    for c in range(1, 5):
        parts.append(f"{c} Capítulo")
        for s in range(1, 4):
            parts.append(f"{c}.{s} Sección")
            parts += [" ".join(sentence(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 6))]
            parts.append(" ".join(sentence(20) for _ in range(60)) if s == 2 else "Corto.")
        parts += ["1. ¿" + sentence(5), "2. Defina " + word(), f"{c} Nota " + sentence(9)]
    parts.append(" ".join(word() for _ in range(900)))
    return "\n\n".join(["  ", *parts, "\n"])


def test_chunk_invariants(spark):
    docs = spark.createDataFrame([(1, book()), (2, book(2).replace("\n\n", "\n\n \n\n")), (3, ""), (4, None), (5, "Solo uno.")], "doc_id long, text string")
    chunks = C.chunks(docs)
    assert C.verify_spans(chunks, docs).where("not matches").count() == 0
    rows = chunks.orderBy("doc_id", "index").collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id for r in rows} == {1, 2}
    for d in (1, 2):
        mine = [r for r in rows if r.doc_id == d]
        assert [r["index"] for r in mine] == list(range(len(mine)))
        assert all(a.char_to <= b.char_from for a, b in zip(mine, mine[1:], strict=False))
        assert all(len(r.text.encode()) <= C.HARD_CAP and len(r.text.encode()) >= C.SHORTEST for r in mine)
        assert all(len(r.overlap.encode()) <= C.OVERLAP for r in mine) and any(r.overlap for r in mine)
        assert {r.kind for r in mine} == {"cuerpo", "preguntas"} or {r.kind for r in mine} == {"cuerpo", "preguntas", "nota"}
        assert all(r.section == "" for r in mine if r.kind == "preguntas")
        assert text[d][mine[0].char_from : mine[0].char_to].decode().strip() == mine[0].text


def test_paragraph_bytes(spark):
    docs = spark.createDataFrame([(1, "é uno\n\n  dos ñ \n\n\n\n \n\ntres")], "doc_id long, text string")
    raw = docs.first().text.encode()
    got = C.paragraphs(docs).orderBy("idx").collect()
    assert [(r.idx, r.text) for r in got] == [(0, "é uno"), (1, "dos ñ"), (2, "tres")]
    assert all(raw[r.offset : r.offset + len(r.text.encode())].decode() == r.text for r in got)


def test_sentences_keep_abbreviations_and_all_text():
    text = "Ver Gén. 2:15 y cap. Tres. Otro caso: sí. «Fin.» Ahora no. sigue igual"
    parts = C.sentences(text)
    assert "".join(parts) == text and parts[0] == "Ver Gén. 2:15 y cap. Tres. " and parts[-1].startswith("Ahora")


def test_cues(spark):
    cues = spark.createDataFrame([("v", 0, 0.0, 1.0, "uno dos"), ("v", 1, 1.0, 2.0, "uno dos tres"), ("v", 2, 2.0, 3.0, "dos tres"), ("v", 3, 9.0, 9.5, "fin.")], "v string, seq int, start_s double, end_s double, text string")
    rolled = C.drop_rolling(cues, "v", "seq", "text").orderBy("seq").collect()
    assert [r.text for r in rolled] == ["uno dos", "tres", "fin."]
    grouped = C.group_cues(cues, "v").orderBy("para").collect()
    assert [(r.cues, r.start_s, r.end_s) for r in grouped] == [(3, 0.0, 3.0), (1, 9.0, 9.5)]


def learned(docs, rules):
    """Chunks of one machine: levels and kinds by the built-in columns but for the learned patterns."""
    import re

    out = []
    for doc, text, family, base in docs:
        r = rules.get(family, (None,) * 4)
        held = []
        for (idx, offset, body, level, kind), _ in zip(base, base):
            quiet = "?" in body or "¿" in body
            if not quiet and r[0] and re.match(r[0], body):
                level = 1 if len(body) <= 40 else 0
            elif not quiet and r[1] and re.match(r[1], body):
                level = 2 if len(body) <= 120 else 0
            if level > 0:
                kind = "cuerpo"
            elif r[2] and re.match(r[2], body):
                kind = "preguntas"
            elif r[3] and re.match(r[3], body):
                kind = "nota"
            held.append((idx, offset, body, level, kind))
        out += [(doc, *c.values()) for c in C.pack(text, held)]
    return sorted(out)


def test_learned_rules_decide_boundaries(spark):
    texts = [(1, book(3), "a"), (2, book(4), "b"), (3, book(5), "none"), (4, book(6), None), (5, None, "a")]
    rules = {"a": ("Corto", None, r"[A-M][a-zñá]+ ", r"Nota|[N-R][a-zñá]+ "), "b": (None, None, None, r"[A-Z][a-zñá]+ [a-f]")}
    profiles = [(k, 2, *v, None, None) for k, v in rules.items()] + [("a", 1, "old", "old", "old", "old", 1, 1), ("zzz", 1, ".", None, None, None, None, None)]
    schema = "fingerprint string, learned_at int, heading_l1_pattern string, heading_l2_pattern string, question_pattern string, footnote_pattern string, heading_l1_max int, heading_l2_max int"
    docs = spark.createDataFrame(texts, "doc_id long, text string, fingerprint string")
    got = C.learned_chunks(docs, spark.createDataFrame(profiles, schema))
    plain = C.paragraphs(docs).withColumn("level", C.heading_level(F.col("text"))).withColumn("kind", C.kind(F.col("text"), F.col("level"))).collect()
    base = {d: [tuple(r[1:]) for r in plain if r.doc_id == d] for d, *_ in texts}
    want = learned([(d, x, f, base[d]) for d, x, f in texts if x], rules)
    assert sorted(map(tuple, got.collect())) == want
    assert {r.kind for r in got.where("doc_id = 1").collect()} == {"cuerpo", "preguntas", "nota"}
    untouched = C.chunks(docs).where("doc_id in (3, 4)").collect()
    assert sorted(map(tuple, got.where("doc_id in (3, 4)").collect())) == sorted(map(tuple, untouched))


def test_transcripts_fall_back_and_times_stay_in_order(spark):
    said = [f"{i} palabra dicha por alguien en el video número {i}." for i in range(30)]
    good, short = "\n\n".join(said), "\n\n".join(said[1:])
    videos = [("ok", good.upper(), good), ("lost", short, good), ("none", None, good), ("bad", short, short), ("empty", "", "")]
    times = [(v, i, i * 2.0, i * 2.0 + 1.5) for v in ("ok", "lost", "none", "bad") for i in range(30)]
    spoken, report = C.transcript_chunks(spark.createDataFrame(videos, "video_id string, corrected string, original string"), spark.createDataFrame(times, "video_id string, idx int, start_s double, end_s double"))
    assert {r.video_id: (r.stream, r.uncovered) for r in report.collect()} == {"ok": ("corrected", 0), "lost": ("original", 0), "none": ("original", 0), "bad": (None, None), "empty": (None, None)}
    rows = spoken.orderBy("video_id", "index").collect()
    assert {r.video_id for r in rows} == {"ok", "lost", "none"} and all(r.kind == "transcripcion" and r.chapter == "" for r in rows)
    for v in ("ok", "lost", "none"):
        mine = [r for r in rows if r.video_id == v]
        assert all(r.start_s == r.para_from * 2.0 and r.end_s == r.para_to * 2.0 + 1.5 for r in mine)
        assert [r.start_s for r in mine] == sorted(r.start_s for r in mine) and mine[0].para_from == 0 and mine[-1].para_to == 29
    assert rows[[r.video_id for r in rows].index("ok")].text.isupper()
