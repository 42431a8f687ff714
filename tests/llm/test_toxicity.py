import random
import zlib

import numpy as np
import pytest

from quillspan.llm import toxicity as T

BAD = ["grumblefoo", "snarkbar", "vexo"]


def corpus(n, seed):
    rnd = random.Random(seed)
    voc = ["".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        sentences = [" ".join(rnd.choices(voc, k=8)) for _ in range(rnd.randint(1, 12))]
        y = int(rnd.random() < 0.2)
        if y:
            k = rnd.randrange(len(sentences))
            bad = rnd.choice(BAD) + rnd.choice(["", voc[rnd.randrange(400)]])
            sentences[k] = f"{sentences[k]} {bad}, {voc[0]}"
        rows.append((i, ". ".join(sentences) + ".", y))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1500, 1)
    return T.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.ones(len(rows)))


def test_held_out_accuracy_and_localisation(model):
    rows = corpus(1800, 1)[1500:]
    wrong = place = hits = 0
    for _, text, y in rows:
        spans, z = model.sentences(text)
        wrong += (model.combine(z) >= 0.5) != bool(y)
        if y and model.combine(z) >= 0.5:
            a, b = spans[int(np.argmax(z))]
            hits += 1
            place += any(w in text[a:b] for w in BAD)
    assert wrong <= 0.05 * len(rows) and place >= 0.95 * hits


def test_degenerate_training():
    none = T.fit([], np.array([], int), np.array([]))
    assert none.combine(none.sentences("some text.")[1]) < 0.01
    assert T.fit(["a."], np.array([1]), np.array([1.0])).combine(np.array([20.0])) > 0.99


def test_training_leaves_held_out_rows_alone_and_scores_all(spark):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    used, counts = T.training_rows(docs, labels, 50, 1 << 20)
    got = used.collect()
    assert not {r.doc_id for r in got} & held and sum(counts.values()) == len(rows) - len(held)
    model = T.train(docs, labels)
    extra = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "vexo " * 50_000, None)], "doc_id long, text string, score string")
    out = T.score(extra, model, spans=True).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and [r.score for r in out if not r.text] == [0, 0, 0]
    assert T.score(extra.where("false"), model).count() == 0
    assert T.train(docs.where("false"), labels.where("false")).combine(np.array([])) == 0


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "two" * 10), (3, "three" * 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)] * 5, "doc_id long, toxic int")
    rows, counts = T.training_rows(docs, labels, 2000, 1 << 20)
    got = rows.collect()
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sorted(r.doc_id for r in got) == sorted({1, 2, 3} - held) and sum(counts.values()) == 3 - len(held)
    many = spark.createDataFrame([(i, "x" * 100) for i in range(500)], "doc_id long, text string")
    rows, _ = T.training_rows(many, many.selectExpr("doc_id", "int(doc_id % 2) as toxic"), 2000, 6400)
    assert rows.count() == 64
