import random

import pytest

from quillspan.llm import decontaminate as D


def word_distance(q, words):
    """Edits of q against its best stretch of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(q, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rnd, words, share, voc):
    w = list(words)
    for _ in range(int(share * len(words))):
        p, o = rnd.randrange(len(w)), rnd.random()
        if o < 0.33:
            w[p] = rnd.choice(voc)
        elif o < 0.66:
            del w[p]
        else:
            w.insert(p, rnd.choice(voc))
    return w


def fixture(share, seed=3, n=120, sizes=(15, 60)):
    rnd = random.Random(seed)
    voc = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(900)]
    items = [(i, " ".join(rnd.choices(voc, k=rnd.randint(*sizes)))) for i in range(40)]
    docs = []
    for d in range(n):
        i, q = items[d % 40]
        docs.append((d, " ".join(rnd.choices(voc, k=50) + edited(rnd, q.split(), share, voc) + rnd.choices(voc, k=50)), i))
    return items, docs


def found(spark, items, docs, **kw):
    d = spark.createDataFrame([(a, b) for a, b, *_ in docs], "doc_id long, text string")
    return D.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()


def test_unedited_passages_are_all_found_and_nothing_else(spark):
    items, docs = fixture(0)
    docs += [(1000 + i, " ".join(random.Random(i).choices(docs[0][1].split(), k=300)), None) for i in range(30)]
    got = found(spark, items, docs)
    want = {(d, i) for d, t, _ in docs for i, q in items if word_distance(q.split(), t.split()) == 0}
    assert {(r.doc_id, r.item_id) for r in got if r.edits == 0} == want
    text = {d: t for d, t, *_ in docs}
    for r in got:
        q = dict(items)[r.item_id]
        assert word_distance(q.split(), text[r.doc_id].split()) <= r.edits <= 0.2 * r.item_words
        if r.edits == 0:
            assert text[r.doc_id][r.begin_char : r.end_char] == q


@pytest.mark.parametrize("sizes", [(5, 15), (15, 60), (100, 500)])
def test_recall_of_edited_passages(spark, sizes):
    for share in (0.1, 0.2):
        items, docs = fixture(share, sizes=sizes)
        got = {(r.doc_id, r.item_id) for r in found(spark, items, docs)}
        assert sum((d, i) in got for d, _, i in docs) >= 0.95 * len(docs), (sizes, share)


def test_query_equals_brute_force(spark, tmp_path):
    items, docs = fixture(0.18, n=40, sizes=(6, 30))
    rnd = random.Random(1)
    docs += [(100 + d, " ".join(edited(rnd, items[d][1].split(), 0.1, ["zz"])) + " tail", d) for d in range(20)]
    docs += [(300, None, None), (301, "", None), (None, "x " + items[0][1], 0)]
    items += [(50, "Three short words"), (51, "短い文章です"), (52, ""), (53, None), (54, "art")]
    docs += [(400, "He said: THREE short words!", 50), (401, "three shorts words", None), (402, "これは短い文章です。", 51), (403, "artful start", None)]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in D.op9_decontaminate(spark, str(tmp_path)).collect()}
    want = {}
    for d, text, _ in docs:
        for i, q in items:
            words = D.normal_words(q or "")
            if len(words) >= 5 and (e := word_distance(words, D.normal_words(text or ""))) <= 0.2 * len(words):
                want[d, i] = e
    want |= {(400, 50): 0, (402, 51): 0}
    # Sound: nothing else is reported, and no fewer edits; whole: at least 95 of 100 are.
    assert set(got) <= set(want) and all(e >= want[k] for k, e in got.items())
    assert len(got) >= 0.95 * len(want) and all(k in got for k, e in want.items() if e == 0)


def test_passes_nulls_repeats_and_clashing_columns(spark):
    items, docs = fixture(0, n=8)
    items += [(90, None), (91, ""), (92, "too short"), (0, items[0][1])]
    rows = [(d, t, "x") for d, t, _ in docs] + [(500, None, "x"), (501, "", "x"), (502, ("filler " * 60_000) + items[2][1], None)] + [(docs[1][0], docs[1][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(frame, table, items_per_pass=15).collect()
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, table, bytes_per_pass=2000).collect()} == {(r.doc_id, r.item_id) for r in got}
    with pytest.raises(ValueError):
        D.contaminated(frame, table, id_col="doc_id", item_col="doc_id")
    hits = {(r.doc_id, r.item_id) for r in got}
    assert {(d, i) for d, _, i in docs} <= hits and (502, 2) in hits
    assert sum(r.doc_id == docs[1][0] and r.item_id == 1 for r in got) == 2
    assert D.contaminated(frame.where("false"), table).count() == 0 and D.contaminated(frame, table.where("false")).count() == 0
