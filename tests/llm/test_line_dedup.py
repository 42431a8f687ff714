import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance(spark, limit):
    rnd = random.Random(5)
    pairs = []
    for _ in range(800):
        a = [rnd.choice("abé") for _ in range(rnd.randint(0, 14))]
        b = a[:]
        for _ in range(rnd.randint(0, 4)):
            k, o = rnd.randint(0, len(b)), rnd.random()
            if o < 0.3:
                b.insert(k, rnd.choice("abc"))
            elif b and o < 0.6:
                del b[min(k, len(b) - 1)]
            elif b:
                b[min(k, len(b) - 1)] = rnd.choice("abé")
        pairs.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.edit_distance(F.col("a"), F.col("b"), limit).alias("d"))
    for r in got.collect():
        assert min(r.d, limit + 1) == min(distance(r.a, r.b), limit + 1), (r.a, r.b)


def alike(s, t, limit, per_edit):
    most = min(limit, min(len(s), len(t)) // per_edit)
    return most > 0 and abs(len(s) - len(t)) <= most and distance(s, t) <= most


def brute(docs, limit, per_edit):
    lines = [(i, p, s) for i, x in docs for p, s in enumerate((x or "").split("\n")) if s.strip()]
    parent = {s: s for *_, s in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s in parent:
        for t in parent:
            if s < t and root(s) != root(t) and alike(s, t, limit, per_edit):
                parent[root(s)] = root(t)
    first = {}
    for i, p, s in sorted(lines):
        first.setdefault(root(s), (i, p))
    return {i: None if x is None else "\n".join(s for p, s in enumerate(x.split("\n")) if not s.strip() or first[root(s)] == (i, p)) for i, x in docs}


@pytest.mark.parametrize("limit", [1, 2])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(limit)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(5, 14))) for _ in range(25)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            s = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(s) + 1)
                if rnd.random() < 0.4:
                    s.insert(k, "x")
                elif len(s) > 1:
                    del s[min(k, len(s) - 1)]
            lines.append("".join(s))
        docs.append((i, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, docs[5][1])]
    out = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_edits=limit, chars_per_edit=5).collect()
    assert {r.doc_id: r.text for r in out} == brute(docs, limit, 5)


def test_edges_and_clashing_columns(spark):
    schema = "doc_id long, text string, N_Removed string, lines int, row_key string, row string, component string"
    assert L.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    line = "a line that is long enough to count " * 3000
    more = (None, "x", "y")
    rows = [(1, line, "a", 1, *more), (2, line + "\nshort", "b", None, *more), (2, line + "\nshort", "b", None, *more), (3, "short\n \n", None, None, *more), (None,) * 7]
    out = L.dedup_lines(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "lines", "row_key", "row", "component", "n_lines", "n_removed"]
    got = sorted((r.doc_id or 0, r.text if r.text is None else len(r.text), r.n_removed, r.row) for r in out.collect())
    assert got == [(0, None, 0, None), (1, len(line), 0, "x"), (2, 5, 1, "x"), (2, 5, 1, "x"), (3, 2, 1, "x")]


@pytest.mark.parametrize("limit", [1, 2])
def test_large_groups_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "LARGE_GROUP", 4)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(60))
    lines = []
    for _ in range(150):
        s = list(base)
        for _ in range(rnd.choice([1, 1, 2, 2, 3])):
            k, o = rnd.randrange(len(s)), rnd.random()
            if o < 0.4:
                s.insert(k, rnd.choice("xyz"))
            elif o < 0.7:
                del s[k]
            else:
                s[k] = rnd.choice("xyz")
        lines.append("".join(s))
    frame = spark.createDataFrame(list(enumerate(lines)), "row_key long, text string")
    rows = L.exploded_lines(frame).select("h", "h2", "line").distinct()
    name = {"%016X%016X" % (r.h & (2**64 - 1), r.h2 & (2**64 - 1)): r.line for r in rows.collect()}
    links = L.line_links(rows, limit, 20)
    got = {frozenset((name[r.a], name[r.b])) for r in links.collect()}
    distinct = sorted(set(lines))
    want = {frozenset((a, b)) for i, a in enumerate(distinct) for b in distinct[:i] if alike(a, b, limit, 20)}
    assert got == want and len(want) > 50
    plan = links._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "levenshtein" not in plan


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (3, 12, 25, 40, 80, 200) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [list(rnd.choice(base)) for _ in range(rnd.randint(1, 6))]
        for s in lines:
            for _ in range(rnd.randint(0, 3)):
                s[rnd.randrange(len(s))] = rnd.choice("xyz")
        docs.append((i, "\n".join(map("".join, lines))))
    docs += [(100, None), (101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute(docs, 1, 20)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in L.op3_line_dedup(spark, str(tmp_path)).collect()}
    for i, x in docs:
        n = 0 if x is None else x.count("\n") + 1
        left = 0 if not kept[i] and n else (kept[i] or "").count("\n") + (x is not None)
        digest = hashlib.sha256((kept[i] or "").encode()).hexdigest()
        assert got[i][0] == n and got[i][2] == digest and (not kept[i] or got[i][1] == n - left)


def test_links_are_decided_without_taking_lines_apart(spark):
    # The distance used to stand before all other conditions of the join, and split both lines of every pair into characters.
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh") for _ in range(80))
    lines = [base, base[:30] + "x" + base[31:], base[:40] + base[41:], base[:9] + "xyz" + base[12:], base[:5] + "y" + base[5:]]
    rows = L.exploded_lines(spark.createDataFrame(list(enumerate(lines)), "row_key long, text string")).select("h", "h2", "line")
    links = L.line_links(rows, 1, 20)
    assert links.count() == 3
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "zip_with(" not in plan


def test_query_also_tells_two_edits(spark, tmp_path):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (25, 45, 90, 200) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [list(rnd.choice(base)) for _ in range(rnd.randint(1, 6))]
        for s in lines:
            for _ in range(rnd.randint(0, 3)):
                s[rnd.randrange(len(s))] = rnd.choice("xyz")
        docs.append((i, "\n".join(map("".join, lines))))
    docs += [(100, None), (101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op3_line_dedup(spark, str(tmp_path)).collect()}
    digest = lambda kept: {i: hashlib.sha256((x or "").encode()).hexdigest() for i, x in kept.items()}
    assert {i: r.kept_sha256 for i, r in got.items()} == digest(brute(docs, 1, 20))
    assert {i: r.wider_sha256 for i, r in got.items()} == digest(brute(docs, 2, 20))
    assert sum(r.wider_removed for r in got.values()) > sum(r.n_removed for r in got.values()) > 0


def test_texts_are_dealt_only_for_lines_that_share_a_key(spark, monkeypatch):
    # All lines' texts used to be dealt and written once each, before any key was made.
    shown, write = {}, L.materialize

    def watched(df, label):
        out = write(df, label)
        shown[label] = (out.count(), out.columns)
        return out

    monkeypatch.setattr(L, "materialize", watched)
    monkeypatch.setattr(L, "FREQUENT", 3)
    rnd = random.Random(12)
    line = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(50))
    common, near = line(), line()
    docs = [(i, "\n".join([common, line(), line(), line()])) for i in range(40)] + [(90, near), (91, near[:20] + "x" + near[21:]), (92, common[1:]), (93, None), (94, near)]
    out = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs, 1, 20)
    assert shown["frequent-lines"] == (1, ["h", "h2"])
    assert shown["live-texts"][0] == 4 and [c for label, (n, c) in shown.items() if "line" in c and n > 20] == []
