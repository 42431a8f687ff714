import random
import re

import xxhash

from quillspan.llm import simhash as S


def brute(rows):
    prints = {}
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: ("%016x" % prints[i], root(i)) for i in ids}


def test_anchors_meet_every_pair_in_reach():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(60):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 2)):
            b ^= 1 << bit
        _, anchor, home = S.anchors(np.array([a], np.uint64), 2)
        assert home.sum() == 1
        _, reach, _ = S.anchors(np.array([b], np.uint64), 2)
        assert anchor[home][0] in reach


def test_groups_equal_brute_force(spark):
    rnd = random.Random(2)
    voc = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(120):
        words = rnd.choices(voc, k=rnd.randint(0, 300))
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.5 and words:
            words[rnd.randrange(len(words))] = "changed"
            rows.append((1000 + i, "\t".join(words).upper()))
    rows += [(5000, None), (5001, ""), (5002, rows[3][1]), (5003, "word " * 120_000)]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: ("%016x" % (r.print & (2**64 - 1)), r.component_id) for r in got} == brute(rows)


def test_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string, component_id string"
    assert S.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    out = S.simhash_groups(spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "q r s t u", "x")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (1, 1), (1, 1)]


def test_near_duplicate_recall(spark):
    rnd = random.Random(4)
    voc = [f"w{i}" for i in range(3000)]
    rows = []
    for n in range(200):
        words = rnd.choices(voc, k=rnd.randint(100, 400))
        other = words[:]
        other[rnd.randrange(len(other))] = f"zz{n}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    assert sum(groups[2 * n] == groups[2 * n + 1] for n in range(200)) >= 190
    assert all(c // 2 == i // 2 for i, c in groups.items())
    kept = {r.doc_id for r in S.near_duplicates_removed(docs).collect()}
    assert all(2 * n in kept for n in range(200))


def jaccard_classes(rows, limit=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_near_copies_inside_a_template_family(spark):
    rnd = random.Random(6)
    form = [f"t{i}" for i in range(240)]
    # Each form fills the same template with its own words; the smallest id is like none of them.
    rows = [(0, " ".join(form + [f"q{i}" for i in range(90)]))]
    for i in range(60):
        own = [f"x{i}.{k}" for k in range(60)]
        rows.append((2 * i + 1, " ".join(form + own)))
        own[rnd.randrange(60)] = "changed"
        rows.append((2 * i + 2, " ".join(form + own)))
    want = jaccard_classes(rows)
    assert len(set(want.values())) == 61
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_recall_and_false_drops_around_the_limit(spark):
    rnd = random.Random(8)
    rows, pairs = [(-1, ""), (-2, " \t"), (-3, "two words"), (-4, "two  WORDS".lower()), (-5, "two words more")], []
    for n in range(300):
        words = [f"w{n}.{k}" for k in range(rnd.randint(60, 300))]
        other = words[:]
        # An edited word changes five shingles: similarity of about 0.70 to 0.90.
        for k in rnd.sample(range(len(words)), max(1, int(len(words) * rnd.uniform(0.011, 0.037)))):
            other[k] = f"z{n}.{k}"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        pairs.append(len(a & b) / len(a | b))
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    assert sum(0.7 < p < 0.8 for p in pairs) > 50 and sum(0.8 <= p < 0.9 for p in pairs) > 50
    groups = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, p in enumerate(pairs):
        assert (groups[2 * n + 1] == 2 * n) == (p >= 0.8), p
    assert [groups[i] for i in (-1, -2, -3, -4, -5)] == [-2, -2, -4, -4, -5]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    voc = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(voc, k=rnd.randint(0, 120)))) for i in range(80)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(40)] + [(900, None), (901, ""), (902, "Two\tWORDS")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (3, "other words are here now", 2)]
    out = S.simhash_groups(spark.createDataFrame(rows, "node long, text string, print long"), id_col="node")
    assert sorted((r.node, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    assert sorted(map(tuple, S.near_duplicates_removed(docs).collect())) == [rows[0], rows[2]]


def test_shingles_are_dealt_once_for_their_leaders(spark, monkeypatch):
    from quillspan.llm import simhash

    plans, write = {}, simhash.materialize

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", watched)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(30)] + [(40, "one two"), (41, None)]
    out = simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()}.keys() == {i for i, _ in docs}
    assert "Join" not in plans["meetings"] and plans["meetings"].count("Exchange hashpartitioning(shingle") == 1


def test_shingles_are_dealt_in_parts(spark, monkeypatch):
    # All shingles used to lie on disk at once, and all texts were dealt for their fingerprints.
    from quillspan.llm import simhash

    labels, write, gone = [], simhash.materialize, []

    def watched(df, label):
        labels.append(label)
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", watched)
    drop = simhash.discard
    monkeypatch.setattr(simhash, "discard", lambda df: (gone.append(df.columns), drop(df)))
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(20)] + [(40, "one two"), (41, None), (42, "one two")]
    out = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == jaccard_classes([(i, t or "") for i, t in docs])
    assert labels.count("meetings") == simhash.PARTS > 1 and "simhash" not in labels
    assert len(gone) == 2 and all("prefix" in c for c in gone)


def test_anchors_are_not_broadcast(spark):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(64) - (1 << 63) for _ in range(100)]
    rows = list(enumerate(prints + [p ^ 1 << rnd.randrange(60) ^ 1 << rnd.randrange(60) for p in prints]))
    # Written, as the query does it: the size that Spark then knows is that of the file.
    found = S.links(S.materialize(spark.createDataFrame(rows, "node long, print long"), "nodes"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    near = {frozenset((a, b)) for a, x in rows for b, y in rows if a != b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    assert {frozenset((r.a, r.b)) for r in found.collect()} == near and len(near) >= 100
