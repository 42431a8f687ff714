import pytest
from pyspark.sql import functions as F

from quillspan.operators import audit as A
from quillspan.operators import community as C
from quillspan.operators import graph as G
from quillspan.operators import mutations as K
from quillspan.operators import retrieval as R
from quillspan.operators import rules as L
from quillspan.operators import semantics as M


def test_gate_reasons(spark):
    cases = [
        ("Un texto normal de Pedro.", "Un texto normal de Pedro.", ""), ("Un texto", "  ", "empty"), ("Un texto normal", "Un texto normal y mucho más largo", "length"),
        ("a" * 200, "a" * 175, "deleted"), ("Según Juan 10:6 dice algo", "Según Juan 10:7 dice algo", "scripture"), ("Nació en 1492 aquí mismo", "Nació en 1493 aquí mismo", "numbers"),
        ("Aquí vive Pedro con él", "Aquí vive Pablo con él", "proper_noun"),
    ]
    rows = spark.createDataFrame(cases, "o string, c string, want string").select("want", A.correction_gate(F.col("o"), F.col("c")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_sequence_audit_finds_planted_breaks(spark):
    spans = spark.createDataFrame([("d", 0, 0, 10, 40), ("d", 1, 5, 20, 40), ("d", 3, 30, 25, 40), ("d", 4, 22, 40, 40)], "d string, i int, a int, b int, t int")
    r = A.sequence_audit(spans, "d", "i", "a", "b", "t").first()
    assert (r.covered, r.total, r.holes, r.inverted, r.disordered) == (38, 40, 1, 1, 1)


def test_library_overview_keeps_tenants_apart(spark):
    m = spark.createDataFrame([("A", "shared", 0, 0.9), ("A", "shared", 1, 0.8), ("A", "shared", 2, 0.9), ("B", "shared", 0, 0.7), ("O", "shared", 0, 0.9), ("A", "lonely", 0, 0.9), ("A", "weak", 1, 0.3)], "version_id string, concept_id string, chunk_id int, confidence double")
    v = spark.createDataFrame([("A", 1, 1), ("B", 1, 1), ("O", 2, 2)], "version_id string, library_id int, tenant_id int")
    got = G.library_mentions(G.confident(m), G.scoped(v, 1), 2).orderBy("version_id").collect()
    assert [(r.version_id, r.concept_id, r.weight, r.documents) for r in got] == [("A", "shared", 3, 2), ("B", "shared", 1, 2)]
    with pytest.raises(ValueError):
        G.scoped(m, 1)


def test_communities_part_two_blocks(spark):
    rows = [(v, c) for v in range(4) for c in range(6)] + [(v, c) for v in range(10, 14) for c in range(20, 26)]
    got = {r.node: r.community for r in C.communities(spark.createDataFrame(rows, "version_id long, concept_id long")).collect()}
    left = {got[f"c{c}"] for c in range(6)}
    assert left.isdisjoint({got[f"c{c}"] for c in range(20, 26)})


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, name string, n int")
    assert sorted(map(tuple, K.upsert(old, new, ["id"]).collect())) == [(1, "a", 1), (2, None, 5), (3, "c", 6)]
    assert sorted(map(tuple, K.merge_keeping(old, new, "id", ["name", "n"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    with pytest.raises(ValueError):
        K.delete_where(old, {})
    assert K.backfill(old, "n", 0)[1] == 1
    edges = spark.createDataFrame([("x", "y", 1, 0.2), ("x", "y", 2, 0.9)], "a string, b string, at int, confidence double")
    assert K.last_writer(edges, ["a", "b"], "at").first().confidence == 0.9


def test_diversify_backfills_after_the_kept_block(spark):
    hits = spark.createDataFrame([("q", i, s, i) for i, s in enumerate(["s", "s", "s", "t", "s"], 1)], "q string, id int, section string, rank int")
    got = R.diversify(hits, "q", "section", 4).orderBy("delivered").collect()
    assert [r.id for r in got] == [1, 2, 4, 3]


def test_where_lost(spark):
    rows = spark.createDataFrame([(1, 2, 1, 1), (None, None, None, None), (60, 70, None, None), (3, None, 90, None), (3, None, 20, None)], "d int, s int, f int, o int")
    got = rows.select(R.where_lost(F.col("d"), F.col("s"), F.col("f"), F.col("o"), 50, 10)).collect()
    assert [r[0] for r in got] == [None, "prefetch", "prefetch", "fusion", "diversify"]


def test_rules(spark):
    assert L.compiles(r"^\d+") and not L.compiles("(")
    p = spark.createDataFrame([(1, 0, "1 Uno"), (1, 1, "prosa"), (1, 2, "3 Tres"), (2, 0, "1 Uno"), (2, 1, "2 Dos")], "doc_id int, idx int, text string")
    got = {r.doc_id: (r.unique, r.rising, r.contiguous) for r in L.heading_sequence_check(p).collect()}
    assert got == {1: (True, True, False), 2: (True, True, True)}
    lines = spark.createDataFrame([(1, 0, "x" * 15_000), (1, 1, "y" * 8_000), (1, 2, "z" * 2_000)], "doc_id int, idx int, text string")
    assert [r.batch for r in L.correction_batches(lines).orderBy("idx").collect()] == [0, 0, 1]


def test_semantics(spark):
    payload = '{"concepts":[{"name":"La Fe","type":null,"description":"a"},{"name":"la  fé","type":"idea","description":"b"}],"claims":[{"text":"x","status":"bad","quote":"ñ y","about":"La Fe","involves":["la fe","Obra"]}]}'
    parsed = M.parse_output(spark.createDataFrame([("c1", "la ñ y más", payload), ("c2", "t", "broken")], "chunk_id string, text string, payload string"))
    c = M.concepts(parsed).collect()
    assert [(r.key, r.name, r.type, r.descriptions) for r in c] == [("la fe", "La Fe", "idea", ["a", "b"])]
    k = M.claims(parsed, ["asserted"]).first()
    assert k.status is None and tuple(k.span) == (3, 7) and k.involves == ["obra"] and M.mentions(parsed).count() == 1
    passes = spark.createDataFrame([("a", "c", 1, 5, 1), ("b", "c", 1, 5, 2), ("a", "c", 9, 12, 2), ("d", "c", None, None, 2)], "claim_id string, chunk_id string, begin int, end int, pass int")
    assert sorted(r.claim_id for r in M.glean(passes).collect()) == ["a", "d"]
