import pytest

from quillspan.operators import replay as P

SCHEMAS = {
    "concepts": "concept_id string, name string, kind string",
    "mentions": "version_id int, chunk_id int, concept_id string, model string, created_at int, confidence double",
    "claims": "version_id int, claim_id string, model string, created_at int, quote string",
    "edges": "version_id int, source_id string, type string, target_id string, model string, created_at int",
}


def tables(spark, rows):
    return {n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}


def state(found):
    return {n: sorted(map(tuple, df.select([c.split()[0] for c in SCHEMAS[n].split(", ")]).collect()), key=repr) for n, df in found.items()}


HELD = {
    "concepts": [("a", "A", "x"), ("b", "B", "x"), ("c", "C", "x"), ("o", "O", "x")],
    "mentions": [(1, 1, "a", "m1", 10, 0.5), (1, 1, "b", "m1", 10, 0.6), (2, 9, "c", "m1", 11, 0.9), (1, 2, "o", "m1", 10, 0.7)],
    "claims": [(1, "k1", "m1", 10, None), (1, "k2", "m1", 10, "q"), (2, "k9", "m1", 11, "z")],
    "edges": [(1, "a", "causes", "b", "m1", 10), (2, "c", "causes", "a", "m1", 11)],
}
ARTIFACT = {
    "concepts": [("a", "A again", "y"), ("d", "D", "y"), ("lone", "L", "y")],
    "mentions": [(1, 1, "a", "m2", 99, 0.8), (1, 3, "d", "m2", 99, 0.4), (1, 3, "d", "m2", 99, 0.4)],
    "claims": [(1, "k2", "m2", 99, "q2"), (1, "k3", "m2", 99, None)],
    "edges": [(1, "a", "causes", "d", "m2", 99)],
}
WANT = {
    "concepts": [("a", "A", "y"), ("c", "C", "x"), ("d", "D", "y"), ("lone", "L", "y")],
    "mentions": [(1, 1, "a", "m1", 10, 0.8), (1, 3, "d", "m2", 99, 0.4), (2, 9, "c", "m1", 11, 0.9)],
    "claims": [(1, "k2", "m1", 10, "q2"), (1, "k3", "m2", 99, None), (2, "k9", "m1", 11, "z")],
    "edges": [(1, "a", "causes", "d", "m2", 99), (2, "c", "causes", "a", "m1", 11)],
}


def test_replay_twice_equals_once(spark, tmp_path):
    s = P.Snapshots(spark, str(tmp_path / "s"))
    assert s.newest() == 0 and s.publish(tables(spark, HELD)) == 1
    assert s.replay(tables(spark, ARTIFACT)) == 2
    once = state(s.read())
    assert once == {n: sorted(rows, key=repr) for n, rows in WANT.items()}
    s.replay(tables(spark, ARTIFACT))
    assert state(s.read()) == once
    # An older artifact published again takes the version back to it, provenance of what stays kept.
    s.replay(tables(spark, {**ARTIFACT, "claims": [(1, "k1", "m1", 10, None)]}))
    assert state(s.read())["claims"] == [(1, "k1", "m1", 10, None), (2, "k9", "m1", 11, "z")]


def test_a_broken_run_leaves_the_snapshot_before(spark, tmp_path):
    s = P.Snapshots(spark, str(tmp_path / "s"))
    s.publish(tables(spark, HELD))
    before = state(s.read())
    broken = P.replayed(s.read(), tables(spark, ARTIFACT))
    broken["claims"] = broken["claims"].selectExpr("version_id", "claim_id", "model", "created_at", "raise_error('lost') as quote")
    with pytest.raises(Exception, match="lost"):
        s.publish(broken)
    assert s.newest() == 1 and state(s.read()) == before
    s.replay(tables(spark, ARTIFACT))
    assert state(s.read()) == {n: sorted(rows, key=repr) for n, rows in WANT.items()}
