import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillspan import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries that SQL can't express, and the test that holds each against a brute-force version or planted cases.
TESTED = {
    "term_ids": "test_text.py::test_fnv",
    "clusters": "test_community.py::test_modularity_is_not_below_one_machine",
    "merged_clusters": "test_community.py::test_merging_equals_its_definition",
    "chunk_windows": "test_chunking.py::test_chunk_invariants",
    "span_verification": "test_chunking.py::test_chunk_invariants",
    "learned_chunks": "test_chunking.py::test_learned_rules_decide_boundaries",
    "transcript_chunks": "test_chunking.py::test_transcripts_fall_back_and_times_stay_in_order",
    "rolling_dedupe": "test_chunking.py::test_cues",
    "timed_paragraphs": "test_chunking.py::test_cues",
    "heading_sequence_check": "test_operators.py::test_rules",
    "correction_batches": "test_operators.py::test_rules",
    "semantic_concepts": "test_operators.py::test_semantics",
    "semantic_claims": "test_operators.py::test_semantics",
    "page_text": "test_sources_streaming.py::test_page_text",
}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [[plain(r[c]) for c in cols] for r in df.collect()]
    if name not in registry.ORACLES:
        file, test = TESTED[name].split("::")
        assert f"def {test}(" in (Path(__file__).parent / file).read_text()
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = [[plain(r[i]) for i in at] for r in rel.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_oracle_is_sql_that_runs(duck):
    for name, sql in entry.oracle_sql().items():
        assert isinstance(sql, str), name
        duck.sql(sql).fetchall()
