import random

from quillspan.llm.common import connected_components


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 7), (7, 7)]
    edges += [(2000, 2001 + i) for i in range(100)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_shared_and_can_be_cleaned_up(spark):
    from pathlib import Path

    from quillspan.llm import common

    made = common.materialize(spark.range(5), "probe")
    folder = Path(made._quillspan_path.removeprefix("file://"))
    assert made.count() == 5 and folder.exists()
    assert made._quillspan_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    common.cleanup(spark)
    assert not folder.exists()


def test_sketched_joins_equal_plain_ones(spark, monkeypatch):
    from quillspan.llm import common

    rows = spark.range(2000).selectExpr("if(id % 50 = 0, null, id) as id", "cast(id % 7 as string) as other")
    keys = spark.range(0, 4000, 9).selectExpr("id")
    for bits in (1 << 23, 64):  # with 64 bits all rows are likely
        monkeypatch.setattr(common, "SKETCH_BITS", bits)
        marked = common.marked(rows, keys, "id")
        assert marked.columns == [*rows.columns, "_likely"] and marked.count() == 2000
        assert marked.where("_likely").count() < (300 if bits > 64 else 2001)
        for got, how in ((common.matching, "left_semi"), (common.lacking, "left_anti")):
            want = rows.join(keys, "id", how)
            assert sorted(map(str, got(rows, keys, "id").collect())) == sorted(map(str, want.collect()))
