import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.llm import bpe, queries


def test_registration():
    names = list(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(names) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_stages_on_planted_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 150").first()
    base = {c: F.lit(None).cast(docs.schema[c].dataType) for c in columns}
    filler = [f"unseen{i}" for i in range(120)]
    one, near = " ".join(filler), " ".join([*filler[:60], "other", *filler[61:]])
    planted = [(900_001, one), (900_002, one), (900_003, near), (900_004, "before it " + item.text + " after it"), (900_005, "an ordinary and harmless line of text"), (900_006, None), (900_007, "")]
    made = spark.createDataFrame(planted, "doc_id long, text string").select(*[F.col(c) if c in ("doc_id", "text") else base[c].alias(c) for c in columns])
    frame = docs.unionByName(made)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        frame = corpus_pipeline.materialize(frame, "t-" + name)
        seen[name] = {r[0] for r in frame.select("doc_id").collect()}
        if name != "bpe":
            assert frame.columns == columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.collect()} - seen["toxicity"]
    assert sum(labels.get(i) == 0 for i in gone) <= 2
    assert {i for i, _ in planted} <= seen["toxicity"] and seen["line_dedup"] == seen["toxicity"]
    after = seen["simhash_near_dedup"]
    assert 900_001 in after and 900_003 not in after and 900_005 in after
    assert 900_004 in after and 900_004 not in seen["decontamination"]
    assert seen["bpe"] == seen["decontamination"] and 900_005 in seen["bpe"]
    encoder = bpe.byte_bpe("byte_bpe_50k.json")
    row = frame.where("doc_id = 900005").first()
    assert row.lossless and encoder.decode(bpe.np.array(row.ids, "uint32").tobytes()).decode() == planted[4][1]
    assert frame.where("not lossless").count() == 0


def test_stages_on_an_empty_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialize(stage(spark, frame, sf), "e-" + name)
        assert frame.count() == 0


def test_near_duplicates_without_id_are_judged_by_text(spark, sf):
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:30], "x", *words[31:]]), "wholly other words that stand alone here"
    rows = [(5, one, 1), (None, one, 2), (None, near, 3), (None, other, 4), (None, other, 5), (None, None, 6), (7, "", 7), (9, "", 8), (9, one, 9)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, component_id int"), sf).collect()
    found = sorted((r.component_id, r.doc_id) for r in kept)
    assert found[0] == (1, 5) and len(found) == 3 and found[1] in ((4, None), (5, None)) and found[2] == (7, 7)
