import collections
import random
import zlib

from quillspan.llm import sharding as S


def check(rows, out, shards, slack):
    assert len(out) == len(rows)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    by_id = dict(rows)
    for r in out:
        text = by_id[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
    loads = [size[s] for s in range(shards)]
    assert max(loads) - min(loads) <= slack, loads


def test_bytes_are_near_equal_with_a_hot_text(spark):
    rnd = random.Random(1)
    rows = [(i, "copy of one text " * 3 if i % 3 == 0 else "é" * rnd.randint(0, 80)) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (-7, "negative id")]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, out, 24, 4 * 170)


def places(out):
    place = collections.defaultdict(set)
    for r in out:
        place[r.text_crc32].add((r.shard, r.group_cut))
    return place


def test_long_texts_and_whole_groups(spark):
    rows = [(i, f"text {i // 2}") for i in range(4000)] + [(9000, "long " * 2000)]
    # Groups of every size up to a shard's share stay whole, and shards stay level.
    rows += [(10_000 + 1000 * g + i, f"copies of text {g} " * 3) for g, n in enumerate((10, 50, 150, 300, 390)) for i in range(n)]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, out, 4, 2 * 10_008)
    assert all(len(s) == 1 and not cut for s in places(out).values() for _, cut in s)


def test_only_groups_beyond_a_share_are_cut(spark):
    rows = [(i, "hot text") for i in range(2000)] + [(5000 + i, f"text {i % 700}") for i in range(2800)] + [(20_000 + i, None) for i in range(300)]
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    check(rows, out, 6, 200)
    cut = {c for c, s in places(out).items() if len(s) > 1}
    assert cut == {zlib.crc32(b"hot text")} and {r.text_crc32 for r in out if r.group_cut} == cut


def test_query_equals_its_contract(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 60)))) for i in range(2500)] + [(9000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, S.op4_shard(spark, str(tmp_path)).collect(), 24, 300)


def test_empty_repeats_and_extra_columns(spark):
    schema = "doc_id long, text string, shard string, key string"
    assert S.shard(spark.createDataFrame([], schema)).count() == 0
    out = S.shard(spark.createDataFrame([(1, "a", "x", "y")] * 3 + [(None, "b", None, None)], schema), 2).collect()
    assert len(out) == 4 and collections.Counter(r.doc_id for r in out)[1] == 3
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
