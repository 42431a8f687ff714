import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from quillspan.llm import importance as I
from quillspan.llm import queries

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, low, high):
    found = PATTERN.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + n]) for n in range(low, high + 1) for i in range(len(found) - n + 1)]


def brute(docs, target, low=1, high=1, buckets=10_000, percent=10, min_words=20):
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % buckets for x in texts for f in features(x, low, high)[1])
    s, t = count([x for _, x in docs]), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, own = features(x, low, high)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(order, 1):
        ranks[r].append(k if k <= percent * len(order) // 100 else None)
    return sorted(((*r[:4], ranks[r].pop() if r[4] else None) for r in rows), key=repr)


def corpus(seed=4, n=300):
    rnd = random.Random(seed)
    voc = ["".join(rnd.choices("abcdé字9", k=rnd.randint(1, 5))) for _ in range(200)]
    text = lambda: "".join(rnd.choice(voc).title() + rnd.choice([" ", ", ", "\n", "-_", "\x7f"]) for _ in range(rnd.randint(0, 90)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (None, text() + docs[0][1] + "a b " * 30), (7, docs[7][1]), (8, docs[9][1]), (n + 2, "Ab " * 700_000)]
    return docs, [text() for _ in range(20)] + [None, ""]


def run(spark, docs, target, low=1, high=1):
    d = spark.createDataFrame([(*r, "s", 5) for r in docs], "doc_id long, text string, score string, rank int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    gains = I.bucket_gains(d, t, low=low, high=high)
    out = I.draw(I.weigh(d, gains, low=low, high=high).drop("text")).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3)])
def test_equals_brute_force(spark, low, high, monkeypatch):
    docs, target = corpus()
    assert run(spark, docs, target, low, high) == brute(docs, target, low, high)


def test_full_tries_start_anew(monkeypatch):
    docs, target = corpus(5, 60)
    monkeypatch.setattr(I, "STRETCH", 40)
    trie = I.Trie(1, 3, 1000)
    for _, x in docs[:60]:
        trie.add((x or "").encode())
    want = collections.Counter(zlib.crc32(f.encode()) % 1000 for _, x in docs[:60] for f in features(x, 1, 3)[1])
    assert trie.totals() == dict(want)


def test_draws_lean_to_the_target(spark):
    rnd = random.Random(1)
    near, far = [f"n{i}" for i in range(300)], [f"f{i}" for i in range(300)]
    docs = [(i, " ".join(rnd.choices(near if i % 5 == 0 else far, k=40))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(rnd.choices(near, k=400)),) for _ in range(5)], "text string")
    got = I.resample(spark.createDataFrame(docs, "doc_id long, text string"), target).collect()
    assert len(got) == 100 and sum(r.doc_id % 5 == 0 for r in got) >= 60 and all(r.text for r in got)  # 20 by chance
    assert sorted(r["rank"] for r in got) == list(range(1, 101))


def test_equal_rows_and_empty_tables(spark):
    docs = [(1, "a b c d e " * 5)] * 400
    assert run(spark, docs, ["a b"]) == brute(docs, ["a b"])
    assert run(spark, [], ["a b"]) == []
    assert run(spark, docs[:30], []) == brute(docs[:30], [])


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_importance_resample"](spark, sf).collect()), key=repr)
    assert got == brute(docs, target)
