import random

from quillspan.operators import audit as A


def test_quotes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "QUOTES_PER_PASS", 4)
    rnd = random.Random(2)
    word = lambda: rnd.choice(["uno", "dos", "tres", "cuatro", "cinco", "seis", "é", "x\ny"])
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 200))), "q") for i in range(40)] + [(40, None, "q"), (41, "", "q"), (None, "uno dos tres", "q")]
    quotes = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 6, 7, 9])))) for i in range(40)]
    quotes += [(100 + i, docs[i][1][3:70]) for i in range(12)] + [(200, None), (201, ""), (202, quotes[0][1])]
    got = A.quoted_in(spark.createDataFrame(docs, "id long, text string, other string"), spark.createDataFrame(quotes, "quote_id long, quote string"), "id", "text", "quote")
    want = sorted((str(i), k) for i, x, _ in docs for k, q in quotes if x and q and q in x)
    assert sorted((str(r.id), r.quote_id) for r in got.collect()) == want
