from quillspan.llm import url_filter as U


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        m = next((i for i in range(n, len(rest)) if rest[i] in "?#"), len(rest))
        path = rest[n:m]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, U.DEFAULT_VERDICT))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "://x.com/en/", "http://a.b.COM/en/1", "http://example.com/en/7/x?y#z", "https://m.example.com/en/70", "http://com/en/",
    "http://notexample.com/en/7", "http://x.net/de/8", "http://www.example.net/de/8.html", "http://example.net/de/9", "http://example.org/es/?q", "http://org/es",
    "http://É.Org/es/1", "ftp://a.com?x=/en/", "http://a.com#/en/", "http://a.com/en/\nnext", "x://y://z.com/en/", "http://.com/en/", "http://user@a.com:80/en/", "http://a.com./en/" + "p" * 50_000,
]


def test_every_case(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {i: judge(u) for i, u in rows}


def test_edges(spark):
    schema = "page_id long, url string, verdict string, full string"
    rules = spark.createDataFrame([*U.RULES, ("com", "/en/", "allow")], "host string, path string, verdict string")
    assert U.judge_urls(spark.createDataFrame([], schema), rules).count() == 0
    rows = [(1, "http://a.com/en/1", "x", "y")] * 3 + [(None, "http://a.com/en/2", None, None)]
    out = U.judge_urls(spark.createDataFrame(rows, schema), rules).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"block"}
    out = U.judge_urls(spark.createDataFrame(rows, schema), rules.where("false")).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"allow"} and {r.rule for r in out} == {None}
