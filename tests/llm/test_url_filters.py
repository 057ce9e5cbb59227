from oracle import same_rows

from umbra.llm import url_filters as U

LISTED = "host string, path string, verdict string"


def test_against_sql(spark, sf_dir):
    same_rows(U.op3_url_filters(spark, sf_dir), U.OP3_SQL, sf_dir)


def judged(spark, urls, listed):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, host int")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.decide(pages, spark.createDataFrame(listed, LISTED)).collect()}


def test_cases(spark):
    got = judged(spark, ["http://A.Example.COM/en/x?q", None, "no scheme", "x://net", "x://net/es/", "https://xnet/es/", "http://h/a#b://c", "http://www.example.com/en/1", "http://a.net/es"], U.RULES)
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "", None, "allow") and got[4] == ("net", "/es/", "net/es/", "block") and got[5][2] is None
    assert got[6] == ("h", "/a", None, "allow") and got[7][2:] == ("www.example.com/en/", "allow") and got[8][2] is None


def test_many_rules_by_brute_force(spark):
    listed = [(f"h{i}.com", f"/{'p' * (i % 5)}", "block" if i % 2 else "allow") for i in range(3000)] + [(None, "/", "block"), ("", "/", "block"), ("z.com", None, "block"), ("h1.com", "/p", "allow")]
    urls = [f"http://{'s.' * (i % 3)}h{i}.com/{'p' * (i % 7)}x" for i in range(0, 6000, 7)] * 2
    got = judged(spark, urls, listed)
    known = {}
    for h, p, v in listed:
        if h and p is not None:
            known[(h, p)] = min(v, known.get((h, p), v))
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        path = "/" + path
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else (None, "allow")
        assert got[i] == (host, path, *want)


def test_empty(spark):
    assert judged(spark, ["http://a.com/"], [])[0] == ("a.com", "/", None, "allow")
    assert judged(spark, [], U.RULES) == {}


def test_filter_has_no_false_negative(spark):
    keys = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key")
    of, blocks = U.bloom(keys, 20_000)
    assert U.marked(keys, of, blocks).where("NOT may").count() == 0
    others = spark.range(20_000, 40_000).selectExpr("CAST(id AS STRING) AS key")
    assert U.marked(others, of, blocks).where("may").count() < 800
