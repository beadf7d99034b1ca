from pyspark.sql import functions as F

from riskloom.llm import url_reputation

SCHEMA = "page_id long, url string, host string, score double"


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], SCHEMA)
    labels = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r["page_id"]: r for r in url_reputation.judge(pages, labels).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no host", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/x", "ftp://x.net/es/", "a://b://c/d", "http://notexample.com/en/",
        "http://x.org?q=/en/", "http://example.com", "://example.com/en/", "http://net/fr/a", "http://x.com/İ\n/z", "http:///en/",
    ]
    rows = judged(spark, urls)
    found = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(len(urls))]
    assert found == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/x", "www.example.com/en/"),
        ("x.net", "/es/", "net/es/"), ("b:", "//c/d", None), ("notexample.com", "/en/", "com/"), ("x.org", "", None), ("example.com", "", None),
        ("example.com", "/en/", "example.com/en/"), ("net", "/fr/a", "net/fr/"), ("x.com", "/İ\n/z", "com/"), ("", "/en/", None),
    ]
    verdicts = {rows[i]["verdict"] for i in range(len(urls)) if rows[i]["rule"] in ("com/", "www.example.com/en/")}
    assert verdicts == {"allow"} and {rows[i]["verdict"] for i in (3, 5, 10, 11)} == {"block"}


def test_a_good_host_passes_and_a_bad_one_does_not(spark):
    urls = [f"http://{h}.org/{i}" for h in ("good", "bad") for i in range(60)] + ["http://good.org/new", "http://bad.org/new", "http://never.org/new"]
    outcomes = [(i, int(i < 60)) for i in range(120)] + [(None, 1), (5, None), (999, 1)]
    rows = judged(spark, urls, outcomes)
    assert rows[120]["verdict"] == "allow" and rows[121]["verdict"] == "block" and rows[122]["verdict"] == "block"
    assert rows[120]["mean"] > rows[122]["mean"] > rows[121]["mean"]


def test_repeated_rows_no_outcomes_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", 0.0)] * 3 + [(None, "http://a.org/x", None, None)], SCHEMA)
    none = spark.createDataFrame([], "page_id long, good int")
    out = url_reputation.judge(pages, none)
    assert out.count() == 4 and out.select("host").distinct().count() == 1
    assert url_reputation.judge(pages.where(F.lit(False)), none).count() == 0
