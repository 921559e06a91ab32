from lorebase.llm import urls as U
from pyspark.sql import functions as F


def test_parts_and_rules(spark):
    cases = {
        "http://Example.COM/en/x?y#z": ("example.com", "/en/x", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "https://a.www.example.com/en": ("a.www.example.com", "/en", "com/"),
        "ftp://x.net/es/?q": ("x.net", "/es/", "net/es/"),
        "//x.net/fr/": ("", "", None),
        "http://net/fr/a": ("net", "/fr/a", "net/fr/"),
        "http://planet/fr/a": ("planet", "/fr/a", None),
        "http://a.com": ("a.com", "", None),
        "http://a.com?x://b.net/es/": ("a.com", "", None),
        "http://É.ORG/A\nB#c": ("É.org", "/A\nB", None),
        "://": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").selectExpr("*", "1 as host", "2 as n", "3 as a")
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))


def test_shrinkage(spark):
    rows = [(f"h{i}.bad.org", 40, 38) for i in range(5)] + [(f"h{i}.good.org", 40, 1) for i in range(5)] + [("new.bad.org", 0, 0), ("new.good.org", 0, 0), ("one.bad.org", 1, 0), ("x.y.co.uk", 3, 3)]
    got = {r.host: r.a / (r.a + r.b) for r in U.reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    assert len(got) == len(rows)
    assert got["new.bad.org"] > 0.85 and got["new.good.org"] < 0.15
    assert got["new.good.org"] < got["one.bad.org"] < got["new.bad.org"]


def test_method_decides_and_empty(spark):
    rows = [(i, f"http://h{i % 3}.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(60)] + [(100, "http://h1.net/en/"), (101, "http://q.org/en/"), (None, "http://a.com/"), (102, "http://h1.net/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages).collect()}
    assert got[100] == got[102] == "block" and got[None] == "allow" and len(got) == 64 - 0
    assert U.judge(pages.limit(0)).count() == 0


def test_addresses_suffixes_and_labels(spark):
    hosts = spark.createDataFrame([("10.1.3.4",), ("10.2.3.4:80",), ("[::1]:8080",), ("a.b.co.uk",), ("x.y.city.kawa.jp",), ("",), ("localhost",)], "host string")
    got = [tuple(r) for r in hosts.select(*U.levels(F.col("host"), (*U.SUFFIXES, "kawa.jp"))).collect()]
    assert got == [("10.1.3.4", "ip"), ("10.2.3.4", "ip"), ("[::1]", "ip"), ("b.co.uk", "co.uk"), ("city.kawa.jp", "kawa.jp"), ("", ""), ("localhost", "localhost")]
    pages = spark.createDataFrame([(1, "http://a.bad.org/x"), (2, "http://b.bad.org/"), (3, "http://c.good.org/"), (4, "http://" + "l" * 200_000 + ".org/")], "page_id long, url string")
    labels = spark.createDataFrame([(f"h{k}.{name}.org", name == "bad") for k in range(6) for name in ("bad", "good") for _ in range(9)], "host string, blocked boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, labels=labels).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(None, "block"), (None, "block"), (None, "allow"), (None, "allow")]
