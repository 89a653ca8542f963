import duckdb
import pytest

from fraglake.llm import url_filter
from fraglake.llm.queries import ORACLE_SQL, URL_RULES, op2_url_bloom

URLS = [
    "http://A.com/x", "http://com/", "http://com", "https://example.com/en/1", "https://example.com/en", "http://www.example.com/en/2?q=/fr/", "http://b.www.example.com/en/",
    "ftp://x.net/es/#a", "http://x.net/fr/é", "http://x.net/de/", "http://notnet/es/", "no scheme", "", None, "a://b://c/d", "http://xexample.com/en/", "HTTP://EXAMPLE.COM/EN/", "http://net/es/\nx",
]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        tail = rest[len(host) :]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_of_all_kinds(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    assert got == [(i, *judge(u)) for i, u in enumerate([*URLS, *URLS])]


def test_a_filter_as_a_table_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    rules = [*URL_RULES, *((f"h{i}.org", f"/{'p' * (i % 7)}", "block") for i in range(200)), (None, "/", "block"), ("com", "/", "allow")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "http://a.h7.org/", "http://h8.org/p"])], "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()))
    assert got[: len(URLS)] == [(i, *judge(u)) for i, u in enumerate(URLS)]
    assert [g[3] for g in got[len(URLS) :]] == ["h7.org/", "h8.org/p"]


def test_no_false_negatives_and_few_false_hits(spark):
    rules = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(2000)], "host string, path string, verdict string")
    listed = url_filter.canonical(rules)
    table = url_filter.build_filter(listed, 2000 // url_filter.KEYS_PER_BLOCK)
    other = url_filter.canonical(spark.createDataFrame([(f"o{i}.org", "/", "block") for i in range(4000)], "host string, path string, verdict string"))

    def passing(keys):
        from pyspark.sql import functions as F

        keyed = keys.withColumn("block", url_filter._block(F.col("h"), 125)).join(table, "block")
        return keyed.where(url_filter._passes([F.col(f"w{k}") for k in range(url_filter.WORDS)], F.col("h"))).count()

    assert passing(listed) == 2000
    assert passing(other) < 200


def test_many_path_lengths_and_long_hosts(spark, monkeypatch):
    urls = [*URLS, "http://" + "a." * 3000 + "net/es/", "http://" + "a" * 5000 + "/" + "b" * 5000, "http://.com/", "http://./", "http://a..com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    expected = [(i, *judge(u)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == expected
    monkeypatch.setattr(url_filter, "MAX_NAMED", 1)
    assert sorted(map(tuple, url_filter.judge(pages, rules).collect())) == expected


@pytest.mark.parametrize("what", ["pages", "rules"])
def test_empty_tables(spark, what):
    pages = spark.createDataFrame([] if what == "pages" else [(1, "http://com/")], "page_id long, url string")
    rules = spark.createDataFrame([] if what == "rules" else [("com", "/", "block")], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).collect()] == ([] if what == "pages" else [(1, "com", "/", None, "allow")])


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    expected = con.execute(ORACLE_SQL["op2_url_bloom"]).fetchall()
    assert sorted(map(tuple, op2_url_bloom(spark, sf).collect())) == sorted(expected)
