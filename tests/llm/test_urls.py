from lendlens.llm.queries import URL_RULES
from lendlens.llm.urls import Rule, filter_urls, rule_index, split_url

CASES = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme.com/": ("", "", None, "allow"),
    "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://www.example.com/en": ("www.example.com", "/en", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com?a/b": ("example.com", "", None, "allow"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://a.net/es/x": ("a.net", "/es/x", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://a.net/esx/": ("a.net", "/esx/", None, "allow"),
    "http://É.Net/fr/a//b": ("É.net", "/fr/a//b", "net/fr/", "block"),
    "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
}


def test_rules_decide(spark):
    rows = [(i, url, "old") for i, url in enumerate(CASES)] + [(99, "http://a.net/es/x", "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, URL_RULES).collect()}
    assert got == {**dict(enumerate(CASES.values())), 99: CASES["http://a.net/es/x"]}
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def test_index_takes_rarest_token_and_keeps_tokenless_rules(spark):
    rules = [Rule("block", "example.com/en/"), Rule("allow", "/")]
    by_token, always = rule_index(rules, {"h:example": 5, "h:com": 9, "p:en": 2})
    assert by_token == {"p:en": [0]} and always == [1]
    df = spark.createDataFrame([("http://any.org/x",), ("http://example.com/en/x",)], "url string")
    assert [r["rule"] for r in filter_urls(df, rules).collect()] == ["/", "example.com/en/"]


def test_every_candidate_search_equals_trying_all_rules():
    for url in filter(None, CASES):
        host, path = split_url(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert CASES[url][2] == (max(fits, key=lambda r: len(r.pattern)).pattern if fits else None)
