"""URL rules against a plain scan over all rules."""

import re

import pytest

from askgrid.llm import url_filter

URLS = ["http://a.example.net/en/x", "https://EXAMPLE.net/EN/x", "http://net/", "http://net", "http://xnet/a",
        "http://b.net/?q=http://org/fr/", "ftp://org/fr/1#a", "http://example.com/de/", "http://example.com/de",
        "http://x.example.com/fr/", "no scheme", "", None, "://", "a://b://c", "http://cheap-pills.example.com/en/4",
        "http://www.free-bets.org/en/", "http://xxx.org/", "http://www.casino.net/fr/", "http://spam-farm/", "http://h\nx.net/a",
        "http://user@net:80/", "http://ÄÖ.net/en/", "http://net/", "http://net/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


@pytest.mark.parametrize("limit", [url_filter.MAX_BROADCAST_RULES, 1])
def test_verdicts_equal_a_plain_scan(spark, limit):
    rules = url_filter.HOST_RULES + url_filter.PATTERN_RULES
    pages = spark.createDataFrame([(i % 20, url, "h") for i, url in enumerate(URLS)], "page_id long, url string, row string")
    found = url_filter.filter_urls(pages, broadcast_limit=limit).collect()
    expected = []
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fit = []
        for rule in url_filter.HOST_RULES:
            rule_host, rule_path = rule.name.split("/", 1)
            if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
                fit.append((-rule.priority, -len(rule.name), rule.name, rule.verdict))
        for rule in url_filter.PATTERN_RULES:
            if re.search(rule.pattern, host + path):
                fit.append((0, -len(rule.name), rule.name, rule.verdict))
        best = min(fit, default=(None, None, None, "allow"))
        expected.append((i % 20, host, path, best[2], best[3]))
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.matched, r.verdict) for r in found))) == sorted(map(repr, expected))
    assert len(rules) == 9


def test_only_candidates_by_the_rarest_token(spark):
    addresses = spark.createDataFrame([(["net", "en", "example"],), (["net", "com", "example"],), (["net"],)], "tokens array<string>")
    index = url_filter.rule_index(addresses, url_filter.rule_table(spark, url_filter.HOST_RULES))
    assert {r.name: r.token for r in index.collect()} == {"net/": "net", "example.net/en/": "en", "example.com/de/": "de", "org/fr/": "fr"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages).count() == 0
