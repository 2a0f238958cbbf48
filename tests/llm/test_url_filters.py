import pytest
from tests_llm_common import rows_of

from annalog.llm import url_filters as u

URLS = [
    ("http://a.example.com/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/x?y", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/", "www.example.com/en/", "allow"),
    ("http://EXAMPLE.COM/en/1", "example.com/en/", "block"),
    ("http://example.com/EN/1", "com/", "allow"),
    ("http://notexample.com/en/1", "com/", "allow"),
    ("http://example.com", None, "allow"),
    ("http://example.com?x=/en/", None, "allow"),
    ("http://b.net/es/1", "net/es/", "block"),
    ("http://b.net/es", None, "allow"),
    ("http://b.net/fr/#a", "net/fr/", "block"),
    ("http://b.net:80/fr/", None, "allow"),
    ("http://casino.example.org/", None, "block"),
    ("http://x.org/best-POKER/now", None, "block"),
    ("http://x.org/pokerface", None, "allow"),
    ("http://casino.x.com/", "com/", "allow"),
    ("mailto:a@b.net", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
    ("ftp://x://y.net/fr/", None, "allow"),
    ("http://é.NET/fr/", "net/fr/", "block"),
    ("http://y.org/" + "a/" * 20_000 + "xxx", None, "block"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, url, "clash", "t") for i, (url, _, _) in enumerate(URLS)] + [(None, "http://b.net/fr/", "c", "t")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, token string")


@pytest.mark.parametrize("limit", [None, 0])
def test_verdicts(pages, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(u, "broadcast_if_small", lambda df, rows: df)
    found = rows_of(u.judge_urls(pages, u.SITE_RULES + u.WORD_RULES), "page_id", "rule", "verdict")
    want = [(i, rule, verdict) for i, (_, rule, verdict) in enumerate(URLS)] + [(None, "net/fr/", "block")] * 2
    assert found == sorted(want, key=repr)


def test_host_and_path(pages):
    rows = {r.page_id: (r.host, r.path) for r in u.judge_urls(pages, u.SITE_RULES).collect()}
    assert rows[1] == ("www.example.com", "/en/x")
    assert rows[11] == ("b.net:80", "/fr/")
    assert rows[6] == ("example.com", "") and rows[7] == ("example.com", "")
    assert rows[16] == rows[17] == rows[18] == ("", "")
    assert rows[19] == ("x:", "//y.net/fr/")


def test_a_rule_is_filed_under_its_rarest_token(spark):
    tokens = spark.createDataFrame([("com",)] * 5 + [("example",)] * 2 + [("en",)] * 3, "token string")
    index = {r["name"]: r["token"] for r in u.rule_index(tokens, u.SITE_RULES).collect()}
    assert index["example.com/en/"] == "example"
    assert index["www.example.com/en/"] == "www"


def test_a_rule_may_end_inside_a_word(spark):
    rule = u.site_rule("block", "a.org", "/ad")
    assert rule.tokens == ("a", "org")
    pages = spark.createDataFrame([(1, "http://a.org/ads/1"), (2, "http://a.org/b")], "page_id long, url string")
    assert rows_of(u.judge_urls(pages, [rule]), "page_id", "verdict") == [(1, "block"), (2, "allow")]


def test_empty_tables(spark, pages):
    assert u.judge_urls(pages.limit(0), u.SITE_RULES).count() == 0
    assert {r.verdict for r in u.judge_urls(pages, []).collect()} == {"allow"}
