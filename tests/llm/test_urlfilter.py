import pytest

from catalograin.llm.urlfilter import Rule, host_links, host_scores, judge_urls, propagate

RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'x' AS rule", "'x' AS verdict")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES).collect()}


def test_rules_and_parts(spark):
    got = judged(spark, [
        (1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://example.net/de", ""), (3, "ftp://x.org/fr/a?b", ""), (4, "http://notexample.com/de/", ""), (5, "http://example.com/de/x", ""),
        (6, "http://net", ""), (7, "http://net?x", ""), (8, "x://y.net/://z.com/de/", ""), (9, None, None), (10, "no scheme", ""), (11, "http://shop.example.com#/de/", ""), (12, "", ""),
    ])
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de", "net/", "block")
    assert got[3] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[4] == ("notexample.com", "/de/", None, "allow")
    assert got[5] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[6] == ("net", "", None, "allow") and got[7] == ("net", "", None, "allow")
    assert got[8] == ("y.net", "/://z.com/de/", "net/", "block")
    assert got[9] == got[10] == got[12] == ("", "", None, "allow") and got[11] == ("shop.example.com", "", None, "allow")


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [(1, "http://spam.net/", ""), (2, "http://farm.com/", link("spam.net", "other.net")), (3, "http://other.net/", ""), (4, "http://good.org/fr/1", link("fine.com")), (5, "http://fine.com/", link("spam.net")), (6, "http://alone.com/", "")]
    got = {i: v[3] for i, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_links_that_count(spark):
    html = """<a href="//Spam.net/x">a</a><a href=https://two.com>b</a><!-- <a href="https://no.com/"> --><script>x='<a href="https://never.com/">'</script><a href="/own//path">c</a><a href='HTTPS://two.com/z'>d</a>"""
    links = host_links(spark.createDataFrame([("me.com", html), ("me.com", html), ("two.com", '<a href="https://two.com/self">'), ("", html)], "host string, html string"))
    assert sorted(map(tuple, links.collect())) == [("me.com", "spam.net"), ("me.com", "two.com")]


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(None, "http://farm.com/", '<a href="http://spam.net/">'), (None, "http://farm.com/", '<a href="http://spam.net/">'), (7, "http://spam.net/", ""), (8, "http://both.com/", '<a href="http://spam.net/">'), (9, "http://x.org/fr/", '<a href="http://both.com/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["host"], r["verdict"]) for r in judge_urls(pages, RULES).collect()))
    assert got == [(0, "farm.com", "allow"), (0, "farm.com", "allow"), (7, "spam.net", "block"), (8, "both.com", "allow"), (9, "x.org", "allow")]


def test_pagerank_against_plain_iteration(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")]
    got = {r["host"]: r["score"] for r in propagate(spark.createDataFrame(links, "source string, target string"), spark.createDataFrame([("a", 1.0), ("d", 0.5)], "host string, seed double"), 5, 0.8).collect()}
    seeds, scores = {"a": 0.2, "d": 0.1}, {"a": 0.2, "d": 0.1}
    for _ in range(5):
        after = dict(seeds)
        for s, t in links:
            after[t] = after.get(t, 0) + 0.8 * scores.get(s, 0) / sum(x == s for x, _ in links)
        scores = after
    assert got == pytest.approx(scores)


def test_edges(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([("h", "x", None), ("h", "x", "allow")], "host string, html string, verdict string")
    assert host_scores(pages).first()["trust"] > 0
