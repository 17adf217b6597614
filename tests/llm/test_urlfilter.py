"""URL rules and the decisions that aliases share."""

from pricetide.llm import urlfilter
from pricetide.llm.queries import RULES


def judged(spark, pages, rules=RULES):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, rule string, node string")
    got = urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def test_parts_and_longest_rule(spark):
    got = judged(spark, [
        ("https://A.Example.ORG/es/1?q#f", None), ("http://example.org/en/12", None), ("http://example.org/en/2", None), ("http://x.com/de/1", None),
        ("http://x.com/fr/1", None), ("http://com/de/", None), ("http://notcom/de/", None), ("http://x.com", None), ("http://É.com?x", None),
        (None, None), ("no scheme", "<html>"), ("", ""), ("x://y://z/w", None), ("http://badexample.org/es/", None), ("://h/p", None),
    ])
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block") and got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == ("x.com", "", None, "allow") and got[8][0] == "É.com"
    assert got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12][:2] == ("y:", "//z/w") and got[13][2:] == ("org/", "allow") and got[14][:2] == ("h", "/p")


def test_aliases_share_decisions(spark):
    link = "<html><LINK href='{}' rel=canonical></html>"
    got = judged(spark, [
        ("http://a.net/1", link.format("http://x.com/de/9")),  # canonical of a blocked address
        ("http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'),  # redirects to it
        ("https://www.b.net/1/?utm_source=f#top", None),  # the usual forms of that one
        ("http://c.net/1", '<meta property="og:url" content="/2">'), ("http://c.net/2", link.format("http://x.com/de/8")),
        ("http://c.net/3", link.format("http://x.com/fr/8")), ("http://c.net/2?id=5", None),
        ("http://d.net/1", link.format("http://x.com/fr/7")), ("http://d.net/2", link.format("http://d.net/1")),
        ("http://d.net/2", link.format("http://x.com/de/7")),  # allowed and blocked aliases: allowed
        ("http://e.net/1", link.format("")), ("http://e.net/2", link.format("mailto:x@y.z")), (None, link.format("http://x.com/de/1")),
    ])
    assert [got[i][3] for i in range(13)] == ["block", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert all(got[i][2] is None for i in range(13))


def test_explicit_rules_stand(spark):
    link = "<link rel=\"canonical\" href=\"http://x.com/de/1\">"
    got = judged(spark, [("http://x.org/1", link), ("http://x.com/de/1", None), ("http://y.net/", link), ("http://y.net", None)])
    assert got[0][2:] == ("org/", "allow") and got[1][2:] == ("com/de/", "block")
    assert got[2][3] == got[3][3] == "allow"  # the group holds an allowed address


def test_no_rows_and_no_rules(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [("http://x.com/de/1", "<link rel=canonical href=http://y.net/>")], [("zz", "/", "block")]) == {0: ("x.com", "/de/1", None, "allow")}


def test_only_column_expressions(spark):
    df = spark.createDataFrame([(1, "http://x.com/de/1", None)], "page_id long, url string, html string")
    plan = urlfilter.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pages_of_unclosed_tags_are_read_once(spark):
    """Hundreds of kilobytes of tags that never close, and links among them."""
    link = "<link rel='canonical' href='http://x.com/de/1'>"
    many = ["<link " * 60_000, "<link rel=canonical " * 20_000 + link, "<meta " * 60_000 + " content=", "<link" + " " * 400_000 + "rel" + " " * 100_000, "<meta property=og:url content=" * 10_000]
    got = judged(spark, [(f"http://a{i}.net/", page) for i, page in enumerate(many)] + [("http://b.net/", "<LINK\nhref=//x.com/de/2\n rel = canonical>")])
    assert [got[i][3] for i in range(6)] == ["allow", "block", "allow", "allow", "allow", "block"]
