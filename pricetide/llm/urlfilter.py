"""URL rules, and block decisions carried to the other addresses of the same page.

A rule names a host and the beginning of a path; it fits that host and its
subdomains, and the longest fitting rule decides.  Pages without a rule are
judged by what is known of their aliases: addresses joined by redirects
(``<meta http-equiv=refresh>``), by canonical links (``<link rel=canonical>``, ``og:url``) and
by the forms that servers redirect to one another as a rule (scheme, ``www.`` and
``m.`` hosts, fragments, tracking parameters, a trailing slash or ``.html``).

Connected components over those edges are the aliases.  If a rule allows any
address of a component, those without a rule are allowed: explicit allowing
takes precedence.  Otherwise, if a rule blocks any of them, they are blocked.
All others are allowed.  Column expressions, joins and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import keep
from pricetide.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name where a visitor came from, not what is shown.
TRACKING = r"(?i)^(?:utm_[^=]*|ref|gclid|fbclid|msclkid|mc_[ce]id)(?:=|$)"
#: A kind of tag, what makes one a link, and where it leads.  Tags are cut out first, so that each is read once, closed or not.
CANONICAL = ("link", r"(?i)\brel\s*+=\s*+[\"']?canonical\b", r"(?i)\bhref\s*+=\s*+[\"']?([^\"'\s>]+)")
SHARED = ("meta", r"(?i)\bproperty\s*+=\s*+[\"']?og:url\b", r"(?i)\bcontent\s*+=\s*+[\"']?([^\"'\s>]+)")
REFRESH = (
    "meta", r"(?i)\bhttp-equiv\s*+=\s*+[\"']?refresh\b",
    r"(?i)\bcontent\s*+=\s*+[\"']?\s*+[0-9.]++\s*+[;,]\s*+url\s*+=\s*+[\"']?([^\"'\s>]+)",
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; null or without ``://``: empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The form all usual redirects lead to: host without ``www.`` or ``m.``, plain path, parameters that count."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$|/+$", "")
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    counting = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.when(host != "", F.concat(host, path, F.when(F.size(counting) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(counting), "&"))).otherwise("")))


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute URL; null where the page's own URL has no host or the link another scheme."""
    scheme = F.regexp_extract(url, "^([^:/?#]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link == "", None)
        .when(link.rlike("^(?i)https?://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(host_of(url) == "", None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def linked(html: Column) -> Column:
    """The links of a page that say it is another page under another address."""
    none = F.array().cast("array<string>")

    def of(word: str, link: tuple[str, str, str]) -> Column:
        tag, marked, target = link
        tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^<>]*+"), F.lit(0)), lambda t: t.rlike(marked))
        to = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, target, 1)), lambda x: x != "")
        return F.when(html.rlike(f"(?i){word}"), to).otherwise(none)

    return F.coalesce(F.concat(of("canonical", CANONICAL), of("og:url", SHARED), of("http-equiv", REFRESH)), none)


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` of the places ``(host, path)`` that a rule fits, once each; the longest decides, allow before block."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fits = (
        places.select("host", "path").where("host <> ''").distinct()
        .withColumn("rule_host", F.explode(suffixes))
        .join(rule, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
    )
    text = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(text)).alias("size"), F.col("rule_verdict").alias("verdict"), text.alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    ``rules(host, path, verdict)`` with verdict ``allow`` or ``block``; hosts in lower case.  A
    URL that is null or holds no ``://`` has an empty host and path, no rule, no
    aliases, and is allowed.  A null or odd page has no links.  Rows that repeat
    are judged alike.  ``rule`` is null where the verdict is not the rule's.
    """
    given = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    placed = given.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.regexp_replace("url", "(?s)#.*", "").alias("node"))
    # an edge joins an address to its usual form, and a page to what it links to
    points = given.select("url", F.explode(F.array_append(F.transform(linked(F.col("html")), lambda x: resolved(x, F.col("url"))), F.col("url"))).alias("to"))
    ends = keep(points.where("url is not null and to is not null").select(F.regexp_replace("url", "(?s)#.*", "").alias("from"), F.regexp_replace("to", "(?s)#.*", "").alias("to")).distinct())
    formed = ends.select(F.explode(F.array("from", "to")).alias("u")).distinct().withColumn("v", address(F.col("u"))).where("v is not null")
    # an address in its usual form has no scheme, so it cannot be mistaken for a URL
    groups = keep(components(ends.select(F.col("from").alias("u"), F.col("to").alias("v")).union(formed)))
    spots = groups.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    known = keep(ruled(spots.union(placed.select("node", "node", "host", "path")), rules))
    carried = (
        spots.join(known, ["host", "path"])
        .groupBy("component")
        .agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
        .select("component", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("carried"))
    )
    by_node = groups.join(carried, "component").select("node", "carried")
    out = placed.join(known, ["host", "path"], "left").join(by_node, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "carried", F.lit("allow")).alias("verdict"))
