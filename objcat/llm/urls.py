"""Url filters: host and path rules, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.components import connected
from objcat.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # ("block" or "allow", "host/path")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^?#]*(\?[^#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What stands for a page among its aliases: host, path and query. Scheme and fragment do not count. Null without a host."""
    return F.when(host(url) != "", F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), _query(url)))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = F.regexp_replace(value, r"(?s)\A[^=]*=\s*", "")
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"\A[\"']|[\"']\z", "")), "&amp;", "&")


def alias_targets(url: Column, html: Column) -> Column:
    """Where the page says it really is: the targets of canonical links and of redirects at once, as whole urls.

    Both stand before the body in any page; comments and scripts are left out first.
    """
    head = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>", "")
    canonical = F.filter(F.regexp_extract_all(head, F.lit(r"(?is)<link\s[^>]*+>"), F.lit(0)), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    refresh = F.filter(F.regexp_extract_all(head, F.lit(r"(?is)<meta\s[^>]*+>"), F.lit(0)), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    links = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)[;,]\s*url\s*=\s*(.*)\z", 1), r"\A['\"]|['\"]\z", "")),
    )
    likely = html.rlike(r"(?i)canonical|refresh")
    none = F.array().cast("array<string>")
    return F.when(likely, F.filter(F.transform(links, lambda link: _resolved(url, link)), lambda u: u.isNotNull())).otherwise(none)


def _resolved(base: Column, link: Column) -> Column:
    """A link as a whole url: absolute, with a host only, from the root, or beside the page. Null if it names no page."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    beside = F.regexp_extract(path(base), r"(?s)\A(.*/)", 1)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"\A(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(beside == "", F.lit("/")).otherwise(beside), link))
    )


def rule_table(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The rules as rows (rule_host, rule_path, rule, action), without leaving the JVM."""
    rows = [F.struct(F.lit(r.split("/")[0]).alias("rule_host"), F.lit("/" + r.partition("/")[2]).alias("rule_path"), F.lit(r).alias("rule"), F.lit(a).alias("action")) for a, r in rules]
    none = F.array().cast("array<struct<rule_host:string,rule_path:string,rule:string,action:string>>")
    return pages.sparkSession.range(1).select(F.explode(F.array(*rows) if rows else none).alias("r")).select("r.*")


def longest_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct (host, path) that a rule fits: the longest such rule.

    A host meets the rules of all its suffixes in an equi-join, so a long list of rules is no product with the urls.
    Of equally long rules the one that is later in the alphabet counts; of equal ones allow.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"))
    met = each.join(rules, each["suffix"] == rules["rule_host"]).filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule").alias("n"), "rule", (F.col("action") == "allow").alias("allow"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(rank.alias("rank"), "action")).alias("best"))
    return best.select("host", "path", F.col("best.rank.rule").alias("rule"), F.col("best.action").alias("action"))


def judge(pages: DataFrame, rules: Iterable[Rule] | DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict) of every page.

    A rule that fits the url decides. Otherwise the page is blocked if any of its aliases, over any number of
    redirects and canonical links and in either direction, has a url that a rule blocks; an explicit allow
    keeps its own urls but does not free their aliases. Everything else is allowed. Null and broken urls have no
    host, no rule and no aliases. Repeated rows get equal results; an empty table gives no rows.
    Pages that share an address, and all links to one hub, are reduced to distinct rows before they meet.
    """
    where = pages.select(pages[key].alias("id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    found = where.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"), alias_targets(F.col("url"), F.col("html")).alias("targets"))
    found = staged(found, "pages")
    table = rules if isinstance(rules, DataFrame) else rule_table(pages, rules)
    targets = found.filter("address is not null").select("address", F.explode("targets").alias("target"))
    edges = staged(targets.select("address", address(F.col("target")).alias("alias"), host(F.col("target")).alias("host"), path(F.col("target")).alias("path")).filter("alias is not null").distinct(), "aliases")

    places = found.select("host", "path").unionByName(edges.select("host", "path")).distinct()
    ruled = staged(longest_rule(places, table), "rules")
    members = connected(edges, "address", "alias")
    spots = found.select("address", "host", "path").unionByName(edges.select(F.col("alias").alias("address"), "host", "path")).distinct()
    blocked = spots.join(ruled.filter("action = 'block'"), ["host", "path"], "left_semi").select(F.col("address").alias("node"))
    bad = members.join(blocked, "node", "left_semi").select("component").distinct()
    tainted = members.join(bad, "component", "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("carried"))
    judged = found.drop("targets").join(ruled, ["host", "path"], "left").join(tainted, "address", "left")
    return judged.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("action", "carried", F.lit("allow")).alias("verdict"))
