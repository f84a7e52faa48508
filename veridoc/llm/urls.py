"""URL filter rules with redirect equivalence.

A rule (verdict, host, path) fits its host and all subdomains if the URL's
path starts with the rule's; of several the longest wins. URLs without a rule
take the decision of their aliases: redirects and canonical links are edges,
their connected components are found by distributed star contraction, and a
component with an explicitly allowed URL allows its members that no rule
fits, one with a blocked URL and no allowed one blocks them; all others are
allowed.

Main path: built-in functions only. Rules are folded into the plan up to
``INLINE_RULES``; longer lists are joined by host suffix, per distinct host.

Defined results: a null URL, or one without "://", has an empty host and
path; repeated rows have equal results; a null html has no edges; of rules of
equal length that fit, the one whose host, then path, comes first in order
decides; an empty table gives an empty result; extra columns are not read; a
very long html or URL takes time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import cut, narrow
from veridoc.llm.components import components

INLINE_RULES = 500
#: Rows of a side that may be a broadcast: URLs of at most some 100 bytes.
BROADCAST_ROWS = 200_000

Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: Column, pattern: str) -> Column:
    """What ``pattern`` captures after the first "://"; empty without one."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://" + pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, "([^/?#]*)"), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, "[^/?#]*([^?#]*)")


def _rule_name(host: str, path: str) -> str:
    return host + path


def match(df: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """``df`` with ``rule`` and ``rule_verdict``, null where no rule fits."""
    by_length = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    if len(rules) > INLINE_RULES:
        return _match_joined(df, by_length, host, path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(by_length):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule = F.when(fits, _rule_name(h, p)).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _match_joined(df: DataFrame, rules: list[Rule], host: str, path: str) -> DataFrame:
    table = df.sparkSession.createDataFrame([(h, p, what, _rule_name(h, p)) for what, h, p in rules], "suffix string, p string, v string, r string")
    labels = F.split(F.col("h"), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select(F.col(host).alias("h")).distinct().select("h", F.explode(suffixes).alias("suffix"))
    per_host = hosts.join(table, "suffix").groupBy("h").agg(F.collect_list(F.struct(F.length("r").alias("n"), "r", "v", "p")).alias("fits"))
    best = F.array_max(F.filter("fits", lambda x: F.col(path).startswith(x["p"])))
    return df.join(per_host, F.col(host) == F.col("h"), "left").withColumn("b", best).withColumn("rule", F.col("b.r")).withColumn("rule_verdict", F.col("b.v")).drop("h", "fits", "b")


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and host in lower case, without the fragment;
    null without "://"."""
    scheme = F.regexp_extract(url, "(?s)^(.*?)://", 1)
    return F.when(url.contains("://"), F.concat(F.lower(scheme), F.lit("://"), host_of(url), _part(url, "[^/?#]*([^#]*)")))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or bare; empty if it is missing."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.regexp_replace(found, "^[\"']|[\"']$", ""))


def _tag(source: Column, name: str, attribute: str, pattern: str) -> Column:
    """The first tag of a name whose attribute has the pattern; empty if there
    is none. A tag ends before the next "<", so that a page is read once."""
    tags = F.regexp_extract_all(source, F.lit(rf"(?is)<{name}\b[^<>]*+>"), F.lit(0))
    return F.coalesce(F.get(F.filter(tags, lambda t: _attribute(t, attribute).rlike(pattern)), F.lit(0)), F.lit(""))


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) of canonical links and refresh redirects of pages, as nodes."""
    base, source = F.col(f"`{url}`"), F.col(f"`{html}`")
    canonical, refresh = _tag(source, "link", "rel", r"(?i)\bcanonical\b"), _tag(source, "meta", "http-equiv", r"(?i)^\s*refresh\b")
    goal = F.regexp_extract(_attribute(refresh, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"']*)", 1)
    folder = F.regexp_extract(path_of(base), "(?s)^(.*/)", 1)
    found = pages.filter(source.rlike(r"(?i)canonical|http-equiv") & base.contains("://")).select(
        node_of(base).alias("a"),
        F.concat(F.regexp_extract(base, "(?s)^(.*?)://", 1), F.lit(":")).alias("scheme"),
        F.concat(F.regexp_extract(base, "(?s)^(.*?)://", 1), F.lit("://"), host_of(base)).alias("root"),
        path_of(base).alias("path"),
        F.when(folder == "", "/").otherwise(folder).alias("folder"),
        F.explode(F.array(_attribute(canonical, "href"), goal)).alias("link"),
    )
    link = F.col("link")
    whole = (
        F.when(link == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat("scheme", link))
        .when(link.startswith("/"), F.concat("root", link))
        .when(link.rlike("^[?#]"), F.concat("root", "path", link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat("root", "folder", link))
    )
    # The explode between keeps the optimizer from inlining ``whole`` many times over.
    goals = found.select("a", F.explode(F.array(whole)).alias("goal"))
    return goals.select("a", node_of(F.col("goal")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of every row. ``redirects`` adds
    (a, b) edges of URLs, as from a crawl log."""
    rows = narrow(pages, key, url).select(F.col(f"`{key}`"), F.col(f"`{url}`").alias("__url"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    judged = match(rows, rules)
    links = edges(narrow(pages, url, html), url, html)
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("a")), node_of(F.col("b"))))
    links = cut(links.distinct())
    n = links.count()
    if not n:
        method = F.lit("allow")
    else:
        nodes = components(links).select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
        of_node = match(nodes, rules)
        by_root = of_node.groupBy("root").agg(F.max((F.col("rule_verdict") == "allow").cast("int")).alias("ok"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("no"))
        blocked = by_root.filter("coalesce(ok, 0) = 0 AND no = 1").select("root")
        nodes = nodes.join(blocked, "root", "left_semi").select(F.col("node"), F.lit(True).alias("__blocked"))
        nodes = F.broadcast(nodes) if n <= BROADCAST_ROWS else nodes
        judged = judged.join(nodes, node_of(F.col("__url")) == F.col("node"), "left")
        method = F.when(F.col("__blocked"), "block").otherwise("allow")
    return judged.select(F.col(f"`{key}`"), "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))
