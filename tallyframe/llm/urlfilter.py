"""URL filter with redirect equivalence.

A list of rules (host and path) decides first: a rule fits its host and all its
subdomains if the url's path starts with the rule's, and the longest that fits
wins.  Urls without a rule take the decision of their aliases: pages are linked
by the canonical links and refresh redirects in their html and by a table of
redirects if one is given, and the components of that graph carry decisions.
An explicit allow has precedence: a url's own rule stands against its aliases,
and in a component with both allowed and blocked members the others are allowed.
A url without rule and without a blocked alias is allowed.

Urls are compared without scheme and fragment.  Rules are a table of any size,
joined to the urls' hosts and the hosts above those.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and is allowed; null or empty html has no links; repeated rows are judged
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, literal_table, materialize


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """Rules as a table (host, path, action), from a table of these columns or a list."""
    if isinstance(rules, DataFrame):
        return rules.select("host", "path", "action").where("host is not null and path is not null and action is not null")
    return literal_table(spark, [(r.host, r.path, r.action) for r in rules], {"host": "string", "path": "string", "action": "string"})


def rules_for(places: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """(host, path, text, action) of the longest rule for each distinct (host, path) that one fits.

    Each host meets the rules of itself and of the hosts above it in a join on
    the host; the rules are broadcast while few and shuffled beyond, where AQE
    may split a host that many pages have.  Of two rules of one text that
    disagree the allowing one counts.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = places.select("host", "path").distinct().withColumn("above", F.explode(F.array_distinct(above)))
    listed = rules.select(F.col("host").alias("above"), F.col("path").alias("start"), F.concat("host", "path").alias("text"), "action")
    fits = asked.join(broadcast_if_small(listed, n_rules, 100_000), "above").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("text", "action"), F.struct(F.length("text"), F.col("text"), F.col("action") == "allow"))
    return fits.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.text", "r.action")


def node_of(url: Column) -> Column:
    """A url without scheme and fragment, its host in lower case."""
    rest = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)([^#]*)", 2)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def resolve_link(base: Column, link: Column) -> Column:
    """An absolute url for a link found on a page; null where there is none."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"^(.*/)?[^/]*$", 1)
    return (
        F.when(link == "", None)
        .when(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://", 0) != "", link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("#") | (F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0) != ""), None)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): nodes that a page's canonical links and refresh redirects join to it."""
    html, url = F.col(html_col), F.col(url_col)
    # a tag that nothing closes is taken to the end of the text, once, and left out: linear whatever the text holds
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*+>?+"), 0), lambda t: t.endswith(">") & (t.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b")))
    some = pages.where(html.rlike(r"(?i)canonical|refresh") & (F.instr(url, "://") > 0)).select(url.alias("url"), F.explode(tags).alias("tag"))
    some = materialize(some, "tags")
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    link = F.when(F.col("tag").rlike(r"(?i)^<link"), href).otherwise(refresh)
    joined = some.select(node_of(F.col("url")).alias("a"), node_of(resolve_link(F.col("url"), link)).alias("b"))
    joined = materialize(joined, "targets")
    return joined.where("b is not null and b <> '/' and a <> b").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` is a list, or a table (host, path, action); ``redirects`` may give
    further edges as (from_url, to_url).
    """
    table = rule_table(pages.sparkSession, rules)
    n_rules = table.count()
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null and a <> b")).distinct()
    edges = materialize(edges, "aliases")
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.join(rules_for(judged, table, n_rules), ["host", "path"], "left")
    if edges.isEmpty():
        spread = F.lit(None).cast("string")
    else:
        nodes = connected_components(edges)
        address = F.concat(F.lit("x://"), F.col("node"))
        nodes = materialize(nodes.select("node", "component", host_of(address).alias("host"), path_of(address).alias("path")), "nodes")
        own = nodes.join(rules_for(nodes, table, n_rules), ["host", "path"], "left")
        by_component = own.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
        decided = by_component.where("blocked and not coalesce(allowed, false)").select("component")
        blocked = nodes.join(decided, "component", "left_semi").select("node", F.lit("block").alias("_spread"))
        judged = judged.withColumn("node", node_of(F.col("_url"))).join(blocked, "node", "left")
        spread = F.col("_spread")
    verdict = F.coalesce(F.col("action"), spread, F.lit("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("text").alias("rule"), verdict.alias("verdict"))
