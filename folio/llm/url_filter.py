"""Blocking and allowing of urls by host and path rules, carried over redirects and canonical links. Native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, release, written
from .components import connected_components

Rule = tuple[str, str, str]  # action (allow or block), host, path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def _normal(rest: Column) -> Column:
    """What follows a host, to the end of the query: with / for an empty path, without the path's . and .. segments."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))

    def without_dots(r: Column) -> Column:
        parts = F.split(F.regexp_extract(r, r"^/?([^?]*)", 1), "/")
        ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
        return F.concat(F.lit("/"), F.array_join(F.aggregate(ended, F.array().cast("array<string>"), step), "/"), F.regexp_extract(r, r"(?s)\?.*$", 0))

    # Lambdas aren't compiled into the stage's code, which else grows by a copy of the text's expression for each use.
    odd = F.get(F.transform(F.array(rest), without_dots), 0)
    return F.when(rest == "", "/").when(rest.rlike(r"^\?|^[^?]*/\.\.?([/?]|$)"), odd).otherwise(rest)


def node_of(url: Column) -> Column:
    """The resource that a url names: without its fragment and dot segments, scheme and host in lower case, / for an empty path."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), _normal(rest)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(name, action) of the longest rule that fits, allow before block at equal length; null if none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's path. The rules are
    literals of the plan: configuration of at most some thousands, the same for any amount of input.
    """
    if not rules:
        return F.lit(None).cast("struct<name:string,action:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    table = F.array(*(F.struct(F.lit(h + p).alias("name"), F.lit(action).alias("action"), F.lit(h).alias("h"), F.lit(p).alias("p")) for action, h, p in ordered))
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    first = F.get(fits, 0)
    return F.when(first.isNotNull(), F.struct(first["name"].alias("name"), first["action"].alias("action")))


def _absolute(target: Column, url: Column, scheme: Column, host: Column, path: Column) -> Column:
    """A link's target, resolved against the page's url and its parts."""
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"^.*/", 0)
    return (
        F.when(target == "", None)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("#"), url)
        .when(target.startswith("?"), F.concat(site, path, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): the resource of each page, and where its canonical links and its refresh redirects point.

    A written table, so that the pages are scanned once; it has a row for each link at most."""
    all_of = lambda tag, target: F.transform(F.regexp_extract_all(F.col(html), F.lit(tag), 0), lambda x: F.regexp_extract(x, target, 1))
    tags = F.concat(
        all_of(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
        all_of(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"),
    )
    found = pages.where(F.col(url).contains("://")).select(F.col(url).alias("url"), F.filter(tags, lambda x: x != "").alias("t")).where(F.size("t") > 0)
    parts = found.select("url", F.explode("t").alias("t")).select("url", F.trim(F.replace("t", F.lit("&amp;"), F.lit("&"))).alias("t"), ascii_lower(F.substring_index("url", "://", 1)).alias("scheme"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = written(parts, "links")
    if parts.isEmpty():
        return parts.select(F.col("url").alias("u"), F.col("t").alias("v"))
    ends = written(parts.select("url", _absolute(*(F.col(c) for c in ("t", "url", "scheme", "host", "path"))).alias("to")), "targets")
    edges = written(ends.select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v")).where("u is not null and v is not null"), "links")
    release(parts, ends)
    return edges


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and alias_of (least url of its aliases, or null).

    A url that a rule fits gets the rule's verdict. Any other is blocked if one of its aliases, over
    any number of redirects and canonical links, is a url that a rule blocks; an explicit allow
    isn't overruled by an alias. All others are allowed. redirects: further (u, v) url pairs, as from a crawl log.

    Null or broken urls: host and path empty, no rule, allowed. Null html has no links. Repeated rows
    each get a row. Existing columns of the added names are replaced. An empty table gives an empty one.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("u")), node_of(F.col("v"))))
    node, hit = (free_name(pages, n) for n in ("node__", "blocked__"))
    out = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "alias_of") if c not in (url, html)))
    out = out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), node: node_of(F.col(url))})
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():  # nobody has an alias
        out = out.withColumns({"alias_of": F.lit(None).cast("string"), hit: F.lit(False)})
    else:
        parts = written(connected_components(edges), "aliases")
        named = written(parts.select("component", host_of(F.col("node")).alias("h"), path_of(F.col("node")).alias("p")), "nodes")
        of_node = rule_of(F.col("h"), F.col("p"), rules)
        blocked = named.groupBy("component").agg(F.max(F.coalesce(of_node["action"] == "block", F.lit(False))).alias("blocked"))
        marks = written(parts.join(blocked, "component").select(F.col("node").alias(node), F.col("component").alias("alias_of"), F.col("blocked").alias(hit)), "marks")
        release(parts, named)
        out = out.join(marks, node, "left")
    method = F.when(F.coalesce(F.col(hit), F.lit(False)), "block").otherwise("allow")
    return out.withColumns({"verdict": F.coalesce(F.col("rule")["action"], method), "rule": F.col("rule")["name"]}).drop(node, hit)


#: The rules of the registered query.
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH p AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM q, rules
  WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p)
  GROUP BY page_id)
SELECT q.page_id, q.host, q.path, fit.rule, coalesce(fit.action, 'allow') AS verdict
FROM q LEFT JOIN fit USING (page_id)
"""
