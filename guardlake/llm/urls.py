"""URL filter: rules with the longest match, and block decisions that follow redirects.

Redirects and canonical links make addresses aliases of one another. The alias classes
are connected components over those edges; a block inside a class reaches the aliases
that no rule names, unless the class also holds an explicit allow. A rule that fits an
address itself always decides. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm.common import connected_components, saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]
#: Verdict, host, path.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules folded into one expression; above that they are joined.
FOLDED = 500


def address(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(address(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(address(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: tuple[Rule, ...], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``df`` with ``rule`` and ``ruled`` (allow or block) of the longest rule that fits, else null.

    Of rules of one length an allow wins, then the smaller text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    if len(order) <= FOLDED:
        fits = lambda r: ((F.col(host_col) == r[1]) | F.col(host_col).endswith("." + r[1])) & F.col(path_col).startswith(r[2])
        first = reduce(lambda rest, r: F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("ruled"))).otherwise(rest), order[::-1], F.lit(None).cast("struct<rule:string,ruled:string>"))
        return df.withColumn("_r", first).select(*df.columns, "_r.rule", "_r.ruled")
    known = df.sparkSession.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(order)], "ruled string, rule_host string, rule_path string, place int")
    pairs = df.select(host_col, path_col).distinct()
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("rule_host", F.explode(suffixes)).join(known, "rule_host").where(F.col(path_col).startswith(F.col("rule_path")))
    best = met.groupBy(host_col, path_col).agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "ruled"), "place").alias("_r"))
    return df.join(best.select(host_col, path_col, "_r.rule", "_r.ruled"), [host_col, path_col], "left").select(*df.columns, "rule", "ruled")


def node(url: Column) -> Column:
    """An address as a node: host, path and query; null without ``://``."""
    return F.when(address(url).isNotNull(), F.concat(host(url), F.regexp_extract(address(url), r"^[^/?#]*([^#]*)", 1)))


def resolved(link: Column, url: Column) -> Column:
    """A link as found at ``url`` as an absolute address."""
    base = F.concat(F.lit("http://"), host(url))
    return (
        F.when(link == "", None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link)).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(base, F.regexp_replace(path(url), r"[^/]*$", ""), link))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(a, b)`` between nodes: canonical links and refresh redirects declared in the markup."""
    quoted = r"""["']?([^"'\s>]+)"""
    canonical = F.regexp_extract(F.regexp_extract(html_col, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*>""", 0), rf"(?is)\bhref\s*=\s*{quoted}", 1)
    refresh = F.regexp_extract(F.regexp_extract(html_col, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>""", 0), rf"(?is)\burl\s*=\s*{quoted}", 1)
    url = F.col(url_col)
    cheap = F.lower(html_col)
    found = pages.where(url.isNotNull() & (cheap.contains("canonical") | cheap.contains("refresh")))
    links = found.select(node(url).alias("a"), F.explode(F.array(resolved(canonical, url), resolved(refresh, url))).alias("link"))
    return links.select("a", node(F.col("link")).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    ``redirects(src, dst)`` adds edges between addresses to those declared in ``html_col``.
    A url that is null or has no ``://`` has an empty host and path and no aliases; rows
    that repeat each get their verdict; an empty table gives an empty result.
    """
    url = F.col(url_col)
    judged = with_rule(pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), node(url).alias("node")), rules)
    edges = [alias_edges(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        edges.append(redirects.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b"))
    plain = judged.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    if not edges:
        return plain
    graph = saved(reduce(DataFrame.union, edges).distinct())
    if not graph.take(1):
        return plain
    parts = connected_components(graph)
    full = F.concat(F.lit("http://"), F.col("node"))
    ruled = with_rule(parts.select("node", "component", host(full).alias("host"), path(full).alias("path")), rules)
    classes = ruled.groupBy("component").agg(F.max(F.col("ruled") == "block").alias("blocked"), F.max(F.col("ruled") == "allow").alias("allowed"))
    blocked = saved(parts.join(classes.where("blocked and not coalesce(allowed, false)").select("component"), "component").select("node").distinct())
    named = judged.join(blocked.withColumn("alias_blocked", F.lit(True)), "node", "left")
    verdict = F.coalesce("ruled", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return named.select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of :func:`op2_urls`; reachability by a recursive query."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    rest = "case when position('://' in {u}) > 0 then substr({u}, position('://' in {u}) + 3) end"
    host_of = lambda u: f"coalesce(translate(regexp_extract({rest.format(u=u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')"
    path_of = lambda u: f"coalesce(regexp_extract({rest.format(u=u)}, '^[^/?#]*([^?#]*)', 1), '')"
    node_of = lambda u: f"case when position('://' in {u}) > 0 then {host_of(u)} || regexp_extract({rest.format(u=u)}, '^[^/?#]*([^#]*)', 1) end"
    quoted = """["'']?([^"''\\s>]+)"""
    return f"""
with recursive rules(verdict, rh, rp) as (values {listed}),
pg as (select row_number() over () as rn, page_id, {host_of('url')} as host, {path_of('url')} as path, {node_of('url')} as node, html, url from pages),
tags as (select *, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>') as c, regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>') as r from pg
  where url is not null and (contains(lower(html), 'canonical') or contains(lower(html), 'refresh'))),
links as (select node, host, path, regexp_extract(c, '(?is)\\bhref\\s*=\\s*{quoted}', 1) as l from tags union all select node, host, path, regexp_extract(r, '(?is)\\burl\\s*=\\s*{quoted}', 1) from tags),
full_links as (select node as a, case when l = '' then null when regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') then l when starts_with(l, '//') then 'http:' || l
  when starts_with(l, '/') then 'http://' || host || l when regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
  else 'http://' || host || regexp_replace(path, '[^/]*$', '') || l end as u from links),
one_way as (select distinct a, {node_of('u')} as b from full_links where a is not null and u is not null),
edges as (select a, b from one_way where a <> b union select b, a from one_way where a <> b),
reach as (select a as n, a as m from edges union select r.n, e.b from reach r join edges e on e.a = r.m),
ruled as (select k.n, arg_max(r.verdict, length(rh || rp)) as v from (select distinct a as n from edges) k, rules r
  where (split_part(split_part(split_part(n, '/', 1), '?', 1), '#', 1) = rh or ends_with(split_part(split_part(n, '/', 1), '?', 1), '.' || rh))
    and starts_with({path_of("('http://' || n)")}, rp) group by k.n),
alias as (select reach.n, bool_or(v = 'block') and not bool_or(v = 'allow') as blocked from reach left join ruled on ruled.n = reach.m group by reach.n),
fit as (select rn, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict from pg, rules
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rn)
select page_id, host, path, rule, coalesce(fit.verdict, case when alias.blocked then 'block' end, 'allow') as verdict
from pg left join fit using (rn) left join alias on alias.n = pg.node"""
