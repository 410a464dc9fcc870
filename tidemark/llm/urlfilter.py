"""URL filters with redirect equivalence.

A rule names a host and a path; it fits that host and its subdomains where the
url's path starts with the rule's, and the longest fitting rule decides.  Pages
that redirect to each other or name each other as canonical are one resource:
components over those edges carry decisions to the aliases that no rule fits.
In a component an explicit allow outweighs a block; without either, ``allow``.

Edges come from all canonical links and refresh redirects in the html outside of
comments, and from a table of redirects if there is one.  Urls are the same node if host (lower-cased),
path and query agree.  A null url, or one without ``://``, has no host and path,
fits no rule and has no aliases; it gets ``allow``.  Null html has no links.  Every
row is judged by its own url, so ids may be null or repeat; html of any length is read
whole.  Of rules of equal length allow comes first.  Other columns are not read,
whatever their names.  No pages give no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components

#: Rules are shipped to every task up to this number, and joined by host beyond it.
BROADCAST_RULES = 50_000

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
BEYOND = r"(?s)^.*?://[^/?#]*([^#]*)"
COMMENT = r"(?s)<!--.*?-->"
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b[^\">]*\"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; empty where there is no host."""
    host = host_of(url)
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_extract(url, BEYOND, 1)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of canonical links and refresh redirects.

    A target is absolute, without scheme, from the root, or beside the page.
    """
    html, url = F.regexp_replace(F.col(html_col), COMMENT, ""), F.col(url_col)
    linked = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv"))
    each = lambda tag, value: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))
    hrefs = F.concat(each(LINK, HREF), each(REFRESH, TARGET))
    rows = linked.select(node_of(url).alias("src"), host_of(url).alias("host"), path_of(url).alias("path"), F.explode(hrefs).alias("href"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rows = rows.where("src <> '' and href <> ''").withColumn("folder", F.when(folder == "", "/").otherwise(folder))
    absolute = (
        F.when(F.instr("href", "://") > 0, F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href"))
        .when(F.col("href").startswith("/"), F.concat(F.lit("http://"), "host", "href"))
        .otherwise(F.concat(F.lit("http://"), "host", "folder", "href"))
    )
    edges = rows.select("src", absolute.alias("dst")).select("src", node_of(F.col("dst")).alias("dst"))
    return edges.where("dst <> '' and src <> dst")


def suffixes(host: Column) -> Column:
    """A host and the domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def fitting_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, path, rule, action) of the longest rule that fits; rows without one are left out.

    ``urls`` has distinct (host, path); of equal rules allow comes first.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1], r, a) for a, r in rules],
        "suffix string, start string, rule string, action string",
    )
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    tried = urls.select("host", "path", F.explode(suffixes(F.col("host"))).alias("suffix"))
    fits = tried.join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("a"), "rule", "action"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``id_col``, host, path, rule, verdict and alias_of (component, null if alone) of every page.

    ``rules``: (allow or block, ``host/path``).  ``redirects``: (src, dst) urls.
    """
    url = F.col(url_col)
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    groups = connected_components(edges)

    node = F.concat(F.lit("http://"), F.col("node"))
    members = groups.withColumns({"host": host_of(node), "path": path_of(node)})
    ruled = members.join(fitting_rules(members.select("host", "path").distinct(), rules), ["host", "path"])
    decided = ruled.groupBy("component").agg(
        F.when(F.max((F.col("action") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("shared")
    )
    aliases = groups.join(decided, "component", "left")

    rows = pages.select(
        F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")
    )
    own = fitting_rules(rows.select("host", "path").distinct(), rules)
    return (
        rows.join(own, ["host", "path"], "left")
        .join(aliases, "node", "left")
        .select(
            F.col(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("action", "shared", F.lit("allow")).alias("verdict"),
            F.col("component").alias("alias_of"),
        )
    )


def oracle(rules: Sequence[tuple[str, str]]) -> str:
    """DuckDB SQL for ``judge`` over ``pages`` without a table of redirects."""
    values = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{a}')" for a, r in rules)
    low = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def host(c: str) -> str:
        return "coalesce(" + low % f"regexp_extract({c}, '{HOST}', 1)" + ", '')"

    def path(c: str) -> str:
        return f"coalesce(regexp_extract({c}, '{PATH}', 1), '')"

    def node(c: str) -> str:
        return f"CASE WHEN {host(c)} <> '' THEN {host(c)} || regexp_extract({c}, '{BEYOND}', 1) ELSE '' END"

    link, href, refresh, target = (p.replace("(?is)", "").replace("'", "''") for p in (LINK, HREF, REFRESH, TARGET))
    plain = "regexp_replace(html, '" + COMMENT.replace("(?s)", "") + "', '', 'gs')"
    folder = "regexp_replace(" + path("url") + ", '[^/]*$', '')"
    fits = """
      SELECT {key}, max(struct_pack(n := length(r.rule), a := r.action = 'allow', rule := r.rule, action := r.action)) AS b
      FROM {rows} u JOIN rules r ON (u.host = r.suffix OR ends_with(u.host, '.' || r.suffix)) AND starts_with(u.path, r.start)
      GROUP BY {key}"""
    return f"""
    WITH RECURSIVE rules(suffix, start, rule, action) AS (VALUES {values}),
    hrefs AS (
      SELECT url, unnest(list_concat(list_transform(regexp_extract_all({plain}, '{link}', 0, 'is'), lambda x: regexp_extract(x, '{href}', 1, 'is')),
                                     list_transform(regexp_extract_all({plain}, '{refresh}', 0, 'is'), lambda x: regexp_extract(x, '{target}', 1, 'is')))) AS href
      FROM pages WHERE regexp_matches(html, 'canonical|http-equiv', 'i') AND {node('url')} <> ''),
    targets AS (
      SELECT {node('url')} AS src, CASE
        WHEN instr(href, '://') > 0 THEN href
        WHEN starts_with(href, '//') THEN 'http:' || href
        WHEN starts_with(href, '/') THEN 'http://' || {host('url')} || href
        ELSE 'http://' || {host('url')} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || href END AS dst
      FROM hrefs WHERE href <> ''),
    edges AS (SELECT src, {node('dst')} AS dst FROM targets WHERE {node('dst')} <> ''),
    links AS (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
    reach(node, other) AS (SELECT u, v FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other),
    nodes AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node),
    members AS (SELECT node, component, {host("('http://' || node)")} AS host, {path("('http://' || node)")} AS path FROM nodes),
    ruled AS ({fits.format(key="u.node, u.component", rows="members")}),
    decided AS (SELECT component, CASE WHEN bool_or(b.action = 'allow') THEN 'allow' ELSE 'block' END AS shared
                FROM ruled GROUP BY component),
    p AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
    own AS ({fits.format(key="u.host, u.path", rows="(SELECT DISTINCT host, path FROM p)")})
    SELECT p.page_id, p.host, p.path, own.b.rule AS rule,
           coalesce(own.b.action, decided.shared, 'allow') AS verdict, nodes.component AS alias_of
    FROM p LEFT JOIN own ON own.host = p.host AND own.path = p.path
    LEFT JOIN nodes ON nodes.node = p.node LEFT JOIN decided ON decided.component = nodes.component
    """
