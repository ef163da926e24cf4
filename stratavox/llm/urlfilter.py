"""URL filters over redirect equivalence (operator 9)."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.operators.components import connected_components
from stratavox.runtime import settle

#: (action, host and path) of the rules of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Parts that the rows of one host are dealt over, so that a host with very many pages isn't the work of one task.
PARTS = 16

_TAG = r"(?is)<(?:link|meta)\b[^>]*?(?:\brel\s*=\s*[\"']?\s*canonical\b|\bhttp-equiv\s*=\s*[\"']?\s*refresh\b)[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'>\s]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """One name for a url whatever its scheme, the case of its host and its fragment; null without :// or a host, as such urls name
    no page that others could mean."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when((F.instr(url, "://") > 0) & (host_of(url) != ""), F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def resolved(base: Column, link: Column) -> Column:
    """An absolute url of a link on a page: absolute, //host, /path or path beside the page; null if neither can be."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.instr(base, "://") == 0, F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of canonical links and refresh redirects that pages declare."""
    tag = F.explode(F.regexp_extract_all(F.col("html"), F.lit(_TAG), F.lit(0)))
    tags = pages.select(pages[url_col].alias("url"), pages[html_col].alias("html")).where("url is not null and html is not null").select("url", tag.alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)])
    link = F.when(F.lower("tag").startswith("<link"), href).otherwise(F.regexp_extract("tag", _URL, 1))
    return tags.select(F.col("url").alias("src"), resolved(F.col("url"), link).alias("dst")).where("dst is not null")


def matching_rule(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, found): the rules whose host is the host or a parent domain, for each distinct non-empty host.

    A join of host suffixes with the rules: the cost follows the labels of a host, not the number of rules.
    """
    spark = hosts.sparkSession
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, a) for a, r in rules]
    table = spark.createDataFrame(rows, "suffix string, rule_path string, rule string, action string")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    each = hosts.where("host <> ''").select("host").distinct().select("host", suffix.alias("suffix")).distinct()
    return each.join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "action", "rule_path")).alias("found"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, decided_by (rule, alias or default).

    The longest rule that fits a url decides it. Urls that redirects (src, dst), refresh tags or canonical
    links join are aliases of one another, by connected components; a url without a rule takes its
    component's decision, where an explicit allow comes before a block, and is allowed if there is none.
    Null urls and urls without ://: empty host and path, no rule, no alias, allowed; urls with an empty host have no rule and no
    alias either. Repeated rows are
    judged each; a url given by a redirect but not by a page still passes its rule on.
    """
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = settle(links.where("src is not null and dst is not null").distinct(), "links")
    named = links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
    roots = connected_components(named)

    def ruled(urls: DataFrame) -> DataFrame:
        found = matching_rule(urls, rules)
        fits = F.filter("found", lambda r: F.col("path").startswith(r["rule_path"]))
        best = F.array_max(fits)
        dealt = urls.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int"))
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # hosts with a rule only
        return dealt.join(found, ["host", "part"], "left").withColumn("best", best).drop("found", "part")

    own = ruled(base)
    ends = links.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    ends = ends.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "node": node_of(F.col("url"))})
    decided = ruled(ends).join(roots, "node").groupBy("root").agg(F.max(F.col("best.action") == "allow").alias("allow"), F.max(F.col("best.action") == "block").alias("block"))
    alias = roots.join(decided, "root").select("node", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("said")).where("said is not null")
    # rows without a node get keys of their own, which no alias has, instead of meeting in one task
    node = F.coalesce(node_of(F.col("url")), F.concat(F.lit("\0"), F.col("page_id").cast("string"), F.lit("/"), F.monotonically_increasing_id().cast("string")))
    all_rows = own.withColumn("node", node).join(alias, "node", "left")
    verdict = F.coalesce(F.col("best.action"), "said", F.lit("allow"))
    by = F.when(F.col("best").isNotNull(), "rule").when(F.col("said").isNotNull(), "alias").otherwise("default")
    return all_rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))


def host_sql(url: str) -> str:
    """host_of() in DuckDB."""
    return f"coalesce(translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '')"


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, redirects: str = "") -> str:
    """The same in one DuckDB statement, by recursive reachability; canonical links, and redirects by a SELECT of src and dst."""
    values = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{a}')" for a, r in rules)
    host = host_sql
    path = lambda u: f"coalesce(regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
    rest = lambda u: f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^#]*)', 1)"
    node = lambda u: f"CASE WHEN {u} LIKE '%://%' AND {host(u)} <> '' THEN {host(u)} || CASE WHEN {rest(u)} = '' THEN '/' ELSE {rest(u)} END END"
    return f"""
WITH RECURSIVE rules(host, path, rule, action) AS (VALUES {values}),
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*?\\brel\\s*=\\s*["'']?\\s*canonical\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL
), links AS (
  SELECT src, regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1) AS dst FROM tags{" UNION ALL " + redirects if redirects else ""}
), edges AS (
  SELECT {node('src')} AS a, {node('dst')} AS b FROM links WHERE {node('src')} IS NOT NULL AND {node('dst')} IS NOT NULL
), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, e.b FROM reach r JOIN linked e ON r.b = e.a),
urls AS (
  SELECT url FROM pages UNION SELECT src FROM links UNION SELECT dst FROM links
), named AS (
  SELECT url, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM urls
), ruled AS (
  SELECT n.url, n.node, n.host, n.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.action, length(r.rule)) AS action
  FROM named n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY ALL
), said AS (
  SELECT reach.a AS node, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS said
  FROM reach JOIN ruled ON ruled.node = reach.b GROUP BY 1
)
SELECT p.page_id, r.host, r.path, r.rule, coalesce(r.action, s.said, 'allow') AS verdict,
  CASE WHEN r.rule IS NOT NULL THEN 'rule' WHEN s.said IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM pages p JOIN ruled r ON r.url IS NOT DISTINCT FROM p.url LEFT JOIN said s ON s.node = r.node
"""
