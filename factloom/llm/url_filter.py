"""URL rules with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ASCII_LOWER, ASCII_UPPER, connected_components, join_groups, lower_ascii, materialise, table

# The rules of the query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Rules are broadcast up to this many (about 100 bytes each), else joined by a shuffle.
BROADCAST_RULES = 200_000
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
#: A tag ends before the next one begins, so that a page of unclosed tags is read once, not once a tag.
CANONICAL = r"(?is)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>"
REFRESH = r"(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>"
#: Numbers of labels among the rules' hosts up to which only suffixes of those numbers are made.
MOST_LENGTHS = 64
#: Of a tag, the value in double, in single or without quotes.
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
#: A reference with an authority is whole; one with a scheme alone (mailto:, data:) leads to no page.
WHOLE, SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://.*$", r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:.*$"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), QUERY, 1)


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. carried out; above the root, .. does nothing."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.lit(""),
        lambda held, s: F.when(s == "..", F.regexp_replace(held, "/[^/]*$", "")).when(s == ".", held).otherwise(F.concat(held, F.lit("/"), s)),
    )
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), ended).otherwise(path)


def node_of(url: Column) -> Column:
    """What names a page among its aliases: host, path without dot segments, and query; null without a host."""
    found = F.concat(host_of(url), without_dots(path_of(url)), query_of(url))
    return F.when(host_of(url) != "", found)


def absolute(href: Column, url: Column) -> Column:
    """href as a whole url, seen from the page at url, by the rules for references; null where it leads to no page.

    What follows ? or # is never taken for a scheme, a host or a path.
    """
    href = F.trim(F.regexp_replace(href, AMPERSAND, "&"))
    origin, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    named = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    rest = F.substr(href, F.length(named) + 1)
    return (
        F.when(href.isNull() | (href == "") | (host_of(url) == "") & ~href.rlike(WHOLE), F.lit(None).cast("string"))
        .when(href.rlike(WHOLE), href)
        .when(href.rlike(SCHEME), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("#"), F.concat(origin, path, query_of(url)))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("/"), F.concat(origin, without_dots(named), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, named)), rest))
    )


def _rule_of(named: DataFrame, rules: DataFrame) -> DataFrame:
    """named(key, host, path) with rule and verdict of the longest fitting rule, where one fits.

    The host's suffixes at dots are looked up among the rules' hosts, those alone
    that have as many labels as some rule's host.
    """
    small = rules.count() <= BROADCAST_RULES
    near = F.broadcast(rules) if small else rules
    lengths = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).distinct().orderBy("n").limit(MOST_LENGTHS + 1).collect()]
    wanted = F.array(*[F.lit(n) for n in lengths]).cast("array<int>") if len(lengths) <= MOST_LENGTHS else F.sequence(F.lit(1), F.col("labels"))
    cut = named.select("key", "path", "host", F.size(F.split("host", r"\.")).alias("labels"))
    suffixes = F.transform(F.filter(wanted, lambda n: n <= F.col("labels")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    fits = cut.select("key", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(near, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("allowed"), rule.alias("rule")))
    return fits.groupBy("key").agg(best.alias("best")).select("key", "best.rule", F.when(F.col("best.allowed"), "allow").otherwise("block").alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the url's
    path starts with its path; the longest fitting one decides, an allow among
    equals. Pages that no rule fits are judged by their aliases: urls are linked
    by canonical links and refresh redirects in the html and by the rows of
    redirects(from_url, to_url), and each connected component takes over the
    decisions that rules make for any of its urls, targets outside pages
    included. An explicit allow in the component goes before a block; a component
    without a decision is allowed.

    Targets are resolved against the page's url (queries, fragments, folders, dot
    segments, &amp;); those of another kind, such as mailto:, are no urls. Urls are
    the same node when host, path without dot segments and query are, whatever
    scheme and fragment. A null url or one without :// has empty host and path and no
    aliases, and is allowed. Repeated rows each give a row; null ids too. Empty
    tables give no rows, and no rules allow all. Other columns are ignored.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else [F.lit(None).cast("string").alias("html")]))
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    canonical = F.transform(tags(CANONICAL), lambda tag: F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)]))
    refresh = F.transform(tags(REFRESH), lambda tag: F.regexp_extract(tag, TARGET, 1))
    read = own.select(
        F.monotonically_increasing_id().alias("key"), "page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"),
        F.transform(F.concat(canonical, refresh), lambda href: absolute(href, url)).alias("targets"),
    )
    read = materialise(read, "pages")
    links = read.select("node", F.explode("targets").alias("to")).where("to is not null")
    links = links.select(F.col("node").alias("a"), node_of(F.col("to")).alias("b"), F.col("to").alias("b_url"))
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"), F.col("to_url").alias("b_url"), F.col("from_url").alias("a_url"))
        links = links.withColumn("a_url", F.lit(None).cast("string")).unionByName(more)
        ends = links.select(F.col("b").alias("key"), F.col("b_url").alias("u")).union(links.select("a", "a_url"))
    else:
        ends = links.select(F.col("b").alias("key"), F.col("b_url").alias("u"))
    edges = materialise(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    ruled = _rule_of(read.where("host <> ''").select("key", "host", "path"), rules)
    judged = read.select("key", "page_id", "host", "path", "node").join(ruled, "key", "left")
    if edges.isEmpty():
        aliased = judged.withColumn("by_alias", F.lit(None).cast("string"))
    else:
        judged = materialise(judged, "judged")
        roots = materialise(connected_components(edges), "roots")
        # Decisions of every url of a component: those of pages, and of targets that are no page.
        outside = ends.where("key is not null and u is not null").select("key", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).distinct()
        decisions = judged.where("verdict is not null").select("node", "verdict").union(_rule_of(outside, rules).select("key", "verdict")).distinct()
        by_root = decisions.join(roots, "node").groupBy("component").agg(F.min("verdict").alias("by_alias"))  # allow sorts before block
        sizes = roots.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
        aliases = join_groups(roots, materialise(by_root.join(sizes, "component"), "decisions"), "component", "nodes", "inner").select("node", "by_alias")
        # Pages that a rule fits, or that have no node, need no alias; a url that many pages have is dealt by a broadcast.
        open_ = materialise(judged.where("verdict is null and node is not null"), "open")
        pages_of = open_.groupBy("node").agg(F.count(F.lit(1)).alias("pages"))
        aliased = join_groups(open_, materialise(aliases.join(pages_of, "node"), "aliases"), "node", "pages").drop("pages")
        settled = judged.where("verdict is not null or node is null").withColumn("by_alias", F.lit(None).cast("string"))
        aliased = aliased.unionByName(settled)
    return aliased.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_alias", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_lower(x: str) -> str:
    return f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _sql_dots(path: str) -> str:
    """Dot segments carried out one by one over the list of segments."""
    walk = f"list_reduce(string_split({path}, '/'), lambda held, s: CASE WHEN s = '..' THEN regexp_replace(held, '/[^/]*$', '') WHEN s = '.' THEN held ELSE held || '/' || s END)"
    return f"CASE WHEN regexp_matches({path}, '(^|/)\\.\\.?(/|$)') THEN {walk} || CASE WHEN regexp_matches({path}, '(^|/)\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"


def _sql_node(url: str) -> str:
    return f"nullif({_sql_lower(f"regexp_extract({url}, '{HOST}', 1)")}, '') || {_sql_dots(f"regexp_extract({url}, '{PATH}', 1)")} || regexp_extract({url}, '{QUERY}', 1)"


def _sql_quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_judged(rows: str) -> str:
    return f"""SELECT u.*, r.host || r.path AS rule, r.verdict AS ruled
  FROM {rows} u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY u.key ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1"""


OP8_SQL = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (
  SELECT row_number() OVER () AS key, page_id, url, html, {_sql_lower(f"regexp_extract(coalesce(url, ''), '{HOST}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path, regexp_extract(coalesce(url, ''), '{QUERY}', 1) AS query, {_sql_node("url")} AS node
  FROM pages
),
tags AS (
  SELECT key, unnest(regexp_extract_all(html, {_sql_quoted(CANONICAL)})) AS tag, true AS link FROM p
  UNION ALL SELECT key, unnest(regexp_extract_all(html, {_sql_quoted(REFRESH)})), false FROM p
),
hrefs AS (
  SELECT key, trim(regexp_replace(CASE WHEN link THEN regexp_extract(tag, {_sql_quoted(HREF)}, 1) || regexp_extract(tag, {_sql_quoted(HREF)}, 2) || regexp_extract(tag, {_sql_quoted(HREF)}, 3)
         ELSE regexp_extract(tag, {_sql_quoted(TARGET)}, 1) END, '{AMPERSAND}', '&', 'g')) AS href FROM tags
),
parts AS (  -- a reference is scheme://rest, or scheme:rest, or a path before ? or #, and what follows
  SELECT p.*, href, regexp_extract(href, '(?s)^([^?#]*)', 1) AS named, substr(href, length(regexp_extract(href, '(?s)^([^?#]*)', 1)) + 1) AS rest FROM p JOIN hrefs USING (key) WHERE href <> ''
),
q AS (
  SELECT *, CASE WHEN regexp_matches(href, '{WHOLE}') THEN href WHEN host = '' OR regexp_matches(href, '{SCHEME}') THEN NULL
         WHEN starts_with(href, '//') THEN 'http:' || href
         WHEN named = '' AND starts_with(rest, '#') THEN 'http://' || host || path || query
         WHEN named = '' THEN 'http://' || host || path || rest
         WHEN starts_with(named, '/') THEN 'http://' || host || {_sql_dots("named")} || rest
         ELSE 'http://' || host || {_sql_dots("(CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || named)")} || rest END AS target
  FROM parts
),
urls AS (SELECT key, page_id, host, path, node FROM p),
e AS (SELECT node AS a, {_sql_node("target")} AS b, target FROM q WHERE target IS NOT NULL),
two AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, b FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
judged AS ({_sql_judged("urls")}),
ends AS (SELECT DISTINCT b AS key, {_sql_lower(f"regexp_extract(target, '{HOST}', 1)")} AS host, regexp_extract(target, '{PATH}', 1) AS path FROM e WHERE b IS NOT NULL),
outside AS ({_sql_judged("ends")}),
decided AS (SELECT node, ruled FROM judged UNION SELECT key, ruled FROM outside),
alias AS (SELECT reach.a AS node, min(ruled) AS by_alias FROM reach JOIN decided ON decided.node = reach.b GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(ruled, by_alias, 'allow') AS verdict FROM judged LEFT JOIN alias USING (node)
"""
