"""URL filters with redirect equivalence.

Rules block or allow a host with its subdomains below a path; the longest rule that fits decides. Urls that
redirect to one another, or name one another as canonical, are aliases: connected components over
those links carry block decisions to the aliases that no rule decides. An explicit allow takes
precedence: a url that an allow rule fits stays allowed whatever its aliases are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ascii_lower, connected_components, materialize, table

#: So many rules at most are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000
#: Markup that makes one url an alias of another, and where the target stands in it.
LINK = r"(?i)<link\b[^>]*>"
CANONICAL = r"""(?i)["'\s/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
HREF = r"""(?i)["'\s/]href\s*=\s*["']?([^"'\s>]+)"""
META = r"(?i)<meta\b[^>]*>"
REFRESH = r"""(?i)["'\s/]http-equiv\s*=\s*["']?\s*refresh["'\s/>]"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


#: A url's scheme and host; a path with a dot segment, seen from behind its first slash.
ROOT = r"^[^:/?#]*://[^/?#]*"
DOTS = r"(^|/)\.\.?(/|$)"
#: A link that names its scheme, with a host and in general.
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """What two spellings of one resource share: A-Z of scheme and host lower-cased, no fragment."""
    at = F.instr(url, "://")
    host, _ = host_and_path(url)
    rest = F.substring(url, at + 3, F.length(url))
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.concat(ascii_lower(F.substring(url, F.lit(1), at + 2)), host, tail))


def folded(url: str | None) -> str | None:
    """A url whose path has no ``.`` and ``..`` segments left: each ``..`` takes the segment before it along, if there is one."""
    m = url and re.match(f"(?s)({ROOT})/([^?#]*)(.*)", url)
    if not m or not re.search(DOTS, m[2]):
        return url
    done, parts = [], m[2].split("/")
    for part in parts:
        if part == "..":
            del done[-1:]
        elif part != ".":
            done.append(part)
    # A last dot segment means the folder itself.
    end = "/" if done and parts[-1] in (".", "..") else ""
    return f"{m[1]}/{'/'.join(done)}{end}{m[3]}"


@F.pandas_udf(StringType())
def fold_dots(urls: pd.Series) -> pd.Series:
    """``folded`` over links: with array functions a path of many segments would be copied once for each."""
    return urls.map(folded, na_action="ignore")


def dotted(url: Column) -> Column:
    """Whether a url's path may have dot segments: cheap, so that only such urls go to ``fold_dots``."""
    return F.coalesce(url.rlike(ROOT + r"/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), F.lit(False))


def page_key(url: Column) -> Column:
    """The ``url_key`` of a page's own url, folded as links to it are."""
    return url_key(F.coalesce(fold_dots(F.when(dotted(url), url)), url))


def resolve(base: Column, href: Column) -> Column:
    """A link's absolute url: absolute, ``//host``, ``/path``, ``?query``, ``#fragment`` and plain relative forms; null for empty links and schemes without ``//``."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(base, ROOT, 0)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    return (
        F.when(href == "", None).when(href.rlike(ABSOLUTE), href).when(href.rlike(SCHEME) | (root == ""), None)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:/?#]*:", 0), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Alias links ``(a, b)`` by url key that pages declare: all their canonical links and refreshing redirects."""
    url, html = F.col(url_col), F.col(html_col)

    def targets(element: str, marked: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(element), F.lit(0)), lambda t: t.rlike(marked))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, target, 1)), lambda h: h != "")

    hrefs = F.concat(targets(LINK, CANONICAL, HREF), targets(META, REFRESH, TARGET))
    found = pages.select(url.alias("url"), F.explode(hrefs).alias("href"))
    named = found.select("url", fold_dots(resolve(F.col("url"), F.col("href"))).alias("target"))
    return named.select(page_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b"))


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct ``(host, path)``: ``(host, path, rule, verdict)``, where one fits."""
    n, most = rules.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1))).first()
    if n <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    # No rule fits a tail of more labels than any rule has, so a host of many labels stays small.
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = places.select("host", "path").distinct().where("host != ''").select("host", "path", F.explode(tails).alias("tail"))
    fits = each.join(rules, F.col("tail") == F.col("rule_host")).where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allowed"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as ``(verdict, "host/path")`` pairs, the path beginning at the first slash."""
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append((host.lower(), slash + path, rule, verdict))
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per input row.

    ``rules`` is a ``rule_table``; ``redirects`` adds ``(src, dst)`` urls to the links that pages declare.
    ``rule`` is the longest that fits (null where none does) and decides; of equally long ones allow wins. Else the url is
    blocked when a block rule decides any url of its component, as it stands or with its dot segments folded, and allowed otherwise. Null urls and urls without
    ``://`` have an empty host and path, no rule and no aliases; null html has no links; a third of all
    rows may share a url; an empty table gives none. Null ids are kept as they are; other columns, whatever their names, are not returned.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), page_key(F.col(url_col)).alias("key"), dotted(F.col(url_col)).alias("dotted"))
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionAll(redirects.select(page_key(F.col("src")).alias("a"), page_key(F.col("dst")).alias("b")))
    aliases = materialize(connected_components(materialize(links.where("a != b").distinct(), "links")), "aliases")

    nodes = aliases.select("root", *[c.alias(n) for c, n in zip(host_and_path(F.col("node")), ("host", "path"), strict=True)])
    decided = materialize(decide(rows.select("host", "path").unionAll(nodes.select("host", "path")), rules), "decided")
    block = decided.where("verdict = 'block'")
    # A url with dot segments may be blocked as it stands, which its folded key alone would not show.
    own = materialize(rows.where("dotted").join(block, ["host", "path"], "left_semi").select("key").distinct(), "own")
    blocked = nodes.join(block, ["host", "path"], "left_semi").select("root").unionAll(aliases.join(own.withColumnRenamed("key", "node"), "node", "left_semi").select("root")).distinct()
    hit = aliases.join(blocked, "root").select(F.col("node").alias("key")).unionAll(own).distinct()
    spread = materialize(hit.withColumn("spread", F.lit(True)), "spread")
    out = rows.join(decided, ["host", "path"], "left").join(spread, "key", "left")
    verdict = F.coalesce("verdict", F.when(F.col("spread"), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


OP5_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter_urls`` over ``pages`` with four rules."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, OP5_RULES))


_HOST = "coalesce(translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_KEY = (
    "CASE WHEN instr({0}, '://') > 0 THEN translate(regexp_extract({0}, '^((?s:.*?)://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    " || regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^#]*)', 1) END"
)


def _sql_rule(host: str, path: str) -> str:
    """The longest fitting rule, and its verdict, as a struct: the rules longest first."""
    cases = []
    for verdict, rule in sorted(OP5_RULES, key=lambda r: -len(r[1])):
        name, _, tail = rule.partition("/")
        cases.append(f"WHEN ({host} = '{name}' OR {host} LIKE '%.{name}') AND starts_with({path}, '/{tail}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return f"CASE {' '.join(cases)} END"


_q = lambda p: p.replace("'", "''")
_ROOT = f"regexp_extract(url, '{ROOT}', 0)"
_HREFS = lambda element, marked, target: f"list_transform(list_filter(regexp_extract_all(html, '{_q(element)}', 0), lambda t: regexp_matches(t, '{_q(marked)}')), lambda t: regexp_extract(t, '{_q(target)}', 1))"
_FOLDER = "regexp_extract(url, '^[^:/?#]*://[^/?#]*(/(?:[^?#]*/)?)?', 1)"
_PARTS = f"list_reduce(list_transform(string_split(regexp_extract({{0}}, '{ROOT}/([^?#]*)', 1), '/'), lambda s: [s]), lambda done, s: CASE s[1] WHEN '.' THEN done WHEN '..' THEN done[:-2] ELSE done || s END, CAST([] AS VARCHAR[]))"
_FOLD = (
    f"CASE WHEN regexp_matches({{0}}, '{ROOT}/') AND regexp_matches(regexp_extract({{0}}, '{ROOT}/([^?#]*)', 1), '{DOTS}') THEN regexp_extract({{0}}, '{ROOT}', 0) || '/' || array_to_string({_PARTS}, '/')"
    f" || CASE WHEN regexp_matches(regexp_extract({{0}}, '{ROOT}/([^?#]*)', 1), '(^|/)\\.\\.?$') AND len({_PARTS}) > 0 THEN '/' ELSE '' END || regexp_extract({{0}}, '[?#](?s:.*)$', 0) ELSE {{0}} END"
)
OP5_SQL = f"""
WITH RECURSIVE named AS (
  SELECT url, {_HREFS(LINK, CANONICAL, HREF)} || {_HREFS(META, REFRESH, TARGET)} AS hrefs FROM pages),
found AS (
  SELECT url, replace(trim(href), '&amp;', '&') AS href FROM (SELECT url, unnest(hrefs) AS href FROM named) WHERE href <> ''),
targets AS (
    SELECT url, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '{ABSOLUTE}') THEN href WHEN regexp_matches(href, '{SCHEME}') OR {_ROOT} = '' THEN NULL
      WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:/?#]*:', 0) || href WHEN starts_with(href, '/') THEN {_ROOT} || href
      WHEN starts_with(href, '?') THEN regexp_extract(url, '^[^?#]*', 0) || href WHEN starts_with(href, '#') THEN regexp_extract(url, '^[^#]*', 0) || href
      ELSE {_ROOT} || CASE WHEN {_FOLDER} = '' THEN '/' ELSE {_FOLDER} END || href END AS target FROM found),
resolved AS (SELECT {_FOLD.format('url')} AS url, {_FOLD.format('target')} AS target FROM targets),
links AS (SELECT {_KEY.format('url')} AS a, {_KEY.format('target')} AS b FROM resolved),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
nodes AS (SELECT DISTINCT a AS node, {_HOST.format('a')} AS host, {_PATH.format('a')} AS path FROM both_ways),
judged AS (SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_KEY.format('whole')} AS key FROM (SELECT *, {_FOLD.format('url')} AS whole FROM pages)),
blocked(node) AS (
  (SELECT node FROM nodes WHERE ({_sql_rule('host', 'path')}).verdict = 'block' UNION SELECT key FROM judged WHERE ({_sql_rule('host', 'path')}).verdict = 'block')
  UNION SELECT e.b FROM blocked JOIN both_ways e ON e.a = blocked.node),
ruled AS (SELECT *, {_sql_rule('host', 'path')} AS r FROM judged)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN key IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM ruled
"""
