"""The graph queries over the test tables, each with the SQL that states its rows.

Query callables take (spark, sf_dir). The SQL is plain and independent of the operators; it sees the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.adapters import is_external, route_language
from ..operators import indexing, locate, materialize, paths, reconcile, relations, search, store, symbols
from ..operators.buckets import GraphTables
from ..operators.paging import Cursor, page
from ..operators.snapshots import SnapshotStore
from ..operators.symbols import NodeFilter
from ..operators.tables import fresh_path, written
from ..sources import facts, files
from . import schema
from .projection import ROOT, Graph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = "fqn, uri, range_start_line, range_start_col"


def query(sql: str | None = None):
    """Register a function of a Graph under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views("", sql)
        return f

    return register


def shown(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("id", "fqn", "uri", *more)


# Scalar mappings and predicates

_LANGUAGE = "CASE {0} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' END"
_EXTENSION = "lower(regexp_extract(uri, '\\.([^.]*)$', 1))"


@query(f"SELECT uri, {_LANGUAGE.format(_EXTENSION)} AS language FROM v_text")
def route_languages(g: Graph):
    return g.texts.select("uri", route_language(F.col("uri")).alias("language"))


@query("""SELECT id, NOT starts_with(uri, 'file:///repo/a') OR (language = 'typescript' AND contains(uri, '/node_modules/')) OR (language = 'rust' AND contains(uri, '/target/'))
  OR (language = 'go' AND contains(uri, '/vendor/')) AS is_external FROM v_node""")
def external_nodes(g: Graph):
    return g.nodes.select("id", is_external(F.col("uri"), f"{ROOT}/a", F.col("language")).alias("is_external"))


@query("""SELECT id, CASE WHEN node_kind = 'Variable' AND construct = 'type' THEN 'TypeAlias' ELSE node_kind END AS kind_label,
  CASE kind WHEN 2 THEN 'Module' WHEN 5 THEN 'Class' WHEN 6 THEN 'Method' WHEN 11 THEN 'Interface' WHEN 12 THEN 'Function' WHEN 13 THEN 'Variable' ELSE concat('Unknown(', kind, ')') END AS symbol_kind FROM v_node""")
def kind_labels(g: Graph):
    return g.nodes.select("id", T.kind_label(F.col("node_kind"), F.col("construct")).alias("kind_label"), T.symbol_kind(F.col("kind")).alias("symbol_kind"))


@query("SELECT uri, replace(ltrim(regexp_replace(replace(uri, 'file:///repo', ''), '\\.[^.]*$', ''), '/'), '/', '.') AS module_path FROM v_text")
def module_paths(g: Graph):
    return g.texts.select("uri", T.module_path(F.col("uri"), ROOT).alias("module_path"))


@query("""SELECT id, CASE WHEN contains(fqn, '.') THEN substr(fqn, 1, length(fqn) - length(list_extract(string_split(fqn, '.'), -1)) - 1) ELSE '' END AS container,
  list_extract(string_split(fqn, '.'), -1) AS leaf, substr(uri, 8) AS path FROM v_node""")
def name_parts(g: Graph):
    return g.nodes.select("id", T.container_prefix(F.col("fqn")).alias("container"), T.leaf(F.col("fqn")).alias("leaf"), T.uri_to_path(F.col("uri")).alias("path"))


@query(f"SELECT uri FROM v_text WHERE {_LANGUAGE.format(_EXTENSION)} IS NOT NULL AND NOT contains(uri, '/src1/')")
def discover_files(g: Graph):
    return files.discover(g.texts.select("uri"), ROOT, [("docs", "src1/")])


HOVER = """SELECT uri, sel_start_line AS line, sel_start_col AS character,
  CASE id % 5 WHEN 0 THEN concat('```ts', chr(10), 'export type ', name, chr(10), '```') WHEN 1 THEN concat('(method) ', name) WHEN 2 THEN concat('  async function ', name, '() ') WHEN 3 THEN '   ' ELSE concat('class ', name) END AS contents
  FROM v_node"""


@query("""SELECT id, CASE id % 5 WHEN 0 THEN 'type' WHEN 2 THEN 'function' WHEN 4 THEN 'class' END AS word FROM v_node""")
def construct_from_hover(g: Graph):
    hover = g.sql(HOVER)
    at = g.nodes.select("id", "uri", F.col("sel_start_line").alias("line"), F.col("sel_start_col").alias("character"))
    return at.join(hover, ["uri", "line", "character"]).select("id", T.construct_from_hover(F.col("contents")).alias("word"))


@query("""SELECT fqn, uri, name, language, CASE WHEN node_kind = 'Variable' AND construct = 'type' THEN 'TypeAlias' ELSE node_kind END AS kind_label, kind AS kind_num, construct, least(4294967295, range_start_line) AS start_line,
  least(4294967295, range_start_col) AS start_col, least(4294967295, range_end_line) AS end_line, least(4294967295, range_end_col) AS end_col, least(4294967295, sel_start_line) AS sel_start_line, least(4294967295, sel_start_col) AS sel_start_col,
  least(4294967295, sel_end_line) AS sel_end_line, least(4294967295, sel_end_col) AS sel_end_col, signature, CAST(NULL AS VARCHAR) AS documentation, is_external FROM v_node""")
def node_results(g: Graph):
    """All fields of every node's result."""
    spans = [F.col(f"{c}.{e}.{w}").alias(f"{p}{e}_{s}") for c, p in (("range", ""), ("selection_range", "sel_")) for e in ("start", "end") for w, s in (("line", "line"), ("character", "col"))]
    return symbols.node_result(g.nodes).select("fqn", "uri", "name", "language", "kind_label", "kind_num", "construct", *spans, "signature", "documentation", "is_external")


@query("SELECT id, substr(md5(concat_ws(chr(1), name, CAST(kind AS VARCHAR), coalesce(detail, chr(2)), range_start_line, range_start_col, range_end_line, range_end_col)), 1, 16) AS fingerprint FROM v_node")
def signature_fingerprints(g: Graph):
    bounds = [F.col(c) for c in ("range_start_line", "range_start_col", "range_end_line", "range_end_col")]
    return g.nodes.select("id", T.signature_fingerprint(F.col("name"), F.col("kind"), F.col("detail"), *bounds).alias("fingerprint"))


@query("SELECT uri, md5(text) AS hash FROM v_text")
def content_hashes(g: Graph):
    return g.texts.select("uri", T.content_hash(F.col("text")).alias("hash"))


# Scans, search, hints and pages


@query("SELECT id, fqn, uri FROM v_node WHERE valid AND language = 'go'")
def list_nodes(g: Graph):
    return shown(symbols.list_nodes(g.nodes, "go"))


@query("SELECT DISTINCT uri FROM v_node WHERE NOT orphan")
def known_uris(g: Graph):
    return symbols.known_uris(g.nodes)


@query("SELECT uri, CAST(sum(CASE WHEN fqn <> replace(ltrim(regexp_replace(replace(uri, 'file:///repo', ''), '\\.[^.]*$', ''), '/'), '/', '.') THEN 1 ELSE 0 END) AS BIGINT) AS real_nodes FROM v_node GROUP BY uri")
def count_real_nodes(g: Graph):
    return symbols.count_real_nodes(g.nodes, ROOT)


@query("SELECT id, fqn, uri FROM v_node WHERE fqn = 'node_modules.brand_13.part_1' OR id = 2000000000001 OR uri = 'file:///repo/node_modules/Brand_11.ts'")
def point_lookups(g: Graph):
    n = g.nodes
    return shown(symbols.by_fqn(n, "node_modules.brand_13.part_1")).unionByName(shown(symbols.by_id(n, 2000000000001))).unionByName(shown(symbols.by_uri(n, "file:///repo/node_modules/Brand_11.ts"))).distinct()


def _found(where: str, limit: int = 100) -> str:
    return f"SELECT id, fqn, uri, n > {limit} AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {KEY}) AS r, count(*) OVER () AS n FROM v_node WHERE valid AND {where}) WHERE r <= {limit}"


@query(_found("NOT is_external AND list_contains(string_split(fqn, '.'), 'Group')"))
def find_symbol_segment(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "Group"), "has_more")


@query(_found("NOT is_external AND contains(fqn, '00001')", 500))
def find_symbol_contains(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "00001", "contains", limit=9999), "has_more")


@query(_found("fqn = 'users.u0.user_7'", 1))
def find_symbol_exact(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "users.u0.user_7", "exact", node_filter=NodeFilter(include_external=True), limit=0), "has_more")


_FUZZY = "len(list_filter(string_split(fqn, '.'), lambda s: 1 - levenshtein(s, '{0}') / greatest(length(s), {1}, 1) >= 0.7)) > 0"


@query(_found("NOT is_external AND " + _FUZZY.format("Supplier_00000012", 17)))
def find_symbol_fuzzy(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "Supplier_00000012", "fuzzy"), "has_more")


@query(_found("NOT is_external AND " + _FUZZY.format("Supplier_00000012", 17)))
def find_symbol_fuzzy_indexed(g: Graph):
    return shown(search.find_symbol(search.SearchIndex.build(g.kept_nodes), g.kept_nodes, "Supplier_00000012", "fuzzy"), "has_more")


@query(_found("NOT is_external AND list_contains(string_split(lower(fqn), '.'), 'group')", 20))
def find_symbol_segment_indexed(g: Graph):
    return shown(search.find_symbol(search.SearchIndex.build(g.kept_nodes), g.kept_nodes, "gROUP", ignore_case=True, limit=20), "has_more")


@query(_found("NOT is_external AND list_contains(string_split(lower(fqn), '.'), 'group')", 20))
def find_symbol_ignore_case(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "gROUP", ignore_case=True, limit=20), "has_more")


@query("SELECT fqn, has_more FROM (" + _found("NOT is_external AND contains(fqn, '')") + ")")
def find_symbol_brief(g: Graph):
    return symbols.find_symbol(g.nodes, "", "contains", brief=True)


@query(_found("NOT is_external AND language = 'python' AND CASE WHEN node_kind = 'Variable' AND construct = 'type' THEN 'TypeAlias' ELSE node_kind END IN ('TypeAlias', 'Class')"))
def filter_kind_language(g: Graph):
    return shown(symbols.find_symbol(g.nodes, "", "contains", node_filter=NodeFilter("python", ("TypeAlias", "Class"))), "has_more")


@query(_found("fqn > 'node_modules.brand_21'", 30))
def page_next(g: Graph):
    return shown(page(symbols.list_nodes(g.nodes), 30, Cursor("node_modules.brand_21", "", 0, 0).encode()), "has_more")


@query("SELECT DISTINCT fqn FROM v_node WHERE valid AND NOT is_external AND list_contains(string_split(fqn, '.'), 'Group') ORDER BY fqn LIMIT 10")
def hint_segment(g: Graph):
    return symbols.hints(g.nodes, "some.where.Group")


@query(f"SELECT DISTINCT fqn FROM v_node WHERE valid AND NOT is_external AND {_FUZZY.format('Groop', 5)} ORDER BY fqn LIMIT 10")
def hint_fuzzy(g: Graph):
    return symbols.hints(g.nodes, "Groop")


@query(f"SELECT DISTINCT fqn FROM v_node WHERE valid AND NOT is_external AND {_FUZZY.format('Groop', 5)} ORDER BY fqn LIMIT 10")
def hint_fuzzy_indexed(g: Graph):
    return search.hints(search.SearchIndex.build(g.kept_nodes), g.kept_nodes, "some.where.Groop")


# Positions

_POINTS = "SELECT uri, sel_start_line + id % 9 AS line, id % 6 AS character FROM v_node"
_INSIDE = """(range_start_line < p.line OR (range_start_line = p.line AND range_start_col <= p.character)) AND (range_end_line > p.line OR (range_end_line = p.line AND range_end_col >= p.character))"""
_INNERMOST = "SELECT p.uri, p.line, p.character, n.id AS node_id, row_number() OVER (PARTITION BY p.uri, p.line, p.character ORDER BY n.range_end_line - n.range_start_line, n.range_end_col - n.range_start_col, n.id) AS r FROM (SELECT DISTINCT uri, line, character FROM ({0})) p JOIN v_node n ON n.uri = p.uri AND " + _INSIDE


@query(f"SELECT uri, line, character, node_id FROM ({_INNERMOST.format(_POINTS)}) WHERE r = 1")
def find_node_by_position(g: Graph):
    return locate.innermost(g.sql(_POINTS), g.nodes)


FACTS = """SELECT 'definition' AS op, c.uri, c.sel_start_line + 2 AS line, CAST(b.l_linenumber AS BIGINT) AS character, s.uri AS target_uri, s.sel_start_line + b.l_orderkey % 8 AS target_line, s.sel_start_col AS target_character,
    CAST(row_number() OVER (PARTITION BY b.c_custkey, b.l_linenumber ORDER BY b.l_suppkey % 7 DESC, b.l_suppkey DESC, b.l_orderkey) AS BIGINT) AS rank
  FROM v_bought b JOIN v_node c ON c.id = 1000000000000 + b.c_custkey JOIN v_node s ON s.id = 2000000000000 + b.l_suppkey"""


def _definitions(g: Graph) -> DataFrame:
    """``FACTS``, written: an answer's rows are ranked where its customer's lines meet."""
    order = Window.partitionBy("c_custkey", "l_linenumber").orderBy((F.col("l_suppkey") % 7).desc(), F.col("l_suppkey").desc(), "l_orderkey")
    rows = g.bought("s").withColumn("rank", F.row_number().over(order).cast("long"))
    return written(rows.selectExpr("'definition' AS op", "c_uri AS uri", "c_sel_start_line + 2 AS line", "CAST(l_linenumber AS BIGINT) AS character", "s_uri AS target_uri", "s_sel_start_line + l_orderkey % 8 AS target_line", "s_sel_start_col AS target_character", "rank"), "facts")


_REQUESTS = "SELECT DISTINCT uri, sel_start_line + 2 AS line, CAST(1 + id % 4 AS BIGINT) AS character FROM v_node"


@query(f"""WITH f AS ({FACTS}), q AS ({_REQUESTS}), t AS (SELECT DISTINCT f.* FROM f JOIN q USING (uri, line, character)),
  i AS (SELECT * FROM ({_INNERMOST.format('SELECT target_uri AS uri, target_line AS line, target_character AS character FROM t')}) WHERE r = 1)
  SELECT DISTINCT t.uri, t.line, t.character, t.rank, i.node_id FROM t JOIN i ON i.uri = t.target_uri AND i.line = t.target_line AND i.character = t.target_character""")
def find_definition_at(g: Graph):
    return locate.find_definition(g.kept(_REQUESTS), _definitions(g), g.kept_nodes)


@query(f"""WITH f AS ({FACTS}), q AS ({_REQUESTS}), t AS (SELECT DISTINCT f.* FROM f JOIN q USING (uri, line, character)),
  i AS (SELECT * FROM ({_INNERMOST.format('SELECT target_uri AS uri, target_line AS line, target_character AS character FROM t UNION ALL SELECT uri, line, character FROM q')}) WHERE r = 1),
  d AS (SELECT t.uri, t.line, t.character, arg_min(i.node_id, t.rank) AS node_id FROM t JOIN i ON i.uri = t.target_uri AND i.line = t.target_line AND i.character = t.target_character GROUP BY ALL)
  SELECT q.uri, q.line, q.character, coalesce(d.node_id, i.node_id) AS anchor_id FROM q LEFT JOIN d USING (uri, line, character) LEFT JOIN i USING (uri, line, character) WHERE coalesce(d.node_id, i.node_id) IS NOT NULL""")
def resolve_anchors(g: Graph):
    return locate.resolve_anchors(g.kept(_REQUESTS), _definitions(g), g.kept_nodes)


# Relations


def _related(kind: str, here: str, there: str, anchors: str, more: str = "true") -> str:
    site = "concat(site_uri, ':', site_start_line, ':', site_start_col)"
    return f"""SELECT e.{here} AS anchor_id, n.id, n.fqn, CAST(count(*) AS BIGINT) AS n_sites, string_agg({site}, ' ' ORDER BY site_uri, site_start_line, site_start_col) AS sites
  FROM v_edge e JOIN v_node n ON n.id = e.{there} WHERE e.valid AND n.valid AND e.edge_type = '{kind}' AND {anchors} AND {more} GROUP BY ALL"""


def _sites(df: DataFrame, *more: str) -> DataFrame:
    line = F.transform("sites", lambda s: F.concat(s["uri"], F.lit(":"), s["start_line"].cast("string"), F.lit(":"), s["start_col"].cast("string")))
    return df.select("anchor_id", "id", "fqn", F.size("sites").cast("long").alias("n_sites"), F.array_join(line, " ").alias("sites"), *more)


def anchors_where(g: Graph, where: str) -> DataFrame:
    return g.nodes.where(where).select(F.col("id").alias("anchor_id"))


@query(_related("calls", "dst_id", "src_id", "true", "NOT n.is_external"))
def find_callers(g: Graph):
    """Callers of every node, grouped, with call sites in order."""
    a = anchors_where(g, "true")
    return _sites(relations.related(a, g.edges, g.nodes, "calls", True, NodeFilter()))


@query(_related("calls", "src_id", "dst_id", "true"))
def find_callees(g: Graph):
    a = anchors_where(g, "true")
    return _sites(relations.related(a, g.edges, g.nodes, "calls", False, NodeFilter(include_external=True)))


@query(_related("references", "dst_id", "src_id", "true", "n.language = 'go' AND NOT n.is_external"))
def find_references(g: Graph):
    a = anchors_where(g, "true")
    return _sites(relations.related(a, g.edges, g.nodes, "references", True, NodeFilter("go")))


@query(f"""WITH g AS ({_related("calls", "dst_id", "src_id", "e.dst_id = 2000000000001", "NOT n.is_external AND n.language = 'python'")}),
  r AS (SELECT g.*, row_number() OVER (ORDER BY g.fqn) AS r, count(*) OVER () AS n FROM g) SELECT anchor_id, id, fqn, n_sites, sites, n > 5 AS has_more FROM r WHERE r <= 5""")
def callers_filtered_page(g: Graph):
    one = anchors_where(g, "id = 2000000000001")
    out = relations.find_callers(one, g.edges, g.nodes, NodeFilter("python"), 5)
    return _sites(out, "has_more")


@query(_related("contains", "dst_id", "src_id", "true").replace("concat(site_uri, ':', site_start_line, ':', site_start_col)", "''").replace("count(*)", "count(site_uri)"))
def containers_without_sites(g: Graph):
    return _sites(relations.related(anchors_where(g, "true"), g.edges, g.nodes, "contains", True))


# Paths

_USERS = "SELECT DISTINCT e.src_id, e.dst_id FROM v_edge e JOIN v_node n ON n.id = e.dst_id WHERE e.valid AND n.valid AND e.edge_type = 'calls' AND e.src_id >= 8000000000000"


@query(f"""WITH RECURSIVE l AS MATERIALIZED ({_USERS}), s AS (SELECT min(id) AS id FROM v_node WHERE id >= 8000000000000),
  walk(id, depth) AS (SELECT id, 0 FROM s UNION SELECT l.dst_id, walk.depth + 1 FROM walk JOIN l ON l.src_id = walk.id WHERE walk.depth < 6)
  SELECT s.id AS start_id, walk.id, CAST(min(walk.depth) AS BIGINT) AS depth FROM walk, s GROUP BY s.id, walk.id""")
def call_reachability(g: Graph):
    start = g.kept_nodes.where("id >= 8000000000000").agg(F.min("id").alias("start_id"))
    return paths.reachable_within(paths.CallIndex.build(g.edges, g.kept_nodes), start, 6)


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT u.*, r.rank FROM ({_USERS}) u JOIN (SELECT id, row_number() OVER (ORDER BY {KEY}, id) AS rank FROM v_node WHERE valid) r ON r.id = u.dst_id),
  s AS (SELECT min(id) AS id FROM v_node WHERE id >= 8000000000000),
  walk(id, depth, ranks, path) AS (
    SELECT id, 0, CAST([] AS BIGINT[]), [id] FROM s
    UNION ALL SELECT dst_id, depth, ranks, path FROM (
      SELECT l.dst_id, walk.depth + 1 AS depth, list_append(walk.ranks, l.rank) AS ranks, list_append(walk.path, l.dst_id) AS path, row_number() OVER (PARTITION BY l.dst_id ORDER BY list_append(walk.ranks, l.rank)) AS nth
      FROM walk JOIN l ON l.src_id = walk.id WHERE walk.depth < 8) WHERE nth = 1),
  best AS (SELECT id, min(depth) AS depth, arg_min(path, depth) AS path FROM walk GROUP BY id)
  SELECT t.hops AS offset_users, best.id IS NOT NULL AS reachable, coalesce(array_to_string(best.path, ' '), '') AS path, best.id IS NULL AND (SELECT max(depth) FROM best) = 8 AS limit_reached
  FROM (VALUES (0), (9), (30), (31), (75)) t(hops) CROSS JOIN s LEFT JOIN best ON best.id = s.id + t.hops""")
def call_path_bfs(g: Graph):
    """Shortest call paths from the first user to five others, by the bounded search: their nodes, ties in the queue's order, and whether a limit cut the search."""
    first = g.kept_nodes.where("id >= 8000000000000").agg(F.min("id").alias("start_id"))
    hops = F.explode(F.array(*[F.lit(h) for h in (0, 9, 30, 31, 75)])).alias("request")
    asked = first.select(hops, "start_id").withColumn("target_id", F.col("start_id") + F.col("request"))
    found = paths.find_call_paths(paths.CallIndex.build(g.edges, g.kept_nodes), asked, 8)
    return found.select(F.col("request").alias("offset_users"), "reachable", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"), "limit_reached")


@query("""SELECT container_id AS ancestor_id, id, CAST(1 AS BIGINT) AS depth FROM v_node WHERE container_id IS NOT NULL
  UNION ALL SELECT u.container_id, d.id, 2 FROM v_node d JOIN v_node u ON u.id = d.container_id WHERE u.container_id IS NOT NULL""")
def contains_descendants(g: Graph):
    return paths.descendants(g.nodes)


# Merges

_EDGE = "src_id, dst_id, edge_type, site_uri, site_start_line, site_start_col"


@query("""SELECT src_id, dst_id, edge_type, site_start_line, site_start_col, max(r.valid) AS valid FROM v_edge_raw r JOIN v_node n ON n.id = src_id GROUP BY ALL""")
def upsert_edges_dedup(g: Graph):
    """Located edges merged into a table that holds some of them as invalid."""
    raw = g.raw_edges.selectExpr("CAST(NULL AS BIGINT) AS id", *_EDGE.split(", "), "site_start_line AS site_end_line", "site_start_col + 3 AS site_end_col", "valid")
    held = g.edges.where("edge_type != 'contains' and dst_id % 2 = 0").withColumn("valid", F.lit(False)).withColumn("id", F.xxhash64(*_EDGE.split(", "))).select(*raw.columns)
    return store.upsert_edges(held, raw).select("src_id", "dst_id", "edge_type", "site_start_line", "site_start_col", "valid")


@query("""SELECT id, fqn, CASE WHEN id % 3 = 0 THEN NULL ELSE construct END AS construct, CASE WHEN id % 3 = 0 THEN sel_start_line + 1 ELSE sel_start_line END AS sel_start_line FROM v_node""")
def upsert_nodes(g: Graph):
    """A third of the nodes come again without construct and moved; ids stay."""
    n = g.kept_nodes
    again = n.where("id % 3 = 0").withColumn("construct", F.lit(None).cast("string")).withColumn("sel_start_line", F.col("sel_start_line") + 1).withColumn("id", -F.col("id"))
    return store.upsert_nodes(n, again)[0].select("id", "fqn", "construct", "sel_start_line")


@query("""SELECT id, CASE WHEN id % 5 = 1 THEN concat(fqn, '_moved') ELSE fqn END AS fqn, CASE WHEN id % 5 = 2 THEN range_start_line + 3 ELSE range_start_line END AS range_start_line FROM v_node
  UNION ALL SELECT -1, concat(fqn, '_taker'), range_start_line FROM v_node WHERE id % 5 = 2""")
def upsert_conflicts(g: Graph):
    """Nodes renamed in place, nodes moved by name, and new names at the places that those left; new rows show as -1."""
    n, r = g.kept_nodes, F.col("id") % 5
    renamed = n.where(r == 1).withColumn("fqn", F.concat("fqn", F.lit("_moved")))
    moved = n.where(r == 2).withColumn("range_start_line", F.col("range_start_line") + 3)
    takers = n.where(r == 2).withColumn("fqn", F.concat("fqn", F.lit("_taker")))
    out, _ = store.upsert_nodes(n, renamed.unionByName(moved).unionByName(takers).withColumn("id", F.xxhash64("fqn")))
    held = n.select("id", F.lit(True).alias("held"))
    return out.join(held, "id", "left").select(F.when(F.col("held"), F.col("id")).otherwise(F.lit(-1).cast("long")).alias("id"), "fqn", "range_start_line")


@query("""SELECT src_id, edge_type, valid AND NOT (edge_type = 'calls' AND src_id % 2 = 0) AS valid, CAST(count(*) AS BIGINT) AS edges FROM v_edge GROUP BY ALL""")
def invalidate_outgoing(g: Graph):
    out = store.invalidate_outgoing_calls(g.edges, anchors_where(g, "id % 2 = 0"))
    return out.groupBy("src_id", "edge_type", "valid").agg(F.count("*").alias("edges"))


@query("""SELECT src_id, dst_id, edge_type, site_start_line, site_start_col, valid AND src_id % 10 <> 3 AS valid, CAST(NULL AS BIGINT) AS new_id FROM v_edge
  UNION ALL SELECT id, id, 'inherits', 0, 0, true, CAST(-1 AS BIGINT) FROM v_node WHERE id % 10 = 3 AND kind = 6""")
def merge_edge_buckets(g: Graph):
    """Edges in bucketed tables: those of a tenth of the sources come again as invalid, and each of their methods with a new edge; ids of old edges show as null, new ones as -1."""
    tables = GraphTables(g.spark, fresh_path(g.spark, "graph"), 16)
    tables.edges.replace(g.edges.withColumn("id", F.monotonically_increasing_id()).select(*tables.edges.columns), list(range(16)), deal=False)
    old = tables.edges.read()
    tables.meta.merge(g.spark.createDataFrame([("last_edge_id", str(1 << 50))], schema.META))
    again = old.where("src_id % 10 = 3").withColumn("id", F.lit(None).cast("long")).withColumn("valid", F.lit(False))
    fresh = g.sql("SELECT CAST(NULL AS BIGINT) AS id, id AS src_id, id AS dst_id, 'inherits' AS edge_type, uri AS site_uri, CAST(0 AS BIGINT) AS site_start_line, CAST(0 AS BIGINT) AS site_start_col, CAST(0 AS BIGINT) AS site_end_line, CAST(1 AS BIGINT) AS site_end_col, true AS valid FROM v_node WHERE id % 10 = 3 AND kind = 6")
    tables.upsert_edges(again.unionByName(fresh))
    return tables.edges.read().select("src_id", "dst_id", "edge_type", "site_start_line", "site_start_col", "valid", F.when(F.col("id") > (1 << 50), F.lit(-1).cast("long")).alias("new_id"))


@query("""WITH moved AS (SELECT id FROM v_node WHERE id % 17 = 4 AND container_id IS NOT NULL), gone AS (SELECT n.id FROM v_node n JOIN moved ON n.id = moved.id + 1 WHERE n.container_id IS NOT NULL)
  SELECT 'node' AS what, v.id AS a, v.container_id AS b, CASE WHEN v.id IN (SELECT id FROM moved) AND v.id + 1 IN (SELECT id FROM gone) THEN 1 ELSE 0 END AS n FROM v_node v WHERE v.id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'new', 1, NULL, 0 FROM moved JOIN gone ON gone.id = moved.id + 1
  UNION ALL SELECT 'edge', src_id, dst_id, CAST(count(*) AS INTEGER) FROM v_edge WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone) GROUP BY src_id, dst_id
  UNION ALL SELECT 'mark', id, NULL, 0 FROM v_node WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'hash', id, NULL, 0 FROM v_node WHERE id % 5 = 0 AND id NOT IN (SELECT id FROM gone)""")
def upsert_cascade(g: Graph):
    """Some members move to others' places, which so go with edges, hashes and marks, while as many new names come: these show whether their ids were ever used."""
    tables, n = GraphTables(g.spark, fresh_path(g.spark, "graph"), 16), g.kept_nodes
    every = list(range(16))
    tables.nodes.replace(n, every)
    tables.edges.replace(g.edges.withColumn("id", F.xxhash64(*_EDGE.split(", "))), every)
    anchors = n.select(F.col("id").alias("anchor_id"))
    tables.marks.replace(anchors.where("anchor_id % 3 = 0").withColumn("edge_type", F.lit("calls")), every)
    tables.cache.replace(anchors.where("anchor_id % 5 = 0").withColumn("content_hash", F.lit("h")), every)
    place = ["uri", "name", "range_start_line", "range_start_col"]
    members = n.where("container_id is not null")
    aims = members.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"_{c}") for c in place])
    moved = members.where("id % 17 = 4").join(aims, "id")
    fresh = moved.withColumn("fqn", F.concat("fqn", F.lit(".fresh"))).withColumn("uri", F.concat("uri", F.lit(".fresh")))
    for c in place:
        moved = moved.withColumn(c, F.col(f"_{c}"))
    tables.upsert_nodes(moved.select(*n.columns).unionByName(fresh.select(*n.columns)), "fqn")
    out, held = tables.nodes.read(), n.select("id", F.lit(True).alias("held"), F.col("range_start_line").alias("was"), F.col("uri").alias("was_uri"))
    shown = out.join(held, "id", "left")
    none = F.lit(None).cast("long")
    old = shown.where("held").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("container_id").alias("b"), ((F.col("uri") != F.col("was_uri")) | (F.col("range_start_line") != F.col("was"))).cast("int").alias("n"))
    new = shown.where("held is null").select(F.lit("new"), F.lit(1).cast("long"), none, F.lit(0))
    edges = tables.edges.read().groupBy("src_id", "dst_id").agg(F.count("*").cast("int").alias("n")).select(F.lit("edge"), "src_id", "dst_id", "n")
    marks, hashes = (t.read().select(F.lit(what), "anchor_id", none, F.lit(0)) for what, t in (("mark", tables.marks), ("hash", tables.cache)))
    return old.union(new).union(edges).union(marks).union(hashes)


@query("""SELECT edge_type, valid AND src_id % 7 <> 0 AND dst_id % 7 <> 0 AS valid, CAST(count(*) AS BIGINT) AS edges FROM v_edge GROUP BY ALL""")
def invalidate_incident(g: Graph):
    out = store.invalidate_incident(g.edges, g.nodes.where("id % 7 = 0").select("id"))
    return out.groupBy("edge_type", "valid").agg(F.count("*").alias("edges"))


@query("""WITH gone AS (SELECT id FROM v_node WHERE id % 13 = 0 OR kind = 5)
  SELECT 'node' AS what, id AS a, CASE WHEN container_id IN (SELECT id FROM gone) THEN NULL ELSE container_id END AS b, CAST(1 AS BIGINT) AS n FROM v_node WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'edge', src_id, dst_id, count(*) FROM v_edge WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone) GROUP BY src_id, dst_id
  UNION ALL SELECT w.what, id, NULL, 1 FROM v_node, (VALUES ('hash'), ('mark')) w(what) WHERE id NOT IN (SELECT id FROM gone)""")
def delete_cascade(g: Graph):
    n, e = g.kept("SELECT id, container_id, kind FROM v_node"), g.edges
    hashes, marks = n.select(F.col("id").alias("anchor_id"), F.lit("h").alias("content_hash")), n.select(F.col("id").alias("anchor_id"), F.lit("calls").alias("edge_type"))
    left, edges, hashes, marks = store.delete_nodes(n, e, hashes, marks, n.where("id % 13 = 0 or kind = 5").select("id"))
    side = [t.select(F.lit(what).alias("what"), F.col("anchor_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1).cast("long").alias("n")) for what, t in (("hash", hashes), ("mark", marks))]
    return side[0].unionByName(side[1]).unionByName(left.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("container_id").alias("b"), F.lit(1).cast("long").alias("n"))).unionByName(
        edges.groupBy(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "a", "b", "n")
    )


@query("SELECT id AS anchor_id, id % 4 = 0 OR id % 6 = 0 AS warm FROM v_node WHERE kind = 6")
def materialized_warm_cold(g: Graph):
    marks = lambda k: anchors_where(g, f"id % {k} = 0").select("anchor_id", F.lit("calls").alias("edge_type"))
    return relations.warmth(anchors_where(g, "kind = 6"), store.mark_materialized(marks(4), marks(6)), "calls")


@query("""SELECT d.doc_id AS anchor_id, d.doc_id % 3 = 0 AND d.doc_id % 5 <> 0 AS fresh FROM v_text d""")
def callees_freshness(g: Graph):
    """Anchors in document files: hashes stored for a third, and every fifth file unreadable."""
    t = g.sql("SELECT uri, doc_id, text FROM v_text")
    cache = t.where("doc_id % 3 = 0").select(F.col("doc_id").alias("anchor_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return relations.callee_freshness(t.select(F.col("doc_id").alias("anchor_id")), t.select(F.col("doc_id").alias("id"), "uri"), t.where("doc_id % 5 != 0"), cache)


@query("SELECT id AS anchor_id, 'h' AS content_hash FROM v_node WHERE language <> 'go'")
def drop_hashes_of_files(g: Graph):
    """Hashes of all nodes, without those in the files of one language."""
    cache = g.nodes.select(F.col("id").alias("anchor_id"), F.lit("h").alias("content_hash"))
    return store.drop_callee_hashes(cache, g.nodes, g.nodes.where("language = 'go'").select("uri"))


@query("""SELECT key, CASE WHEN b IS NOT NULL THEN b ELSE a END AS value FROM (SELECT uri AS key, md5(text) AS a, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS b FROM v_text)""")
def meta_upsert(g: Graph):
    meta = g.texts.select(F.col("uri").alias("key"), T.content_hash(F.col("text")).alias("value"))
    return store.merge_keyed(meta, g.sql("SELECT uri AS key, 'new' AS value FROM v_text WHERE doc_id % 2 = 0"), ["key"])


@query("SELECT id, CASE WHEN id % 2 = 0 THEN concat('sig ', name) ELSE signature END AS signature FROM v_node")
def update_signatures(g: Graph):
    new = g.nodes.where("id % 2 = 0").select("fqn", F.concat(F.lit("sig "), "name").alias("signature"))
    return store.update_column(g.nodes, new, "fqn", "signature").select("id", "signature")


@query("SELECT id, CASE WHEN id % 3 = 1 THEN CASE WHEN id % 2 = 0 THEN 'enum' END ELSE construct END AS construct FROM v_node")
def update_constructs(g: Graph):
    """Constructs set by id, some to null."""
    new = g.nodes.where("id % 3 = 1").select("id", F.when(F.col("id") % 2 == 0, "enum").alias("construct"))
    return store.update_column(g.nodes, new, "id", "construct").select("id", "construct")


# Building edges from facts

_REFS = """SELECT 'references' AS op, p.uri, p.sel_start_line AS line, p.sel_start_col AS character, c.uri AS target_uri, c.sel_start_line + b.l_linenumber AS target_line, CAST(2 AS BIGINT) AS target_character
  FROM v_bought b JOIN v_node c ON c.id = 1000000000000 + b.c_custkey JOIN v_node p ON p.id = 7000000000000 + b.l_partkey"""


@query(f"""WITH f AS (SELECT DISTINCT p.id AS anchor_id, f.target_uri AS uri, f.target_line AS line, f.target_character AS character FROM ({_REFS}) f JOIN v_node p ON p.uri = f.uri AND p.sel_start_line = f.line AND p.sel_start_col = f.character),
  i AS (SELECT * FROM ({_INNERMOST.format('SELECT uri, line, character FROM f')}) WHERE r = 1)
  SELECT i.node_id AS src_id, f.anchor_id AS dst_id, f.uri AS site_uri, f.line AS site_start_line FROM f JOIN i USING (uri, line, character)""")
def materialize_references(g: Graph):
    refs = g.bought("p").selectExpr("'references' AS op", "p_uri AS uri", "p_sel_start_line AS line", "p_sel_start_col AS character", "c_uri AS target_uri", "c_sel_start_line + l_linenumber AS target_line", "CAST(2 AS BIGINT) AS target_character")
    return materialize.reference_edges(anchors_where(g, "true"), g.kept_nodes, refs).select("src_id", "dst_id", "site_uri", "site_start_line")


@query("""SELECT 'definition' AS op, c.uri, c.sel_start_line AS line, c.sel_start_col AS character, CASE k.k WHEN 0 THEN c.uri ELSE concat(c.uri, '.', k.k) END AS target_uri,
    c.range_start_line + CASE WHEN k.k = 1 THEN 7 ELSE k.k END AS target_line, CAST(k.k AS BIGINT) AS target_character, CAST(CASE WHEN c.id % 4 = 1 THEN 0 ELSE k.k END AS BIGINT) AS rank
  FROM v_node c, (VALUES (0), (1), (2)) k(k) WHERE c.kind <> 2 AND (c.id % 4 = 0 OR (c.id % 4 = 1 AND k.k = 0) OR (c.id % 4 = 2 AND k.k < 2))""")
def parse_locations(g: Graph):
    """Location answers of every node as JSON: a list with links, one location alone, a short list, and one that is no JSON."""
    n = g.nodes.where("kind != 2")
    text = lambda c: F.col(c).cast("string")
    span = lambda line, col: F.concat(F.lit('{"start":{"line":'), line, F.lit(',"character":'), F.lit(str(col)), F.lit('},"end":{"line":'), line, F.lit(',"character":9}}'))
    plus = lambda k: (F.col("range_start_line") + k).cast("string")
    plain = F.concat(F.lit('{"uri":"'), "uri", F.lit('","range":'), span(text("range_start_line"), 0), F.lit("}"))
    link = lambda k, line: F.concat(F.lit('{"targetUri":"'), "uri", F.lit(f'.{k}","targetRange":'), span(plus(99), 50), F.lit(',"targetSelectionRange":'), span(line, k), F.lit("}"))
    one, two = link(1, plus(7)), link(2, plus(2))
    r = F.col("id") % 4
    answer = F.when(r == 0, F.concat(F.lit("["), plain, F.lit(","), one, F.lit(","), two, F.lit("]"))).when(r == 1, plain).when(r == 2, F.concat(F.lit("["), plain, F.lit(","), one, F.lit("]"))).otherwise("{broken")
    return facts.locations(n.select(F.lit("definition").alias("op"), "uri", F.col("sel_start_line").alias("line"), F.col("sel_start_col").alias("character"), answer.alias("answer")))


@query("""SELECT uri, sel_start_line AS line, sel_start_col AS character, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN concat('m ', name) ELSE concat(name, chr(10), chr(10), 'two') END AS contents FROM v_node WHERE id % 4 < 3""")
def parse_hover(g: Graph):
    """Hover answers of every node as JSON: a text, a text with its kind, a list of both, and null contents."""
    r = F.col("id") % 4
    quoted = F.concat(F.lit('"'), "name", F.lit('"'))
    shape = F.when(r == 0, quoted).when(r == 1, F.concat(F.lit('{"kind":"markdown","value":"m '), "name", F.lit('"}'))).when(r == 2, F.concat(F.lit("["), quoted, F.lit(',"",{"language":"x","value":"two"}]'))).otherwise("null")
    answer = F.concat(F.lit('{"contents":'), shape, F.lit("}"))
    return facts.hover_text(g.nodes.select("uri", F.col("sel_start_line").alias("line"), F.col("sel_start_col").alias("character"), answer.alias("answer")))


_SPAN = "named_struct('start', named_struct('line', {0}, 'character', {1}), 'end', named_struct('line', {0}, 'character', {1} + 3))"


def _calls(g: Graph, direction: str) -> DataFrame:
    """Call facts of customers (outgoing, to suppliers) or suppliers (incoming; some callers at module scope)."""
    a, b = ("c", "s") if direction == "outgoing" else ("s", "c")
    zero = "false" if direction == "outgoing" else "l_orderkey % 4 = 0"
    ends = [f"CASE WHEN {zero} THEN CAST(0 AS BIGINT) ELSE {b}_{col} END AS {name}" for col, name in (("sel_start_line", "item_line"), ("sel_start_col", "item_character"), ("sel_end_line", "item_end_line"), ("sel_end_col", "item_end_character"))]
    span = _SPAN.format("CAST(l_orderkey AS BIGINT)", "CAST(l_linenumber AS BIGINT)")
    at = [f"{a}_uri AS anchor_uri", f"{a}_sel_start_line AS anchor_line", f"{a}_sel_start_col AS anchor_character", f"{b}_uri AS item_uri"]
    return written(g.bought("s").selectExpr(f"'{direction}' AS direction", *at, *ends, f"array({span}) AS from_ranges"), "calls")


_AT_NAME = _INNERMOST.format("SELECT uri, sel_start_line AS line, sel_start_col AS character FROM v_node WHERE id < 3000000000000")


@query(f"""WITH i AS (SELECT * FROM ({_AT_NAME}) WHERE r = 1),
  m AS (SELECT n.uri, m.id FROM (SELECT DISTINCT uri FROM v_node WHERE id < 2000000000000) n JOIN v_node m ON m.uri = n.uri AND m.kind = 2)
  SELECT DISTINCT CASE WHEN b.l_orderkey % 4 = 0 THEN m.id ELSE i.node_id END AS src_id, s.id AS dst_id, CAST(b.l_orderkey AS BIGINT) AS site_start_line, CAST(b.l_linenumber AS BIGINT) AS site_start_col
  FROM v_bought b JOIN v_node c ON c.id = 1000000000000 + b.c_custkey JOIN v_node s ON s.id = 2000000000000 + b.l_suppkey JOIN m ON m.uri = c.uri
  JOIN i ON i.uri = c.uri AND i.line = c.sel_start_line AND i.character = c.sel_start_col""")
def materialize_calls_module_scope(g: Graph):
    out = materialize.call_edges(anchors_where(g, "true"), g.kept_nodes, _calls(g, "incoming"), "incoming", ROOT)
    return out.select("src_id", "dst_id", "site_start_line", "site_start_col")


_IMPLS = """SELECT 'implementation' AS op, s.uri, s.sel_start_line AS line, s.sel_start_col AS character, c.uri AS target_uri, c.sel_start_line AS target_line, c.sel_start_col AS target_character
  FROM v_symbol y JOIN v_node s ON s.id = y.id JOIN v_symbol z ON z.what = 'customer' AND z.key = y.key * 3 JOIN v_node c ON c.id = z.id WHERE y.what = 'supplier' AND y.key % 2 = 0"""


@query(f"""WITH i AS (SELECT * FROM ({_AT_NAME}) WHERE r = 1),
  impl AS (SELECT DISTINCT s.id AS node_id, i.node_id AS impl_id FROM ({_IMPLS}) f JOIN v_node s ON s.uri = f.uri AND s.sel_start_line = f.line AND s.sel_start_col = f.character
    JOIN i ON i.uri = f.target_uri AND i.line = f.target_line AND i.character = f.target_character JOIN v_node up ON up.id = s.container_id WHERE s.language IN ('typescript', 'go') AND up.node_kind = 'Interface' AND s.id < 3000000000000),
  called AS (SELECT DISTINCT b.c_custkey, si.node_id AS sid, b.l_orderkey, b.l_linenumber FROM v_bought b JOIN v_node s ON s.id = 2000000000000 + b.l_suppkey JOIN i si ON si.uri = s.uri AND si.line = s.sel_start_line AND si.character = s.sel_start_col)
  SELECT DISTINCT 1000000000000 + b.c_custkey AS src_id, coalesce(impl.impl_id, b.sid) AS dst_id, 'calls' AS edge_type, CAST(b.l_orderkey AS BIGINT) AS site_start_line, CAST(b.l_linenumber AS BIGINT) AS site_start_col
  FROM called b LEFT JOIN impl ON impl.node_id = b.sid
  UNION ALL SELECT DISTINCT impl.impl_id, impl.node_id, 'implements', NULL, NULL FROM impl JOIN called b ON b.sid = impl.node_id""")
def interface_dispatch(g: Graph):
    out = materialize.call_edges(anchors_where(g, "true"), g.kept_nodes, _calls(g, "outgoing"), "outgoing", ROOT, g.sql(_IMPLS))
    return out.select("src_id", "dst_id", "edge_type", "site_start_line", "site_start_col")


@query(f"""SELECT n.id, coalesce(n.signature, nullif(trim(h.contents), '')) AS signature FROM v_node n LEFT JOIN ({HOVER}) h ON h.uri = n.uri AND h.line = n.sel_start_line AND h.character = n.sel_start_col""")
def signature_backfill(g: Graph):
    return materialize.backfill(g.nodes, g.sql(HOVER)).select("id", "signature")


@query("""SELECT id, CASE WHEN language = 'rust' OR language = 'go' THEN 'lsp_unavailable' WHEN id % 2 = 0 THEN 'lsp_timeout' END AS degrade_reason,
  CASE WHEN language = 'rust' OR language = 'go' THEN 'down' WHEN id % 2 = 0 THEN 'degraded' END AS lsp_status FROM v_node""")
def degradation(g: Graph):
    health = g.spark.createDataFrame([("python", "healthy"), ("typescript", "healthy"), ("rust", "restarting")], "language string, status string")
    asked = g.nodes.select("id", "language", (F.col("id") % 2 == 0).alias("timed_out"))
    return relations.degradation(asked, health).select("id", "degrade_reason", "lsp_status")


# Maintenance

_OLD = "SELECT id, fqn, uri, name, language, kind, node_kind, detail, range_start_line, range_start_col, range_end_line, range_end_col, sel_start_line, sel_start_col, sel_end_line, sel_end_col, signature_hash, orphan FROM v_node"


def _new(g: Graph) -> DataFrame:
    """What the files hold now: every tenth symbol gone, and others renamed, moved or changed."""
    return _changed(g.kept(_OLD))


def _changed(nodes: DataFrame) -> DataFrame:
    n = nodes.where("id % 10 != 0")
    r = F.col("id") % 10
    n = n.withColumn("name", F.when(r == 1, F.concat("name", F.lit("_new"))).otherwise(F.col("name")))
    n = n.withColumn("fqn", F.when(r == 1, F.concat("fqn", F.lit("_new"))).otherwise(F.col("fqn")))
    for c in ("range_start_line", "range_end_line", "sel_start_line", "sel_end_line"):
        n = n.withColumn(c, F.when((r == 2) & (F.col(c) < schema.END), F.col(c) + 2).otherwise(F.col(c)))
    n = n.withColumn("signature_hash", F.when(r.isin(2, 3), F.lit("other")).otherwise(F.col("signature_hash")))
    return n.select("uri", F.col("id").alias("pos"), *[c for c in n.columns if c not in ("id", "uri", "orphan")])


@query("""SELECT uri, CAST(sum(CASE WHEN id % 10 > 3 THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(sum(CASE WHEN id % 10 IN (2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS renamed,
  CAST(sum(CASE WHEN id % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(sum(CASE WHEN id % 10 IN (0, 1) AND NOT orphan THEN 1 ELSE 0 END) AS BIGINT) AS orphaned,
  CAST(sum(CASE WHEN id % 10 IN (0, 1) AND orphan THEN 1 ELSE 0 END) AS BIGINT) AS deleted FROM v_node GROUP BY uri""")
def reconcile_exact_outcome(g: Graph):
    return reconcile.outcome(reconcile.plan_reconcile(g.kept(_OLD), _new(g), renames=False))


_SAME = "concat_ws(chr(1), kind, coalesce(detail, chr(2)), range_start_line, range_start_col, range_end_line, range_end_col, sel_start_line, sel_start_col, sel_end_line, sel_end_col)"


@query(f"""WITH o AS (SELECT id, uri, kind, detail, range_start_line FROM v_node WHERE id % 10 IN (0, 1))
  SELECT n.uri, n.id AS new_pos, o.id AS old_id, CAST(CASE WHEN o.id = n.id THEN 1 ELSE 0 END AS INTEGER) AS tier, abs(n.range_start_line - o.range_start_line) AS drift
  FROM o n JOIN o ON o.uri = n.uri AND o.kind = n.kind AND abs(n.range_start_line - o.range_start_line) <= 3 WHERE n.id % 10 = 1""")
def rename_candidates(g: Graph):
    old, new = g.kept(_OLD), _new(g)
    return reconcile.rename_candidates(old, new, reconcile.exact_pairs(old, new))


@query("""SELECT uri, CAST(sum(CASE WHEN id % 10 > 3 THEN 1 ELSE 0 END) AS BIGINT) AS unchanged, CAST(sum(CASE WHEN id % 10 IN (2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS updated, CAST(sum(CASE WHEN id % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS renamed,
  CAST(0 AS BIGINT) AS inserted, CAST(sum(CASE WHEN id % 10 = 0 AND NOT orphan THEN 1 ELSE 0 END) AS BIGINT) AS orphaned, CAST(sum(CASE WHEN id % 10 = 0 AND orphan THEN 1 ELSE 0 END) AS BIGINT) AS deleted
  FROM v_node GROUP BY uri""")
def reconcile_full(g: Graph):
    return reconcile.outcome(reconcile.plan_reconcile(g.kept(_OLD), _new(g)))


_TABLES = """SELECT CASE WHEN id % 10 = 1 THEN concat(fqn, '_new') ELSE fqn END AS fqn, id, CASE WHEN id % 10 = 2 THEN range_start_line + 2 ELSE range_start_line END AS range_start_line,
  CASE WHEN id % 10 IN (2, 3) THEN 'other' ELSE signature_hash END AS signature_hash, id % 10 <> 0 AS valid, id % 10 = 0 AS orphan FROM v_node WHERE NOT (id % 10 = 0 AND orphan)"""


@query(_TABLES)
def reconcile_tables(g: Graph):
    """The nodes after all files were reconciled: names, places, hashes and states by id."""
    return _reconciled(g)[0].select("fqn", "id", "range_start_line", "signature_hash", "valid", "orphan")


def _to_reconcile(g: Graph) -> tuple[DataFrame, ...]:
    """Nodes, edges (to be written before they are read twice, as their ids are given when they are read), hashes and marks of every node before, and the symbols of all files, the members' containers being symbols' parents."""
    old = g.kept_nodes
    new = _changed(old.drop("construct", "signature", "documentation", "valid", "generation")).withColumn("parent_pos", F.when(F.col("container_id") % 10 != 0, F.col("container_id"))).drop("container_id")
    edges = g.edges.withColumn("id", F.monotonically_increasing_id() + 1).select(*[c.split()[0] for c in schema.EDGES.split(", ")])
    anchors = old.select(F.col("id").alias("anchor_id"))
    return old, edges, anchors.withColumn("content_hash", F.lit("h")), anchors.withColumn("edge_type", F.lit("calls")), new


def _reconciled(g: Graph):
    """All tables after all files were reconciled."""
    old, edges, cache, marks, new = _to_reconcile(g)
    kept = g.with_site_ends(written(edges.drop("site_end_line", "site_end_col"), "edges")).select(*edges.columns)
    return reconcile.reconcile(old, kept, cache, marks, new, old.select("uri"))


@query(_TABLES)
def reconcile_in_place(g: Graph):
    """The nodes as in ``reconcile_tables``, by two changes to tables in place, each of half of the files."""
    old, edges, cache, marks, new = _to_reconcile(g)
    tables = GraphTables(g.spark, fresh_path(g.spark, "tables"), 16)
    for table, rows in ((tables.nodes, old), (tables.edges, edges), (tables.cache, cache), (tables.marks, marks)):
        table.replace(rows, list(range(table.n)), deal=table is not tables.edges)
    new = written(new, "symbols")
    half = F.pmod(F.xxhash64("uri"), F.lit(2))
    for which in range(2):
        tables.reconcile(new, old.where(half == which).select("uri"))
    return tables.nodes.read().select("fqn", "id", "range_start_line", "signature_hash", "valid", "orphan")


_GONE = "(id % 10 = 0 AND orphan)"


@query(f"""WITH gone AS (SELECT id FROM v_node WHERE {_GONE}), hit AS (SELECT id FROM v_node WHERE id % 10 IN (1, 2, 3)), link AS (SELECT container_id AS up, id FROM v_node WHERE container_id IS NOT NULL AND container_id % 10 <> 0 AND id % 10 <> 0),
  e AS (SELECT src_id, dst_id, edge_type, valid AND src_id NOT IN (SELECT id FROM hit) AND dst_id NOT IN (SELECT id FROM hit) OR (edge_type = 'contains' AND EXISTS (SELECT 1 FROM link WHERE link.up = src_id AND link.id = dst_id)) AS valid
    FROM v_edge WHERE src_id NOT IN (SELECT id FROM gone) AND dst_id NOT IN (SELECT id FROM gone))
  SELECT edge_type AS what, src_id AS a, dst_id AS b, CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL
  UNION ALL SELECT 'mark', id, NULL, 1, 1 FROM v_node WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'container', id, CASE WHEN id % 10 = 0 THEN CASE WHEN container_id NOT IN (SELECT id FROM gone) THEN container_id END WHEN container_id % 10 <> 0 THEN container_id END, 1, 1 FROM v_node WHERE id NOT IN (SELECT id FROM gone)""")
def reconcile_side_tables(g: Graph):
    """Edges by their ends, marks, hashes (none: all files were reconciled) and containers after all files were reconciled."""
    nodes, edges, cache, marks, _ = _reconciled(g)
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    shown = edges.groupBy(F.col("edge_type").alias("what"), F.col("src_id").alias("a"), F.col("dst_id").alias("b")).agg(F.count_if("valid").alias("valid"), F.count("*").alias("n"))
    side = [t.select(F.lit(what).alias("what"), F.col("anchor_id").alias("a"), none.alias("b"), one.alias("valid"), one.alias("n")) for what, t in (("mark", marks), ("hash", cache))]
    own = nodes.select(F.lit("container").alias("what"), F.col("id").alias("a"), F.col("container_id").alias("b"), one.alias("valid"), one.alias("n"))
    return shown.unionByName(side[0]).unionByName(side[1]).unionByName(own)


@query("""SELECT uri, CASE doc_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'skipped' WHEN 2 THEN 'new' ELSE 'changed' END AS state FROM v_text""")
def drift_classify(g: Graph):
    t = g.sql("SELECT uri, doc_id, text FROM v_text")
    stored = t.where("doc_id % 5 != 2").select("uri", F.when(F.col("doc_id") % 5 == 1, T.content_hash(F.col("text"))).otherwise("old").alias("hash"))
    return reconcile.drift(t.where("doc_id % 5 != 0"), stored, t.where("doc_id % 5 in (0, 1)").select("uri"))


_START = "CASE WHEN {lang} IS NULL THEN 9 ELSE doc_id % 7 END"


@query(f"""WITH f AS (SELECT uri, {_START.format(lang=_LANGUAGE.format(_EXTENSION))} AS c FROM v_text),
  t AS (SELECT CAST(count(*) AS BIGINT) AS checked, CAST(coalesce(sum(CASE WHEN c = 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS failures, CAST(coalesce(sum(CASE WHEN c = 4 THEN 1 ELSE 0 END), 0) AS BIGINT) AS skipped FROM f)
  SELECT uri, CASE c WHEN 0 THEN 'removed' WHEN 1 THEN 'unchanged' WHEN 4 THEN 'held' WHEN 5 THEN 'failed' WHEN 9 THEN 'unsupported' ELSE 'committed' END AS state, CAST(CASE WHEN c = 0 THEN 0 WHEN c IN (2, 3, 6) THEN 2 ELSE 1 END AS BIGINT) AS live,
  CASE WHEN c = 0 THEN 'empty' WHEN c IN (1, 2, 3, 6) THEN 'now' ELSE 'before' END AS stored, checked, failures, skipped FROM f, t""")
def startup_drift(g: Graph):
    """A start over all documents as files: gone, unchanged, new, changed, emptied, broken, with a source that is late, or of no language; each file's state, live symbols and stored hash, and the tallies.

    The graph knows a symbol of each file but the new ones, which have no hash stored either."""
    t = g.kept(f"SELECT uri, text, {_START.format(lang=_LANGUAGE.format(_EXTENSION))} AS c FROM v_text")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    bounds = [F.lit(1).cast("long").alias(b) for b in reconcile.BOUNDS]
    known = t.where("c != 2").select(
        F.pmod(F.xxhash64("uri"), F.lit(1 << 61)).alias("id"), F.concat("uri", F.lit(".kept")).alias("fqn"), "uri", F.lit("kept").alias("name"), F.lit("python").alias("language"), F.lit(12).cast("long").alias("kind"),
        F.lit("Function").alias("node_kind"), none.alias("construct"), F.lit(None).cast("long").alias("container_id"), *bounds, none.alias("signature"), none.alias("documentation"), none.alias("detail"), F.lit("h").alias("signature_hash"),
        F.lit(True).alias("valid"), F.lit(False).alias("orphan"), zero.alias("generation"), F.lit(False).alias("is_external"),
    )
    before = t.where("c != 2").select(F.concat(F.lit(reconcile.STORED), "uri").alias("key"), F.when(F.col("c") == 1, T.content_hash(F.col("text"))).otherwise("before").alias("value"))
    graph = SnapshotStore(g.spark, fresh_path(g.spark, "snapshots"))
    graph.commit(nodes=known, index_meta=before)
    asked = []

    def fetch(uris: DataFrame) -> DataFrame:
        asked.append(1)
        late = (F.col("c") == 6) & (F.lit(len(asked)) < 2)
        member = F.concat(F.lit('[{"name":"found","kind":12,"range":{"start":{"line":5,"character":0},"end":{"line":6,"character":0}},"selectionRange":{"start":{"line":5,"character":4},"end":{"line":5,"character":9}}}]'))
        return t.join(uris.hint("merge"), "uri", "left_semi").where(~late).select("uri", F.when(F.col("c") == 4, "[]").when(F.col("c") == 5, "{broken").otherwise(member).alias("symbols"))

    states, tallies = reconcile.start_up(graph, t.where("c != 0").select("uri", "text"), fetch, ROOT, retries=2, delay=0)
    now = graph.read()
    live = now.nodes.where("not orphan").groupBy("uri").agg(F.count("*").alias("live"))
    stored = now.index_meta.where(F.col("key").startswith(reconcile.STORED)).select(F.substring("key", len(reconcile.STORED) + 1, 1 << 30).alias("uri"), F.col("value").alias("hash"))
    hashed = t.select("uri", T.content_hash(F.col("text")).alias("own"))
    out = states.join(live.hint("merge"), "uri", "left").join(stored.hint("merge"), "uri", "left").join(hashed.hint("merge"), "uri", "left").join(F.broadcast(tallies))
    kind = F.when(F.col("hash") == "", "empty").when(F.col("hash") == F.col("own"), "now").otherwise("before")
    return out.select("uri", "state", F.coalesce("live", zero).alias("live"), kind.alias("stored"), "checked", "failures", "skipped")


@query("""SELECT uri, CAST(1 AS BIGINT) AS start_line, CAST(3 AS BIGINT) AS end_line, total_lines, array_to_string(lines[2:3], chr(10)) AS content
  FROM (SELECT uri, lines, CAST(len(lines) AS BIGINT) AS total_lines FROM (SELECT uri, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM v_text))""")
def read_ranges(g: Graph):
    asked = g.texts.select("uri", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    return files.read_range(g.texts, asked)


def _answers(g: Graph) -> DataFrame:
    """documentSymbol answers for the files of the graph, as JSON trees: a class with its members; every seventh is broken."""
    rows = g.sql("SELECT uri, name, kind, detail, range_start_line AS l, CAST(uri AS STRING) AS u FROM v_node WHERE kind <> 2 AND name <> 'Group'")
    at = lambda line: F.concat(F.lit('{"start":{"line":'), line, F.lit(',"character":4},"end":{"line":'), line, F.lit(',"character":9}}'))
    line = F.col("l").cast("string")
    member = F.concat(F.lit('{"name":"'), "name", F.lit('","kind":'), F.col("kind").cast("string"), F.lit(',"range":'), at(line), F.lit(',"selectionRange":'), at(line), F.lit("}"))
    trees = rows.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
    text = F.concat(F.lit('[{"name":"Group","kind":5,"range":'), at(F.lit("1")), F.lit(',"selectionRange":'), at(F.lit("1")), F.lit(',"children":['), "members", F.lit("]}]"))
    return trees.select("uri", F.when(F.pmod(F.length("uri"), F.lit(7)) == 0, F.lit("{broken")).otherwise(text).alias("symbols"))


_OWN = "replace(ltrim(regexp_replace(replace(uri, 'file:///repo', ''), '\\.[^.]*$', ''), '/'), '/', '.')"


@query(f"""SELECT fqn, uri, kind, l AS range_start_line, CAST(4 AS BIGINT) AS range_start_col, l AS sel_start_line, CAST(4 AS BIGINT) AS sel_start_col, l AS range_end_line, CAST(9 AS BIGINT) AS range_end_col, parent
  FROM (SELECT concat({_OWN}, '.Group.', name) AS fqn, uri, kind, range_start_line AS l, concat({_OWN}, '.Group') AS parent FROM v_node WHERE kind <> 2 AND name <> 'Group' UNION ALL SELECT DISTINCT concat({_OWN}, '.Group'), uri, 5, 1, NULL FROM v_node) WHERE length(uri) % 7 <> 0
  UNION ALL SELECT DISTINCT {_OWN}, uri, 2, 0, 0, 0, 0, 9223372036854775807, 9223372036854775807, NULL FROM v_node""")
def flatten_symbols(g: Graph):
    """Names, kinds, bounds and the parent's name."""
    flat = facts.flatten_symbols(_answers(g), ROOT)
    up = flat.where("path != ''").select("uri", F.col("path").alias("parent_path"), F.col("fqn").alias("parent"))
    return flat.join(up, ["uri", "parent_path"], "left").select("fqn", "uri", "kind", "range_start_line", "range_start_col", "sel_start_line", "sel_start_col", "range_end_line", "range_end_col", "parent")


@query("""SELECT CAST(count(*) AS BIGINT) AS files_seen, CAST(sum(CASE WHEN length(f.uri) % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS files_indexed,
  CAST(sum(CASE WHEN length(f.uri) % 7 = 0 THEN 0 ELSE 2 + f.members END) AS BIGINT) AS symbols_upserted, CAST(sum(CASE WHEN length(f.uri) % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fetch_errors
  FROM (SELECT uri, count(*) AS members FROM v_node WHERE kind <> 2 AND name <> 'Group' GROUP BY uri) f""")
def index_stats(g: Graph):
    """The four counters of an indexing pass over an empty graph."""
    return _indexed(g)[2]


@query(f"""WITH f AS (SELECT DISTINCT uri, {_OWN} AS module FROM v_node WHERE length(uri) % 7 <> 0)
  SELECT concat(module, '.Group.', name) AS fqn, uri, name, kind, concat(module, '.Group') AS container FROM v_node JOIN f USING (uri) WHERE kind <> 2 AND name <> 'Group'
  UNION ALL SELECT concat(module, '.Group'), uri, 'Group', 5, NULL FROM f UNION ALL SELECT module, uri, list_extract(string_split(module, '.'), -1), 2, NULL FROM f""")
def index_repository(g: Graph):
    """The nodes that an indexing pass makes of the files' answers, with their containers."""
    nodes = written(_indexed(g)[0], "indexed")
    up = nodes.select(F.col("id").alias("container_id"), F.col("fqn").alias("container"))
    return nodes.join(up, "container_id", "left").select("fqn", "uri", "name", "kind", "container")


def _indexed(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    answers = written(_answers(g), "answers")
    empty = lambda ddl: g.spark.createDataFrame([], ddl)
    return indexing.index_repository(empty(schema.NODES), empty(schema.EDGES), answers.select("uri"), answers, ROOT)


# Extensions beyond graph queries: what runtime events would need


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY ALL""")
def event_windows(g: Graph):
    from ..streaming.changes import windowed_counts

    out = windowed_counts(g.table("events").select("ts", "event_type"), "ts", "event_type", "1 hour", "10 minutes")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "events")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def event_seconds(g: Graph):
    return g.table("events").select("event_id", T.epoch_seconds(F.col("ts")).alias("seconds"))


@query("""SELECT dst_id, CAST(count(*) AS BIGINT) AS call_sites, CAST(count(DISTINCT src_id) AS BIGINT) AS callers FROM v_edge WHERE edge_type = 'calls' AND valid GROUP BY dst_id""")
def call_frequency(g: Graph):
    return relations.call_frequency(g.edges, g.tasks("lineitem", "events"))
