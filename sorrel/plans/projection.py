"""The test tables as a property graph.

The views are stated once, in SQL that Spark and DuckDB both read, so that a query's oracle sees the
same graph as the operators do. Files hold a few dozen symbols each: customers and suppliers of one nation in
blocks of keys, users in blocks, parts as foreign code, and documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "file:///repo"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

_EXT = "CASE n_nationkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' ELSE '.go' END"
_LANG = "CASE n_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' ELSE 'go' END"
_FOLDER = "concat('file:///repo/', replace(lower(r_name), ' ', '_'), '/', replace(lower(n_name), ' ', '_'))"
_MODULE = "concat(replace(lower(r_name), ' ', '_'), '.', replace(lower(n_name), ' ', '_'))"
_LABEL = "CASE kind WHEN 2 THEN 'Module' WHEN 5 THEN 'Class' WHEN 6 THEN 'Method' WHEN 11 THEN 'Interface' WHEN 12 THEN 'Function' WHEN 13 THEN 'Variable' ELSE 'Unknown(99)' END"

#: Name and SQL, each using only those before it and the test tables. Block numbers are by integer arithmetic that both dialects share.
VIEWS: dict[str, str] = {
    "v_place": f"SELECT n_nationkey, {_FOLDER} AS folder, {_MODULE} AS module, {_EXT} AS ext, {_LANG} AS language FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_symbol": """
SELECT CAST(1000000000000 + c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS key, concat('c', CAST((c_custkey - c_custkey % 500) AS VARCHAR(20))) AS block, n_nationkey, 'customer' AS what,
       replace(c_name, '#', '_') AS name,
       CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 6 WHEN 'AUTOMOBILE' THEN 12 WHEN 'MACHINERY' THEN 13 WHEN 'HOUSEHOLD' THEN 6 ELSE 99 END AS BIGINT) AS kind,
       CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 THEN 'type' END AS construct, CAST(10 * (c_custkey % 500) + 2 AS BIGINT) AS line
FROM customer JOIN v_place ON c_nationkey = n_nationkey
UNION ALL
SELECT CAST(2000000000000 + s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT), concat('s', CAST((s_suppkey - s_suppkey % 50) AS VARCHAR(20))), n_nationkey, 'supplier', replace(s_name, '#', '_'), CAST(6 AS BIGINT), NULL,
       CAST(10 * (s_suppkey % 50) + 2 AS BIGINT)
FROM supplier JOIN v_place ON s_nationkey = n_nationkey""",
    "v_file": """
SELECT DISTINCT concat(folder, '/', block, ext) AS uri, concat(module, '.', block) AS module, language, what, n_nationkey, block FROM v_symbol JOIN v_place USING (n_nationkey)""",
    "v_node": f"""
SELECT id, fqn, uri, name, language, kind, {_LABEL} AS node_kind, construct, container_id, range_start_line, range_start_col, range_end_line, range_end_col, sel_start_line, sel_start_col, sel_end_line, sel_end_col,
       signature, detail, md5(concat(fqn, '/', CAST(range_start_line AS VARCHAR(20)))) AS signature_hash, valid, orphan, is_external
FROM (
  SELECT CAST(s.id AS BIGINT) AS id, concat(p.module, '.', s.block, '.Group.', s.name) AS fqn, concat(p.folder, '/', s.block, p.ext) AS uri, s.name, p.language, s.kind, s.construct,
         CAST(CASE WHEN s.what = 'customer' THEN 3000000000000 ELSE 4000000000000 END + s.key - s.key % CASE WHEN s.what = 'customer' THEN 500 ELSE 50 END + s.n_nationkey AS BIGINT) AS container_id,
         s.line AS range_start_line, CAST(4 AS BIGINT) AS range_start_col, s.line + 6 AS range_end_line, CAST(1 AS BIGINT) AS range_end_col, s.line AS sel_start_line, CAST(8 AS BIGINT) AS sel_start_col,
         s.line AS sel_end_line, CAST(8 + length(s.name) AS BIGINT) AS sel_end_col,
         CASE WHEN s.key % 3 = 0 THEN concat('def ', s.name, '()') END AS signature, CASE WHEN s.key % 7 = 0 THEN 'detail' END AS detail, s.key % 11 <> 0 AS valid, s.key % 11 = 0 AND s.key % 2 = 0 AS orphan, false AS is_external
  FROM v_symbol s JOIN v_place p USING (n_nationkey)
  UNION ALL
  SELECT CAST(CASE WHEN what = 'customer' THEN 3000000000000 ELSE 4000000000000 END + CAST(substr(block, 2) AS BIGINT) + n_nationkey AS BIGINT), concat(module, '.Group'), uri, 'Group', language,
         CAST(CASE WHEN what = 'supplier' THEN 11 ELSE 5 END AS BIGINT), NULL, NULL, 1, 0, 6000, 1, 1, 6, 1, 11, NULL, NULL, true, false, false FROM v_file
  UNION ALL
  SELECT CAST(CASE WHEN what = 'customer' THEN 5000000000000 ELSE 6000000000000 END + CAST(substr(block, 2) AS BIGINT) + n_nationkey AS BIGINT), module, uri, block, language, CAST(2 AS BIGINT), NULL, NULL,
         0, 0, 9223372036854775807, 9223372036854775807, 0, 0, 0, 0, NULL, NULL, true, false, false FROM v_file
  UNION ALL
  SELECT CAST(7000000000000 + p_partkey AS BIGINT), concat('node_modules.', replace(lower(p_brand), '#', '_'), '.part_', CAST(p_partkey AS VARCHAR(20))), concat('file:///repo/node_modules/', replace(p_brand, '#', '_'), '.ts'),
         concat('part_', CAST(p_partkey AS VARCHAR(20))), 'typescript', CAST(12 AS BIGINT), NULL, NULL, CAST(10 * p_partkey AS BIGINT), 0, CAST(10 * p_partkey + 5 AS BIGINT), 1, CAST(10 * p_partkey AS BIGINT), 9,
         CAST(10 * p_partkey AS BIGINT), 20, NULL, NULL, true, false, true FROM part
  UNION ALL
  SELECT DISTINCT CAST(8000000000000 + user_id AS BIGINT), concat('users.u', CAST(user_id - user_id % 100 AS VARCHAR(20)), '.user_', CAST(user_id AS VARCHAR(20))), concat('file:///repo/users/u', CAST(user_id - user_id % 100 AS VARCHAR(20)), '.py'),
         concat('user_', CAST(user_id AS VARCHAR(20))), 'python', CAST(12 AS BIGINT), NULL, NULL, CAST(10 * (user_id % 100) AS BIGINT), 0, CAST(10 * (user_id % 100) + 5 AS BIGINT), 1, CAST(10 * (user_id % 100) AS BIGINT), 4,
         CAST(10 * (user_id % 100) AS BIGINT), 10, NULL, NULL, true, false, false FROM events WHERE user_id IS NOT NULL
) n""",
    "v_bought": "SELECT c_custkey, l_suppkey, l_partkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "v_edge_raw": """
SELECT CAST(1000000000000 + c_custkey AS BIGINT) AS src_id, CAST(2000000000000 + l_suppkey AS BIGINT) AS dst_id, 'calls' AS edge_type, CAST(l_orderkey AS BIGINT) AS site_start_line, CAST(l_linenumber AS BIGINT) AS site_start_col, l_returnflag <> 'R' AS valid FROM v_bought
UNION ALL
SELECT CAST(1000000000000 + c_custkey AS BIGINT), CAST(7000000000000 + l_partkey AS BIGINT), 'references', CAST(l_orderkey AS BIGINT), CAST(l_linenumber AS BIGINT), l_returnflag <> 'R' FROM v_bought
UNION ALL
SELECT CAST(2000000000000 + l_suppkey AS BIGINT), CAST(7000000000000 + l_partkey AS BIGINT), 'calls', CAST(l_orderkey AS BIGINT), CAST(l_linenumber AS BIGINT), l_returnflag <> 'R' FROM v_bought
UNION ALL
SELECT CAST(8000000000000 + a.user_id AS BIGINT), CAST(8000000000000 + b.user_id AS BIGINT), 'calls', CAST(a.event_id AS BIGINT), CAST(0 AS BIGINT), true
FROM events a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1 + (a.event_id % 5) * 3""",
    "v_edge": """
SELECT e.src_id, e.dst_id, e.edge_type, n.uri AS site_uri, e.site_start_line, e.site_start_col, e.site_start_line AS site_end_line, e.site_start_col + 3 AS site_end_col, e.valid
FROM (SELECT src_id, dst_id, edge_type, site_start_line, site_start_col, max(valid) AS valid FROM v_edge_raw GROUP BY src_id, dst_id, edge_type, site_start_line, site_start_col) e JOIN v_node n ON n.id = e.src_id
UNION ALL
SELECT container_id, id, 'contains', NULL, NULL, NULL, NULL, NULL, true FROM v_node WHERE container_id IS NOT NULL""",
    "v_text": """
SELECT concat('file:///repo/docs/', source, '/', CAST(doc_id AS VARCHAR(20)), CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.go' ELSE '.txt' END) AS uri, CAST(doc_id AS BIGINT) AS doc_id, text FROM documents WHERE text IS NOT NULL""",
}


def with_views(name: str, sql: str) -> str:
    """The SQL with the views up to ``name``'s needs before it, for an engine that has the test tables."""
    needed: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if v not in needed and any(w == v for w in _words(text)):
                need(VIEWS[v])
                if v not in needed:
                    needed.append(v)

    need(sql)
    if not needed:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    own = body[len("WITH RECURSIVE") :] if recursive else body[len("WITH") :] if body.upper().startswith("WITH ") else None
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ctes}, {own}" if own else f"{head} {ctes}\n{body}"


def _words(text: str) -> set[str]:
    import re

    return set(re.findall(r"\w+", text))


class Graph:
    """The views over one folder of test tables, as DataFrames; no table is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        """Run SQL over the test tables and the views, whose names it may use freely."""
        text = with_views("", query)
        used = {t: self.table(t) for t in TABLES if t in _words(text)}
        marked = text
        for t in used:
            import re

            marked = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", marked)
        return self.spark.sql(marked, **used)

    def tasks(self, *tables: str) -> int:
        """So many tasks take 150,000 rows of these tables each, whatever the session's number of shuffle partitions."""
        return sum(self.table(t).count() for t in tables) // 150_000 + 1

    @property
    def nodes(self) -> DataFrame:
        return self.sql("SELECT *, CAST(NULL AS STRING) AS documentation, CAST(0 AS BIGINT) AS generation FROM v_node")

    @property
    def edges(self) -> DataFrame:
        """``v_edge``, without a shuffle of the edges by their keys.

        A line's edges are made unique where its order's lines meet, before orders bring customers and their files: of what is shuffled, only the suppliers' calls are
        edges. As the ranges of ids in the views do, this takes keys to be below 1e12.
        """
        contains = self.sql("SELECT container_id AS src_id, id AS dst_id, 'contains' AS edge_type, CAST(NULL AS STRING) AS site_uri, CAST(NULL AS BIGINT) AS site_start_line, CAST(NULL AS BIGINT) AS site_start_col, true AS valid FROM v_node WHERE container_id IS NOT NULL")
        rows = self._located(True).unionByName(contains)
        return self.with_site_ends(rows).select("src_id", "dst_id", "edge_type", "site_uri", "site_start_line", "site_start_col", "site_end_line", "site_end_col", "valid")

    @staticmethod
    def with_site_ends(rows: DataFrame) -> DataFrame:
        """Edges with their sites' ends, which follow from the beginnings."""
        return rows.withColumn("site_end_line", F.col("site_start_line")).withColumn("site_end_col", F.col("site_start_col") + 3)

    @property
    def raw_edges(self) -> DataFrame:
        """``v_edge_raw`` with its sources' files as ``site_uri``: repeated edges stay."""
        return self._located(False)

    def _located(self, unique: bool) -> DataFrame:
        """The located edges with their sources' files; if ``unique``, one of each, valid if one of them is."""

        def once(rows: DataFrame, *keys: str) -> DataFrame:
            return rows.groupBy(*keys).agg(F.max("valid").alias("valid")) if unique else rows.select(*keys, "valid")

        # All branches read the same columns of the lines, so that one exchange serves them.
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
        # By their number: a task has several times its lines as edges, which the size of what it reads does not tell.
        lines = lines.repartition(self.tasks("lineitem"), "l_orderkey").withColumn("valid", F.col("l_returnflag") != "R")
        orders = self.table("orders").select("o_orderkey", "o_custkey").repartition("o_custkey")
        orders = orders.distinct() if unique else orders
        buyers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"))
        of_customers = self.sql("SELECT id AS src_id, id - 1000000000000 AS o_custkey, uri AS site_uri FROM v_node WHERE id >= 1000000000000 AND id < 2000000000000")
        if not unique:
            # A customer's row for each of its own, as in v_bought.
            of_customers = of_customers.join(buyers, "o_custkey")
        # The kind is a flag until all is grouped and sorted, as texts make that slower.
        ends = [(2000000000000, "l_suppkey", True), (7000000000000, "l_partkey", False)]
        end = F.inline(F.array(*[F.struct((F.lit(base) + F.col(key)).cast("long").alias("dst_id"), F.lit(called).alias("called")) for base, key, called in ends]))
        theirs = once(lines.select("l_orderkey", "l_linenumber", "valid", end), "l_orderkey", "l_linenumber", "dst_id", "called")
        theirs = theirs.join(orders.join(of_customers, "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        theirs = theirs.withColumn("edge_type", F.when(F.col("called"), F.lit("calls")).otherwise(F.lit("references")))
        sold = once(lines, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        bought = orders.join(buyers, "o_custkey", "left_semi" if unique else "inner")
        # A missing supplier finds no node; as a null it would be kept out of the lines' exchange in this branch alone.
        sold = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi" if unique else "inner").withColumn("src_id", F.coalesce(F.lit(2000000000000) + F.col("l_suppkey"), F.lit(0)).cast("long"))
        of_suppliers = self.sql("SELECT id AS src_id, uri AS site_uri FROM v_node WHERE id >= 2000000000000 AND id < 3000000000000")
        sold = sold.withColumn("dst_id", (F.lit(7000000000000) + F.col("l_partkey")).cast("long")).withColumn("edge_type", F.lit("calls")).join(of_suppliers, "src_id")
        used = self.sql("""SELECT CAST(8000000000000 + a.user_id AS BIGINT) AS src_id, CAST(8000000000000 + b.user_id AS BIGINT) AS dst_id, 'calls' AS edge_type, CAST(a.event_id AS BIGINT) AS site_start_line, CAST(0 AS BIGINT) AS site_start_col, true AS valid
          FROM events a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1 + (a.event_id % 5) * 3""")
        used = once(used, "src_id", "dst_id", "edge_type", "site_start_line", "site_start_col").join(self.sql("SELECT id AS src_id, uri AS site_uri FROM v_node WHERE id >= 8000000000000"), "src_id")
        shown = ["src_id", "dst_id", "edge_type", "site_uri", "site_start_line", "site_start_col", "valid"]
        at = [F.col("l_orderkey").cast("long").alias("site_start_line"), F.col("l_linenumber").cast("long").alias("site_start_col")]
        located = [rows.select("src_id", "dst_id", "edge_type", "site_uri", *at, "valid") for rows in (theirs, sold)]
        return located[0].unionByName(located[1]).unionByName(used.select(*shown))

    def bought(self, other: str) -> DataFrame:
        """``v_bought`` joined to the nodes of its customers and of its suppliers (``other`` is ``s``) or parts (``p``), whose columns bear ``c_`` and the other's letter before their names.

        Lines go through the other end's shuffle without any node's columns, meet the customers' last, and so lie by customer. As the ranges of ids in the views do, this takes
        keys to be below 1e12.
        """
        base, key = {"s": (2000000000000, "l_suppkey"), "p": (7000000000000, "l_partkey")}[other]

        def ends(letter: str, low: int) -> DataFrame:
            found = self.sql(f"SELECT * FROM v_node WHERE id >= {low} AND id < {low + 1000000000000}")
            return found.select((F.col("id") - low).alias(f"{letter}_key"), *[F.col(c).alias(f"{letter}_{c}") for c in found.columns])

        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        sold = lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        buyers = self.table("customer").select("c_custkey").join(ends("c", 1000000000000), F.col("c_custkey") == F.col("c_key"))
        return sold.join(ends(other, base), F.col(key) == F.col(f"{other}_key")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    def kept(self, query: str) -> DataFrame:
        """The rows of a query, written once: for operators that read their input many times."""
        from ..operators.tables import written

        if query not in self._kept:
            self._kept[query] = written(self.sql(query), "view")
        return self._kept[query]

    @property
    def kept_nodes(self) -> DataFrame:
        return self.kept("SELECT *, CAST(NULL AS STRING) AS documentation, CAST(0 AS BIGINT) AS generation FROM v_node")

    @property
    def texts(self) -> DataFrame:
        return self.sql("SELECT uri, text FROM v_text")
