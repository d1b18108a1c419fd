"""Building a graph from files and their captured symbol trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.adapters import BUILT_IN, LanguageAdapter
from ..plans import schema
from ..sources import facts, files
from .store import upsert_edges, upsert_nodes
from .tables import written

EDGE_COLUMNS = [c.split()[0] for c in schema.EDGES.split(", ")]
SPAN = [f"{p}_{e}" for p in ("range", "sel") for e in ("start_line", "start_col", "end_line", "end_col")]


def index_repository(nodes: DataFrame, edges: DataFrame, found: DataFrame, answers: DataFrame, root_uri: str, rules: list[tuple[str, str]] = (), adapters: tuple[LanguageAdapter, ...] = BUILT_IN, last: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One indexing pass: discover, route, flatten, upsert nodes, then ``contains`` edges.

    ``found`` is ``(uri)`` of files and ``answers`` their ``(uri, symbols)``; a missing or broken answer is counted and
    skipped. Re-indexing resets construct and signature and never removes what has vanished; only a row whose place another symbol takes goes, with its edges.
    New ids follow ``last``, the greatest of nodes and edges so far. Returns
    nodes, edges, one row ``(files_seen, files_indexed, symbols_upserted, fetch_errors)`` and the ids ``(id)`` that went, whose hashes and marks go too.
    """
    seen = written(files.discover(found.select("uri").distinct(), root_uri, rules, adapters).join(answers.select("uri", "symbols"), "uri", "left"), "seen")
    good = seen.where("try_parse_json(symbols) is not null")
    rows = written(facts.index_symbols(facts.flatten_symbols(good, root_uri), root_uri), "symbols")
    null = F.lit(None)
    # Of symbols with one name in a file the last in the tree's order counts.
    batch = rows.select(
        F.row_number().over(_by_path()).cast("long").alias("id"), "fqn", "uri", "name", "language", "kind", "node_kind", null.cast("string").alias("construct"), null.cast("long").alias("container_id"), *SPAN,
        null.cast("string").alias("signature"), null.cast("string").alias("documentation"), "detail", "signature_hash", F.lit(True).alias("valid"), F.lit(False).alias("orphan"), F.lit(0).cast("long").alias("generation"), "is_external",
    )
    upserted, gone = upsert_nodes(nodes, batch, last=last[0])
    merged = written(upserted, "nodes")
    ids = rows.select("uri", "path", "fqn").join(merged.select("fqn", "id"), "fqn")
    parents = ids.select("uri", F.col("path").alias("parent_path"), F.col("id").alias("src_id"))
    links = rows.where("parent_path is not null").select("uri", "path", "parent_path").join(ids.select("uri", "path", F.col("id").alias("dst_id")), ["uri", "path"]).join(parents, ["uri", "parent_path"])
    contains = links.select(
        null.cast("long").alias("id"), "src_id", "dst_id", F.lit("contains").alias("edge_type"), null.cast("string").alias("site_uri"), *[null.cast("long").alias(f"site_{e}") for e in ("start_line", "start_col", "end_line", "end_col")], F.lit(True).alias("valid")
    ).where("src_id != dst_id")
    for end in ("src_id", "dst_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    merged = merged.join(gone.select(F.col("id").alias("container_id"), F.lit(True).alias("_gone")), "container_id", "left").withColumn("container_id", F.when(F.col("_gone").isNull(), F.col("container_id"))).select(*nodes.columns)
    up = links.groupBy(F.col("dst_id").alias("id")).agg(F.max("src_id").alias("_up"))
    merged = merged.join(up, "id", "left").withColumn("container_id", F.coalesce("_up", "container_id")).select(*nodes.columns)
    per_file = rows.groupBy("uri").agg(F.count("*").alias("n"))
    good_answer = F.expr("try_parse_json(symbols)").isNotNull()
    stats = seen.select("uri", good_answer.alias("ok")).join(per_file, "uri", "left").agg(
        F.count("*").alias("files_seen"), F.count_if("ok").alias("files_indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols_upserted"), F.count_if(~F.col("ok")).alias("fetch_errors")
    )
    return merged, upsert_edges(edges.select(*EDGE_COLUMNS), contains.select(*EDGE_COLUMNS), last[1]), stats, gone


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("uri").orderBy("path")
