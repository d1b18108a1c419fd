"""Neighbours over located edges: references, callers, callees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import SORT_KEY
from .paging import page
from .symbols import NodeFilter

SITE = ["site_uri", "site_start_line", "site_start_col", "site_end_line", "site_end_col"]


def neighbors(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, edge_type: str, incoming: bool) -> DataFrame:
    """Valid neighbours of the anchors ``(anchor_id)``, one row per valid edge, with its site."""
    here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    used = edges.where((F.col("edge_type") == edge_type) & F.col("valid")).select(F.col(here).alias("anchor_id"), F.col(there).alias("id"), *SITE)
    return used.join(anchors.select("anchor_id").distinct(), "anchor_id").join(nodes.where("valid"), "id")


def group_by_node(found: DataFrame) -> DataFrame:
    """One row per anchor and neighbour (by its sort key), with its sites in order; a neighbour without sites has an empty list."""
    rest = [c for c in found.columns if c not in {"anchor_id", *SORT_KEY, *SITE}]
    least = F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("_row")
    grouped = found.groupBy("anchor_id", *SORT_KEY).agg(least, _sites_of().alias("sites"))
    return grouped.select("anchor_id", *SORT_KEY, "_row.*", "sites")


def _sites_of():
    site = F.struct(*[F.col(c).alias(c.removeprefix("site_")) for c in SITE])
    return F.array_sort(F.collect_list(F.when(F.col("site_uri").isNotNull(), site)))


def related(anchors: DataFrame, edges: DataFrame, nodes: DataFrame, edge_type: str, incoming: bool, node_filter: NodeFilter = NodeFilter()) -> DataFrame:
    """Grouped neighbours that the filter lets through, for many anchors at once: ``group_by_node`` of ``neighbors``.

    Sites meet where the anchors do and are grouped there by the neighbours' ids, so the neighbours' own columns join one row for all sites of a pair and are never
    grouped with them. Only neighbours that share a sort key with another are then grouped by it.
    """
    here, there = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    used = edges.where((F.col("edge_type") == edge_type) & F.col("valid")).select(F.col(here).alias("anchor_id"), F.col(there).alias("id"), *SITE)
    pairs = used.join(anchors.select("anchor_id").distinct(), "anchor_id").groupBy("anchor_id", "id").agg(_sites_of().alias("sites"))
    # Nulls in a key are one value here, as in grouping.
    shown = node_filter.apply(nodes).where("valid").withColumn("_same", F.count("*").over(Window.partitionBy(*SORT_KEY)) > 1)
    found = pairs.join(shown, "id").select("anchor_id", *SORT_KEY, *[c for c in nodes.columns if c not in SORT_KEY], "sites", "_same")
    least = F.min(F.struct("id", *[c for c in nodes.columns if c not in {"id", *SORT_KEY}])).alias("_row")
    twins = found.where("_same").groupBy("anchor_id", *SORT_KEY).agg(least, F.array_sort(F.flatten(F.collect_list("sites"))).alias("sites"))
    twins = twins.select("anchor_id", *SORT_KEY, "_row.*", "sites")
    return found.where("not _same").select(*twins.columns).unionByName(twins)


def _page_of(anchors, edges, nodes, edge_type, incoming, node_filter, limit, cursor):
    return page(related(anchors, edges, nodes, edge_type, incoming, node_filter), limit, cursor)


def find_references(anchors, edges, nodes, node_filter: NodeFilter = NodeFilter(), limit=None, cursor=None) -> DataFrame:
    return _page_of(anchors, edges, nodes, "references", True, node_filter, limit, cursor)


def find_callers(anchors, edges, nodes, node_filter: NodeFilter = NodeFilter(), limit=None, cursor=None) -> DataFrame:
    return _page_of(anchors, edges, nodes, "calls", True, node_filter, limit, cursor)


def find_callees(anchors, edges, nodes, node_filter: NodeFilter = NodeFilter(), limit=None, cursor=None) -> DataFrame:
    return _page_of(anchors, edges, nodes, "calls", False, node_filter, limit, cursor)


def callee_freshness(anchors: DataFrame, nodes: DataFrame, files: DataFrame, cache: DataFrame) -> DataFrame:
    """``(anchor_id, fresh)``: whether the stored hash is that of the anchor's file now; an unreadable file is never fresh."""
    from ..functions.text import content_hash

    placed = anchors.select("anchor_id").join(nodes.select(F.col("id").alias("anchor_id"), "uri"), "anchor_id")
    # Only the anchors' own files are hashed.
    hashes = files.join(placed.select("uri").distinct(), "uri", "left_semi").select("uri", content_hash(F.col("text")).alias("now"))
    at = placed.join(hashes, "uri", "left").join(cache, "anchor_id", "left")
    return at.select("anchor_id", F.coalesce(F.col("now") == F.col("content_hash"), F.lit(False)).alias("fresh"))


def warmth(anchors: DataFrame, materialized: DataFrame, edge_type: str) -> DataFrame:
    """``(anchor_id, warm)``: whether the anchor's edges of a type were ever built."""
    marks = materialized.where(F.col("edge_type") == edge_type).select("anchor_id").distinct().withColumn("warm", F.lit(True))
    return anchors.select("anchor_id").join(marks, "anchor_id", "left").select("anchor_id", F.coalesce("warm", F.lit(False)).alias("warm"))


def degradation(requests: DataFrame, health: DataFrame) -> DataFrame:
    """Adds ``degrade_reason`` and ``lsp_status`` to ``(.., language, timed_out)`` rows; null where all is well.

    A source that is not there outranks a timeout. ``health`` is ``(language, status)``; a missing row is down.
    """
    up = F.coalesce("status", F.lit("down"))
    out = requests.join(health, "language", "left")
    reason = F.when(up != "healthy", F.lit("lsp_unavailable")).when(F.col("timed_out"), F.lit("lsp_timeout"))
    status = F.when(up != "healthy", F.lit("down")).when(F.col("timed_out"), F.lit("degraded"))
    return out.withColumn("degrade_reason", reason).withColumn("lsp_status", status).drop("status")


def call_frequency(edges: DataFrame, tasks: int) -> DataFrame:
    """Valid call sites and distinct callers of each callee ``(dst_id)``.

    Edges are dealt to so many tasks by their number, not by the session's setting. A callee's callers lie in up to 16 shares, so that one that all call is not one task's.
    """
    calls = edges.where("edge_type = 'calls' and valid").select("dst_id", "src_id", F.pmod(F.xxhash64("src_id"), F.lit(16)).cast("byte").alias("_share"))
    pairs = calls.repartition(tasks, "dst_id", "_share").groupBy("dst_id", "_share", "src_id").agg(F.count("*").alias("call_sites"))
    shares = pairs.groupBy("dst_id", "_share").agg(F.sum("call_sites").alias("call_sites"), F.count("src_id").alias("callers"))
    return shares.repartition(tasks, "dst_id").groupBy("dst_id").agg(F.sum("call_sites").alias("call_sites"), F.sum("callers").alias("callers"))
