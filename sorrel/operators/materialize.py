"""From captured facts to edges: references, calls, interface dispatch, and hover details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .locate import innermost
from .tables import written


def _edge(src, dst, kind: str, uri, start_line, start_col, end_line, end_col):
    return [
        F.lit(None).cast("long").alias("id"), src.cast("long").alias("src_id"), dst.cast("long").alias("dst_id"), F.lit(kind).alias("edge_type"), uri.cast("string").alias("site_uri"), start_line.cast("long").alias("site_start_line"),
        start_col.cast("long").alias("site_start_col"), end_line.cast("long").alias("site_end_line"), end_col.cast("long").alias("site_end_col"), F.lit(True).alias("valid"),
    ]


def _anchor_points(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    at = nodes.select(F.col("id").alias("anchor_id"), F.col("uri").alias("a_uri"), F.col("sel_start_line").alias("a_line"), F.col("sel_start_col").alias("a_char"), F.col("language").alias("a_language"))
    return anchors.select("anchor_id").distinct().join(at, "anchor_id")


def reference_edges(anchors: DataFrame, nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """New ``references`` edges: from the innermost symbol around each referring place to the anchor."""
    facts = locations.where("op = 'references'").select(F.col("uri").alias("a_uri"), F.col("line").alias("a_line"), F.col("character").alias("a_char"), F.col("target_uri").alias("uri"), F.col("target_line").alias("line"), F.col("target_character").alias("character"))
    # Read twice, by different columns: unwritten, the facts would be shuffled for each.
    places = written(_anchor_points(anchors, nodes).join(facts, ["a_uri", "a_line", "a_char"]).select("anchor_id", "uri", "line", "character"), "places")
    found = places.join(innermost(places, nodes), ["uri", "line", "character"])
    return found.select(*_edge(F.col("node_id"), F.col("anchor_id"), "references", F.col("uri"), F.col("line"), F.col("character"), F.col("line"), F.col("character"))).distinct()


def call_edges(anchors: DataFrame, nodes: DataFrame, calls: DataFrame, direction: str, root_uri: str, implementations: DataFrame | None = None) -> DataFrame:
    """New ``calls`` edges (and ``implements`` where an interface's method is called), one for each call site.

    ``calls`` rows hold the other symbol's selection start in ``item_*`` and its end in ``item_end_*``; an
    incoming caller whose selection is all zero is its file's module. ``implementations`` are location rows:
    a callee that is a member of an interface, in a language with dispatch by interface, is replaced by
    all its resolved implementations, if there are any. Of several prepared items of an anchor (``item_rank``) the first counts.
    """
    calls = calls.where(F.col("direction") == direction)
    facts = (first_items(calls) if "item_rank" in calls.columns else calls).select(F.col("anchor_uri").alias("a_uri"), F.col("anchor_line").alias("a_line"), F.col("anchor_character").alias("a_char"), "item_uri", "item_line", "item_character", "item_end_line", "item_end_character", F.explode("from_ranges").alias("site"))
    # Read twice, by different columns: unwritten, the facts would be shuffled for each.
    sites = _anchor_points(anchors, nodes).join(facts, ["a_uri", "a_line", "a_char"])
    sites = written(sites.select("anchor_id", "a_uri", "item_uri", "item_line", "item_character", "item_end_line", "item_end_character", "site"), "sites")
    points = sites.select(F.col("item_uri").alias("uri"), F.col("item_line").alias("line"), F.col("item_character").alias("character"), F.col("item_end_line").alias("end_line"), F.col("item_end_character").alias("end_character"))
    if direction == "incoming":
        from .locate import resolve_callers

        found = resolve_callers(points, nodes, root_uri)
    else:
        found = innermost(points, nodes)
    named = found.select(F.col("uri").alias("item_uri"), F.col("line").alias("item_line"), F.col("character").alias("item_character"), "node_id")
    joined = sites.join(named, ["item_uri", "item_line", "item_character"])
    site = [F.col("site.start.line"), F.col("site.start.character"), F.col("site.end.line"), F.col("site.end.character")]
    if direction == "incoming":
        return joined.select(*_edge(F.col("node_id"), F.col("anchor_id"), "calls", F.col("item_uri"), *site)).distinct()
    if implementations is None:
        return joined.select(*_edge(F.col("anchor_id"), F.col("node_id"), "calls", F.col("a_uri"), *site)).distinct()
    joined = written(joined.select("anchor_id", "node_id", "a_uri", "site"), "callees")
    dispatched = interface_dispatch(joined.select("node_id").distinct(), nodes, implementations)
    spread = joined.join(dispatched, "node_id", "left").withColumn("callee", F.coalesce("impl_id", "node_id"))
    made = spread.select(*_edge(F.col("anchor_id"), F.col("callee"), "calls", F.col("a_uri"), *site))
    null = F.lit(None)
    shown = dispatched.select(*_edge(F.col("impl_id"), F.col("node_id"), "implements", null, null, null, null, null))
    return made.unionByName(shown).distinct()


def interface_dispatch(callees: DataFrame, nodes: DataFrame, implementations: DataFrame) -> DataFrame:
    """``(node_id, impl_id)`` for callees ``(node_id)`` that an interface contains, in TypeScript and Go."""
    own = nodes.where(F.col("language").isin("typescript", "go")).select(F.col("id").alias("node_id"), "container_id", F.col("uri").alias("a_uri"), F.col("sel_start_line").alias("a_line"), F.col("sel_start_col").alias("a_char"))
    interfaces = nodes.where("node_kind = 'Interface'").select(F.col("id").alias("container_id"))
    gated = callees.join(own, "node_id").join(interfaces, "container_id", "left_semi")
    facts = implementations.where("op = 'implementation'").select(F.col("uri").alias("a_uri"), F.col("line").alias("a_line"), F.col("character").alias("a_char"), F.col("target_uri").alias("uri"), F.col("target_line").alias("line"), F.col("target_character").alias("character"))
    places = gated.join(facts, ["a_uri", "a_line", "a_char"])
    found = innermost(places, nodes).withColumnRenamed("node_id", "impl_id")
    return places.join(found, ["uri", "line", "character"]).where("impl_id != node_id").select("node_id", "impl_id").distinct()


def backfill(nodes: DataFrame, hover: DataFrame) -> DataFrame:
    """Nodes without a signature get the trimmed hover text at their name, if it is not empty."""
    said = hover.select("uri", F.col("line").alias("sel_start_line"), F.col("character").alias("sel_start_col"), F.nullif(T.trimmed(F.col("contents")), F.lit("")).alias("_said"))
    one = said.groupBy("uri", "sel_start_line", "sel_start_col").agg(F.min("_said").alias("_said"))
    out = nodes.join(one, ["uri", "sel_start_line", "sel_start_col"], "left")
    return out.withColumn("signature", F.coalesce("signature", "_said")).select(*nodes.columns)


def refine_constructs(nodes: DataFrame, hover: DataFrame) -> DataFrame:
    """Nodes without a construct get the keyword that their hover text begins with."""
    said = hover.select("uri", F.col("line").alias("sel_start_line"), F.col("character").alias("sel_start_col"), T.construct_from_hover(F.col("contents")).alias("_word"))
    one = said.groupBy("uri", "sel_start_line", "sel_start_col").agg(F.min("_word").alias("_word"))
    out = nodes.join(one, ["uri", "sel_start_line", "sel_start_col"], "left")
    return out.withColumn("construct", F.coalesce("construct", "_word")).select(*nodes.columns)


def first_items(calls: DataFrame) -> DataFrame:
    """Only the first prepared item of each anchor counts."""
    at = ["direction", "anchor_uri", "anchor_line", "anchor_character"]
    return calls.join(calls.groupBy(*at).agg(F.min("item_rank").alias("item_rank")), [*at, "item_rank"], "left_semi")
