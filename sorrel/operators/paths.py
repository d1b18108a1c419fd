"""Bounded shortest call paths, by frontiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import SORT_KEY
from .buckets import BucketTable
from .tables import fresh_path, numbered, written

DEFAULT_DEPTH, MAX_DEPTH = 8, 20
DEFAULT_BUDGET, MAX_BUDGET = 30, 200


def clamp_depth(depth: int | None) -> int:
    return max(1, min(MAX_DEPTH, DEFAULT_DEPTH if depth is None else depth))


def clamp_budget(budget: int | None) -> int:
    return max(0, min(MAX_BUDGET, DEFAULT_BUDGET if budget is None else budget))


@dataclass
class CallPath:
    reachable: bool
    path: list[int]
    limit_reached: bool


class CallIndex:
    """Valid calls as rows ``(src_id, dst_id, rank)`` in buckets by caller, so that a level of a search reads its own nodes' buckets alone.

    ``rank`` is the callee's place in the order of all valid nodes' sort keys, so a path's place among others is an array of longs. ``changed`` may name callers ``(id)`` whose rows
    ``fresh (src_id, dst_id)`` take the place of the index's; these are few, as what requests have changed since the index was made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.links = BucketTable(spark, f"{path}/links", "src_id bigint, dst_id bigint, rank bigint", ["src_id"], buckets)
        self.ranks = BucketTable(spark, f"{path}/ranks", "id bigint, rank bigint", ["id"], buckets)
        self.changed: DataFrame | None = None
        self.fresh: DataFrame | None = None

    @classmethod
    def build(cls, edges: DataFrame, nodes: DataFrame, path: str | None = None, buckets: int = 64) -> CallIndex:
        """The index of the graph, written below ``path`` (default: a folder that goes with the driver's JVM)."""
        spark = edges.sparkSession
        out = cls(spark, path or fresh_path(spark, "calls"), buckets)
        every = list(range(buckets))
        out.ranks.replace(numbered(nodes.where("valid").select("id", *SORT_KEY), [*SORT_KEY, "id"], "rank").select("id", "rank"), every)
        ranked = out.ranks.read().withColumnRenamed("id", "dst_id")
        out.links.replace(edges.where("edge_type = 'calls' and valid").select("src_id", "dst_id").distinct().join(ranked, "dst_id"), every)
        return out

    def change(self, callers: DataFrame, edges: DataFrame) -> None:
        """From now on the calls of ``callers (id)`` are those of ``edges``."""
        fresh = written(edges.where("edge_type = 'calls' and valid").join(callers.select(F.col("id").alias("src_id")).distinct(), "src_id", "left_semi").select("src_id", "dst_id").distinct(), "fresh")
        ranked = self.ranks.read(self.ranks.buckets_of(fresh, "dst_id")).withColumnRenamed("id", "dst_id")
        self.changed, self.fresh = written(callers.select("id").distinct(), "callers"), written(fresh.join(ranked, "dst_id").select("src_id", "dst_id", "rank"), "ranked")

    def callees(self, callers: DataFrame) -> DataFrame:
        """The rows of callers ``(id)``; other buckets are not read."""
        found = self.links.read(self.links.buckets_of(callers, "id"))
        if self.changed is not None:
            found = found.join(self.changed.withColumnRenamed("id", "src_id"), "src_id", "left_anti").select("src_id", "dst_id", "rank").unionByName(self.fresh)
        return found


def find_call_paths(calls: CallIndex, requests: DataFrame, max_depth: int | None = None, stale: DataFrame | Callable[[DataFrame], DataFrame] | None = None, budget: int | None = None) -> DataFrame:
    """For each ``(request, start_id, target_id)`` the shortest chain of valid calls: ``(request, reachable, path, limit_reached)``.

    All requests advance together, a level a round. A queue meets the nodes of a level in the order of the ranks along
    their paths, so each node keeps the least such sequence and ties fall as they do in a queue. A node at
    ``max_depth`` hops is not expanded and sets ``limit_reached``. ``stale`` names anchors ``(anchor_id)`` whose callees are not fresh, or is a
    function that picks them from given ``(anchor_id)``, so that only the frontiers' anchors are looked at:
    each expansion of one spends one of a request's ``budget``, and beyond it sets ``limit_reached`` while known
    calls are still followed. Finding the target clears the flag. Invalid and foreign nodes: only valid ones are entered, foreign ones too.
    """
    depth = clamp_depth(max_depth)
    own = requests.select("request", "start_id", "target_id")
    same = own.where("start_id = target_id").select("request", F.array("start_id").alias("path"))
    none = F.expr("cast(array() as array<bigint>)")
    frontier = written(own.where("start_id != target_id").select("request", "target_id", F.col("start_id").alias("id"), none.alias("order"), F.array("start_id").alias("path")), "frontier")
    seen, hits = frontier.select("request", "id"), same
    purse = own.select("request", F.lit(clamp_budget(budget)).cast("long").alias("left"), F.lit(False).alias("limited"))
    for _ in range(depth):
        if frontier.isEmpty():
            break
        if stale is not None:
            late = stale(frontier.select(F.col("id").alias("anchor_id")).distinct()) if callable(stale) else stale
            waiting = frontier.join(late.select(F.col("anchor_id").alias("id")).distinct(), "id", "left_semi").groupBy("request").agg(F.count("*").alias("n"))
            n = F.coalesce("n", F.lit(0))
            purse = written(purse.join(waiting, "request", "left").select("request", F.greatest(F.col("left") - n, F.lit(0)).alias("left"), (F.col("limited") | (n > F.col("left"))).alias("limited")), "purse")
        first = F.min(F.struct(F.concat("order", F.array("rank")).alias("order"), F.concat("path", F.array("dst_id")).alias("path"))).alias("first")
        level = frontier.join(calls.callees(frontier), F.col("id") == F.col("src_id")).groupBy("request", "target_id", "dst_id").agg(first)
        level = written(level.select("request", "target_id", F.col("dst_id").alias("id"), "first.order", "first.path"), "level")
        found = level.where("id = target_id").select("request", "path")
        hits = hits.unionByName(found)
        frontier = written(level.join(found.select("request"), "request", "left_anti").join(seen, ["request", "id"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("request", "id"))
    cut = frontier.select("request").distinct().withColumn("cut", F.lit(True))
    out = own.select("request").join(hits, "request", "left").join(cut, "request", "left").join(purse, "request", "left")
    reachable = F.col("path").isNotNull()
    limited = ~reachable & (F.coalesce("cut", F.lit(False)) | F.coalesce("limited", F.lit(False)))
    return out.select("request", reachable.alias("reachable"), F.coalesce("path", none).alias("path"), limited.alias("limit_reached"))


def find_call_path(calls: CallIndex, start: int, target: int, max_depth: int | None = None, stale: DataFrame | Callable[[DataFrame], DataFrame] | None = None, budget: int | None = None) -> CallPath:
    """One request of ``find_call_paths``."""
    one = calls.links.spark.createDataFrame([(0, start, target)], "request long, start_id long, target_id long")
    row = find_call_paths(calls, one, max_depth, stale, budget).first()
    return CallPath(row["reachable"], list(row["path"]), row["limit_reached"])


def reachable_within(calls: CallIndex, starts: DataFrame, max_depth: int) -> DataFrame:
    """``(start_id, id, depth)`` of all nodes that starts ``(start_id)`` reach in so many calls or fewer."""
    frontier = written(starts.select("start_id", F.col("start_id").alias("id"), F.lit(0).cast("long").alias("depth")).distinct(), "frontier")
    seen = frontier
    for hop in range(1, max_depth + 1):
        step = frontier.join(calls.callees(frontier), F.col("id") == F.col("src_id")).select("start_id", F.col("dst_id").alias("id")).distinct()
        frontier = written(step.join(seen, ["start_id", "id"], "left_anti").withColumn("depth", F.lit(hop).cast("long")), "frontier")
        if frontier.isEmpty():
            break
        # Each hop's nodes are a written table of their own.
        seen = seen.unionByName(frontier)
    return seen


def descendants(nodes: DataFrame) -> DataFrame:
    """``(ancestor_id, id, depth)`` over the containment tree, of any depth; a node that contains itself is an error.

    Each node's list of ancestors, nearest first, is joined to that of its last ancestor until none grows: lists double, so a tree of depth d takes about log2(d) joins.
    """
    lists = written(nodes.where("container_id is not null").select("id", F.array("container_id").alias("up")), "ancestors")
    while True:
        if not lists.where(F.array_contains("up", F.col("id"))).isEmpty():
            raise ValueError("a node contains itself")
        further = lists.select(F.col("id").alias("last"), F.col("up").alias("further"))
        grown = lists.join(further, F.element_at("up", -1) == F.col("last"), "left")
        grown = written(grown.select("id", F.concat("up", F.coalesce("further", F.expr("cast(array() as array<bigint>)"))).alias("up"), F.col("further").isNotNull().alias("grew")), "ancestors")
        lists = grown.select("id", "up")
        if grown.where("grew").isEmpty():
            return lists.select("id", F.posexplode("up").alias("depth", "ancestor_id")).select("ancestor_id", "id", (F.col("depth") + 1).cast("long").alias("depth"))
