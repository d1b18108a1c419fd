"""Keyed merges into the graph's tables: each takes tables and returns the new ones. ``buckets`` applies them to tables in place, by the parts that they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import EDGE_KEY
from .tables import numbered, written

PHYSICAL_KEY = ["uri", "range_start_line", "range_start_col", "name"]


def _last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``; the row travels whole through a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best._row.*").select(*df.columns)


def get_meta(meta: DataFrame, key: str) -> str | None:
    """A setting's value, None where there is none."""
    row = meta.where(F.col("key") == key).select("value").first()
    return row and row["value"]


def top_id(table: DataFrame, last: int = 0) -> int:
    """The greatest id that was ever given out: ``last``, as stored, or the table's own greatest."""
    return max(last, table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])


def allocate(new: DataFrame, existing: DataFrame, order: list[str], last: int = 0) -> DataFrame:
    """Gives rows the next ids after all that were ever given out, in ``order``."""
    return numbered(new, order, "id", top_id(existing, last)).select(*new.columns)


def merge_nodes(nodes: DataFrame, batch: DataFrame, order: str = "id", last: int = 0) -> tuple[DataFrame, DataFrame]:
    """What ``upsert_nodes`` changes, written: rows that replace those of their id or are new, and the ids ``(id)`` of old rows that go."""
    columns = nodes.columns
    # The order travels apart: as "id" it would go with the key's columns.
    batch = batch.withColumn("_order", F.col(order))
    batch = written(_last(_last(batch, ["fqn"], [F.col("_order")]), PHYSICAL_KEY, [F.col("_order")]).drop("_order"), "batch")
    by_name = nodes.select(F.col("id").alias("_by_name"), "fqn")
    by_place = nodes.join(batch.select("fqn"), "fqn", "left_anti").select(F.col("id").alias("_by_place"), *PHYSICAL_KEY)
    found = batch.join(by_name, "fqn", "left").join(by_place, PHYSICAL_KEY, "left")
    placed = written(found.withColumn("_old", F.coalesce("_by_name", "_by_place")).drop("_by_name", "_by_place"), "placed")
    known = placed.where("_old is not null").withColumn("id", F.col("_old")).select(*columns)
    fresh = placed.where("_old is null").select(*columns)
    gone = nodes.join(placed.select(*PHYSICAL_KEY), PHYSICAL_KEY, "left_semi").join(known.select("id"), "id", "left_anti").select("id")
    return written(known.unionByName(allocate(fresh, nodes, ["fqn"], last)), "changed"), written(gone, "gone")


def upsert_nodes(nodes: DataFrame, batch: DataFrame, order: str = "id", last: int = 0) -> tuple[DataFrame, DataFrame]:
    """Insert or overwrite by ``fqn``, else by physical key; ids of overwritten rows stay, and both keys stay unique.

    Of a batch's rows with one name the last by ``order`` counts, then of those at one place. An old row is claimed once:
    by name before place, so a place's old row whose name the batch has elsewhere is not
    taken over. An old row that nothing claims goes when a batch row comes to stand at its place. All other columns come from the batch, nulls too.
    New ids follow ``last`` and the table's greatest. Returns the table and the ids ``(id)`` that went: what hangs on these goes by ``delete_nodes``.
    """
    changed, gone = merge_nodes(nodes, batch, order, last)
    kept = nodes.join(changed.select("id"), "id", "left_anti").join(gone, "id", "left_anti")
    return kept.select(*nodes.columns).unionByName(changed), gone


def _merged(edges: DataFrame, batch: DataFrame, last: Callable[[int], int]) -> DataFrame:
    """The rows of both by the six-part key, null-safe, written once, and whether the batch has them as ``_hit``. New ids follow ``last`` of the greatest in ``edges``.

    Both cross one shuffle, in which a source's edges on one line stay side by side, and nothing is joined. New rows are numbered where they lie.
    """
    rest = [c for c in edges.columns if c not in EDGE_KEY and c != "id"]
    order = ["valid", "site_end_line", "site_end_col"]
    both = edges.withColumn("_batch", F.lit(False)).unionByName(batch.select(F.lit(None).cast("long").alias("id"), *EDGE_KEY, *rest, F.lit(True).alias("_batch")))
    # A source's edges without a line are dealt out by their other ends.
    at = F.coalesce("site_start_line", "dst_id")
    dealt = both.repartition("src_id", at).withColumn("_at", at)
    key = Window.partitionBy("_at", *EDGE_KEY).orderBy("_batch")
    whole = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.max(F.when(F.col("_batch"), F.struct(*order, *[c for c in rest if c not in order]))).over(whole)
    met = dealt.withColumn("_best", best).withColumn("_nth", F.row_number().over(key)).withColumn("_hit", F.col("_best").isNotNull())
    met = met.select("_batch", "_nth", "_hit", "id", *EDGE_KEY, *[F.when(F.col("_hit"), F.col(f"_best.{c}")).otherwise(F.col(c)).alias(c) for c in rest])
    shown = [*edges.columns, "_hit"]
    # Among new rows alone these numbers have no gaps inside a task.
    new = met.where("_batch and _nth = 1").select(*shown, F.monotonically_increasing_id().alias("_n"))
    out = written(met.where("not _batch").select(*shown, F.lit(None).cast("long").alias("_n")).unionByName(new), "merged", "zstd")
    part = F.shiftright("_n", 33)
    bases, at = [], last(top_id(out))
    for task, n in sorted((r["_part"], r["count"]) for r in out.where("_n is not null").groupBy(part.alias("_part")).count().collect()):
        bases.append((task, at))
        at += n
    shift = F.broadcast(edges.sparkSession.createDataFrame(bases, "_part long, _base long"))
    given = F.col("_base") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.join(shift, part == F.col("_part"), "left").withColumn("id", F.coalesce("id", given)).select(*shown)


def merged_edges(edges: DataFrame, batch: DataFrame, last: int | None = None) -> DataFrame:
    """What ``upsert_edges`` changes or adds, written: the batch's edges with their ids. New ids follow ``last`` (default: the greatest in ``edges``)."""
    return _merged(edges, batch, lambda top: top if last is None else last).where("_hit").select(*edges.columns)


def upsert_edges(edges: DataFrame, batch: DataFrame, last: int = 0) -> DataFrame:
    """Merge by the six-part key, null-safe: known edges keep their id and take validity and end from the batch; new ids follow ``last`` and the table's greatest."""
    return _merged(edges, batch, lambda top: max(top, last)).select(*edges.columns)


def merge_keyed(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` replace those of ``table`` with the same keys: settings and callee hashes."""
    return table.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch.select(*table.columns))


def mark_materialized(marks: DataFrame, batch: DataFrame) -> DataFrame:
    """Marks already there stay; new ones are added once."""
    return marks.unionByName(batch.join(marks, marks.columns, "left_anti").distinct())


def update_column(nodes: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` from ``(key, column)`` rows, where there is one."""
    new = values.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = nodes.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
    return out.select(*nodes.columns)


def invalidate_outgoing_calls(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    hit = anchors.select(F.col("anchor_id").alias("src_id")).distinct().withColumn("_hit", F.lit(True))
    out = edges.join(hit, "src_id", "left")
    return out.withColumn("valid", F.col("valid") & ~(F.coalesce("_hit", F.lit(False)) & (F.col("edge_type") == "calls"))).select(*edges.columns)


#: So many ids are broadcast at most.
FEW = 8192


def _ids(rows: DataFrame, name: str) -> DataFrame:
    """The distinct ids of ``rows``, written, for joins with many rows: a few are broadcast; of more, each task holds its share in memory, so that what they meet is dealt out but not sorted."""
    ids = written(rows.select("id").distinct(), name)
    return ids.hint("broadcast" if ids.count() <= FEW else "shuffle_hash")


def invalidate_incident(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges at either end of changed nodes ``(id)`` are no longer valid."""
    ids = _ids(changed, "touched")
    src = ids.select(F.col("id").alias("src_id"), F.lit(True).alias("_s"))
    dst = ids.select(F.col("id").alias("dst_id"), F.lit(True).alias("_d"))
    out = edges.join(src, "src_id", "left").join(dst, "dst_id", "left")
    return out.withColumn("valid", F.col("valid") & F.col("_s").isNull() & F.col("_d").isNull()).select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, cache: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove nodes ``(id)`` with their edges, hashes and marks; children lose their container."""
    ids = _ids(gone, "gone")
    left = nodes.join(ids, "id", "left_anti")
    up = ids.select(F.col("id").alias("container_id"), F.lit(True).alias("_up"))
    left = left.join(up, "container_id", "left").withColumn("container_id", F.when(F.col("_up").isNull(), F.col("container_id"))).select(*nodes.columns)
    for end in ("src_id", "dst_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    anchors = ids.withColumnRenamed("id", "anchor_id")
    return left, edges, cache.join(anchors, "anchor_id", "left_anti"), marks.join(anchors, "anchor_id", "left_anti")


def drop_callee_hashes(cache: DataFrame, nodes: DataFrame, uris: DataFrame) -> DataFrame:
    """Hashes of anchors in the named files go."""
    anchors = nodes.join(uris.select("uri").distinct(), "uri", "left_semi").select(F.col("id").alias("anchor_id"))
    return cache.join(anchors, "anchor_id", "left_anti")
