"""From positions in files to the innermost symbol around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import END
from .tables import written


#: Level of a span that crosses line 0, or nearly all lines; all such are one block.
TOP = 64
#: So many halvings make a level: a point meets that many fewer levels, and in each block up to 2^BAND spans more.
BAND = 4


def _block(line: str) -> Column:
    return F.expr(f"CASE WHEN level = {TOP} THEN 0L ELSE shiftright(CAST({line} AS BIGINT), level) END")


def innermost(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each distinct ``(uri, line, character)`` the innermost node around it: the point with ``node_id``.

    A span lies in one block: of every fourth of the halvings of a file's lines, the smallest that holds it whole. A point looks into its own block on each
    level that spans of its file have (16 at most), so it meets nested spans around a block's middle and not all of its file's; the containment is the
    residual of that equi-join. Then the least span in one map-side combined aggregate; ties go to the smaller id. Points in no node, and nulls in a
    position or a span, are dropped.
    """
    inside = (
        ((F.col("range_start_line") < F.col("line")) | ((F.col("range_start_line") == F.col("line")) & (F.col("range_start_col") <= F.col("character"))))
        & ((F.col("range_end_line") > F.col("line")) | ((F.col("range_end_line") == F.col("line")) & (F.col("range_end_col") >= F.col("character"))))
    )
    spans = nodes.select("uri", "id", "range_start_line", "range_start_col", "range_end_line", "range_end_col").dropna()
    crossed = F.bin(F.col("range_start_line").cast("long").bitwiseXOR(F.col("range_end_line").cast("long")))
    spans = spans.withColumn("level", (F.ceil(F.length(crossed) / BAND) * BAND).cast("int")).withColumn("block", _block("range_start_line"))
    levels = spans.select("uri", "level").distinct()
    asked = points.select("uri", "line", "character").dropna().distinct().join(levels, "uri").withColumn("block", _block("line"))
    joined = asked.join(spans, ["uri", "level", "block"]).where(inside)
    size = F.struct((F.col("range_end_line") - F.col("range_start_line")).alias("lines"), (F.col("range_end_col") - F.col("range_start_col")).alias("cols"), "id")
    return joined.groupBy("uri", "line", "character").agg(F.min(size)["id"].alias("node_id"))


def resolve_callers(points: DataFrame, nodes: DataFrame, root_uri: str) -> DataFrame:
    """Like ``innermost`` for call sites' enclosing symbols with their selection: an all-zero selection means the file's module."""
    from ..functions.text import module_path

    zero = (F.col("line") == 0) & (F.col("character") == 0) & (F.col("end_line") == 0) & (F.col("end_character") == 0)
    modules = nodes.select(F.col("fqn").alias("module"), F.col("id").alias("node_id"))
    at_module = points.where(zero).withColumn("module", module_path(F.col("uri"), root_uri)).join(modules, "module").select("uri", "line", "character", "node_id").distinct()
    return innermost(points.where(~zero), nodes).select("uri", "line", "character", "node_id").unionByName(at_module)


def find_definition(requests: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Definition targets of ``(uri, line, character)`` requests, resolved to nodes; what resolves to none is dropped.

    ``facts`` are location rows, ``rank`` numbering an answer's targets in its order (none, or null: all alike); returns ``(uri, line, character, rank, node_id)``,
    a row for each target, so a node that two targets lie in comes twice.
    """
    rank = F.coalesce("rank", F.lit(0)) if "rank" in facts.columns else F.lit(0)
    asked = facts.where("op = 'definition'").join(requests.select("uri", "line", "character").distinct(), ["uri", "line", "character"])
    targets = asked.select("uri", "line", "character", rank.cast("long").alias("rank"), F.col("target_uri").alias("t_uri"), F.col("target_line").alias("t_line"), F.col("target_character").alias("t_character"))
    # Read twice, by different columns: unwritten, the facts would be shuffled for each.
    targets = written(targets, "targets")
    found = innermost(targets.select(F.col("t_uri").alias("uri"), F.col("t_line").alias("line"), F.col("t_character").alias("character")), nodes)
    named = found.select(F.col("uri").alias("t_uri"), F.col("line").alias("t_line"), F.col("character").alias("t_character"), "node_id")
    return targets.join(named, ["t_uri", "t_line", "t_character"]).select("uri", "line", "character", "rank", "node_id").distinct()


def resolve_anchors(requests: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The symbol that each ``(uri, line, character)`` means: the first of its definition's targets that resolves, in the answer's order, else the symbol around it.

    Targets of one rank are taken by the smaller id.
    """
    found = find_definition(requests, facts, nodes)
    defined = found.groupBy("uri", "line", "character").agg(F.min(F.struct("rank", "node_id"))["node_id"].alias("defined"))
    around = innermost(requests, nodes)
    both = requests.select("uri", "line", "character").distinct().join(defined, ["uri", "line", "character"], "left").join(around, ["uri", "line", "character"], "left")
    return both.select("uri", "line", "character", F.coalesce("defined", "node_id").alias("anchor_id")).where("anchor_id is not null")


__all__ = ["END", "find_definition", "innermost", "resolve_anchors", "resolve_callers"]
