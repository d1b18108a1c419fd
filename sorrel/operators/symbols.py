"""Symbol search, filters, hints and result shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .paging import page, sort_key


@dataclass(frozen=True)
class NodeFilter:
    """What queries let through: one language, some kind labels, and foreign code only if asked for."""

    language: str | None = None
    kinds: tuple[str, ...] = ()
    include_external: bool = False

    def apply(self, nodes: DataFrame) -> DataFrame:
        if not self.include_external:
            nodes = nodes.where(~F.col("is_external"))
        if self.language is not None:
            nodes = nodes.where(F.col("language") == self.language)
        if self.kinds:
            nodes = nodes.where(T.kind_label(F.col("node_kind"), F.col("construct")).isin(*self.kinds))
        return nodes


def list_nodes(nodes: DataFrame, language: str | None = None) -> DataFrame:
    """Valid nodes, of one language if named."""
    out = nodes.where("valid")
    return out if language is None else out.where(F.col("language") == language)


def by_fqn(nodes: DataFrame, fqn: str) -> DataFrame:
    """The node of a name, valid or not."""
    return nodes.where(F.col("fqn") == fqn)


def by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def by_uri(nodes: DataFrame, uri: str) -> DataFrame:
    return nodes.where(F.col("uri") == uri)


def known_uris(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("orphan")).select("uri").distinct()


def count_real_nodes(nodes: DataFrame, root_uri: str) -> DataFrame:
    """By file: its nodes other than the module root, orphans too."""
    module = T.module_path(F.col("uri"), root_uri)
    return nodes.groupBy("uri").agg(F.count_if(F.col("fqn") != module).alias("real_nodes"))


def find_symbol(nodes: DataFrame, pattern: str, mode: str = "segment", ignore_case: bool = False, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor=None, brief: bool = False) -> DataFrame:
    """A page of valid nodes whose name fits the pattern; ``brief`` keeps the names alone."""
    found = node_filter.apply(list_nodes(nodes)).where(T.matches(F.col("fqn"), pattern, mode, ignore_case))
    shown = page(found, limit, cursor)
    return shown.select("fqn", "has_more") if brief else shown


def hints(nodes: DataFrame, missing: str, limit: int = 10) -> DataFrame:
    """Names close to one that does not exist: own valid nodes with its last segment, else with one like it."""
    want = missing.rpartition(".")[2]
    own = nodes.where("valid and not is_external").select("fqn")
    exact = own.where(T.matches(F.col("fqn"), want, "segment")).distinct().orderBy("fqn").limit(limit)
    fuzzy = own.where(T.matches(F.col("fqn"), want, "fuzzy")).distinct().orderBy("fqn").limit(limit)
    # Both sides hold ``limit`` rows at most, so deciding between them costs nothing.
    return exact.select("fqn").unionAll(fuzzy.join(exact.limit(1).select(F.lit(True).alias("hit")), F.lit(True), "left_anti"))


def node_result(nodes: DataFrame) -> DataFrame:
    """The fields that results show, with nested ranges and numbers saturated."""

    def span(part: str) -> Column:
        at = lambda end: F.struct(T.shown_number(F.col(f"{part}_{end}_line")).alias("line"), T.shown_number(F.col(f"{part}_{end}_col")).alias("character"))
        return F.struct(at("start").alias("start"), at("end").alias("end"))

    return nodes.select(
        "fqn", "uri", "name", "language", T.kind_label(F.col("node_kind"), F.col("construct")).alias("kind_label"), T.shown_number(F.col("kind")).alias("kind_num"),
        "construct", span("range").alias("range"), span("sel").alias("selection_range"), "signature", "documentation", "is_external",
    )


def result_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; absent optional fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


__all__ = ["NodeFilter", "by_fqn", "by_id", "by_uri", "count_real_nodes", "find_symbol", "hints", "known_uris", "list_nodes", "node_result", "result_json", "sort_key"]
