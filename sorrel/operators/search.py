"""An index for symbol search: which nodes have a segment in their names, and which segments are like a given one.

Segments are kept once, in buckets by their ASCII-folded form, with the ids of their nodes in another table; segments' pairs of neighbouring characters are kept in
buckets of their own, so that a fuzzy search reads the buckets of its own pairs alone, and only segments that share enough of them have their distance computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .buckets import BucketTable
from .paging import page
from .symbols import NodeFilter, list_nodes
from .tables import fresh_path, written

#: Similarity of a fuzzy match; characters of a gram; what stands before and behind a segment in its grams.
LIKE, GRAM, EDGE = 0.7, 2, "\u0001"


def shared_at_least(longer: int) -> int:
    """Grams, counted with their repeats, that two segments at the least similarity share, the longer having so many characters: each edit changes ``GRAM`` of them at most.

    It is 1 or more at every length, so a segment that shares no gram is no match.
    """
    return max(1, longer + GRAM - 1 - GRAM * edits(longer))


def edits(longer: int) -> int:
    """Edits that leave two segments similar enough, the longer having so many characters."""
    return next(d for d in range(math.ceil((1 - LIKE) * longer) + 1, -1, -1) if 1 - d / max(1, longer) >= LIKE)


def _grams(folded: Column) -> Column:
    padded = F.concat(F.lit(EDGE), folded, F.lit(EDGE))
    each = F.transform(F.sequence(F.lit(1), F.char_length(padded) - 1), lambda i: F.substring(padded, i, F.lit(GRAM)))
    return F.transform(F.array_distinct(each), lambda g: F.struct(g.alias("gram"), F.size(F.filter(each, lambda x: x == g)).alias("times")))


class SearchIndex:
    """Segments ``(folded, segment, length)``, their nodes ``(folded, segment, id)`` and grams ``(gram, times, folded, length)``, in buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        table = lambda name, ddl, key: BucketTable(spark, f"{path}/{name}", ddl, [key], buckets)
        self.spark = spark
        self.postings = table("postings", "folded string, segment string, id bigint", "folded")
        self.grams = table("grams", "gram string, times int, folded string, length int", "gram")

    @classmethod
    def build(cls, nodes: DataFrame, path: str | None = None, buckets: int = 64) -> SearchIndex:
        """The index of all nodes, valid or not, written below ``path`` (default: a folder that goes with the driver's JVM)."""
        out = cls(nodes.sparkSession, path or fresh_path(nodes.sparkSession, "search"), buckets)
        every = list(range(buckets))
        segments = nodes.select("id", F.explode(F.array_distinct(F.split("fqn", r"\."))).alias("segment"))
        out.postings.replace(segments.select(T.ascii_lower(F.col("segment")).alias("folded"), "segment", "id"), every)
        distinct = out.postings.read().select("folded").distinct()
        grams = distinct.select("folded", F.char_length("folded").alias("length"), F.explode(_grams(F.col("folded"))).alias("g"))
        out.grams.replace(grams.select("g.gram", "g.times", "folded", "length"), every)
        return out

    def _table(self, rows: list[tuple], ddl: str) -> DataFrame:
        return self.spark.createDataFrame(rows, ddl)

    def with_segment(self, want: str, ignore_case: bool = False) -> DataFrame:
        """Ids ``(id)`` of nodes that have the segment: one bucket is read."""
        folded = want.translate(str.maketrans(T.UPPER, T.LOWER))
        rows = self.postings.read(self.postings.buckets_of(self._table([(folded,)], "folded string"))).where(F.col("folded") == folded)
        return (rows if ignore_case else rows.where(F.col("segment") == want)).select("id").distinct()

    def candidates(self, want: str) -> DataFrame:
        """Folded segments ``(folded)`` that may be similar enough to ``want``, by length and by the grams that they share with it: none that is similar is missing."""
        folded = want.translate(str.maketrans(T.UPPER, T.LOWER))
        n, padded = len(folded), f"{EDGE}{folded}{EDGE}"
        times: dict[str, int] = {}
        for i in range(len(padded) - 1):
            times[padded[i : i + GRAM]] = times.get(padded[i : i + GRAM], 0) + 1
        own = self._table(list(times.items()), "gram string, wanted int")
        # Lengths at which some segment is similar, and the grams to share at each.
        lengths = [(m, shared_at_least(max(m, n))) for m in range(int(LIKE * n) - 1, math.ceil(n / LIKE) + 2) if m >= 0 and abs(m - n) <= edits(max(m, n))]
        need = F.broadcast(self._table(lengths, "length int, need int"))
        rows = self.grams.read(self.grams.buckets_of(own)).join(F.broadcast(own), "gram").join(need, "length")
        shared = rows.groupBy("folded").agg(F.sum(F.least("times", "wanted")).alias("shared"), F.first("need").alias("need"))
        return shared.where("shared >= need").select("folded")

    def like(self, want: str, ignore_case: bool = False) -> DataFrame:
        """Ids ``(id)`` of nodes with a segment whose similarity to ``want`` is ``LIKE`` or more: distances are those of the candidates alone."""
        near = written(self.candidates(want), "candidates")
        rows = self.postings.read(self.postings.buckets_of(near)).join(near, "folded")
        name, aim = (F.col("folded"), want.translate(str.maketrans(T.UPPER, T.LOWER))) if ignore_case else (F.col("segment"), want)
        longest = F.greatest(F.char_length(name), F.char_length(F.lit(aim)), F.lit(1))
        return rows.where(1 - F.levenshtein(name, F.lit(aim)) / longest >= LIKE).select("id").distinct()


def find_symbol(index: SearchIndex, nodes: DataFrame, pattern: str, mode: str = "segment", ignore_case: bool = False, node_filter: NodeFilter = NodeFilter(), limit: int | None = None, cursor=None, brief: bool = False) -> DataFrame:
    """``symbols.find_symbol`` for the modes ``segment`` and ``fuzzy``, by the index of the nodes."""
    if mode not in ("segment", "fuzzy"):
        raise ValueError(f"no index for mode: {mode}")
    ids = index.with_segment(pattern, ignore_case) if mode == "segment" else index.like(pattern, ignore_case)
    shown = page(node_filter.apply(list_nodes(nodes)).join(ids, "id", "left_semi").select(*nodes.columns), limit, cursor)
    return shown.select("fqn", "has_more") if brief else shown


def hints(index: SearchIndex, nodes: DataFrame, missing: str, limit: int = 10) -> DataFrame:
    """``symbols.hints`` by the index: names of own valid nodes with the last segment of ``missing``, else with one like it."""
    want, own = missing.rpartition(".")[2], nodes.where("valid and not is_external").select("id", "fqn")
    named = lambda ids: own.join(ids, "id", "left_semi").select("fqn").distinct().orderBy("fqn").limit(limit)
    exact = named(index.with_segment(want))
    return named(index.like(want)) if exact.isEmpty() else exact
