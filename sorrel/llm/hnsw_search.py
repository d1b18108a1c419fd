"""Nearest neighbours by a navigable small-world graph in each shard.

Hierarchical navigable small-world graph per shard, stored as flat neighbour arrays, with shard results merged. Distinct vectors are dealt
to shards of bounded size; a task builds its shard's graph and returns a row for each vector with its neighbours on all
levels in one flat array. Queries meet every shard in blocks, go down its graph, and the best of all shards' answers
are each query's. Vectors that many rows share are one node, with the few smallest ids that an answer can name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Rows of a shard: at most, whatever the table's size, and at least while there are task slots without a shard.
SHARD_MOST, SHARD_LEAST = 1 << 16, 1 << 12
#: Numbers (rows x dimensions) of a shard at most, and of a block of queries.
SHARD_CELLS, BLOCK_CELLS = 1 << 23, 1 << 20
#: Neighbours of a node on the lowest level and on the others; beam widths of building and of searching.
WIDE, NARROW = 32, 16
BUILD_BEAM, SEARCH_BEAM = 80, 128
#: Nodes that are inserted, and queries that are searched, at a time.
AT_ONCE = 512
#: Nodes of the beam whose neighbours are looked at in a step.
OPENED = 4


def _level_sizes(n: int) -> list[int]:
    """How many of ``n`` nodes reach each level: all, a sixteenth, and so on down to one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // NARROW))
    return sizes[:-1] or sizes


def beam_search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of one level for many queries side by side: ids and similarities of the ``width`` best nodes met, best first (-1: none).

    ``entry`` holds each query's starting nodes (-1: none); nodes from ``limit`` on are not entered.
    """
    n, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((n, len(neighbours) + 1), bool)
    seen[:, -1] = True
    if limit is not None:
        seen[:, limit:] = True
    ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    opened = np.ones((n, width), bool)
    # Within a part no row has a node twice.
    parts = [entry[:, i : i + 1] for i in range(entry.shape[1])]
    while True:
        fresh = []
        for part in parts:
            fresh.append(~seen[rows[:, None], part])
            seen[rows[:, None], part] = True
        new, fresh = np.concatenate(parts, 1), np.concatenate(fresh, 1)
        found_ids, found_sims = np.full(new.shape, -1, np.int32), np.full(new.shape, -np.inf, np.float32)
        q, k = np.nonzero(fresh)
        met = new[q, k]
        found_ids[q, k] = met
        found_sims[q, k] = np.einsum("ij,ij->i", vectors[met], queries[q])
        all_ids, all_sims = np.concatenate([ids, found_ids], 1), np.concatenate([sims, found_sims], 1)
        all_opened = np.concatenate([opened, found_ids < 0], 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        ids, sims, opened = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_opened))
        opened |= ids < 0
        todo = ~opened
        if not todo.any():
            return ids, sims
        # The first nodes of each beam that are not opened yet.
        nth = np.cumsum(todo, 1)
        chosen = np.full((n, OPENED), -1, np.int64)
        r, c = np.nonzero(todo & (nth <= OPENED))
        chosen[r, nth[r, c] - 1] = ids[r, c]
        opened[r, c] = True
        parts = [np.where(chosen[:, i : i + 1] >= 0, neighbours[chosen[:, i]], -1) for i in range(OPENED)]


def spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first (-1: none), ``most`` as neighbours: those nearer to the row than to one chosen before, then the nearest of the rest."""
    n, width = ids.shape
    near = vectors[ids]
    between = np.matmul(near, near.transpose(0, 2, 1))
    worst, taken, count = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool), np.zeros(n, np.int64)
    for c in range(width):
        ok = (ids[:, c] >= 0) & (sims[:, c] > worst[:, c]) & (count < most)
        taken[:, c] = ok
        count += ok
        worst[ok] = np.maximum(worst[ok], between[ok, c])
    # Chosen ones first, each kind by nearness.
    order = np.argsort(np.where(taken, 0, 1) * width * 2 + np.where(ids >= 0, 0, width) + np.arange(width), 1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _link_back(vectors: np.ndarray, neighbours: np.ndarray, start: int, end: int) -> None:
    """Give the neighbours of nodes ``start`` to ``end`` their links back, thinned where a node has too many."""
    most = neighbours.shape[1]
    own = np.repeat(np.arange(start, end), most)
    other = neighbours[start:end].ravel()
    own, other = own[other >= 0], other[other >= 0]
    sims = np.einsum("ij,ij->i", vectors[own], vectors[other])
    order = np.lexsort((-sims, other))
    own, other = own[order], other[order]
    heads, counts = np.unique(other, return_counts=True)
    place = np.arange(len(other)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Of more new links than a node can hold, the nearest are tried.
    keep = place < most
    incoming = np.full((len(heads), min(most, int(counts.max(initial=1)))), -1, np.int32)
    incoming[np.searchsorted(heads, other[keep]), place[keep]] = own[keep]
    for at in range(0, len(heads), AT_ONCE):
        h = heads[at : at + AT_ONCE]
        both = np.concatenate([neighbours[h], incoming[at : at + AT_ONCE]], 1)
        # A link that is there already counts once.
        both[:, most:][(both[:, most:, None] == both[:, None, :most]).any(2)] = -1
        near = np.where(both >= 0, np.einsum("ijk,ik->ij", vectors[both], vectors[h]), -np.inf)
        order = np.argsort(-near, 1, kind="stable")
        neighbours[h] = spread(vectors, np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1), most)


def build_graph(vectors: np.ndarray) -> list[np.ndarray]:
    """Neighbour tables by level, lowest first; the first ``k`` nodes reach a level of ``k`` rows. ``vectors`` are of length one, in random order.

    Levels are built from the top. Nodes are inserted in batches that no more than double what is there: each looks for its neighbours
    in the level so far, starting from what the level above finds, and among its own batch.
    """
    sizes = _level_sizes(len(vectors))
    graph: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        n, most = sizes[level], WIDE if level == 0 else NARROW
        table_ = np.full((n, most), -1, np.int32)
        start = 0
        while start < n:
            end = min(n, start + min(AT_ONCE, max(start, WIDE)))
            batch = vectors[start:end]
            among = batch @ batch.T
            np.fill_diagonal(among, -np.inf)
            top = np.argsort(-among, 1)[:, :most]
            ids, sims = top.astype(np.int32) + start, np.take_along_axis(among, top, 1)
            # Without itself a batch of one has nobody.
            ids[~np.isfinite(sims)] = -1
            if start:
                entry = descend(vectors, graph, batch, level, start)
                more, more_sims = beam_search(vectors, table_, batch, entry, BUILD_BEAM, start)
                ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, more_sims], 1)
                order = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            table_[start:end] = spread(vectors, ids, sims, most)
            _link_back(vectors, table_, start, end)
            start = end
        graph[level] = table_
    return graph


def descend(vectors: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, level: int, limit: int) -> np.ndarray:
    """Starting nodes for ``level``, below ``limit``, from the levels above it."""
    entry = np.zeros((len(queries), 1), np.int64)
    for above in range(len(graph) - 1, level, -1):
        entry = beam_search(vectors, graph[above], queries, entry, NARROW)[0].astype(np.int64)
    entry = np.where(entry < limit, entry, -1)
    return np.concatenate([entry, np.zeros((len(queries), 1), np.int64)], 1) if level < len(graph) - 1 else entry


def search_graph(vectors: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``width`` best nodes that the search meets, best first (-1: none)."""
    out = []
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE]
        out.append(beam_search(vectors, graph[0], q, descend(vectors, graph, q, 0, len(vectors)), width))
    return np.concatenate([ids for ids, _ in out]), np.concatenate([s for _, s in out])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A table's column in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return _one(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: none of its components is null or not finite, and not all are zero."""
    big = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == big))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def index_vectors(rows: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index, written: ``(dim, shard, node, ids, vector, levels, neighbours)``, a row for each distinct vector.

    ``ids`` are the ``k + 1`` smallest of the rows that have the vector: more of them can be in no answer. ``neighbours`` holds the node's
    neighbours on all its ``levels``, lowest first, ``WIDE`` of the lowest and ``NARROW`` of each other, -1 for none. Every usable vector is indexed;
    vectors of other lengths are in shards of their own. Of rows that repeat an id the one with the smallest vector counts; rows without an id take no part.
    """
    spark = rows.sparkSession
    id_kind = rows.schema[id_col].dataType.simpleString()
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    one = own.groupBy("id").agg(F.min("vector").alias("vector"))
    # Spark limits such a window's groups before the shuffle, so copies of one vector do not meet in one task.
    ranked = one.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = materialize(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector")), "vectors")
    slots = spark.sparkContext.defaultParallelism
    counts = [(r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect()]
    shards = [(dim, max(-(-n // min(SHARD_MOST, max(1, SHARD_CELLS // dim))), min(-(-n // SHARD_LEAST), 2 * slots))) for dim, n in counts]
    dealt = nodes.join(F.broadcast(spark.createDataFrame(shards, "dim int, shards long")), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), "shards")).drop("shards")

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        # The nodes' order, and with it their levels, is drawn from their vectors alone.
        raw = _matrix(group.column("vector"), dim)
        order = np.argsort([xxhash.xxh64_intdigest(v.tobytes()) for v in raw], kind="stable")
        graph = build_graph(_unit(raw[order]))
        levels = np.array([sum(i < len(t) for t in graph) for i in range(len(order))])
        ends = np.concatenate([[0], np.cumsum(WIDE + NARROW * (levels - 1))])
        flat = np.full(ends[-1], -1, np.int32)
        for level, links in enumerate(graph):
            width = WIDE if level == 0 else NARROW
            at = ends[: len(links)] + (0 if level == 0 else WIDE + NARROW * (level - 1))
            flat[at[:, None] + np.arange(width)] = links
        group = group.take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        return pa.table([group.column("dim"), group.column("shard"), pa.array(np.arange(len(order), dtype=np.int32)), group.column("ids"), group.column("vector"), pa.array(levels.astype(np.int32)), lists], ["dim", "shard", "node", "ids", "vector", "levels", "neighbours"])

    kinds = f"dim int, shard long, node int, ids array<{id_kind}>, vector array<double>, levels int, neighbours array<int>"
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, kinds), "index")


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, width: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows that the search finds for each query row: ``(query_id, rank, id, score)``, ranks from 1.

    Score is the cosine in double precision of the vectors as they are; ties go to the smaller id. A query's own id is no
    candidate. Unusable queries, and those without an id, have no rows; of queries that repeat an id the one with the smallest vector counts. A query finds
    fewer than ``k`` rows where there are no more of its length. Other columns are ignored; an empty table on either side gives none.
    """
    spark = index.sparkSession
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = materialize(asked.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    shards = index.groupBy("dim", "shard").agg(F.count("*").alias("nodes"))
    # Blocks of queries and shards meet, each pair in a task: both sides are sent once for each part of the other.
    sizes = [(r["dim"], max(1, -(-r["count"] * r["dim"] // BLOCK_CELLS))) for r in asked.groupBy("dim").count().collect()]
    blocks = F.broadcast(spark.createDataFrame(sizes, "dim int, blocks long"))
    dealt = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    packed = dealt.mapInArrow(_packer(id_kind), f"dim int, block long, ids array<{id_kind}>, vectors array<double>")
    spots = shards.select("dim", "shard").join(blocks, "dim")
    # Columns of new names: a co-group's sides must not share any.
    sent = packed.join(F.broadcast(spots.select("dim", "shard").distinct()), "dim").select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("block").alias("q_block"), "ids", "vectors").toDF("q_dim", "q_shard", "q_block", "q_ids", "q_vectors")
    shelves = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        kind = nodes.schema.field("ids").type.value_type
        names = ["query_id", "id", "score"]
        if not nodes.num_rows or not asked.num_rows:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names)
        dim = nodes.column("dim")[0].as_py()
        nodes = nodes.sort_by("node")
        raw, levels = _matrix(nodes.column("vector"), dim), nodes.column("levels").to_numpy()
        flat = _one(nodes.column("neighbours")).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(WIDE + NARROW * (levels - 1))])
        graph = []
        for level in range(levels.max(initial=1)):
            held = np.flatnonzero(levels > level)
            at = ends[held] + (0 if level == 0 else WIDE + NARROW * (level - 1))
            graph.append(flat[at[:, None] + np.arange(WIDE if level == 0 else NARROW)])
        query_ids = _one(asked.column("q_ids")).flatten()
        q = _matrix(asked.column("q_vectors"), 1).reshape(-1, dim)
        found, _ = search_graph(_unit(raw), graph, _unit(q), max(width, 2 * k))
        rows, cols = np.nonzero(found >= 0)
        hit = found[rows, cols]
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        score = np.einsum("ij,ij->i", raw[hit], q[rows]) / (norm[hit] * np.sqrt(np.einsum("ij,ij->i", q, q))[rows])
        lists = _one(nodes.column("ids"))
        least = pc.rank(lists.flatten().take(lists.offsets[:-1]), tiebreaker="min").to_numpy()
        # The best k + 1 nodes hold k ids that are not the query's own.
        order = np.lexsort((least[hit], -score, rows))
        rows, hit, score = rows[order], hit[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place <= k
        rows, hit, score = rows[first], hit[first], score[first]
        lists = lists.take(pa.array(hit))
        times = np.diff(lists.offsets.to_numpy())
        return pa.table([query_ids.take(pa.array(np.repeat(rows, times))), lists.flatten(), pa.array(np.repeat(score, times))], names)

    found = shelves.groupBy("dim", "shard", "block").cogroup(sent.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(search, f"query_id {id_kind}, id {id_kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.where("query_id != id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _packer(id_kind: str):
    """Arrow batches of ``(id, vector, dim, block)`` to a row for each dimension and block in the batch, its vectors side by side."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            dims, blocks = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "block"))
            ids, vectors = batch.column(names.index("id")), batch.column(names.index("vector"))
            rows = []
            for dim, block in sorted(set(zip(dims.tolist(), blocks.tolist(), strict=True))):
                here = pa.array(np.flatnonzero((dims == dim) & (blocks == block)))
                rows.append((dim, block, ids.take(here), vectors.take(here).flatten()))
            offsets = lambda i: pa.array(np.concatenate([[0], np.cumsum([len(r[i]) for r in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets(i), pa.concat_arrays([r[i] for r in rows])) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), *lists], ["dim", "block", "ids", "vectors"])

    return run


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each row of ``embeddings`` whose id is divisible by 50, among all other rows."""
    small_batches(spark, rows=8192, mb=16)
    rows = table(spark, sf_dir, "embeddings")
    return nearest(index_vectors(rows), rows.where("vec_id % 50 = 0"))
