"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Covering LSH: give each fingerprint bit a non-zero vector of ``radius + 1`` bits; the table of a
non-zero vector v keeps the bits whose vector has an odd product with v. For any ``radius`` differing
bits some v is orthogonal to all their vectors, so every pair within the radius agrees on the whole
key of one table at least: nothing is left to chance. Work is on distinct fingerprints; within
a table's bucket only a spanning forest of the links is emitted, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, small_batches, table

BITS = 64
#: Distinct fingerprints of one bucket that a task compares by itself; larger buckets are probed instead.
BUCKET = 16384


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return counts


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles with repeats; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > width:
        starts, ends = starts[: n - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    del words
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65536):
        pairs = zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)
        counts += bit_counts(np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64))
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """``2**(radius+1) - 1`` masks; of any ``radius`` bits one mask holds none."""
    dims = radius + 1
    vectors = [i % (2**dims - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2**dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct values (as many as values at most)."""
    edges, rest = [], values
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hit = rest[near]
                edges += [(int(x), int(y)) for y in hit]
                frontier += list(hit)
                rest = rest[~near]
    return edges


def bucket_links(radius: int, bucket: int = BUCKET):
    """Arrow batches of ``(slot, key, fp)``, sorted, to links ``(a, b, hot)``; one bucket's rows adjoin.

    Of a bucket with more than ``bucket`` rows the rows come out as ``hot`` instead, to be probed.
    """

    def run(batches):
        slot, key, held, hot = None, None, [], False

        def closed():
            vals = np.concatenate(held) if held else np.zeros(0, np.uint64)
            return _forest(vals, radius) if 1 < len(vals) <= bucket else []

        def out(links, alone):
            a = [x for x, _ in links] + alone
            b = [y for _, y in links] + alone
            arrays = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([False] * len(links) + [True] * len(alone), pa.bool_())], ["a", "b", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(s)]])
            links, alone = [], []
            wide = np.flatnonzero(np.diff(bounds) > 1)
            for i in sorted({0, len(bounds) - 2, *wide.tolist()}):
                lo, hi = bounds[i], bounds[i + 1]
                if (s[lo], k[lo]) != (slot, key):
                    links += closed()
                    slot, key, held, hot = s[lo], k[lo], [], False
                held.append(fp[lo:hi].copy())
                if hot or sum(map(len, held)) > bucket:
                    hot = True
                    alone += [int(x) for part in held for x in part]
                    held = []
            yield out(links, alone)
        if links := closed():
            yield out(links, [])

    return run


def _probe_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links between the values of crowded buckets, exactly and without comparing them pairwise.

    Two values are within ``radius`` when some z is within ``near`` of one and ``radius - near`` of the
    other. Each value is sent to all z around it; around one z there are a fixed number of values at
    most, and all within ``far`` of z link to one that is within ``near``.
    """
    near = radius // 2
    far = radius - near
    flips = [(sum(1 << i for i in c), n <= near) for n in range(far + 1) for c in combinations(range(BITS), n)]
    masks = np.array([m for m, _ in flips], np.uint64)
    close = np.array([c for _, c in flips])

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 32):
                x = fp[at : at + 32]
                z = (x[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(x, len(masks)).view(np.int64)), pa.array(np.tile(close, len(x)))], ["z", "x", "close"])

    sent = hot.mapInArrow(spread, "z long, x long, close boolean")
    around = sent.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("x"))).alias("b"), F.collect_set("x").alias("xs")).where("b is not null and size(xs) > 1")
    return around.select(F.explode("xs").alias("a"), "b").where("a != b").distinct()


def link_fingerprints(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Components of distinct fingerprints ``(fp long)`` under links of ``radius`` differing bits or fewer.

    Returns ``(node, root)`` for fingerprints with a link.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    slots = fps.select("fp", F.explode(keys).alias("k")).select("k.slot", "k.key", "fp")
    dealt = slots.repartition("slot", "key").sortWithinPartitions("slot", "key", "fp")
    found = materialize(dealt.mapInArrow(bucket_links(radius, bucket), "a long, b long, hot boolean"), "links")
    hot = found.where("hot").select("a").distinct()
    edges = found.where("not hot").select("a", "b")
    if not hot.isEmpty():
        edges = edges.unionAll(_probe_links(hot, radius))
    return connected_components(edges)


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Near-duplicate groups of every whole text: ``(id, fingerprint, component_id)``, one row per input row.

    Text is lower-cased A-Z and cut at ASCII white space; texts link when their fingerprints differ in
    at most ``radius`` bits. ``component_id`` is the smallest id reachable over links. Null and word-less
    texts have fingerprint zero, which links like any other. Null ids take part but are never a
    component's id unless it has no other; repeated rows stay rows; an empty table gives none.
    Other columns, whatever their names, are not read and not returned.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def prints(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    printed = materialize(rows.mapInArrow(prints, f"id {rows.schema['id'].dataType.simpleString()}, fp long"), "prints")
    distinct = materialize(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    roots = link_fingerprints(distinct.select("fp"), radius, bucket)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(named, "root").select("fp", "component_id"), "classes")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return printed.join(classes, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_groups`` over ``documents``: three-word shingles, radius 3."""
    return simhash_groups(table(spark, sf_dir, "documents"))
