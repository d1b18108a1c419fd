"""Near copies by word shingles: covering tables and MinHash bands find candidates, whole shingle sets decide.

The covering tables are those of the SimHash operator, over five-word shingles: every pair of fingerprints within their radius shares
a key. They alone would lose most near copies: at a similarity of 0.8 fingerprints differ in 9.7 of 64 bits in the mean, and covering 19
bits would take 2**20 - 1 tables. So the keys of each text also hold ``BANDS`` bands of ``DEPTH`` minima: two texts of
similarity s share one band with probability s ** DEPTH, and 24 bands of 4 miss a pair of similarity 0.8 with
probability (1 - 0.8 ** 4) ** 24 < 4e-6.

Pairs are compared in three passes. First each row meets a centre of its key (hot keys are salted: a centre of
its salt, and these the key's). Once the links found are components, each row of a key meets the one of another
component whose minima agree with its own most, among up to ``HELD`` rows of the key; in keys of more rows that is
repeated with others until a round finds no link. These two passes only make components large early, whatever they miss. The last takes every key that still has rows of
different components, and compares all pairs of such rows that may be similar, so that none of a key is left out: the rows outside the key's largest component
meet all its rows, in tiles of bounded size, where a pair goes on if ``LIKELY`` of its minima agree and the sets' ``LOWEST`` least hashes (all of them in small sets) allow the similarity. Whole texts are read only for pairs that are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import connected_components, materialize, small_batches
from .simhash_dedup import covering_masks, majority

BANDS, DEPTH = 24, 4
#: Minima of which must agree, of all, for a pair to be compared again: five deviations below what similarity 0.8 gives.
LIKELY = 0.6
HELD, SALTS, HOT = 2048, 1024, 1 << 16
#: Hashes of a set by which pairs are screened once more: all of a set of fewer, else a sample.
LOWEST = 256
#: Ids that are broadcast at most, at 8 bytes each; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Bytes of a text that are cut into words at a time: a bound on memory for very long ones.
CHUNK = 1 << 18
_RNG = np.random.default_rng(20240501)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32)
_ODD = _RNG.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, DEPTH), np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
_PLACE = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_SLOT = _RNG.integers(0, 1 << 64, 1 << 10, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, seed: int = 42) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, words cut at ASCII white space."""
    raw, parts, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and raw[end : end + 1] not in (b" ", b"\n"):
            end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter((digest(w, seed) for w in words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The set of hashes of a text's word shingles, sorted; one shingle of a text with fewer words or none."""
    words = word_hashes(text)
    n = max(1, len(words) - width + 1)
    total = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


@lru_cache(maxsize=8)
def _masks(radius: int) -> np.ndarray:
    return np.array(covering_masks(radius), np.uint64)


def keys(hashes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit keys of a set, its fingerprint under each covering mask and each band of its minima, and a byte of each of the minima."""
    masks = _masks(radius)
    cover = _mixed((np.uint64(majority(hashes)) & masks) ^ _SLOT[: len(masks)])
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[None, at : at + 1024] ^ _FLIP) * _ODD).min(1), out=least)
    bands = (least.reshape(BANDS, DEPTH).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) + _BAND
    return np.concatenate([cover, bands]), (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets, sorted, is ``percent`` or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _where_in(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` joined by uid to distinct written ids, broadcast only if few: else neither side's size is bounded."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids.hint("merge")
    return rows.join(ids, "uid", how)


def _order(*more):
    """Which of two rows is the centre: a hash of the uid, drawn anew by ``more``."""
    return F.struct(F.xxhash64("uid", *[F.lit(m) for m in more]).alias("h"), "uid")


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair once, as ``(a, b)``."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _first_pairs(slots: DataFrame) -> DataFrame:
    """Each row of ``(uid, key)`` with a centre of the key and its salt, and these centres with one of the key."""
    salted = slots.withColumn("salt", F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(SALTS)))
    near = salted.withColumn("b", F.min(_order()).over(Window.partitionBy("key", "salt"))["uid"])
    far = near.where("uid = b").withColumn("b", F.min(_order()).over(Window.partitionBy("key"))["uid"])
    star = lambda df: df.where("uid != b").select(F.col("uid").alias("a"), "b")
    return star(near).unionAll(star(far))


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    n = BANDS * DEPTH
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * n, column.offset * n).reshape(-1, n)


def likeliest(batches):
    """Arrow batches of ``(key, uid, root, minima)``, sorted by key, to pairs ``(a, b)``: each row and the likeliest earlier one of its key with another root."""
    key, uid, root, sig = None, *(np.zeros(0, np.int64),) * 2, np.zeros((0, BANDS * DEPTH), np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        k, u, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        m = _bytes(batch.column(3))
        bounds = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        mixed = np.minimum.reduceat(r, bounds[:-1]) != np.maximum.reduceat(r, bounds[:-1])
        pairs = []
        # A key's rows may go on over batches.
        for i in sorted({0, len(bounds) - 2, *np.flatnonzero(mixed).tolist()}):
            lo, hi = bounds[i], bounds[i + 1]
            if k[lo] != key:
                key, uid, root, sig = k[lo], u[:0], r[:0], m[:0]
            for at in range(lo, hi, 64):
                new = slice(at, min(at + 64, hi))
                us, rs, ms = np.concatenate([uid, u[new]]), np.concatenate([root, r[new]]), np.concatenate([sig, m[new]])
                agree = (m[new][:, None] == ms[None]).sum(2, dtype=np.int16)
                agree[(r[new][:, None] == rs[None]) | (np.arange(len(us))[None] >= len(uid) + np.arange(new.stop - at)[:, None])] = 0
                best = agree.argmax(1)
                hit = agree[np.arange(len(best)), best] >= LIKELY * BANDS * DEPTH
                pairs.append((u[new][hit], us[best[hit]]))
                uid, root, sig = us[:HELD], rs[:HELD], ms[:HELD]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs])) for i in range(2)], ["a", "b"])


def _next_pairs(slots: DataFrame, counts: DataFrame, turn: int) -> DataFrame:
    """Pairs of rows ``(key, uid, root, minima)`` with one key but different roots; the rows of hot keys are dealt to salts."""
    hot = materialize(counts.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("salts")), "hot")
    salted = slots.join(F.broadcast(hot) if hot.count() <= BROADCAST else hot.hint("merge"), "key", "left")
    draw = F.xxhash64("uid", F.lit(turn))
    dealt = salted.withColumn("salt", F.coalesce(F.pmod(draw, "salts"), F.lit(0).cast("long"))).withColumn("draw", draw)
    dealt = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "draw")
    return dealt.select(F.xxhash64("key", "salt").alias("key"), "uid", "root", "minima").mapInArrow(likeliest, "a long, b long")


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The least ``LOWEST`` hashes of a sorted set, of 32 bits each: a sample of it, or all of a small set."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:LOWEST]


def may_be_similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets may have that similarity, by their least hashes: exactly but for two elements where these are all, else within five deviations."""
    ends = [x[-1] for x in (a, b) if len(x) == LOWEST]
    if ends:
        # Up to here both samples are whole.
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
    union, p = len(a) + len(b) - both, percent / 100
    slack = 5 * (p * (1 - p) * max(union, 1)) ** 0.5 if ends else 2
    return both + slack >= p * union


def _meet(percent: int, covers: int):
    """Arrow batches of ``(tile, place, side, uid, root, minima, low)``, sorted by tile and side, to pairs ``(a, b)`` of different roots: each row of side 1 with those of side 0 in its tile.

    ``LIKELY`` of a pair's minima agree, and by their least hashes the sets may be similar. ``place`` is that of the tile's key among a row's keys: a pair that shares several bands
    comes from the first of them alone.
    """

    def meet(batches):
        tile, uid, root, sig, low = None, *(np.zeros(0, np.int64),) * 2, np.zeros((0, BANDS * DEPTH), np.uint8), []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, place, side, u, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            m, own = _bytes(batch.column(5)), batch.column(6)
            bounds = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (side[1:] != side[:-1])) + 1, [len(t)]])
            pairs = [(u[:0], u[:0])]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if t[lo] != tile:
                    tile, uid, root, sig, low = t[lo], u[:0], r[:0], m[:0], []
                if side[lo] == 0:
                    uid, root, sig = np.concatenate([uid, u[lo:hi]]), np.concatenate([root, r[lo:hi]]), np.concatenate([sig, m[lo:hi]])
                    low += [np.frombuffer(own[int(k)].as_py(), np.uint32) for k in range(lo, hi)]
                    continue
                step = max(1, (1 << 22) // max(1, len(uid) * BANDS * DEPTH))
                for at in range(lo, hi, step):
                    end = min(hi, at + step)
                    agree = (m[at:end][:, None] == sig[None]).sum(2, dtype=np.int16)
                    x, y = np.nonzero((agree >= LIKELY * BANDS * DEPTH) & (r[at:end][:, None] != root[None]))
                    if not len(x):
                        continue
                    bands = (m[at + x] == sig[y]).reshape(-1, BANDS, DEPTH).all(2)
                    first = np.where(bands.any(1), bands.argmax(1), -1)
                    here = first == place[lo] - covers if place[lo] >= covers else first < 0
                    x, y = x[here], y[here]
                    held = {k: np.frombuffer(own[int(at + k)].as_py(), np.uint32) for k in set(x.tolist())}
                    near = np.fromiter((may_be_similar(held[i], low[j], percent) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                    pairs.append((u[at + x[near]], uid[y[near]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs])) for i in range(2)], ["a", "b"])

    return meet


def _last_pairs(rooted: DataFrame, texts: DataFrame, percent: int, width: int, radius: int) -> DataFrame:
    """All pairs of different roots that share a key and may be similar, of rows ``(uid, keys, root, minima)`` with ``texts (uid, text)``.

    A key's smaller components, dealt to blocks of about ``HELD`` rows, meet all its rows, dealt to parts of about ``HOT``; each block and part are a tile.
    """
    slots = rooted.select("uid", "root", F.explode("keys").alias("key"))
    mixed = slots.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    mixed = materialize(mixed, "mixed")
    few = mixed.count() <= BROADCAST
    inside = materialize(slots.join(F.broadcast(mixed) if few else mixed.hint("merge"), "key"), "inside")
    sizes = inside.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    blocks, parts = F.ceil((F.col("n") - F.col("most.n")) / HELD), F.ceil(F.col("n") / HOT)
    plan = materialize(sizes.select("key", F.col("most.root").alias("largest"), blocks.alias("blocks"), parts.alias("parts")), "tiles")

    def sample(batches):
        for batch in batches:
            low = [lowest(shingles(t.as_py(), width)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["uid", "low"])

    # Only rows of these keys are read again.
    members = materialize(inside.select("uid").distinct(), "members")
    lows = materialize(_where_in(texts, members, "left_semi").select("uid", "text").mapInArrow(sample, "uid long, low binary"), "lows")
    own = rooted.join(lows.hint("merge"), "uid").select("uid", "root", "minima", "low", F.posexplode("keys").alias("place", "key")).join(F.broadcast(plan) if few else plan.hint("merge"), "key")
    draw, upto = F.xxhash64("uid", F.lit(11)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    small = own.where("root != largest").withColumn("block", F.pmod(draw, "blocks")).withColumn("part", upto("parts")).withColumn("side", F.lit(0))
    every = own.withColumn("part", F.pmod(draw, "parts")).withColumn("block", upto("blocks")).withColumn("side", F.lit(1))
    columns = [F.xxhash64("key", "block", "part").alias("tile"), "place", "side", "uid", "root", "minima", "low"]
    dealt = small.select(*columns).unionByName(every.select(*columns)).repartition("tile").sortWithinPartitions("tile", "side", "uid")
    return dealt.mapInArrow(_meet(percent, len(_masks(radius))), "a long, b long")


def near_copies(docs: DataFrame, percent: int = 80, width: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without near copies: one row stays of each component under links of similarity ``percent`` or more.

    Text is lower-cased A-Z and cut at ASCII white space; null and word-less texts are equal to each other. The row with
    the smallest id stays, one without an id only where no row of its component has one; of rows that repeat it one
    stays. Other columns, whatever their names, are carried; an empty table gives none.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    text = F.col(names[text_at]).cast("string").alias("text")

    def sketch(batches):
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            got = [keys(shingles(t, width), radius) for t in batch.column(len(names)).to_pylist()]
            flat = np.concatenate([k for k, _ in got] or [np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // max(1, n))), pa.array(flat))
            minima = pa.array([m.tobytes() for _, m in got], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(at, at + n)), lists, minima], [*names, "uid", "keys", "minima"])
            at += n

    def compare(batches):
        last, held = None, None
        for batch in batches:
            found = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, held = b, shingles(y.as_py(), width)
                found.append(similar(shingles(x.as_py(), width), held, percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(found, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    small_batches(spark, mb=8)
    rows = materialize(plain.select(*names, text).mapInArrow(sketch, f"{kinds}, uid long, keys array<long>, minima binary"), "sketches")
    pairs = materialize(_oriented(_first_pairs(rows.select("uid", F.explode("keys").alias("key")))), "pairs")
    ends = materialize(pairs.select(F.col("a").alias("uid")).unionAll(pairs.select(F.col("b").alias("uid"))).distinct(), "ends")
    near = materialize(_where_in(rows.select("uid", "keys", "minima", text), ends, "left_semi"), "near")

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (near.select(F.col("uid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), "links")

    links, done = linked(pairs), pairs
    counts = materialize(near.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "counts")
    crowded, turn = not counts.where(F.col("n") > HELD).isEmpty(), 0
    while True:
        groups = materialize(connected_components(links).withColumnRenamed("node", "uid"), "groups")
        if turn and not crowded:
            break
        turn += 1
        rooted = near.select("uid", "keys", "minima").join(groups.hint("merge"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        fresh = _oriented(_next_pairs(rooted.select(F.explode("keys").alias("key"), "uid", "root", "minima"), counts, turn))
        fresh = materialize(fresh.join(done.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        more = linked(fresh)
        done = done.unionAll(fresh)
        if more.isEmpty():
            break
        links = links.unionAll(more)

    rooted = near.select("uid", "keys", "minima").join(groups.hint("merge"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rest = materialize(_oriented(_last_pairs(rooted, near.select("uid", "text"), percent, width, radius)).join(done.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = linked(rest)
    if not more.isEmpty():
        groups = materialize(connected_components(links.unionAll(more)).withColumnRenamed("node", "uid"), "groups")

    member = rows.select("uid", F.col(names[id_at]).alias("id")).join(groups.hint("merge"), "uid")
    rank = F.struct(F.col("id").isNull(), "id", "uid")
    stays = member.groupBy("root").agg(F.min(rank)["uid"].alias("uid")).select("uid")
    gone = materialize(groups.select("uid").join(stays.hint("merge"), "uid", "left_anti"), "copies")
    return _where_in(rows, gone, "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
