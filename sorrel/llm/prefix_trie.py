"""The trie of conversations' beginnings, with what sharing them would save.

Smallest-member ownership: a node of the trie is owned by the smallest of the conversations through it. As fewer go on with each turn, a
conversation owns a suffix of its path, from its first owned depth on; so ``(conv_id, depth)`` names a node. Aggregates mark the owned
nodes (a window would gather a node's conversations in one task), and one group-by on the prefix sums what its conversations' occurrences hold minus what they own, their
children and their leaves: no node is joined to its subtree.

A prefix is known by a SHA-256 tree over its turns' digests, in blocks of ``BLOCK`` turns, so that a conversation of any length is
spread over tasks by block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Turns of a block, the unit of a window; and blocks of a block of the next level.
BLOCK = 64
#: Bytes of a list of ids that pass as one row.
CHUNK = 1 << 16


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, place, digest, bytes)``: each turn's place in its conversation from 0, a digest of role and text, and the text's bytes.

    Places are counted over sorted ranges, so a conversation may reach over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = materialize(rows, "digests").repartitionByRange(*order).sortWithinPartitions(*order)
    # A partition's number and a row's number in it.
    at = materialize(dealt.select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "turns")
    runs = at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row for each part that a conversation reaches into.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return at.join(shifts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "bytes")


def rebuilt_turns(placed: DataFrame, group: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, digest, bytes)`` of the rebuilt conversations, and all conversations ``(conv_id)``.

    Conversation c begins with the first h turns of conversation c - c % ``group``, h being the CRC-32 of its decimal id modulo ``modulus``, and goes on with its own from its h-th.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    sizes = materialize(sizes, "sizes")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    # Turns taken over: all of the base's where it has fewer.
    convs = materialize(sizes.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "convs")
    own = placed.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "bytes")
    heads = placed.where(F.col("place") < modulus - 1).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs, "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    return own.unionByName(lent), convs.select("conv_id")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """Adds to ``(conv_id, depth, digest, bytes)`` the prefix up to each turn: ``(conv_id, depth, bytes, prefix, upto)``, ``upto`` being its bytes.

    ``longest`` is the greatest depth. A window sees a block of turns; what stands before a block comes from the same function over the blocks.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK)
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    here = turns.withColumn("block", block).select("conv_id", "depth", "block", "bytes", F.sha2(F.array_join(F.collect_list("digest").over(within), ""), 256).alias("own"), F.sum("bytes").over(within).alias("own_bytes"))
    if longest <= BLOCK:
        return here.select("conv_id", "depth", "bytes", F.sha2(F.col("own"), 256).alias("prefix"), F.col("own_bytes").alias("upto"))
    here = materialize(here, "blocks")
    whole = here.where(F.col("depth") % BLOCK == 0).select("conv_id", (F.col("block") + 1).alias("depth"), F.col("own").alias("digest"), F.col("own_bytes").alias("bytes"))
    before = prefixes(whole, longest // BLOCK).select("conv_id", F.col("depth").alias("block"), F.col("prefix").alias("head"), F.col("upto").alias("head_bytes"))
    first = here.where("block = 0").select("conv_id", "depth", "bytes", F.sha2(F.col("own"), 256).alias("prefix"), F.col("own_bytes").alias("upto"))
    later = here.where("block > 0").join(before, ["conv_id", "block"])
    return first.unionByName(later.select("conv_id", "depth", "bytes", F.sha2(F.concat("own", F.lit("."), "head"), 256).alias("prefix"), (F.col("own_bytes") + F.col("head_bytes")).alias("upto")))


def id_list_digests(members: DataFrame) -> DataFrame:
    """``(prefix, ends_sha256)``: the SHA-256 of each prefix's conversation ids, ascending and joined by commas.

    Sorted ranges become texts of ``CHUNK`` bytes, and a running digest reads those of a prefix in order: no list is gathered.
    """
    kinds = "prefix string, first long, ids string"

    def join(batches):
        prefix, held, size = None, [], 0
        for batch in batches:
            out = []
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (p != prefix or size >= CHUNK):
                    out.append((prefix, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                prefix = p
                held.append(c)
                size += 8
            yield _columns(out)
        if held:
            yield _columns([(prefix, held[0], ",".join(map(str, held)))])

    def _columns(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["prefix", "first", "ids"])

    def digest(batches):
        prefix, state = None, None
        for batch in batches:
            out = []
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != prefix:
                    out += [(prefix, state.hexdigest())] if state else []
                    prefix, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _pairs(out)
        if state:
            yield _pairs([(prefix, state.hexdigest())])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["prefix", "ends_sha256"])

    chunks = members.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInArrow(join, kinds)
    return chunks.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(digest, "prefix string, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 5, modulus: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations (``rebuilt_turns``): ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    ``conv_id`` is the smallest member, ``saved_tokens`` the bytes of last texts that nodes of the subtree hold once too often for each member but one, ``ends_sha256`` that of
    the members that end at the node. Turns are ordered by turn, null first, ties by role, then by the digest of role and text; null roles and texts are empty, repeated rows
    are turns of their own, rows without a conversation id take no part, other columns are ignored. Ids are taken as 64-bit integers. A conversation that is left without turns is a
    member of the root; an empty table has no nodes.
    """
    small_batches(turns.sparkSession, rows=8192, mb=16)
    placed = materialize(ordered_turns(turns, id_col, turn_col, role_col, text_col), "placed")
    made, convs = rebuilt_turns(placed, group, modulus)
    made = materialize(made, "rebuilt")
    # Conversations as they are now: their length and bytes, of those without turns too.
    lengths = convs.join(made.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("bytes").alias("total")), "conv_id", "left")
    lengths = materialize(lengths.select("conv_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("total", F.lit(0)).alias("total")), "lengths")
    deepest = lengths.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), F.lit("").alias("prefix"), F.col("total").alias("rest"), "length")
    deep = prefixes(made, deepest).join(lengths, "conv_id")
    # What a conversation holds from a node on.
    path = deep.select("conv_id", "depth", "prefix", (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest"), "length")
    path = materialize(path.unionByName(root), "paths")

    # Written, so that the join on a prefix that many share is one of two exchanges, which Spark can split.
    owners = materialize(path.groupBy("prefix").agg(F.min("conv_id").alias("owner"), F.bool_or(F.col("depth") < F.col("length")).alias("goes_on")), "owners")
    owned = F.col("conv_id") == F.col("owner")
    marks = path.join(owners, "prefix").groupBy("conv_id").agg(
        F.min(F.when(owned, F.col("depth"))).alias("first_owned"),
        F.max(F.when(owned, F.col("rest"))).alias("owned_bytes"),
        F.coalesce(F.bool_or(owned & (F.col("depth") == F.col("length")) & ~F.col("goes_on")), F.lit(False)).cast("long").alias("leaf"),
        F.max_by(F.when(~owned, F.col("owner")), F.when(~owned, F.col("depth"))).alias("above"),
    )
    marked = path.join(materialize(marks, "marks"), "conv_id")
    own = F.coalesce(F.col("depth") >= F.col("first_owned"), F.lit(False))
    nodes = marked.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        # The owner alone has an owned depth here.
        F.max(F.when(own & (F.col("depth") > F.col("first_owned")), F.col("conv_id")).when(own, F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("first_owned"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(own, zero).otherwise(F.col("rest") - F.coalesce("owned_bytes", zero))).alias("saved_tokens"),
    )
    ends = id_list_digests(path.where("depth = length"))
    out = nodes.join(ends, "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie`` over ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


_BYTES = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"
OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS dg
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, dg) - 1 AS p, dg, strlen(text) AS bytes FROM t),
convs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT c, count(p.p) AS k FROM (SELECT v.c, q.p FROM convs v LEFT JOIN placed q ON q.c = v.base AND q.p < v.h) p GROUP BY c),
turns AS (
  SELECT v.c, q.p + 1 AS d, q.dg, q.bytes FROM convs v JOIN placed q ON q.c = v.base AND q.p < v.h
  UNION ALL SELECT v.c, q.p - v.h + k.k + 1, q.dg, q.bytes FROM convs v JOIN taken k ON k.c = v.c JOIN placed q ON q.c = v.c AND q.p >= v.h),
path AS (
  SELECT c, d, string_agg(dg, '') OVER (PARTITION BY c ORDER BY d) AS key, bytes, count(*) OVER (PARTITION BY c) AS n FROM turns
  UNION ALL SELECT v.c, 0, '', 0, (SELECT count(*) FROM turns x WHERE x.c = v.c) FROM convs v),
node AS (
  SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(n = d) AS childless,
         coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM path GROUP BY key),
kids AS (SELECT substr(key, 1, length(key) - 64) AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
       CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM node v LEFT JOIN node up ON v.d > 0 AND up.key = substr(v.key, 1, length(v.key) - 64) LEFT JOIN kids ON kids.key = v.key
JOIN (SELECT key, count(*) FILTER (childless) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
      FROM (SELECT DISTINCT p.key, u.key AS low, u.n_convs, u.bytes, u.childless FROM path w JOIN path p ON p.c = w.c AND p.d <= w.d JOIN node u ON u.key = w.key) GROUP BY key) sub ON sub.key = v.key
"""
