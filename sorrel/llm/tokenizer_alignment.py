"""Alignment of two tokenizers' tokens over a corpus.

Segment deduplication: a text is cut before those white-space runs that no token of either vocabulary can reach across, which is
verified from the vocabularies when they are loaded; distinct segments are tokenised and aligned once, alignments are joined back, and documents composed of
them. A task first reduces the texts of a batch to numbers of its own distinct segments, so that only those are shuffled, and a batch's texts meet
its segments' alignments again by the batch's number.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, small_batches, table

#: Characters of a text that are cut at a time, and bytes of texts whose segments are numbered together.
PIECE, BATCH = 1 << 18, 32 << 20
#: Linked pairs that are broadcast at most, at 17 bytes each; more are joined by a shuffle.
BROADCAST = 1 << 20
# A run's start: not behind white space in the widest sense, so that no run is cut in two under any library's reading of white space.
_CUT = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0\xad ᠎ -‏ -  -⁤　﻿])(?=[ \n])")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenizerPair:
    """A byte-level BPE of the ``tokenizers`` library and a BPE of ``sentencepiece``, with their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(len(self.b))]
        self._verify()
        self.space = self.b.piece_to_id("▁")

    def _piece(self, piece: str) -> bytes:
        raw = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(raw[1], 16)]) if raw else piece.replace("▁", " ").encode()

    def _verify(self) -> None:
        """No piece of B may hold a starting character behind another kind of character, nor a line feed beside anything; A must cut there itself."""
        import json

        pieces = [self.b.id_to_piece(i) for i in range(len(self.b)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        if any(re.search("[^▁]▁", p) or "\n" in p or " " in p for p in pieces):
            raise ValueError("a piece reaches across the start of a white-space run")
        if self.b.encode("a b") != self.b.encode("a") + self.b.encode("b") or self.b.encode("a\nb")[: len(self.b.encode("a"))] != self.b.encode("a"):
            raise ValueError("the sentencepiece model does not put a space before a text")
        config = json.loads(self.a.to_str())
        before = config["pre_tokenizer"] or {}
        if config["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError("the tokenizer does not cut before white space by the byte-level pattern")

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """B's tokens of segments as they stand inside a text: the library puts a space before what it is given."""
        spaced = [s[0] == " " for s in segments]
        out = self.b.encode([s[1:] if x else s for s, x in zip(segments, spaced, strict=True)], num_threads=1)
        # A line feed is in no piece, so the space before it is a token of its own; an empty rest is a space alone.
        return [(ids or [self.space]) if x else ids[1:] for ids, x in zip(out, spaced, strict=True)]

    def align(self, segments: list[str]) -> list[tuple]:
        """``(ok, groups, links)`` of each segment: whether both give its bytes back, the groups as text, and linked pairs as ``a << 32 | b``."""
        out = []
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for segment, encoded, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self.encode_b(segments), strict=True):
            a, raw = encoded.ids, segment.encode()
            in_a, in_b = list(map(a_bytes, a)), list(map(b_bytes, b))
            if b"".join(in_a) != raw or b"".join(in_b) != raw:
                out.append((False, "", []))
                continue
            groups, links = [], []
            i = j = from_a = from_b = end_a = end_b = 0
            for part in in_a:
                end_a += len(part)
                i += 1
                while end_b < end_a:
                    end_b += len(in_b[j])
                    j += 1
                if end_a == end_b:
                    groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                    links.append(a[i - 1] << 32 | b[j - 1])
                    from_a, from_b = i, j
            out.append((True, ";".join(groups), links))
        return out


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> TokenizerPair:
    return TokenizerPair(a_path, b_path)


def segments(text: str):
    """The segments of a space and ``text``, in lists for a piece of text at a time."""
    text = f" {text}"
    at = 0
    while at < len(text):
        end = at + PIECE
        cut = _CUT.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield _CUT.split(text[at:end])
        at = end


def number_segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as numbers of the distinct segments of their batch, written.

    Rows of two kinds: ``(batch, id, codes)`` of a text, null codes for a null or empty one, and ``(batch, code, segment, n)`` of each distinct segment of a batch and its occurrences.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        known, seen, size = {}, [], 0

        def close(schema_id):
            words = list(known)
            n = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.nulls(n, schema_id), pa.nulls(n, pa.list_(pa.int32())), pa.array(range(n), pa.int32()), pa.array(words, pa.string()), pa.array(np.bincount(np.concatenate(seen), minlength=n))],
                ["batch", "id", "codes", "code", "segment", "n"],
            )

        for batch in batches:
            lists, numbers = [], []
            id_type = batch.column(0).type
            done = []
            start = 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                codes = None
                if text:
                    parts = []
                    for words in segments(text):
                        for w in words:
                            if w not in known:
                                known[w] = len(known)
                        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                        size += sum(map(len, words))
                    codes = np.concatenate(parts)
                    seen.append(codes)
                lists.append(codes)
                numbers.append(number)
                if size >= BATCH:
                    done.append(_texts(numbers, batch.column(0).slice(start, row + 1 - start), lists))
                    done.append(close(id_type))
                    number, known, seen, size = number + 1, {}, [], 0
                    start, lists, numbers = row + 1, [], []
            if lists:
                done.append(_texts(numbers, batch.column(0).slice(start), lists))
            yield from done
        if known:
            yield close(id_type)

    def _texts(numbers, ids, lists):
        n = len(lists)
        empty = np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int32)
        flat = pa.array(np.concatenate([empty, *[x for x in lists if x is not None]]))
        codes = pa.ListArray.from_arrays(ends, flat, mask=pa.array([x is None for x in lists]))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), ids, codes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], ["batch", "id", "codes", "code", "segment", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _stored(rows.mapInArrow(run, f"batch long, id {kind}, codes array<int>, code int, segment string, n long"), "segments")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, packed tighter: numbers of words and runs of equal rows shrink much."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align_segments(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Segments ``(batch, code, segment, n)`` aligned, written: each distinct one is tokenised and aligned once, where its batches' rows meet.

    ``(batch, code, ok, groups, links)`` for each row, and for each distinct segment one without a batch, with its occurrences ``n``.
    """

    def run(batches):
        pair, held = _pair(a_path, b_path), None
        names, types = ["batch", "code", "ok", "groups", "links", "n"], (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.int64())
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(2).to_pylist()
            counts = batch.column(3).to_numpy()
            starts = [0, *(k for k in range(1, len(words)) if words[k] != words[k - 1])]
            again = held is not None and words[0] == held[0]
            got = ([held[1]] if again else []) + pair.align([words[k] for k in starts[again:]])
            sums = np.add.reduceat(counts, starts).tolist()
            if again:
                sums[0] += held[2]
            elif held is not None:
                got, sums, starts = [held[1], *got], [held[2], *sums], [0, *starts]
            # The last segment may go on in the next batch.
            held = (words[-1], got[-1], sums[-1])
            times = np.diff([*starts, len(words)]).tolist()
            spread = [g for g, t in zip(got, times, strict=True) for _ in range(t)]
            ended = list(zip(got[:-1], sums[:-1], strict=True))
            rows = [*spread, *(g for g, _ in ended)]
            empty = [None] * len(ended)
            columns = [batch.column(0).to_pylist() + empty, batch.column(1).to_pylist() + empty, [g[0] for g in rows], [g[1] for g in spread] + empty, [g[2] for g in rows], [None] * len(spread) + [n for _, n in ended]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, held[1][0], None, held[1][2], held[2]), types, strict=True)], names)

    dealt = words.select("batch", "code", "segment", "n").repartition("segment").sortWithinPartitions("segment")
    return _stored(dealt.mapInArrow(run, "batch long, code int, ok boolean, groups string, links array<long>, n long"), "aligned")


def count_pairs(aligned: DataFrame, texts: DataFrame) -> DataFrame:
    """``(link, count, best)`` over all whole texts, written: occurrences of broken texts' segments are taken off."""
    summed = aligned.where("batch is null and ok").select("links", "n")
    off = texts.where("not whole and codes is not null").select("batch", F.explode("codes").alias("code")).groupBy("batch", "code").agg((-F.count("*")).alias("n"))
    off = aligned.where("batch is not null and ok").select("batch", "code", "links").join(off, ["batch", "code"]).select("links", "n")
    counts = summed.unionByName(off).select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count")).where("count > 0")
    counts = materialize(counts.withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1))), "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("top"))
    return materialize(counts.join(highest, "b").select("link", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def score_segments(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(w_batch, code, groups, n_best, count_sum)`` of rows ``(batch, code, groups, links)``: how many of their links are best, and their counts' sum."""
    spark = entries.sparkSession
    if pairs.count() > BROADCAST:
        linked = entries.select("batch", "code", F.explode("links").alias("link")).join(pairs, "link").groupBy("batch", "code").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        both = entries.drop("links").join(linked, ["batch", "code"], "left")
        return both.select(F.col("batch").alias("w_batch"), "code", "groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
    known = pairs.toArrow().sort_by("link")
    held = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("link", "count", "best")])

    def run(batches):
        link, count, best = held.value
        for batch in batches:
            links = batch.column(3)
            flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
            # A link of broken texts alone has no count.
            at = np.minimum(np.searchsorted(link, flat), max(0, len(link) - 1))
            hit = link[at] == flat if len(link) else np.zeros(len(flat), bool)
            totals = [np.concatenate([[0], np.cumsum(np.where(hit, v[at], 0) if len(link) else flat)])[ends] for v in (best.astype(np.int64), count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.diff(t)) for t in totals]], ["w_batch", "code", "groups", "n_best", "count_sum"])

    return entries.select("batch", "code", "groups", "links").mapInArrow(run, "w_batch long, code int, groups string, n_best long, count_sum long")


def compose(texts: pa.Table, entries: pa.Table) -> pa.Table:
    """A batch's texts ``(id, codes, whole)`` from the alignments of its segments ``(code, groups, n_best, count_sum)``."""
    codes = entries.column("code").to_numpy()
    top = int(codes.max(initial=-1)) + 1
    groups = [""] * top
    for c, g in zip(codes.tolist(), entries.column("groups").to_pylist(), strict=True):
        groups[c] = g
    # A segment's groups hold all its tokens: n + 1 groups with n semicolons, and a token more on a side for each comma there.
    values = np.zeros((top, 5), np.int64)
    shown = entries.column("groups")
    values[codes, 2] = n = pc.count_substring(shown, ";").to_numpy() + 1
    values[codes, 0] = n_a = n + pc.count_substring(pc.replace_substring_regex(shown, r"\|[^;]*", ""), ",").to_numpy()
    values[codes, 1] = 2 * n + pc.count_substring(shown, ",").to_numpy() - n_a
    for k, c in ((3, "n_best"), (4, "count_sum")):
        values[codes, k] = entries.column(c).to_numpy()
    rows, digests = np.zeros((texts.num_rows, 5), np.int64), []
    for i, (held, whole) in enumerate(zip(texts.column("codes"), texts.column("whole").to_pylist(), strict=True)):
        if not whole:
            digests.append("")
            continue
        own, state = held.values.to_numpy(), hashlib.sha256()
        for at in range(0, len(own), PIECE):
            part = own[at : at + PIECE]
            rows[i] += values[part].sum(0)
            state.update((";" * (at > 0) + ";".join(map(groups.__getitem__, part.tolist()))).encode())
        digests.append(state.hexdigest())
    n_a, n_b, n_links, n_best, count_sum = (pa.array(rows[:, k]) for k in range(5))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([texts.column("id"), n_a, n_b, n_links, n_links, n_best, count_sum, pa.array(digests, pa.string())], names)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """How the tokens of A and B meet in each text, and how often each pair of ids is linked in the corpus.

    A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` BPE model, at the same paths on every executor; both see a space and the text, special strings as plain text.
    Texts that are null, empty, or that either cannot give back byte for byte have no tokens: zeros and an empty ``groups_sha256``, and count for no pair.
    Every row, repeated ones and those without an id too, is one document and has one row; other columns are ignored; an empty table gives none.

    Returns ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` and ``(a, b, count, best)``, ``best`` marking the pairs whose count is the highest of their B id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession, rows=8192, mb=8)
    both = number_segments(docs, id_col, text_col)
    texts = both.where("code is null").select("batch", "id", "codes")
    aligned = align_segments(both.where("code is not null"), a_path, b_path)
    # Texts with a segment that does not come back; few batches have any.
    broken = materialize(aligned.where("batch is not null and not ok").groupBy("batch").agg(F.collect_list("code").alias("broken")), "broken")
    texts = texts.join(broken, "batch", "left").select("batch", "id", "codes", (F.col("codes").isNotNull() & ~F.coalesce(F.arrays_overlap("codes", "broken"), F.lit(False))).alias("whole"))
    pairs = count_pairs(aligned, texts)
    entries = score_segments(aligned.where("batch is not null and ok"), pairs)
    out = texts.groupBy("batch").cogroup(entries.groupBy("w_batch")).applyInArrow(compose, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    shown = pairs.select(F.shiftright("link", 32).alias("a"), F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count", "best")
    return out.withColumnRenamed("id", id_col), shown


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``align_tokenizers`` over ``documents``."""
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
