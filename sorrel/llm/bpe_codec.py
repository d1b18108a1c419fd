"""Encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged across, so each such pair is
a certain cut. White space is inside no token of this kind of vocabulary, which makes words the outer
fragments; within a word the pairs cut further. Each distinct fragment is encoded once, on its own, and
a text's ids are the concatenation.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from contextlib import contextmanager
from functools import lru_cache
from itertools import accumulate, chain, compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import SPACE, byte_alphabet
from .common import small_batches, table

#: Words whose ids an encoder keeps: a bound on a worker's memory.
WORDS = 400_000
#: Longer words and fragments are not kept.
KEPT_LENGTH = 64
_IDS, _TEXT = itemgetter(0), itemgetter(1)


@contextmanager
def _no_collection():
    """Pause the cycle collector: a batch makes millions of tuples and no cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Recent:
    """A map in two generations of ``room`` entries: what is asked for moves to the newer one, the older one goes when that is full."""

    def __init__(self, room: int):
        self.room, self.new, self.old = room, {}, {}

    def absent(self, keys: set) -> set:
        """The keys that are not held; all others are in ``new`` afterwards."""
        if len(self.new) > self.room:
            self.new, self.old = {}, self.new
        out = keys - self.new.keys()
        back = out & self.old.keys()
        self.new.update(zip(back, map(self.old.pop, back), strict=True))
        return out - back


class ForcedBoundaryBPE:
    """A word-level BPE vocabulary file (end-of-word suffix, pattern split, NFC and lower case)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.suffix = spec["model"]["end_of_word_suffix"]
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not self.suffix:
            raise ValueError("not a word-level BPE tokenizer of the expected kind")
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        byte = byte_alphabet()
        self.shown = {b: c for c, b in byte.items()}
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            if t not in self.special:
                b = np.array([byte[c] for c in t.removesuffix(self.suffix)])
                self.inside[b[:-1], b[1:]] = True
        plain = spec | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.last = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(json.dumps(plain | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.odd = re.compile("[\x1c-\x1f]")
        self.space = re.compile(f"[{SPACE}]+")
        self.packed = {i: np.array([i], "<u4").tobytes() for i in self.token}
        self.known_last, self.known_inner, self.codes = (Recent(WORDS // 2) for _ in range(3))

    def words(self, text: str) -> list[str]:
        """The outer fragments; special strings are fragments of their own."""
        if self.mark and any(s in text for s in self.special):
            return [w for i, part in enumerate(self.mark.split(text)) for w in ([part] if i % 2 else self.words(part))]
        # split() would also cut at the separators 1c to 1f, which are no white space here.
        return [w for w in self.space.split(text) if w] if self.odd.search(text) else text.split()

    def matches(self, words: list[str]) -> list[list[str]]:
        """The words' normal forms, each cut by the vocabulary's pattern; a word of letters alone is one match."""
        # No white space is in a word, and nothing composes across a line feed or changes its case by it.
        lines = "\n".join(words)
        norms = (lines if lines.isascii() else unicodedata.normalize("NFC", lines).replace("Σ", "σ")).lower().split("\n") if words else []
        return [[n] if n.isalpha() else self.pattern.findall(n) for n in norms]

    def cut(self, matches: list[str]) -> tuple[list[bytes], list[int]]:
        """All matches' inner fragments in a row, and for each match how many fragments lie before it."""
        raws = [m.encode("utf-8", "surrogatepass") for m in matches]
        whole = b"".join(raws)
        b = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        if not len(b):
            return [], [0]
        # A cut inside a character would leave bytes that are no text; the fragment stays whole there.
        open_ = np.concatenate([[True], ~self.inside[b[:-1], b[1:]] & (b[1:] & 0xC0 != 0x80)])
        open_[ends[:-1]] = True
        at = np.flatnonzero(open_)
        cuts = [*at.tolist(), len(whole)]
        return [whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], [0, *np.searchsorted(at, ends).tolist()]

    def fragments(self, word: str) -> list[bytes]:
        """A word's inner fragments."""
        return self.cut(self.matches([word])[0])[0]

    def _encode_fragments(self, tokenizer, known: Recent, parts: set[bytes]) -> list[bytes]:
        """Ids and tokens of the distinct fragments that are not known, in one batch; returns those too long to be kept."""
        new = list(known.absent(parts))
        got = tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in new], add_special_tokens=False)
        packed, token = self.packed.__getitem__, self.token.__getitem__
        for p, e in zip(new, got, strict=True):
            ids = e.ids
            known.new[p] = b"".join(map(packed, ids)), " ".join(map(token, ids))
        return [p for p in new if len(p) > KEPT_LENGTH]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known: by their distinct fragments, of which those that end a match are apart."""
        plain = [w for w in words if w not in self.special]
        split = self.matches(plain)
        parts, first = self.cut([*chain.from_iterable(split)])
        ends = np.zeros(len(parts), bool)
        ends[np.array(first[1:], np.int64) - 1] = True
        long_last = self._encode_fragments(self.last, self.known_last, set(compress(parts, ends.tolist())))
        long_inner = self._encode_fragments(self.inner, self.known_inner, set(compress(parts, (~ends).tolist())))
        last, inner, codes = self.known_last.new, self.known_inner.new, self.codes.new
        coded = [last[p] if e else inner[p] for p, e in zip(parts, ends.tolist(), strict=True)]
        at = [first[m] for m in accumulate(map(len, split), initial=0)]
        for w, i, j in zip(plain, at, at[1:], strict=False):
            codes[w] = coded[i] if j - i == 1 else (b"".join(map(_IDS, coded[i:j])), " ".join(map(_TEXT, coded[i:j])))
        for w in words & self.special.keys():
            codes[w] = self.packed[self.special[w]], w
        for p in long_last:
            del last[p]
        for p in long_inner:
            del inner[p]

    @_no_collection()
    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """By text: its ids as little-endian 32-bit, and what they decode to."""
        split = [self.words(t) for t in texts]
        new = self.codes.absent(set().union(*split))
        self.learn(new)
        code, out = self.codes.new.__getitem__, []
        for ws in split:
            coded = [*map(code, ws)]
            out.append((b"".join(map(_IDS, coded)), " ".join(filter(None, map(_TEXT, coded)))))
        for w in new:
            if len(w) > KEPT_LENGTH:
                del self.codes.new[w]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces, as a vocabulary without a decoder gives them."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def _codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text's ids and their decoding: ``(id, ids binary, decoded string)``, one row per input row.

    Ids are little-endian 32-bit. Null text counts as empty and has no ids; repeated rows
    and null ids keep a row each; other columns are ignored; an empty table gives none.
    """
    return _coded(docs, tokenizer_path, id_col, text_col, "ids binary, decoded string", lambda ids, text: (ids, text), ["ids", "decoded"])


def _coded(docs, path, id_col, text_col, schema, shape, names):
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            rows = [shape(i, t) for i, t in codec.encode_batch([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows]) for k in range(len(names)))], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def _digests(ids: bytes, text: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec over ``documents``, with digests of ids and decoding taken where they are made."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return _coded(table(spark, sf_dir, "documents"), path, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, ["n_tokens", "ids_sha256", "decoded_sha256"])
