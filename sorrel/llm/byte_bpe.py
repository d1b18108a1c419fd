"""A byte-level BPE encoder that works on whole texts by merge ranks."""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

#: The characters with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a text that are encoded at a time: a bound on memory for very long ones.
CHUNK = 1 << 18


def _rank_encoder(model: dict):
    """The same encoding by merge ranks, which is the faster one; None where ids are not in merge order."""
    import public_tokenizers
    import tiktoken

    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    byte = byte_alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}
    ranks = {k: v for k, v in ranks.items() if v < 256 + len(model["merges"])}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextEncoder:
    """Ids of a text as 16-bit little-endian bytes, equal to those of the tokenizer file's library.

    In this vocabulary's pattern a single space with visible characters on both sides always begins a
    word, so long texts are cut there and encoded in chunks. Special strings inside a text
    become their own ids, as the library does by default; it is loaded for such texts only.
    """

    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("end_of_word_suffix"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.path = tokenizer_path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if max([*model["vocab"].values(), *self.special.values()]) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.plain = _rank_encoder(model)
        self.cut = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def chunks(self, text: str):
        """The text in parts that encode on their own."""
        begin = 0
        while len(text) - begin > CHUNK and (found := self.cut.search(text, begin + CHUNK)):
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:] if begin else text

    def __call__(self, text: str) -> bytes:
        encode = self.library if self.plain is None or any(s in text for s in self.special) else self.plain
        return b"".join([np.array(encode(part), "<u2").tobytes() for part in self.chunks(text)])
