"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one printable character, every entry of the vocabulary to a piece of such characters whose score is its
negative rank, so the merge of the highest score is the merge of the lowest rank. Normalisation is the identity. A text is cut
into pre-tokens by the pattern of the vocabulary, each is encoded by itself, and decoding maps ids back to their bytes.

Null and empty texts give no ids. Rows are independent of each other: repeated rows give repeated results, an empty table gives
an empty one, extra columns are dropped.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

#: Unicode's White_Space, which is what \s means in the patterns of public rank files. Python's own \s has four more characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pre-tokens remembered by a worker. A bound on memory alone; what is forgotten is encoded again.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(word) for word, rank in (line.split() for line in f if line.strip())}
    return [found[i] for i in range(len(found))]


@lru_cache(1)
def byte_characters() -> str:
    """One printable character for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(free)) for b in range(256))


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(byte_characters())


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | 0x80 if n else low)
        if not n:
            return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(words: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece i is words[i]; the unknown piece, never needed, follows the last."""
    normal, unknown, bpe = 1, 2, 2  # of the model format
    out = [_block(1, _block(1, to_characters(w).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal)) for rank, w in enumerate(words)]
    out.append(_block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown)))
    out.append(_block(2, _number(3, bpe) + _number(4, len(words) + 1) + _number(40, len(words)) + _number(41, -1) + _number(42, -1) + _number(43, -1)))
    out.append(_block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


@lru_cache(1)
def classes() -> dict[str, str]:
    """Letters, numbers and space as the inside of a character class of the standard library's re, which reads them fastest."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    spans = lambda kind: "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(rf"{kind}+", every))
    return {r"\p{L}": spans(r"\p{L}"), r"\p{N}": spans(r"\p{N}"), r"\s": SPACE}


def splitter(pattern: str):
    """The findall of a pre-token pattern whose classes are L, N and white space."""
    inside, out, at = classes(), [], 0
    within = False
    while at < len(pattern):
        name = next((n for n in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(n, at)), None)
        if name is None:
            within = (within or pattern[at] == "[") and pattern[at] != "]"
            out.append(pattern[at])
        elif name == r"\S":
            out.append(f"[^{SPACE}]")
        else:
            out.append(inside[name] if within else f"[{inside[name]}]")
        at += len(name or ".")
    return re.compile("".join(out)).findall


class Codec(dict):
    """Maps a pre-token to its ids; remembers what it has met."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.words = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.words))
        self.pre_tokens = splitter(pattern)

    def __missing__(self, token: str) -> list[int]:
        ids = self.model.encode(to_characters(token.encode()))
        if len(token) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pre_tokens(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row. The rank file must be at `path` on every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in in_slices(batches, "text", 4 << 20):
            every = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, every)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(every), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([c.decode(x) for x in every], pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)
