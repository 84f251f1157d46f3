"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

The model is serialised here, field by field: one piece for each token, spelt with one printable character
for each byte and scored by its negative rank, so that sentencepiece's best-scoring merge is the merge of
lowest rank; normalisation is the identity. Pre-tokens are encoded one by one, ids are piece numbers less
the unknown piece, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import columns_of, map_rows, ready, sha

#: Distinct pre-tokens that a generation of a worker's memory holds.
REMEMBERED = 200_000
#: Characters of text that are looked up at once: few enough to stay in a processor's cache.
STEP_CHARS = 1 << 16
#: Those longer than this (code points) are encoded each time and not remembered.
REMEMBERED_CHARS = 64


def byte_letters() -> list[str]:
    """A printable, non-space character for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: integers as varints (negative ones in 64 bits), floats in 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file: piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    letters = byte_letters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [("", 0.0, unknown), *(("".join(letters[b] for b in t), float(-r), normal) for t, r in by_rank)]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(24, 0) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43)) + _field(45, "".encode())
    normalizer = _field(1, b"identity") + _field(2, b"") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return body + _field(2, trainer) + _field(3, normalizer)


class Memory:
    """The numbers of pre-tokens' pieces, as packed 32-bit integers, in two generations.

    When the younger is full it becomes the older, and what the older still answers moves back. So frequent
    pre-tokens stay; a generation holds REMEMBERED pre-tokens and those of one more call. Long ones are
    learned each time.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]]):
        self.learn = learn
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def look(self, words: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, words))
        gaps = list(compress(range(len(out)), map(not_, out)))
        if gaps:
            missing = {words[i] for i in gaps}
            found = {w: x for w in missing if (x := self.older.get(w))}
            new = list(missing.difference(found))
            found.update(zip(new, self.learn(new), strict=True))
            for i in gaps:
                out[i] = found[words[i]]
            known.update(found)
            for w in new:
                if len(w) > REMEMBERED_CHARS:
                    del known[w]
            if len(known) > REMEMBERED:
                self.older, self.known = known, {}
        return out


class Spelling:
    """Byte strings by number, in rows of a table, so that a whole sequence is spelt at once."""

    WIDTH = 16

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.width = min(self.WIDTH, max(map(len, strings), default=1))
        self.table = np.frombuffer(b"".join(s[: self.width].ljust(self.width) for s in strings), np.uint8).reshape(-1, self.width)
        self.size = np.array([min(len(s), 255) for s in strings], np.uint8)
        self.at = np.arange(self.width, dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        if len(size) and size.max() > self.width:
            return b"".join([self.strings[i] for i in numbers.tolist()])
        return self.table[numbers][self.at < size[:, None]].tobytes()


class Codec:
    """Encodes and decodes whole texts.

    Each pre-token, a match of the pattern, is encoded on its own, and its ids are remembered. Decoding and
    the decimals of ids are look-ups by id.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(ranks))
        self.tokens = Spelling([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self.numerals = Spelling([b"%d " % i for i in range(len(ranks))])
        self.memory = Memory(self._learn)

    def _learn(self, words: list[str]) -> Iterable[bytes]:
        """The piece numbers of pre-tokens, encoded one by one."""
        spelt = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return (array("i", x).tobytes() for x in self.model.encode(spelt, num_threads=1)) if spelt else ()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, which are piece numbers less the unknown piece; what isn't remembered is learned at once."""
        parts = [self.split(t) for t in texts]
        found = iter(self.memory.look(list(chain.from_iterable(parts))))
        return [np.frombuffer(b"".join(islice(found, len(p))), np.int32) - 1 for p in parts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, joined by one space."""
        return self.numerals.join(ids)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.join(ids)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file on this worker; the file is a part of the installed tokenizer package."""
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Per row: the carried columns, ids array<int>, n_tokens, ids_sha256 and decoded_sha256 of the decoded ids.

    A null text counts as empty and gives no ids. Every row gives one row, repeated ones too, in any order;
    columns that aren't carried are left out, so their names can't clash. Long texts are encoded whole.
    """
    ready(docs.sparkSession)
    kinds = docs.select(*carry).schema.fields
    added = [("ids", T.ArrayType(T.IntegerType()))] * with_ids + [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    inner = [f"c{i}" for i in range(len(kinds))]

    def step(rows: dict[str, list]) -> dict[str, object]:
        tool = codec(path, pattern)
        found = tool.encode_all([t or "" for t in rows["text"]])
        out: dict[str, object] = {c: rows[c] for c in inner}
        out["n_tokens"] = [len(ids) for ids in found]
        out["ids_sha256"] = [sha(tool.decimals(ids)) for ids in found]
        out["decoded_sha256"] = [sha(tool.decode(ids)) for ids in found]
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + out["n_tokens"], dtype=np.int32)), pa.array(np.concatenate(found)))
        return out

    taken = docs.select(*(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)), F.col("text").alias("text"))
    schema = columns_of(*((c, f.dataType) for c, f in zip(inner, kinds, strict=True)), *added)
    found = map_rows(taken, step, schema, step_chars=STEP_CHARS)
    return found.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), *(n for n, _ in added))
