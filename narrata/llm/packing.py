"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of n tokens belongs to class m = capacity // n: its length lies between the reciprocal parts
capacity / (m + 1) and capacity / m, and a bin of that class takes exactly m pieces, whatever they are. So
bins fill without a look at any other class, and every task fills its own: nothing is shuffled.

Padding comes from lengths that lie well below their class's part. Documents may be cut, so such a length
first gives a piece of the next smaller part exactly, capacity // (m + 1), and what is left is classed again;
lengths under a sixteenth of the capacity stay whole, since there the parts lie close together. What a task
has left in its unfilled bins (fewer than m pieces of each class) is strung together and cut at the capacity,
and the last of it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack as pack_ids
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import LOWER, STEP_CHARS, arrow_schema, columns_of, cuts, ready

#: Lengths up to capacity // WHOLE stay whole; so do those that leave at most capacity // SLACK of a bin empty.
WHOLE, SLACK = 16, 64
#: Words that one call of the library encodes, and those that a worker remembers in each of two generations.
CALL, REMEMBERED = 20_000, 500_000
#: Sequences are numbered within a task; the task's number stands above these bits.
TASK_BITS = 36


class Remembered:
    """The ids of words. A full generation becomes the older one; what it still answers moves to the younger."""

    def __init__(self, learn: Callable[[list[bytes]], Iterable[bytes]]):
        self.learn = learn
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that has all these words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        if missing := words.difference(self.known):
            new = []
            for w in missing:  # a set's own intersection would go through the whole table
                if (ids := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.known[w] = ids
            self.known.update(zip(new, self.learn(new), strict=True))
        return self.known


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, as packed unsigned 32-bit integers.

    No token spans white space, so the runs between ASCII white space are encoded one by one and remembered.
    An unknown run of ASCII letters with ASCII marks around them is made of its letters and its marks, which
    are remembered too; every other run, one with an apostrophe (contractions) or `<` (special strings)
    among them, goes to the library as it stands.
    """

    PLAIN = re.compile(rb"[a-z]+|[^a-z]+")
    SIMPLE = re.compile(rb"[A-Za-z!-&(-/:;=>?@\[-`{-~]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.runs, self.parts = Remembered(self._runs), Remembered(self._library)

    def _library(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words: of lower-case letters alone by the library's model, others by the whole tokenizer."""
        others = iter([w for w in words if not w.isalpha()])
        whole = self._whole(others)
        for w in words:
            if w.isalpha():  # of ASCII letters: nothing to normalise or to split
                ids = [t.id for t in self.model.tokenize(w.decode())]
                yield pack_ids(f"<{len(ids)}I", *ids)
            else:
                yield next(whole)

    def _whole(self, words: Iterator[bytes]) -> Iterator[bytes]:
        while some := [w.decode() for w in islice(words, CALL)]:
            found = self.tool.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))).tolist()
            yield from map(lambda a, b: ids[a:b], [0, *ends[:-1]], ends)

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        simple, plain = self.SIMPLE.fullmatch, self.PLAIN.findall
        split = [plain(r.translate(LOWER)) if simple(r) else (r,) for r in runs]
        part = self.parts.of(set().union(*split)).__getitem__
        return [part(s[0]) if len(s) == 1 else b"".join(map(part, s)) for s in split]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        run = self.runs.of(set().union(*split)).__getitem__
        return [b"".join(map(run, runs)) for runs in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file on this worker; the file is a part of the installed tokenizer package."""
    return WordEncoder(path)


def lengths(n: int, capacity: int) -> list[int]:
    """The lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > capacity // WHOLE and capacity - capacity // n * n > capacity // SLACK:
        out.append(capacity // (capacity // n + 1))
        n -= out[-1]
    return out + [n] * (n > 0)


class Bins:
    """The bins of one task. A piece is (document's columns, start, length, ids); a sequence a list of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def put(self, piece: tuple) -> list[tuple] | None:
        """The filled bin, if this piece fills one."""
        m = self.capacity // piece[2]
        waiting = self.open.setdefault(m, [])
        waiting.append(piece)
        return self.open.pop(m) if len(waiting) == m else None

    def rest(self) -> Iterator[list[tuple]]:
        """Sequences of what is left: full ones, then one for each power of two."""
        pieces = [p for m in sorted(self.open) for p in self.open[m]]
        left = sum(p[2] for p in pieces)
        pieces.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            made = []
            while size:
                columns, start, length, ids = pieces.pop()
                n = min(size, length)
                made.append((columns, start, n, ids[: 4 * n]))
                if n < length:
                    pieces.append((columns, start + n, length - n, ids[4 * n :]))
                size -= n
            yield made


def padded(length: int, capacity: int) -> int:
    """What a sequence of so many tokens takes: itself if that is a power of two, else the capacity."""
    return length if length & (length - 1) == 0 else capacity


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most capacity tokens.

    Per piece: the carried columns, ids array<long> (with_ids), start (tokens of its document before it),
    length, ids_crc32 (of the ids as unsigned little-endian 32-bit integers), doc_tokens, sequence_id, offset
    (in the sequence, from 0 without gaps) and padded_to (the sequence's length with its padding). A document
    is its text's ids and end_id; a null or empty text is end_id alone, so every row gives a piece at least.
    Repeated rows are packed each for itself, in the order in which the task reads them; columns that aren't
    carried are left out, so their names can't clash. An empty table has no pieces. Sequences are numbered
    within tasks, so a task that is run again must read the same rows in the same order, as scans of files
    do. A task keeps fewer than m pieces of each class m, less than capacity tokens a class.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    ready(docs.sparkSession)
    kinds = docs.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]
    added = [("ids", T.ArrayType(T.LongType()))] * with_ids
    added += [(name, T.LongType()) for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")]
    schema = columns_of(*((c, f.dataType) for c, f in zip(inner, kinds, strict=True)), *added)
    arrow = arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def rows(sequences: list[tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        made = []
        for number, pieces in sequences:
            offset, full = 0, padded(sum(p[2] for p in pieces), capacity)
            for (columns, n), start, length, ids in pieces:
                shown = [np.frombuffer(ids, "<u4").astype(np.int64)] * with_ids
                made.append((*columns, *shown, start, length, crc32(ids), n, number, offset, full))
                offset += length
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tool, bins, number = encoder(path), Bins(capacity), TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            columns = batch.to_pydict()
            texts = [t or "" for t in columns["text"]]
            for a, b in cuts(texts, batch.num_rows, STEP_CHARS):
                full = []
                for i, ids in enumerate(tool.encode_all(texts[a:b]), a):
                    ids += end
                    document, start = (tuple(columns[c][i] for c in inner), len(ids) // 4), 0
                    for n in lengths(len(ids) // 4, capacity):
                        if (filled := bins.put((document, start, n, ids[4 * start : 4 * (start + n)]))) is not None:
                            full.append((number, filled))
                            number += 1
                        start += n
                yield from rows(full)
        yield from rows(list(enumerate(bins.rest(), number)))

    taken = docs.select(*(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)), F.col("text").alias("text"))
    found = taken.mapInArrow(run, schema)
    return found.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), *(n for n, _ in added))


def padding(pieces: DataFrame) -> DataFrame:
    """One row: sequences, tokens, padding, and the padding's share of all places."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.first("padded_to").alias("places"))
    total = each.agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(F.expr("places - tokens")).alias("padding"))
    return total.withColumn("share", F.expr("padding / (tokens + padding)"))
