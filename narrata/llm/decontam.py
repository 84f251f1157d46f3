"""Benchmark decontamination by Wu-Manber search for word windows.

The patterns are the windows of the benchmark items, grouped by length. For each length a machine has a
shift table over blocks of two words: how far the search may move on without passing an occurrence. At a
shift of zero, the bucket of the block at the window's end (its suffix) and then the block at its start
select the patterns, and a direct comparison of all words confirms them.

The machines are built from a shard of items whose size is measured; a benchmark beyond one shard is
searched shard by shard, in passes that carry the hits along with the row, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import map_rows, ready

WINDOW = 10
#: Bytes of benchmark text that one broadcast machine is built from.
SHARD_BYTES = 16 << 20
#: Words are lower-case ASCII letters, digits and whatever is not ASCII; all other bytes divide them.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Machine:
    """Wu-Manber tables for patterns (tuples of word numbers) of one length."""

    def __init__(self, patterns: dict[tuple[int, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        size = max(1 << 12, 1 << (8 * len(patterns)).bit_length())
        self.mask = size - 1
        far = length - self.block + 1
        self.shift = np.full(size, far, np.uint8 if far < 256 else np.int64)
        self.buckets: dict[int, dict[tuple[int, ...], list[tuple[tuple[int, ...], list[int]]]]] = {}
        for p, items in patterns.items():
            for j in range(self.block, length + 1):
                h = self.hash(p[j - self.block : j])
                self.shift[h] = min(self.shift[h], length - j)
            self.buckets.setdefault(self.hash(p[-self.block :]), {}).setdefault(p[: self.block], []).append((p, items))

    def hash(self, block: tuple[int, ...]) -> int:
        h = block[0]
        for w in block[1:]:
            h = h * 1_000_003 + w
        return h & self.mask

    def occurrences(self, text: list[int], numbers: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Start and items of every occurrence in a text of word numbers (0: in no pattern)."""
        m, b = self.length, self.block
        if len(text) < m:
            return
        hashes = (numbers if b == 1 else numbers[:-1] * 1_000_003 + numbers[1:]) & self.mask
        shifts = self.shift[hashes].tolist()
        at, last = m - b, len(text) - b  # at: start of the window's last block
        while at <= last:
            step = shifts[at]
            if step:
                at += step
                continue
            start = at + b - m
            bucket = self.buckets.get(int(hashes[at]))
            if bucket is not None:
                for pattern, items in bucket.get(tuple(text[start : start + b]), ()):
                    if tuple(text[start : start + m]) == pattern:
                        yield start, items
            at += 1


class Search:
    """All machines of a shard of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(ids[i : i + m], set()).add(number[name])
        self.machines = [Machine({p: sorted(x) for p, x in ps.items()}, m) for m, ps in sorted(found.items())]

    def hits(self, text: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Whether each word is inside an occurrence; the items that occur."""
        known = self.vocabulary.get
        ids = [known(w, 0) for w in text]
        numbers = np.array(ids, np.int64)
        edges, items = np.zeros(len(ids) + 1, np.int32), set()
        for machine in self.machines:
            for start, found in machine.occurrences(ids, numbers):
                edges[start] += 1
                edges[start + machine.length] -= 1
                items.update(found)
        return np.cumsum(edges[:-1]) > 0, items


def shards(benchmark: DataFrame, id_column: str, bound: int) -> Iterator[list[tuple[str, str | None]]]:
    """The distinct items in lists whose texts hold about bound bytes together at most, by measured sizes."""
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), F.col("text").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (bound // 2 or 1)) if total > bound else 1)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r["name"], r["text"]) for r in part.collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row of docs: the carried columns, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it is inside an occurrence of a window of some item: window consecutive words, or all
    words of an item that has fewer. A null or wordless text has no words on either side and hits nothing.
    Rows of one item_id are one item; a null item_id is the item named "". Without items nothing is hit.
    Every row of docs gives one row. Very long texts are searched whole.
    """
    ready(docs.sparkSession)
    kinds = docs.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]
    state = docs.select(
        *(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)),
        F.col("text").alias("text"),
        F.lit(b"").alias("bits"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
    )
    schema = state.schema
    for shard in shards(benchmark, id_column, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Search(shard, window))

        def step(rows: dict[str, list], shared=shared) -> dict[str, object]:
            search = shared.value
            bits, items, counts = [], [], []
            for text, before, already in zip(rows["text"], rows["bits"], rows["items"], strict=True):
                split = words(text)
                hit, found = search.hits(split)
                if before:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=len(split)).astype(bool)
                bits.append(np.packbits(hit).tobytes() if hit.any() else b"")
                items.append(sorted({*already, *(search.names[i] for i in found)}))
                counts.append(len(split))
            return rows | {"bits": bits, "items": items, "n_words": counts}

        state = map_rows(state, step, schema)
    return state.select(
        *(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)),
        "n_words",
        _ones("bits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def _ones(column: str) -> F.Column:
    """The number of set bits of a binary column."""
    digits = F.hex(column)
    return sum(
        (F.lit(n) * (F.length(digits) - F.length(F.translate(digits, chars, ""))) for n, chars in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F"))), F.lit(0)
    ).cast("long")
