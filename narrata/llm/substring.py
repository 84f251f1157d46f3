"""Substring deduplication by recompression: removes every word inside a window of words that occurs twice.

Parsing. Rounds name token runs and pairs of symbols: a maximal run of equal tokens becomes one symbol with
its length in its name (a long run ends short of its edges, which a window may cut), then a symbol of the left
half of the alphabet and a right-hand neighbour of the right half become one symbol, up to a length that each
round allows. A name is a 64-bit hash of the names it is made of, and the half is a bit of that name, so the
names of these rounds are global without an exchange. What a round does at a place depends on the neighbouring
symbols only; so the symbols inside equal substrings are equal, but for a margin at either edge that the
rounds' lengths bound.

Revealing. In each window the symbol of the smallest name, among those that start in a fixed stretch of it,
is its anchor; equal windows have their anchor at the same place. An anchor owns a run of consecutive
windows, all of which hold the same stretch of words around it. A Spark round names the anchors' next level,
the symbol with that stretch to its left and right: it counts the names over all texts, and those that occur
once drop out, since nothing they are part of can be repeated.

Verifying. A second Spark round names the level above, the whole context: the words of all windows that an
anchor owns, by 128 bits of their SHA-256. Anchors of repeated names whose context occurs twice settle all
their windows at once. The others have their windows named one by one, by their words again, and compared.
Every grouping is combined within the task before it is shuffled, so a passage that a third of all rows
share is a row or so of each task; joins are plain equi-joins, which Spark can split. Nothing is broadcast
by hint: every side grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import arrow_schema, columns_of, cuts, hash_words, inverse, kept, mix, powers, ready, sha

WINDOW = 35
#: Anchors or windows of a task that are combined at once, and places that one row lists at most.
COMBINED, PLACES = 1 << 20, 2048
#: Where an anchor or a window is: 128 bits of the row's id and text, the word.
PLACE = np.dtype([("r1", "<i8"), ("r2", "<i8"), ("at", "<i4")])

_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Plan:
    """The lengths that follow from the window: longest run, longest symbol of each round, margin, stretch of anchors."""

    window: int
    run: int
    caps: tuple[int, ...]
    margin: int
    stretch: int

    @staticmethod
    def of(window: int) -> Plan:
        best = Plan(window, 1, (), 0, window)
        for run, caps in ((2, (2,)), (2, (2, 4)), (4, (2, 4)), (4, (2, 4, 6))):
            margin = longest = run  # a run at the edge may be cut
            for cap in caps:
                margin += min(longest, cap - 1)
                longest = max(run, min(cap, 2 * longest))
            stretch = window - 2 * margin - longest + 1
            if stretch >= 2 * longest:
                best = Plan(window, run, caps, margin, stretch)
        return best

    @property
    def key_words(self) -> int:
        return self.window - self.stretch + 1


class Text:
    """Words of several texts, with hashes of any stretch of them."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.x, self.counts = hash_words(raw)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self._raw = raw
        self._clean: tuple[memoryview, np.ndarray] | None = None
        self._sums: np.ndarray | None = None

    def digests(self, a: np.ndarray, b: np.ndarray, shape: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the SHA-256 of the words from a up to b, joined by one space; shape is told apart too."""
        if self._clean is None:
            words = b" ".join(self._raw).split()
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            self._clean = memoryview(b" ".join(words)), np.concatenate(([0], ends))
        data, starts = self._clean
        found = b"".join([sha256(data[i:j]).digest()[:16] for i, j in zip(starts[a].tolist(), (starts[b] - 1).tolist(), strict=True)])
        both = np.frombuffer(found, np.uint64).reshape(-1, 2)
        return both[:, 0] if shape is None else mix(both[:, 0] + mix(shape)), both[:, 1]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a up to b, the same wherever they stand."""
        if self._sums is None:
            self._sums = np.zeros(len(self.x) + 1, np.uint64)
            np.cumsum(self.x * powers(_BASE, len(self.x)), out=self._sums[1:])
        return mix((self._sums[b] - self._sums[a]) * powers(inverse(_BASE), len(self.x) + 1)[a])

    def parse(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, names and lengths of the symbols after all rounds."""
        name, start, row = self.x, np.arange(len(self.x), dtype=np.int32), self.row
        length = np.ones(len(name), np.int8)

        def join(at: np.ndarray, made: np.ndarray) -> None:
            """Symbol at[i] takes in the next one under a new name."""
            nonlocal name, start, row, length
            name, length = name.copy(), length.copy()
            name[at] = made
            length[at] += length[at + 1]
            stay = np.ones(len(name), bool)
            stay[at + 1] = False
            name, start, row, length = name[stay], start[stay], row[stay], length[stay]

        if plan.caps and len(name) > 1:
            # Maximal runs: names get the run's length; what a window's edge may cut is left alone, bar pairs.
            same = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
            if same.any():
                head = np.flatnonzero(np.concatenate(([True], ~same)))
                many = np.diff(np.append(head, len(name)))
                runs = (many > 1) & (many <= plan.run)
                at, many = head[runs], many[runs]
                name, length = name.copy(), length.copy()
                name[at] = mix(name[at] ^ np.uint64(0xA5A5A5A5) + many.astype(np.uint64))
                length[at] = many
                gone = np.zeros(len(name) + 1, np.int32)
                np.add.at(gone, at + 1, 1)
                np.add.at(gone, at + many, -1)
                stay = np.cumsum(gone[:-1]) == 0
                name, start, row, length = name[stay], start[stay], row[stay], length[stay]
        for k, cap in enumerate(plan.caps):
            half = (name * np.uint64(0x9FB21C651E98DF25 + 2 * k)) >> np.uint64(63) == 0
            pair = half[:-1] & ~half[1:] & (row[:-1] == row[1:]) & (length[:-1] + length[1:] <= cap)
            at = np.flatnonzero(pair)
            join(at, mix(name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + name[at + 1] + np.uint64(k)))
        return start, name, length

    def anchors(self, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and the last window that each owns."""
        n, w = len(self.x), plan.window
        none = np.zeros(0, np.int64)
        if n < w:
            return none, none, none
        start, name, length = self.parse(plan)
        self._name, self._length = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        self._name[start], self._length[start] = name, length
        bits = max(24, n.bit_length())
        place = np.uint64(bits)
        best = np.full(n, ~np.uint64(0), np.uint64)
        best[start] = (mix(name) >> place << place) | start.astype(np.uint64)
        reach = 1
        while reach * 2 <= plan.stretch:
            best = np.minimum(best[: len(best) - reach], best[reach:])
            reach *= 2
        if plan.stretch > reach:
            rest = plan.stretch - reach
            best = np.minimum(best[: len(best) - rest], best[rest:])
        windows = np.flatnonzero(self.row[: n - w + 1] == self.row[w - 1 :])
        if not len(windows):
            return none, none, none
        chosen = (best[windows + plan.margin] & np.uint64((1 << bits) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        return chosen[new], windows[new], windows[np.append(new[1:], len(windows)) - 1]

    def keys(self, plan: Plan, anchors: np.ndarray) -> np.ndarray:
        """Names of the anchors' next level: the symbol, with what stands left and right of it in all windows owned."""
        if not len(anchors):
            return np.zeros(0, np.uint64)
        a, b = anchors - plan.margin, anchors + self._length[anchors]
        return mix(self._name[anchors] + mix(self.hash(a, anchors)) * np.uint64(3) + mix(self.hash(b, a + plan.key_words)) * np.uint64(5))

    def contexts(self, plan: Plan, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for all words of the windows that an anchor owns, with their number and its place."""
        shape = ((anchors - low) << 32 | (high - low)).astype(np.uint64)
        return self.digests(low, high + plan.window, shape)


def _steps(batch: pa.RecordBatch, text: str = "text") -> Iterator[dict[str, list]]:
    columns = batch.to_pydict()
    for a, b in cuts(columns[text], batch.num_rows):
        yield {k: v[a:b] for k, v in columns.items()}


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _places(r1: list, r2: list, text: Text, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), PLACE)
    rows = text.row[at]
    out["r1"], out["r2"] = np.array(r1, np.int64)[rows], np.array(r2, np.int64)[rows]
    out["at"] = at - text.first[rows]
    return out


class Combiner:
    """Gathers rows of a name (three hashes), a weight and a place, and gives one row for each name of a task.

    Places of a name are listed in rows of up to PLACES; COMBINED rows are held at most.
    """

    def __init__(self, schema: pa.Schema):
        self.schema, self.held, self.n = schema, [], 0

    def add(self, key: np.ndarray, name: tuple[np.ndarray, np.ndarray], weight: np.ndarray, places: np.ndarray, listed: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, *name, weight, places, listed))
        self.n += len(key)
        if self.n >= COMBINED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        *names, weight, places, listed = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((names[2], names[1]))  # the key follows from the other two
        names, weight, places, listed = [x[order] for x in names], weight[order], places[order], listed[order]
        new = np.concatenate(([True], (names[1][1:] != names[1][:-1]) | (names[2][1:] != names[2][:-1])))
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        rank = np.arange(len(new)) - heads[group]
        head = np.flatnonzero(new | (rank % PLACES == 0))
        sums = np.add.reduceat(weight, head)
        raw = np.ascontiguousarray(places[listed]).view(np.uint8)
        many = np.add.reduceat(listed.astype(np.int64), head)
        offsets = np.concatenate(([0], np.cumsum(many * PLACE.itemsize))).astype(np.int32)
        listing = pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        columns = [*(pa.array(_signed(x[head])) for x in names), pa.array(sums), listing]
        whole = pa.RecordBatch.from_arrays(columns, schema=self.schema)
        for i in range(0, len(head), 10_000):
            yield whole.slice(i, 10_000)


_ROWS = columns_of(("key", T.LongType()), ("c1", T.LongType()), ("c2", T.LongType()), ("n", T.LongType()), ("places", T.BinaryType()))
_KEYS = columns_of(("key", T.LongType()))
_FLAGS = columns_of(("r1", T.LongType()), ("r2", T.LongType()), ("flags", T.BinaryType()))


def _emit_keys(plan: Plan):
    """For each task, the keys of its anchors, twice where it has seen one more than once."""
    schema = arrow_schema(_KEYS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            found = np.concatenate((found, found[count > 1]))
            whole = pa.RecordBatch.from_arrays([pa.array(_signed(found))], schema=schema)
            yield from (whole.slice(i, 10_000) for i in range(0, len(found), 10_000))

        for batch in batches:
            for rows in _steps(batch):
                text = Text(rows["text"])
                held.append(text.keys(plan, text.anchors(plan)[0]))
                n += len(held[-1])
                if n >= 4 * COMBINED:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _emit_anchors(plan: Plan):
    schema = arrow_schema(_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(schema)
        for batch in batches:
            for rows in _steps(batch):
                text = Text(rows["text"])
                anchors, low, high = text.anchors(plan)
                one = np.ones(len(anchors), np.int64)
                places = _places(rows["r1"], rows["r2"], text, anchors)
                yield from combiner.add(text.keys(plan, anchors), text.contexts(plan, anchors, low, high), one, places, one.astype(bool))
        yield from combiner.flush()

    return run


# Flags of an anchor: its windows are all repeated; they are to be hashed, to find their like; they are to be
# hashed for others to find, since they are known to be repeated. WINDOW_FLAG marks one window by its start.
SETTLED, ASK, TELL, ONE = 1, 2, 4, 8
_FLAG = np.dtype([("at", "<i4"), ("flag", "u1")])


def _emit_windows(plan: Plan):
    """The windows of anchors flagged ASK or TELL, by their words; weight 2 where known to be repeated."""
    schema = arrow_schema(_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner(schema)
        for batch in batches:
            for rows in _steps(batch):
                text = Text(rows["text"])
                anchors, low, high = text.anchors(plan)
                flag = _flags_at(text, rows["flags"], anchors)
                pick = (flag & (ASK | TELL)) > 0
                low, high, flag = low[pick], high[pick], flag[pick]
                many = high - low + 1
                starts = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                ask = np.repeat((flag & ASK) > 0, many)
                name = text.digests(starts, starts + plan.window)
                places = _places(rows["r1"], rows["r2"], text, starts)
                yield from combiner.add(name[0], name, np.where(ask, 1, 2).astype(np.int64), places, ask)
        yield from combiner.flush()

    return run


def _flags_at(text: Text, flags: list[bytes | None], anchors: np.ndarray) -> np.ndarray:
    """The flags (not ONE) of each anchor."""
    out = np.zeros(len(text.x) + 1, np.uint8)
    for i, f in enumerate(flags):
        if f:
            found = np.frombuffer(f, _FLAG)
            found = found[found["flag"] != ONE]
            np.bitwise_or.at(out, found["at"] + text.first[i], found["flag"])
    return out[anchors]


def _remove(plan: Plan, texts: bool):
    def step(rows: dict[str, list]) -> dict[str, object]:
        flagged = [i for i, f in enumerate(rows["flags"]) if f]
        covered: dict[int, np.ndarray] = {}
        if flagged:
            text = Text([rows["text"][i] for i in flagged])
            flags = [rows["flags"][i] for i in flagged]
            anchors, low, high = text.anchors(plan)
            edges = np.zeros(len(text.x) + 1, np.int32)
            settled = (_flags_at(text, flags, anchors) & SETTLED) > 0
            np.add.at(edges, low[settled], 1)
            np.add.at(edges, high[settled] + plan.window, -1)
            for i, f in enumerate(flags):
                found = np.frombuffer(f, _FLAG)
                starts = found["at"][found["flag"] == ONE] + text.first[i]
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + plan.window, -1)
            cover = np.cumsum(edges[:-1]) > 0
            covered = {i: cover[text.first[k] : text.first[k + 1]] for k, i in enumerate(flagged)}
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for i, t in enumerate(rows["text"]):
            split = (t or "").encode().split()
            gone = covered.get(i)
            left = split if gone is None else [w for w, g in zip(split, gone.tolist(), strict=True) if not g]
            joined = b" ".join(left)
            out["n_words"].append(len(split))
            out["n_removed"].append(len(split) - len(left))
            out["kept_sha256"].append(sha(joined))
            out["kept_text"].append((t if len(left) == len(split) else joined.decode()) if texts else None)
        return out

    return step


def _flag_rows(rows: DataFrame, flag: int) -> DataFrame:
    """A row for each place: its row, and the flag there. Grouping by text combines them in the task."""
    schema = arrow_schema(_FLAGS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            places = np.frombuffer(raw, PLACE)
            for i in range(0, len(places), 20_000):
                part = places[i : i + 20_000]
                body = np.zeros(len(part), _FLAG)
                body["at"], body["flag"] = part["at"], flag
                offsets = (np.arange(len(part) + 1) * _FLAG.itemsize).astype(np.int32)
                listing = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(body.view(np.uint8))])
                yield pa.RecordBatch.from_arrays([pa.array(part["r1"]), pa.array(part["r2"]), listing], schema=schema)

    return rows.select("places").mapInArrow(run, _FLAGS)


def _per_text(*flags: DataFrame) -> DataFrame:
    """One row for each flagged text, with its distinct flags; checkpointed. Equal rows flag the same places, so their flags meet here."""
    found = flags[0]
    for other in flags[1:]:
        found = found.unionByName(other)
    return kept(found.groupBy("r1", "r2").agg(F.concat_ws("", F.collect_set(F.hex("flags"))).alias("flags")).withColumn("flags", F.unhex("flags")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """Per row of docs (columns doc_id and text): the carried columns, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of characters other than ASCII white space. A word goes if it is in a window of window
    consecutive words of its text whose words also start anywhere else, in another row or in the same one.
    Windows are judged on the input. kept_text (with texts=True, else null) is the text itself if nothing
    went, else the words left, joined by one space. A null or short text has no window and loses nothing.
    A repeated row repeats all its windows, so both lose them. A null doc_id is a value like any other; rows
    are told apart by 128 bits of their id and text, so rows that are the same in both are flagged alike.
    Every row gives one row. Texts are parsed whole.
    """
    ready(docs.sparkSession)
    plan = Plan.of(window)
    named = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("text"))
    row = [F.xxhash64(F.lit(k), *named).alias(f"r{k}") for k in (1, 2)]
    own = docs.where(F.col("text").isNotNull()).select(*row, "text")
    keys = own.select("text").mapInArrow(_emit_keys(plan), _KEYS)
    repeated = kept(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    rows = kept(own.mapInArrow(_emit_anchors(plan), _ROWS).join(repeated, "key", "left_semi"))
    first = F.min(F.substring("places", 1, PLACE.itemsize))
    contexts = kept(rows.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), first.alias("places")))
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = contexts.join(kept(several), "key", "left_semi")
    settled = rows.join(contexts.where("n > 1").select("key", "c1", "c2"), ["key", "c1", "c2"], "left_semi")
    asking, telling = shared.where("n = 1"), shared.where("n > 1")
    flags = _per_text(_flag_rows(settled, SETTLED), _flag_rows(asking, ASK), _flag_rows(telling, TELL))

    def flagged(flags: DataFrame, how: str, *columns: F.Column) -> DataFrame:
        side = flags.withColumnsRenamed({"r1": "f1", "r2": "f2"})
        base = docs.select(*columns, *row, F.col("text").alias("k_text"))
        return base.join(side, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2")), how)

    todo = flags.where(F.col("flags").isNotNull())
    asked = flagged(todo, "inner").select("r1", "r2", F.col("k_text").alias("text"), "flags")
    windows = kept(asked.mapInArrow(_emit_windows(plan), _ROWS))
    again = windows.groupBy("c1", "c2").agg(F.sum("n").alias("n")).where("n > 1").select("c1", "c2")
    found = windows.where(F.octet_length("places") > 0).join(again, ["c1", "c2"], "left_semi")
    flags = _per_text(flags, _flag_rows(found, ONE))

    kinds = docs.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]
    last = flagged(flags, "left", *(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)))
    taken = last.select(*inner, F.col("k_text").alias("text"), "flags")
    made = columns_of(("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, kinds, strict=True)] + made.fields)
    remove, out = _remove(plan, texts), arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _steps(batch):
                cols = remove(rows) | {c: rows[c] for c in inner}
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    result = taken.mapInArrow(run, schema)
    return result.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), *made.names)
