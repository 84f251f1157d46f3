"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two machines work one behind the other.

* The splitter reads character classes and marks where pre-tokens begin. Its table has a few states, so a
  chunk of text is a map from the state before it to the state after it. All chunks of a batch are read side
  by side, their maps compose through a parallel prefix scan, and a second reading with the now known states
  gives the marks. Marks lag by at most one character.
* The counter reads the bytes of a pre-token. Each transition is annotated with the number of tokens that
  the encoding of the prefix gains or loses, so the count of a pre-token is the sum along its path. A state
  is the longest suffix that can still begin a longer token, with the last tokens and the counts at the
  places inside it; only states that occur are compiled, and they are kept up to a bound. A chunk of a long
  pre-token is a map from the state before it to the state after it and the tokens gained; such maps compose
  by following the states and adding the tokens, and are remembered with their chunk. Every pre-token begins
  at the root, so a whole pre-token's map is its count alone; composing those is adding, and a prefix scan
  over a batch's pre-tokens gives the counts at all text boundaries at once.

The counter rests on a property of BPE with ranked merges: a sequence of tokens is the encoding of its bytes
if and only if every neighbouring pair encodes to itself. So the last token of a prefix is the one whose
pair with the encoding before it holds, and it never changes what stands before.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.bpe_codec import byte_letters
from narrata.llm.common import columns_of, map_rows, ready

#: Bounds of what a worker remembers: compiled transitions, counts of pre-tokens, and the length of those.
TRANSITIONS, REMEMBERED, REMEMBERED_CHARS = 1_000_000, 300_000, 48
#: Characters that one chunk map of the splitter covers, and bytes that one of the counter covers.
CHUNK, CHUNK_BYTES = 64, 256

# Character classes of the splitter.
SPACE, BLANK, LETTER, STMD, RV, EL, EE, NUMBER, QUOTE, OTHER, BREAK = range(11)
# States: nothing open; a word, a number, other characters; a quote that may open a contraction, one that
# still needs an e or an l; one space or several blanks ending in a space; the same ending in another blank.
OPEN, WORD, DIGITS, MARKS, APOS, NEED_E, NEED_L, SPACE1, SPACES, BLANK1, BLANKS = range(11)
# Marks of a transition: a pre-token begins at the character read, or at the one before it.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and marks[class, state] of ` ?letters| ?numbers| ?others|contractions|blanks`."""
    after, marks = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    letters = (LETTER, STMD, RV, EL, EE)
    body = {**dict.fromkeys(letters, WORD), NUMBER: DIGITS, QUOTE: MARKS, OTHER: MARKS}
    fresh = body | {QUOTE: APOS, SPACE: SPACE1, BLANK: BLANK1, BREAK: OPEN}

    def put(state: int, kind: int, to: int, mark: int) -> None:
        after[kind, state], marks[kind, state] = to, mark

    for state in range(11):
        for kind in range(11):
            put(state, kind, fresh[kind], HERE)
    for state, kinds in ((WORD, letters), (DIGITS, (NUMBER,)), (MARKS, (QUOTE, OTHER)), (APOS, (QUOTE, OTHER))):
        for kind in kinds:
            put(state, kind, body[kind], 0)
    put(APOS, STMD, OPEN, 0)
    put(APOS, RV, NEED_E, 0)
    put(APOS, EL, NEED_L, 0)
    for state, wanted in ((NEED_E, EE), (NEED_L, EL)):
        for kind in range(11):
            put(state, kind, fresh[kind], HERE | BEFORE)  # the letter after the quote began a word after all
        for kind in letters:
            put(state, kind, WORD, BEFORE)
        put(state, wanted, OPEN, 0)
    for state in (SPACE1, SPACES, BLANK1, BLANKS):
        put(state, SPACE, SPACES, 0)
        put(state, BLANK, BLANKS, 0)
    for kind, to in body.items():
        put(SPACE1, kind, to, 0)
        put(SPACES, kind, to, BEFORE)
        put(BLANKS, kind, fresh[kind], HERE | BEFORE)
    return after, marks


NEXT, MARKS_OF = _splitter()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, and of 0x110000, which stands for a break between texts."""
    import regex

    table = np.full(0x110001, OTHER, np.uint8)
    everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    for kind, chars in ((SPACE, " "), (QUOTE, "'"), (STMD, "stmd"), (RV, "rv"), (EL, "l"), (EE, "e")):
        for c in chars:
            table[ord(c)] = kind
    table[0x110000] = BREAK
    return table


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the columns of maps[state, chunk], by doubling strides."""
    stride, n = 1, maps.shape[1]
    while stride < n:
        longer = maps.copy()
        longer[:, stride:] = np.take_along_axis(maps[:, stride:], maps[:, :-stride].astype(np.intp), axis=0)
        maps, stride = longer, stride * 2
    return maps


def starts(classes: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin. The classes must end with a BREAK; a break begins a pre-token of its own."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, BREAK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    table = NEXT.ravel()
    maps = np.repeat(np.arange(11, dtype=np.uint8)[:, None], chunks, axis=1)
    offsets = grid.astype(np.intp) * 11
    for row in offsets:
        maps = table[row + maps]
    state = np.zeros(chunks, np.uint8)
    state[1:] = compose(maps)[OPEN, :-1]
    marks = np.empty((CHUNK, chunks), np.uint8)
    flat = MARKS_OF.ravel()
    for j, row in enumerate(offsets):
        at = row + state
        marks[j], state = flat[at], table[at]
    marks = marks.T.ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


class Counter:
    """The compiled counter of a vocabulary: counts the tokens of a pre-token."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {a + b: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.pair_rank = {pair: r for r, pair in enumerate(merges)}
        self.tokens = set(vocabulary)
        self.begun = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.states: list[tuple] = [(b"", ((None, 0),))]
        self.number = {self.states[0]: 0}
        self.go: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, int] = {}
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """The merges applied lowest rank first: what the compiler consults for a pair, never for a text."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.pair_rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            pair, merged, i = (parts[i], parts[i + 1]), [], 0
            while i < len(parts):
                hit = i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair
                merged.append(parts[i] + parts[i + 1] if hit else parts[i])
                i += 1 + hit
            parts = merged
        return parts

    def holds(self, left: bytes | None, right: bytes) -> bool:
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= TRANSITIONS:
                self.pairs.clear()
            self.pairs[key] = self.encode(right) == [right] if left is None else self.encode(left + right) == [left, right]
        return self.pairs[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the new state, and the tokens gained."""
        suffix, places = self.states[state]  # places[k]: last token and count (relative) k bytes into the suffix
        suffix += bytes([byte])
        for k, (last, count) in enumerate(places):
            token = suffix[k:]
            if token in self.tokens and self.holds(last, token):
                break
        gained = count + 1
        places = tuple((x, c - gained) for x, c in places) + ((token, 0),)
        keep = next((k for k in range(len(suffix)) if suffix[k:] in self.begun), len(suffix))
        key = (suffix[keep:], places[keep:])
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], gained

    def read(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after data from a state, and the tokens gained."""
        go, total = self.go, 0
        for byte in data:
            key = state << 8 | byte
            step = go.get(key)
            if step is None:
                step = go[key] = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return state, total

    def _bound(self, state: int) -> int:
        """The state's number after forgetting everything compiled, if that is over the bound."""
        if len(self.go) <= TRANSITIONS:
            return state
        key = self.states[state]
        del self.states[1:]
        self.number = {self.states[0]: 0}
        self.go.clear()
        self.maps.clear()
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def count(self, piece: str) -> int:
        data = piece.encode()
        self._bound(0)
        if len(data) <= CHUNK_BYTES:
            return self.read(0, data)[1]
        state = total = 0
        for i in range(0, len(data), CHUNK_BYTES):
            state, chunk = self._bound(state), data[i : i + CHUNK_BYTES]
            found = self.maps.get((state, chunk))
            if found is None:
                if len(self.maps) >= TRANSITIONS // CHUNK_BYTES:
                    self.maps.clear()
                found = self.maps[state, chunk] = self.read(state, chunk)
            state = found[0]
            total += found[1]
        return total

    def __getitem__(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            found = self.count(piece)
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found


@lru_cache(maxsize=2)
def machine(path: str) -> tuple[Counter, tuple[str, ...]]:
    """The counter and the special strings of a tokenizer file (JSON, byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"], spec["model"]
    if (split["type"], split["add_prefix_space"], split["use_regex"], spec["normalizer"], model["type"]) != ("ByteLevel", False, True, None, "BPE"):
        raise ValueError(f"not a byte-level BPE tokenizer without normalisation: {path}")
    byte = {c: b for b, c in enumerate(byte_letters())}
    special = tuple(t["content"] for t in spec["added_tokens"])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special strings with conditions are not supported")
    spell = lambda s: bytes(byte[c] for c in s)
    merges = [tuple(map(spell, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return Counter({spell(t): i for t, i in model["vocab"].items() if t not in special}, merges), special


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, special strings counting one and dividing the text."""
    counter, special = machine(path)
    totals, sections = [0] * len(texts), []
    for i, text in enumerate(texts):
        parts = [text]
        for s in special:
            parts = [x for p in parts for x in p.split(s)]
        totals[i] += len(parts) - 1
        sections += [(i, p) for p in parts if p]
    if not sections:
        return totals
    joined = "\0".join(p for _, p in sections) + "\0"
    classes = class_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for _, p in sections]) - 1
    classes[ends] = BREAK
    at = starts(classes)
    real = classes[at] != BREAK
    stops = np.append(at[1:], len(classes))[real]
    at = at[real]
    counts = np.fromiter(map(counter.__getitem__, map(joined.__getitem__, map(slice, at.tolist(), stops.tolist()))), np.int64, len(at))
    scan = np.concatenate(([0], np.cumsum(counts)))
    for (i, _), n in zip(sections, np.diff(scan[np.searchsorted(at, np.concatenate(([0], ends)))]).tolist(), strict=True):
        totals[i] += n
    return totals


def count_tokens(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """Per row: the carried columns, n_bytes, n_tokens, and over_limit (more tokens than limit).

    A null text counts as empty: no bytes, no tokens. Every row gives one row. Columns that aren't carried
    are left out. Very long texts are read whole; a batch's memory is bounded by its longest text.
    """
    ready(docs.sparkSession)
    kinds = docs.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]

    def step(rows: dict[str, list]) -> dict[str, object]:
        texts = [t or "" for t in rows["text"]]
        return {"n_tokens": count_texts(texts, path), "n_bytes": [len(t.encode()) for t in texts]} | {c: rows[c] for c in inner}

    taken = docs.select(*(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)), F.col("text").alias("text"))
    schema = columns_of(*((c, f.dataType) for c, f in zip(inner, kinds, strict=True)), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()))
    found = map_rows(taken, step, schema)
    return found.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
