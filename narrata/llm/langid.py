"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three characters of the lower-cased text, with runs of non-letters read as
one space, hashed to a fixed number of places. Document frequencies cover all training rows; the weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample of them, and a
temperature, fitted on rows of the sample that were set aside, calibrates the scores. Every label of the
training rows is a class; a training set whose weights can't be held raises an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import arrow_schema, columns_of, cuts, kept, map_rows, measured, ready

PLACES = 1 << 15
UNKNOWN = "und"
#: Bound of the fitting sample: rows of each language at most.
SAMPLE_PER_LANGUAGE = 800
#: Parts that a language's rows are dealt into while the smallest hashes are sought.
PARTS = 64
#: Weights (places that occur in the sample, by languages) that a fit may have; beyond it raises an error.
WEIGHTS = 24_000_000
#: Errors of a class smaller than this leave its weights as they are.
LEAST_ERROR = 1e-3


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        import regex

        table = np.zeros(0x110000, bool)
        everything = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for m in regex.finditer(r"\p{L}+", everything):
            a, b = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            table[a : b + 1] = True
        _LETTERS = table
    return _LETTERS


_LETTERS: np.ndarray | None = None


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all n-grams of all texts, the text that each is of, and whether a text has a letter."""
    joined = "\n".join((t or "").lower() for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len((t or "").lower()) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    is_letter = letters()[codes]
    has = np.zeros(len(texts), bool)
    has[row[is_letter]] = True
    # A run of other characters is one space; a text begins and ends with one.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    keep[first] = True
    c, row = np.where(is_letter, codes, 32).astype(np.uint64)[keep], row[keep]
    grams, rows = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        same = row[: len(h)] == row[n - 1 :]
        grams.append((mixed >> np.uint64(64 - 15)).astype(np.int32)[same])
        rows.append(row[: len(h)][same])
    return np.concatenate(grams), np.concatenate(rows), has


@dataclass
class Model:
    """Weights of the places that have any; row 0 is for all other places, and is zero."""

    languages: list[str]
    at: np.ndarray  # place to row of weights
    weights: np.ndarray  # row, language; scaled by the inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, grams: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of weights by text: TF is the share of an n-gram among its text's, so sums are means."""
        counts = np.maximum(np.bincount(rows, minlength=n), 1)
        found = self.at[grams]
        if len(self.languages) <= 64:
            return np.stack([np.bincount(rows, self.weights[found, k], n) / counts for k in range(len(self.languages))], 1) + self.bias
        pairs, times = np.unique(rows.astype(np.int64) * len(self.weights) + found, return_counts=True)
        edges = np.searchsorted(pairs, np.arange(n + 1) * len(self.weights))
        sums = [times[a:b].astype(np.float32) @ self.weights[pairs[a:b] % len(self.weights)] for a, b in zip(edges, edges[1:], strict=False)]
        return np.stack(sums) / counts[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        grams, rows, has = features(texts)
        p = softmax(self.logits(grams, rows, len(texts)) / self.temperature)
        best = p.argmax(1)
        return (
            [self.languages[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)],
            [float(p[i, k]) if has[i] else 0.0 for i, k in enumerate(best)],
        )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = 0.5, l1: float = 0.3, l2: float = 0.02, epochs: int = 4) -> Model | None:
    """FTRL-proximal with L1 and L2 on (places, shares, language) rows; every fifth row of a language calibrates.

    None without rows. Classes whose error on a row is below LEAST_ERROR keep their weights, so a row costs
    what its rivals cost, however many classes there are.
    """
    if not samples:
        return None
    languages = sorted({y for *_, y in samples})
    number = {y: k for k, y in enumerate(languages)}
    used_places = np.unique(np.concatenate([i for i, *_ in samples]))
    at = np.zeros(len(idf), np.int32)
    at[used_places] = np.arange(1, len(used_places) + 1)
    if (size := (len(used_places) + 1) * len(languages)) > WEIGHTS:
        raise ValueError(f"{len(languages)} languages with {len(used_places)} places need {size} weights; the bound is {WEIGHTS}")
    # Each row's TF-IDF vector has length one while fitting; the scale goes into the temperature.
    rows = [(at[i], x * idf[i], number[y]) for i, x, y in samples]
    # Every fifth row of a language is set aside, so a language of few rows is learned from all of them.
    seen, held, used = [0] * len(languages), [], []
    for r in rows:
        seen[r[2]] += 1
        (used if seen[r[2]] % 5 else held).append(r)
    shape = (len(used_places) + 2, len(languages))  # the last row is the bias
    z, n, w = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    order = np.random.default_rng(7)
    scale = 1 / max(1e-9, float(np.mean([np.sqrt((x * x).sum()) for _, x, _ in rows])))
    for _ in range(epochs):
        for k in order.permutation(len(used)):
            i, x, y = used[k]
            i, x = np.append(i, shape[0] - 1), np.append(x * scale, 1.0)
            error = softmax(x @ w[i])
            error[y] -= 1
            rivals = np.flatnonzero(np.abs(error) >= LEAST_ERROR)
            part = np.ix_(i, rivals) if len(rivals) < len(error) else (i, slice(None))
            g = x[:, None] * error[rivals]
            before, step = n[part], g * g
            zp = z[part] + g - (np.sqrt(before + step) - np.sqrt(before)) / alpha * w[part]
            z[part], n[part] = zp, before + step
            w[part] = np.where(np.abs(zp) <= l1, 0, -(zp - np.sign(zp) * l1) / ((1 + np.sqrt(before + step)) / alpha + l2))
    weights = w[:-1] * scale
    weights[1:] *= idf[used_places, None]
    model = Model(languages, at, weights.astype(np.float32), w[-1].astype(float))
    if held and len(languages) > 1:
        raw = w[:-1] * scale
        model.temperature = calibrate(np.stack([x @ raw[i] + model.bias for i, x, _ in held]), np.array([y for *_, y in held]))
    return model


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of the least cross-entropy to smoothed targets.

    As in Platt's scaling the right class counts 1 - 1 / (rows + 2) and the others share the rest, so the
    optimum is finite even if every row is right.
    """
    n, k = logits.shape
    wanted = np.full((n, k), 1 / (n + 2) / (k - 1))
    wanted[np.arange(n), target] = 1 - 1 / (n + 2)
    logits = logits - logits.max(1, keepdims=True)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        return float((np.log(np.exp(x).sum(1)) - (wanted * x).sum(1)).mean())

    low, high = np.log(1e-4), np.log(1e4)  # the loss is convex in the inverse temperature
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task: how many of its texts have each place, and, at place -1, how many texts it has."""
    total, seen = np.zeros(PLACES, np.int64), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in cuts(texts, len(texts)):
            grams, rows, _ = features(texts[a:b])
            pairs = np.unique(rows.astype(np.int64) * PLACES + grams)
            total += np.bincount(pairs % PLACES, minlength=PLACES)
            seen += b - a
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], seen))], schema=arrow_schema(_FREQUENCY))


_FREQUENCY = columns_of(("place", T.IntegerType()), ("n", T.LongType()))
_ROW = columns_of(("lang", T.StringType()), ("places", T.BinaryType()), ("shares", T.BinaryType()))


def _vectors(rows: dict[str, list]) -> dict[str, object]:
    grams, of, _ = features(rows["text"])
    pairs, count = np.unique(of.astype(np.int64) * PLACES + grams, return_counts=True)
    edges = np.searchsorted(pairs, np.arange(len(rows["text"]) + 1) * PLACES)
    places, shares = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        places.append((pairs[a:b] % PLACES).astype(np.int32).tobytes())
        shares.append((count[a:b] / max(1, count[a:b].sum())).astype(np.float32).tobytes())
    return {"lang": rows["lang"], "places": places, "shares": shares}


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """The model of labelled texts (doc_id, text, lang): None if there is no labelled text.

    Rows without a text or a language teach nothing. Document frequencies are of all rows; the weights see at
    most per_language rows of each language: those of the smallest hashes of id and text, so the same ones on
    every run, and all rows if there are no more.
    """
    ready(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text"))
    # Each task keeps a language's smallest hashes before the shuffle, and each of PARTS parts of a language before the last one.
    lowest, rank = drawn.select("lang", "draw", F.pmod("draw", F.lit(PARTS)).alias("part")), F.row_number()
    for by in (["lang", "part"], ["lang"]):
        lowest = lowest.withColumn("i", rank.over(Window.partitionBy(*by).orderBy("draw"))).where(F.col("i") <= per_language)
    cut = kept(lowest.groupBy("lang").agg(F.max("draw").alias("cut")))
    n = cut.count()
    if not n:
        return None
    if n > WEIGHTS:
        raise ValueError(f"more than {WEIGHTS} languages")
    found = rows.select("text").mapInArrow(_document_frequencies, _FREQUENCY).groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = next((r["n"] for r in found if r["place"] == -1), 0)
    df = np.zeros(PLACES)
    for r in found:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    chosen = drawn.join(measured(cut, "octet_length(lang)"), "lang").where("draw <= cut").withColumn("i", rank.over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("i") <= per_language).select("text", "lang")
    vectors = map_rows(chosen, _vectors, _ROW).collect()
    vectors.sort(key=lambda r: (r["lang"], bytes(r["places"]), bytes(r["shares"])))
    samples = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32), r["lang"]) for r in vectors]
    order = np.random.default_rng(5).permutation(len(samples))
    return fit([samples[k] for k in order], idf)


def identify(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the carried columns, lang_pred, score (the calibrated probability of lang_pred).

    A null text, and one without a letter, is `und` with score 0, and so is every text if there is no model.
    Every row gives one row. Texts are read whole; only the text is looked at.
    """
    ready(docs.sparkSession)
    kinds = docs.select(*carry).schema.fields
    inner = [f"c{i}" for i in range(len(kinds))]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: dict[str, list]) -> dict[str, object]:
        model, texts = shared.value, rows["text"]
        lang, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return {c: rows[c] for c in inner} | {"lang_pred": lang, "score": score}

    taken = docs.select(*(F.col(f.name).alias(c) for f, c in zip(kinds, inner, strict=True)), F.col("text").alias("text"))
    schema = columns_of(*((c, f.dataType) for c, f in zip(inner, kinds, strict=True)), ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    found = map_rows(taken, step, schema)
    return found.select(*(F.col(c).alias(f.name) for c, f in zip(inner, kinds, strict=True)), "lang_pred", "score")


def held_out(column: str = "doc_id") -> Column:
    """Whether a row's crc32 says that it isn't learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
