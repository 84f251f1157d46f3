"""Quality classifier: document evidence and hierarchical empirical Bayes over hosts and paths.

A sparse logistic model of hashed word, word-beginning and shape features gives each document the log odds
of being low in quality and of being toxic; it is fitted on a bounded sample of labelled documents. Grouped
aggregation then sums, for each path and each host, the known labels and, for unlabelled documents, the
model's probabilities. A host's rate is shrunk toward the global rate, a path's toward its host's, by a prior
strength estimated from the spread of the rates; a document's posterior moves its log odds by what the rest
of its path differs from the global rate.
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import columns_of, inverse, kept, map_rows, measured, mix, powers, ready, sampled, small

BITS = 18
HEADS = ("low", "toxic")
#: Bound of the fitting sample: labelled documents of each pair of labels at most.
SAMPLE_PER_CLASS = 1000
#: L1 penalties that a fit chooses from.
PENALTIES = (0.1, 0.4, 1.6)
#: A document goes if either posterior says that it is more likely bad than not.
LIMIT = 0.5
#: Log odds that a site may add or take away at most: a site is evidence, not a verdict.
SITE_LIMIT = 2.0
#: Places of a shape's buckets, and of all features.
BUCKETS, SHAPES = 128, 7
FEATURES = (1 << BITS) + BUCKETS * SHAPES
_EDGES = (0.001, 0.003, 0.006, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)
_LETTER, _UPPER, _SPACE, _ENDS = (re.compile(p) for p in (r"[^\W\d_]", r"[A-ZÀ-ÖØ-Þ]", r"\s", r"[^\w\s]{3,}(?=\s|$)"))
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = 0xD6E8FEB86659FD93


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: words and their first 4, 5 and 6 bytes, hashed; then buckets of the shape."""
    low = [(t or "").lower().encode().translate(_FOLD) for t in texts]
    joined = b" " + b" ".join(low) + b" "
    data = np.frombuffer(joined, np.uint8)
    white = data == 0x20
    first = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    last = np.flatnonzero(~white[:-1] & white[1:]) + 1
    row = np.searchsorted(np.cumsum([1] + [len(t) + 1 for t in low])[1:], first, "right")
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
    back = powers(inverse(_BASE), len(data) + 1)[first]
    found, rows = [], []
    for k, size in enumerate((1 << 30, 4, 5, 6)):
        longer = last - first > (0 if k == 0 else size)
        end = np.minimum(last, first + size)
        found.append((mix((total[end] - total[first]) * back + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int64)[longer])
        rows.append(row[longer])
    shapes = np.array([shape_of(t or "") for t in texts], np.int64).reshape(len(texts), -1)
    for k in range(shapes.shape[1]):
        found.append((1 << BITS) + k * BUCKETS + shapes[:, k])
        rows.append(np.arange(len(texts)))
    pairs = np.unique(np.concatenate(rows).astype(np.int64) * FEATURES + np.concatenate(found))
    return pairs // FEATURES, pairs % FEATURES


def shape_of(text: str) -> list[int]:
    """Buckets of the shares of capitals, symbols, lone symbols, capital words, words that end in symbols, words
    that repeat the one before, and distinct words (with the text's size)."""
    words = text.split()
    n = len(words)
    letters = len(_LETTER.findall(text))
    distinct = min(9, int(10 * len(set(words)) / n)) if n else 10
    return [
        _bucket(len(_UPPER.findall(text)), letters),
        _bucket(len(text) - letters - len(_SPACE.findall(text)), len(text)),
        _bucket(sum(1 for w in words if len(w) == 1 and not w.isalnum()), n),
        _bucket(sum(1 for w in words if len(w) > 1 and w.isupper()), n),
        _bucket(len(_ENDS.findall(text)), n),
        _bucket(sum(1 for a, b in zip(words, words[1:], strict=False) if a == b), n),
        distinct * 11 + min(10, n.bit_length()),
    ]


def _bucket(x: int, of: int) -> int:
    return bisect(_EDGES, x / of) if of else 0


@dataclass
class Model:
    weights: np.ndarray  # feature, head
    bias: np.ndarray

    def logits(self, texts: list[str | None]) -> np.ndarray:
        row, f = features(texts)
        return np.stack([np.bincount(row, self.weights[f, k], len(texts)) for k in range(len(HEADS))], 1) + self.bias


def fit(samples: list[tuple[np.ndarray, np.ndarray]], prior: np.ndarray | None = None, l1: float | None = None, alpha: float = 0.4, l2: float = 0.05, steps: int = 24_000) -> Model:
    """FTRL-proximal logistic regression on (features, labels) rows, both heads at once; NaN labels teach nothing.

    Both heads may read all features, and read those that their labels bear out (see telling). Without an L1 penalty, the one of PENALTIES with the least loss on every
    fifth row, which is set aside for that, is taken for each head. prior is the rate of each head among all
    labelled rows: the sample takes rare labels in full, so the bias moves by the difference in log odds.
    """
    epochs = min(60, max(4, steps // len(samples)))
    rates = np.array([np.nanmean(np.append(y, 0.5)) for y in np.array([y for _, y in samples]).T])
    if l1 is None:
        held, rest = samples[::5], [x for k, x in enumerate(samples) if k % 5]
        loss = np.array([_loss(_ftrl(rest, np.full(len(HEADS), p), alpha, l2, epochs), held) for p in PENALTIES]) if rest else np.zeros((len(PENALTIES), len(HEADS)))
        penalty = np.array(PENALTIES)[loss.argmin(0)]
    else:
        penalty = np.full(len(HEADS), l1)
    model = _ftrl(samples, penalty, alpha, l2, epochs)
    if prior is not None:
        inside = np.clip(rates, 0.01, 0.99), np.clip(prior, 1e-4, 1 - 1e-4)
        model.bias = model.bias + np.log(inside[1] / (1 - inside[1])) - np.log(inside[0] / (1 - inside[0]))
    return model


def _loss(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean log loss by head."""
    x = np.array([model.weights[f].sum(0) + model.bias for f, _ in rows])
    y = np.array([y for _, y in rows])
    return np.nan_to_num(np.nanmean(np.logaddexp(0, x) - y * x, 0)) if np.isfinite(y).any() else np.zeros(len(HEADS))


def telling(samples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether each feature tells something of each head.

    The likelihood-ratio statistic of feature and label must be over twice the logarithm of the number of
    features seen, so that in a sample without any relation less than one feature is expected to pass.
    """
    out = np.zeros((FEATURES, len(HEADS)), bool)
    of = np.concatenate([f for f, _ in samples])
    seen = np.bincount(of, minlength=FEATURES)
    bound = 2 * np.log(max(2, (seen > 0).sum()))
    for h in range(len(HEADS)):
        known = [(f, y[h]) for f, y in samples if not np.isnan(y[h])]
        n, k = len(known), sum(y for _, y in known)
        if not 0 < k < n:
            continue
        has = np.bincount(np.concatenate([f for f, _ in known]), minlength=FEATURES).astype(float)
        bad = np.bincount(np.concatenate([f for f, y in known if y]), minlength=FEATURES).astype(float)

        def part(x: np.ndarray, of: np.ndarray | float, rate: float) -> np.ndarray:
            return x * np.log(np.maximum(x, 1e-9) / np.maximum(of * rate, 1e-9))

        bad_share, good_share = k / n, 1 - k / n
        ratio = part(bad, has, bad_share) + part(has - bad, has, good_share) + part(k - bad, n - has, bad_share) + part(n - has - (k - bad), n - has, good_share)
        out[:, h] = 2 * ratio >= bound
    return out


def _ftrl(samples: list[tuple[np.ndarray, np.ndarray]], l1: np.ndarray, alpha: float, l2: float, epochs: int) -> Model:
    size = FEATURES
    reads = np.concatenate((telling(samples), np.ones((1, len(HEADS)), bool)))
    used = reads.any(1)
    samples = [(f[used[f]], y) for f, y in samples]
    z, n = np.zeros((size + 1, len(HEADS))), np.zeros((size + 1, len(HEADS)))

    def weights(at) -> np.ndarray:
        za = z[at]
        out = -(za - np.sign(za) * l1) / ((1 + np.sqrt(n[at])) / alpha + l2)
        out[np.abs(za) <= l1] = 0
        return out

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            f, y = samples[k]
            at = np.append(f, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(0), -30, 30))) - y
            g = np.where(np.isnan(g), 0.0, g) * reads[at]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), w[-1])


_VECTOR = columns_of(("features", T.BinaryType()), ("low", T.DoubleType()), ("toxic", T.DoubleType()))


def _vectors(rows: dict[str, list]) -> dict[str, object]:
    row, f = features(rows["text"])
    edges = np.searchsorted(row, np.arange(len(rows["text"]) + 1))
    return {"features": [f[a:b].astype(np.int32).tobytes() for a, b in zip(edges, edges[1:], strict=False)], "low": rows["low"], "toxic": rows["toxic"]}


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id, low, toxic (0, 1 or null): of several labels the worst counts; null ids label nothing."""
    found = labels.where("doc_id is not null").groupBy("doc_id")
    return found.agg((1 - F.min("quality")).cast("double").alias("low"), F.max("toxic").cast("double").alias("toxic")).where("low is not null or toxic is not null")


def train(docs: DataFrame, known: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model of labelled documents; None without any.

    The sample is hashed by id and text, so the same on every run, and holds per_class rows of each pair of
    labels at most; all labelled documents give the prior.
    """
    spark = docs.sparkSession
    counts = known.groupBy("low", "toxic").count().collect()
    if not counts:
        return None
    prior = []
    for h in HEADS:
        n = sum(r["count"] for r in counts if r[h] is not None)
        prior.append((sum(r["count"] for r in counts if r[h]) + 0.5) / (n + 1))
    # Ids first, by a draw somewhat larger than the bound; then the bound, over rows.
    share = [((r["low"], r["toxic"]), min(1.0, 1.5 * per_class / r["count"])) for r in counts]
    pick: Column = F.lit(False)
    for (low, toxic), fraction in share:
        pick = pick | (F.col("low").eqNullSafe(low) & F.col("toxic").eqNullSafe(toxic) & sampled("doc_id", fraction, 17))
    chosen = kept(known.where(pick))
    rows = docs.where("text is not null").select("doc_id", "text").join(measured(chosen), "doc_id")
    order = Window.partitionBy("low", "toxic").orderBy(F.xxhash64(F.lit(17), "doc_id", "text"))
    rows = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= per_class).select("text", "low", "toxic")
    found = map_rows(rows, _vectors, _VECTOR).collect()
    found.sort(key=lambda r: (bytes(r["features"]), str(r["low"]), str(r["toxic"])))
    nan = float("nan")
    samples = [(np.frombuffer(r["features"], np.int32), np.array([nan if r[h] is None else r[h] for h in HEADS])) for r in found]
    mixed = np.random.default_rng(5).permutation(len(samples))
    return fit([samples[k] for k in mixed], np.array(prior)) if samples else None


_EVIDENCE = columns_of(
    ("doc_id", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("host", T.StringType()), ("path", T.StringType()), ("e_low", T.DoubleType()), ("e_toxic", T.DoubleType())
)


def evidence(docs: DataFrame, model: Model | None) -> DataFrame:
    """Log odds of each document (doc_id, text, h1, h2, host, path), by its whole text; 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: dict[str, list]) -> dict[str, object]:
        model = shared.value
        found = model.logits(rows["text"]) if model else np.zeros((len(rows["text"]), len(HEADS)))
        return {c: rows[c] for c in ("doc_id", "h1", "h2", "host", "path")} | {"e_low": found[:, 0], "e_toxic": found[:, 1]}

    return map_rows(docs, step, _EVIDENCE)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, rate: str, n: str, to: str) -> float:
    """Prior strength by moments: the larger, the less the groups' rates differ beyond chance."""
    r = rates.agg(
        F.sum(n).alias("n"),
        F.sum(F.expr(f"{n} * pow({rate} - {to}, 2)")).alias("spread"),
        F.sum(F.expr(f"{to} * (1 - {to})")).alias("chance"),
        F.sum(F.expr(f"{n} * {to} * (1 - {to})")).alias("whole"),
    ).first()
    if not r["n"] or not r["whole"]:
        return 10.0
    between = max(0.0, (r["spread"] - r["chance"]) / r["n"])
    return float(min(1e4, max(1.0, (r["whole"] / r["n"]) / between - 1))) if between else 1e4


def site_rates(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums and prior strengths of every (host, path), and the global rates, from soft labels p_low and p_toxic.

    Per path: n, hn (documents of the path and of its host) and for each head h s_h, h_h (their sums), mh_h and
    mp_h (strengths of the global rate in a host's, and of a host's in a path's).
    """
    paths = kept(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS)))
    whole = paths.agg(F.sum("n").alias("n"), *(F.sum(f"s_{h}").alias(h) for h in HEADS)).first()
    rate = {h: (whole[h] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5 for h in HEADS}
    hosts = kept(paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{h}").alias(f"h_{h}") for h in HEADS)))
    found = kept(paths.join(hosts, "host"))
    for h in HEADS:
        of_host = _strength(hosts.select(F.expr(f"h_{h} / hn").alias("r"), F.col("hn").alias("n"), F.lit(rate[h]).alias("g")), "r", "n", "g")
        shrunk = (F.col(f"h_{h}") + of_host * rate[h]) / (F.col("hn") + of_host)
        of_path = _strength(found.select(F.expr(f"s_{h} / n").alias("r"), "n", shrunk.alias("g")), "r", "n", "g")
        found = found.withColumns({f"mh_{h}": F.lit(of_host), f"mp_{h}": F.lit(of_path)})
    return kept(found), rate


def site_rate(head: str, rate: float, own: Column | float = 0.0, one: int = 0) -> Column:
    """The rate of a path shrunk toward its host's, and that toward the global one; own is left out of both sums."""
    host = (F.col(f"h_{head}") - own + F.col(f"mh_{head}") * rate) / (F.col("hn") - one + F.col(f"mh_{head}"))
    return (F.col(f"s_{head}") - own + F.col(f"mp_{head}") * host) / (F.col("n") - one + F.col(f"mp_{head}"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Per row of docs: doc_id, h1 and h2 (hashes of the text), p_low, p_toxic, site_low, site_toxic, keep.

    host and path name a site and a part of it; a null is a site of its own. site_h is what the other
    documents say of a document's path: their labels, or the model's probabilities where they have none,
    shrunk toward the host's and the global rate; the document itself is left out, so it can't confirm
    itself, and a site of one row says what the global rate says. A document goes (keep is false) if either
    posterior is over LIMIT. A null or empty text has the evidence of its empty shape. Without labels there
    is no model and no rate, and everything is kept. Repeated rows give rows of their own. Texts are read whole.
    """
    ready(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *(F.xxhash64(F.lit(k), "text").alias(f"h{k}") for k in (1, 2)),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
    )
    known = kept(one_label(labels))
    scored = evidence(own, train(own, known, per_class))
    if known.isEmpty():
        nothing = [F.lit(None).cast("double").alias(c) for c in ("p_low", "p_toxic", "site_low", "site_toxic")]
        return scored.select("doc_id", "h1", "h2", *nothing, F.lit(True).alias("keep"))
    soft = {f"p_{h}": F.coalesce(F.col(h), 1 / (1 + F.exp(-F.col(f"e_{h}")))) for h in HEADS}
    scored = kept(scored.join(measured(known), "doc_id", "left").withColumns(soft).drop(*HEADS))
    sites, rate = site_rates(scored)
    out = scored.join(F.broadcast(sites) if small(sites, "length(host) + length(path)") else sites, ["host", "path"])
    for h in HEADS:
        out = out.withColumn(f"site_{h}", site_rate(h, rate[h], F.col(f"p_{h}"), 1))
        move = F.least(F.greatest(_logit(F.col(f"site_{h}")) - _logit(F.lit(rate[h])), F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"e_{h}") + move))))
    return out.select("doc_id", "h1", "h2", "p_low", "p_toxic", "site_low", "site_toxic", ((F.col("p_low") <= LIMIT) & (F.col("p_toxic") <= LIMIT)).alias("keep"))
