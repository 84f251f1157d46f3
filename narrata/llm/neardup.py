"""Near-duplicate documents: MinHash banding, sequential Bayesian pruning, exact verification.

1. Each text becomes its set of word shingles (64-bit hashes) and a MinHash signature. Texts of one set are
   one class, named by its smallest doc_id, and go on as one.
2. Bands of the signature make buckets. Every member of a bucket is paired with the bucket's smallest
   member; the pairs whose signatures agree somewhat make families. A bucket with members that agree too
   little goes on with those, and with the members in a grey zone. Signatures differ in a number of places
   that obeys the triangle inequality, and the grey zone is wide enough for it: two members that the pruning
   of step 3 would let pass end up in one family, or go on together. What goes on after PEELS rounds makes
   families as it is, bucket by bucket.
3. Members of a family are compared in blocks. Signatures are compared batch by batch: after each batch a pair
   goes on only if the posterior probability of a similarity at or above the threshold, given the hashes agreed
   so far, is at least the chosen miss probability. Survivors, most similar first, are verified on their full
   sets, unless the links found in the block connect them already. First each block is compared in itself and
   with REPRESENTATIVES members that are sent to all blocks of the family; that links most of a family of near
   copies, and each set is sent once. Then the members that aren't linked to the family's largest part, and
   they alone, are compared with the other blocks.
4. Links give components.

No pair is formed for identical sets, no bucket or family is collected into one task, and nothing is capped.
The probability of losing a link is that of no common band plus MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import LOWER, arrow_schema, columns_of, cuts, hash_words, kept, map_rows, measured_ids, mix, ready, small_ids
from narrata.llm.components import components

HASHES, BAND = 128, 4
#: Probability with which the pruning may lose a pair at the threshold.
MISS = 1e-6
#: Hashes compared in one batch.
BATCH = 32
#: Share of agreeing hashes with its bucket's smallest member below which a member goes on with the bucket.
STAY = 0.62
#: Rounds in which buckets are parted by agreement.
PEELS = 2
#: Members in a block, and members that all blocks of a family are compared with first.
BLOCK, REPRESENTATIVES = 384, 8

_SEED = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes of its runs of words.

    Texts are lower-cased in A-Z. A text with fewer words is one shingle, one without words has none.
    """
    x, counts = hash_words([(t or "").encode().translate(LOWER) for t in texts])
    first = np.concatenate(([0], np.cumsum(counts)))
    run = x[: max(0, len(x) - words + 1)].copy()
    for k in range(1, words):
        run = run * np.uint64(0xC2B2AE3D27D4EB4F) + x[k : k + len(run)]
    run = mix(run + np.uint64(words))
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= words:
            out.append(np.unique(run[first[i] : first[i] + n - words + 1]))
        elif n:
            whole = x[first[i] : first[i] + 1]
            for k in range(first[i] + 1, first[i] + n):
                whole = whole * np.uint64(0xC2B2AE3D27D4EB4F) + x[k : k + 1]
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima, in 32 bits each."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(found), 2048):
        part = found[i : i + 2048]
        least = np.minimum(least, ((part[:, None] * _SEED) >> np.uint64(32)).min(0))
    return least.astype(np.uint32)


def names(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(found).sum(dtype=np.uint64), mix(found * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int((b + np.uint64(len(found))).view(np.int64))


@lru_cache(maxsize=16)
def least_agreeing(threshold: float, miss: float, size: int = HASHES, batch: int = BATCH) -> list[int]:
    """For each batch, the fewest agreeing hashes with which a pair goes on.

    With a uniform prior on the similarity s, the posterior after m of n agreements is Beta(m + 1, n - m + 1);
    a pair goes on while P(s >= threshold | m, n) >= miss. That tail is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        logs = [math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(threshold) + (n + 1 - k) * math.log1p(-threshold) for k in range(m + 1)]
        return sum(map(math.exp, logs))

    if threshold >= 1:
        return list(range(batch, size + 1, batch))
    return [next(m for m in range(n + 1) if tail(m, n) >= miss or m == n) for n in range(batch, size + 1, batch)]


class Sets:
    """Distinct union-find over the members of a block comparison."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def compare(sigs: np.ndarray, sets: list[np.ndarray], split: int, percent: int, miss: float, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between members [0, split) and [split, n), or among all if split is 0, that connect what is linked.

    Links between members that other links here connect already, or that are of one part, are left out.
    """
    n, found, joined = len(sets), [], Sets(len(sets))
    first: dict[int, int] = {}
    for i, part in enumerate(parts or ()):
        joined.join(i, first.setdefault(part, i))
    bounds = least_agreeing(percent / 100, miss)
    rows = range(split) if split else range(n)
    pairs: list[tuple[int, int, int]] = []
    for i in rows:
        others = np.arange(split, n) if split else np.arange(i + 1, n)
        agree = np.zeros(len(others), np.int64)
        for k, bound in enumerate(bounds):
            if not len(others):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            agree = agree + (sigs[others, part] == sigs[i, part]).sum(1)
            go = agree >= bound
            others, agree = others[go], agree[go]
        pairs += [(-m, i, j) for m, j in zip(agree.tolist(), others.tolist(), strict=True)]
    pairs.sort()
    for _, i, j in pairs:
        if joined.find(i) != joined.find(j) and linked(sets[i], sets[j], percent):
            joined.join(i, j)
            found.append((i, j))
    return found


_SIGNED = columns_of(("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()), ("sig", T.BinaryType()))


def _sign(words: int):
    def step(rows: dict[str, list]) -> dict[str, object]:
        found = shingles(rows["text"], words)
        named = [names(x) for x in found]
        return {
            "doc_id": rows["doc_id"],
            "n_shingles": [len(x) for x in found],
            "s1": [a for a, _ in named],
            "s2": [b for _, b in named],
            "sig": [signature(x).tobytes() if len(x) else None for x in found],
        }

    return step


_BANDS = columns_of(("band", T.LongType()), ("node", T.LongType()))


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_BANDS)
    for batch in batches:
        node = np.array(batch.column(0).to_pylist(), np.int64)
        if not len(node):
            continue
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), -1, BAND).astype(np.uint64)
        key = np.zeros(sigs.shape[:2], np.uint64)
        for k in range(BAND):
            key = mix(key + sigs[:, :, k] + np.uint64(k + 1))
        key = mix(key + np.arange(sigs.shape[1], dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, sigs.shape[1]))], schema=schema)


_AGREE = columns_of(("a", T.LongType()), ("b", T.LongType()), ("share", T.DoubleType()))


def _agreement(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_AGREE)
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((left == right).mean(1))], schema=schema)


def _families(nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """(node, component) of the nodes that share buckets and agree somewhat."""
    join = max(0.0, STAY - 1 + least_agreeing(percent / 100, miss)[-1] / HASHES)
    members = nodes.mapInArrow(_bands, _BANDS)
    edges = None
    for peel in range(PEELS + 1):
        pivots = members.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "pivot")
        paired = kept(members.join(measured_ids(kept(pivots)), "band").where("node <> pivot"))
        pairs = paired.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        if peel == PEELS:
            return components(edges.unionByName(pairs))
        both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        share = kept(both.select("a", "b", "sa", "sb").mapInArrow(_agreement, _AGREE))
        close = share.where(F.col("share") >= join).select("a", "b")
        edges = close if edges is None else edges.unionByName(close)
        rest = paired.join(measured_ids(share.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "share")), ["node", "pivot"])
        open_ = rest.groupBy("band").agg(F.min("share").alias("least")).where(F.col("least") < join).select("band")
        members = kept(rest.where(F.col("share") < STAY).join(measured_ids(kept(open_)), "band", "left_semi").select("band", "node"))
        if members.isEmpty():
            break
    return components(edges)


#: Where a member's set goes: a comparison (family, block, chunk), its side there, and the part it is linked to.
_PLACE = ("family", "block", "chunk", "side", "part")
_MEMBER = columns_of(
    ("family", T.LongType()), ("block", T.IntegerType()), ("chunk", T.IntegerType()), ("side", T.IntegerType()), ("part", T.LongType()), ("node", T.LongType()), ("found", T.BinaryType())
)
_LINK = columns_of(("a", T.LongType()), ("b", T.LongType()))


def _spread(words: int):
    """For each member, its full set once for every place it goes to."""
    schema = arrow_schema(_MEMBER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for lo, hi in cuts(columns["text"], batch.num_rows):
                out: list[tuple] = []
                for row, found in enumerate(shingles(columns["text"][lo:hi], words), lo):
                    raw = found.tobytes()
                    for place in columns["places"][row]:
                        out.append((*(place[k] for k in _PLACE), columns["node"][row], raw))
                        if len(out) >= 2000:
                            yield _batch(out, schema)
                            out = []
                if out:
                    yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _verify(percent: int, miss: float):
    schema = arrow_schema(_LINK)

    def run(members: pa.Table) -> pa.Table:
        node, side, part = (members.column(c).to_pylist() for c in ("node", "side", "part"))
        order = sorted(range(len(node)), key=lambda k: (side[k], node[k]))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.column("found")]
        sets, node, part = [sets[k] for k in order], [node[k] for k in order], [part[k] for k in order]
        two = members.column("chunk")[0].as_py() >= 0
        split = side.count(0) if two else 0
        links = [] if two and split in (0, len(node)) else compare(np.array([signature(s) for s in sets]), sets, split, percent, miss, part)
        return pa.Table.from_arrays([pa.array([node[a] for a, _ in links], pa.int64()), pa.array([node[b] for _, b in links], pa.int64())], schema=schema)

    return run


def _links(texts: DataFrame, places: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """The links found by the comparisons that places (node, and where its set goes) describe."""
    sent = kept(places.groupBy("node").agg(F.collect_list(F.struct(*_PLACE)).alias("places")))
    size = "8 + 56 * size(places)"
    if small_ids(sent.select("node")) and not small_ids(sent, size):
        # Few members that go to many places: only their texts are shuffled.
        texts = texts.join(F.broadcast(sent.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    spread = texts.join(measured_ids(sent, size), F.col("doc_id") == F.col("node")).mapInArrow(_spread(words), _MEMBER)
    return kept(spread.groupBy("family", "block", "chunk").applyInArrow(_verify(percent, miss), _LINK))


def _family_links(texts: DataFrame, grouped: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) that connect what is linked in each family of grouped (node, family)."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sizes = kept(grouped.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    placed = kept(grouped.join(measured_ids(sizes), "family").withColumn("block", block))

    def place(rows: DataFrame, chunk: F.Column, side: int, part: F.Column) -> DataFrame:
        return rows.select("node", "family", "block", chunk.cast("int").alias("chunk"), F.lit(side).alias("side"), part.cast("long").alias("part"))

    # Each block in itself, and with the representatives of the family.
    slots = placed.where("blocks > 1").groupBy("family", "blocks", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(REPRESENTATIVES))).agg(F.min("node").alias("node"))
    others = slots.withColumn("home", block).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    alone = [place(rows, F.lit(-1), 0, F.col("node")) for rows in (placed, others)]
    first = _links(texts, alone[0].unionByName(alone[1]), words, percent, miss)
    wide = placed.where("blocks > 1")
    if wide.isEmpty():
        return first
    # Members outside the family's largest part, with all blocks but their own.
    parts = kept(wide.join(measured_ids(kept(components(first))), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
    counts = parts.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = kept(counts.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("left")).where("left > 0"))
    marked = kept(parts.join(measured_ids(largest), "family").withColumn("chunks", F.ceil(F.col("left") / BLOCK).cast("int")))
    open_ = marked.where("part <> main").withColumns({"home": F.col("block"), "chunk": F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks"))})
    asking = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    asked = marked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    second = _links(texts, place(asking, F.col("chunk"), 0, F.col("part")).unionByName(place(asked, F.col("chunk"), 1, F.col("part"))), words, percent, miss)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Per row of docs (columns doc_id and text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles (see
    shingles); component_id is the smallest doc_id reachable by links, itself included, and kept says that it
    is the row's own. A text without words, or null, has no shingle and is linked with nothing. Rows that
    share a doc_id are one document; if their texts differ, it is linked by either. A row with a null doc_id
    is linked with nothing, has a null component_id and is kept. Every row gives one row.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = kept(map_rows(texts, _sign(words), _SIGNED))
    named = signed.where("doc_id is not null and n_shingles > 0")
    nodes = kept(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")))
    families = _families(nodes.select("node", "sig"), percent, miss)
    heads = families.select(F.col("component").alias("node"), "component").distinct()
    grouped = kept(families.unionByName(heads).withColumnRenamed("component", "family"))
    links = _family_links(texts, grouped, words, percent, miss)
    classes = kept(signed.select("doc_id", "n_shingles", "s1", "s2").join(measured_ids(nodes.select("s1", "s2", "node")), ["s1", "s2"], "left"))
    # Rows of one doc_id with different texts: their classes belong together.
    torn = classes.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    torn = classes.join(torn, "doc_id").select("a", F.col("node").alias("b"))
    found = kept(components(links.unionByName(torn)))
    out = classes.select("doc_id", "n_shingles", "node").join(measured_ids(found), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
