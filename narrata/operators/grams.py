"""Which names occur in which texts, by an index of character grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.relational import few
from narrata.sources.shared import kept

#: Characters of a gram; names that are shorter are grams themselves.
GRAM = 5
#: Texts with one gram that one part of it holds; a gram in more texts is dealt out over several parts.
DEALT = 20_000
#: Places of the table that says which grams names may have, whatever their number; characters taken at once.
PLACES, STEP = 1 << 22, 1 << 20


def hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all overlapping grams of so many characters, with the number of the text of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = len(codes) - size + 1
    if n <= 0:
        return of[:0], codes[:0]
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = of[:n] == of[size - 1 :]
    return of[:n][inside], (h ^ (h >> np.uint64(32)))[inside]


def steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP characters together."""
    start = weight = 0
    for i, t in enumerate(texts):
        weight += len(t)
        if weight >= STEP or i == len(texts) - 1:
            yield start, i + 1
            start, weight = i + 1, 0


def postings(rows: DataFrame, size: int, shorter: bool, sizes: list[int] | None = None, known: np.ndarray | None = None) -> DataFrame:
    """(key, gram), distinct within a row, for rows (key, text): grams of the sizes; with shorter, a text below size is its own.

    known is a table of the places that grams sought fall to; others are left out.
    """
    kind = rows.schema["key"]
    table = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in steps(texts):
                found = []
                for n in sizes or sorted({min(len(t), size) for t in texts[a:b]}):
                    if n:
                        of, grams = hashes([t if not shorter or min(len(t), size) == n else "" for t in texts[a:b]], n)
                        if table is not None:
                            some = table.value[(grams & np.uint64(PLACES - 1)).astype(np.int64)]
                            of, grams = of[some], grams[some]
                        found.append((of, grams))
                if not found:
                    continue
                of, grams = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((grams, of))
                of, grams = of[order], grams[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of[new] + a)), pa.array(grams[new].view(np.int64))], names=["key", "gram"])

    return rows.select("key", "text").mapInArrow(run, f"key {kind.dataType.simpleString()}, gram long")


def containing(texts: DataFrame, names: DataFrame, size: int = GRAM) -> DataFrame:
    """(text_id, name), distinct: the texts (text_id, text) and the names (name) that occur in them, inside words too.

    A name can only be where each of its grams is, so it is looked for where its rarest one is: texts give
    their distinct grams, as hashes, those of names are counted, each name is filed under the gram that the
    fewest texts have, and texts meet names by equal grams. What meets is compared in full. Null and empty
    names are in no text, null texts have no names; repeated rows count once. Names never leave Spark's
    tables: tasks get a table of fixed size that says which grams may be sought. A gram of very many texts is
    dealt out over parts.
    """
    named = kept(names.select("name").where("name <> ''").distinct(), "names")
    sizes = sorted(r["n"] for r in named.select(F.least(F.length("name"), F.lit(size)).alias("n")).distinct().collect())  # at most size numbers
    if not sizes:
        return texts.select("text_id", F.lit("").alias("name")).limit(0)
    own = kept(postings(named.select(F.col("name").alias("key"), F.col("name").alias("text")), size, True).withColumnRenamed("key", "name"), "grams")
    known = np.zeros(PLACES, bool)
    for r in own.select(F.pmod("gram", F.lit(PLACES)).alias("place")).distinct().collect():  # at most PLACES numbers
        known[r["place"]] = True
    whole = texts.where("text IS NOT NULL").select(F.col("text_id").alias("key"), "text")
    spread = postings(whole, size, False, sizes, known).withColumnRenamed("key", "text_id")
    # Rows (text_id, gram) for grams of names alone; grams that no text has make their names impossible.
    at = kept(spread.join(few(own.select("gram").distinct()), "gram", "left_semi"), "postings")
    counts = at.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    seen = own.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("best"))
    filed = kept(seen.where("best.n > 0").select("name", "best.gram", F.ceil(F.col("best.n") / DEALT).cast("int").alias("parts")), "filed")
    parts = few(filed.groupBy("gram").agg(F.max("parts").alias("parts")))
    dealt = at.join(parts, "gram").select("text_id", "gram", F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int").alias("part"))
    every = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("name", "gram", "part")
    met = dealt.join(few(every, "octet_length(name)"), ["gram", "part"]).select("text_id", "name")
    return met.distinct().join(texts.select("text_id", "text").distinct(), "text_id").where(F.contains("text", "name")).select("text_id", "name").distinct()
