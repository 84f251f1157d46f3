"""Chunk records, incremental indexing and cosine retrieval."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import text
from narrata.operators.relational import few

#: Vectors in a block.
BLOCK = 512


def chunk_records(sources: DataFrame, size: int = 2000, overlap: int = 200, most: int | None = 100, version: str = "1.0") -> DataFrame:
    """Chunk rows of sources (source_id, content) with their ids, hashes and sizes."""
    rows = text.chunks(sources.select("source_id", F.col("content").alias("_text")), "_text", size, overlap, most)
    return rows.select(
        text.chunk_id(F.col("source_id").cast("string"), F.col("chunk_index"), F.col("start_offset"), F.col("end_offset"), version).alias("chunk_id"),
        "source_id",
        "chunk_index",
        "start_offset",
        "end_offset",
        "content",
        F.sha2("content", 256).alias("content_sha256"),
        F.octet_length("content").cast("long").alias("byte_count"),
    )


def to_index(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """The sources whose content the registry (source_id, content_sha256) doesn't hold."""
    seen = registry.select("source_id", F.col("content_sha256").alias("_seen"))
    now = sources.withColumn("content_sha256", F.sha2("content", 256))
    return now.join(seen, "source_id", "left").where(~F.col("content_sha256").eqNullSafe(F.col("_seen"))).drop("_seen")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if either is zero, null if they differ in length or are empty."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and a vector, packed BLOCK to a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], batch.schema.names)


def _by_size(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the places, matrix and norms of the vectors without nulls."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == n)
        flat = vectors.take(pa.array(at)).flatten()
        whole = ~np.asarray(flat.is_null()).reshape(-1, n).any(1)
        rows = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, n)[whole]
        out[n] = at[whole], rows, np.sqrt((rows * rows).sum(1))
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, chunk_id, score, rank): for each query (query_id, vector) the k best candidates (chunk_id, vector).

    Blocks of queries meet blocks of candidates (broadcast if they are few); each pair of blocks keeps its best k
    of a query before the shuffle. Scores below the threshold and vectors of another size drop out; scores equal in
    nine places go by chunk_id.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        id_type, vector = df.schema[name].dataType, df.schema["vector"].dataType
        return df.select(name, "vector").mapInArrow(_blocks, T.StructType([T.StructField(name, T.ArrayType(id_type)), T.StructField("vector", T.ArrayType(vector))]))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, c_ids, c = (batch.column(j)[i].values for j in range(4))
                order = pc.sort_indices(c_ids, sort_keys=[("", "ascending")], null_placement="at_start")
                c_ids, c = c_ids.take(order), _by_size(c.take(order))
                for n, (q_at, q_rows, q_norm) in _by_size(q).items():
                    if n not in c:
                        continue
                    at, rows, norm = c[n]
                    norms = np.outer(q_norm, norm)
                    score = np.where(norms == 0, 0.0, q_rows @ rows.T / np.where(norms == 0, 1.0, norms))
                    rounded = np.where(np.isnan(score), np.inf, np.round(score, 9))
                    top = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
                    found = np.take_along_axis(score, top, 1)
                    x, y = np.nonzero(~(found < threshold))
                    places = np.take_along_axis(rounded, top, 1)[x, y]
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q_at[x])), c_ids.take(pa.array(at[top[x, y]])), pa.array(found[x, y]), pa.array(places)], ["query_id", "chunk_id", "score", "_places"])

    asked = few(packed(queries, "query_id").withColumnRenamed("vector", "_q"), "aggregate(_q, 0L, (n, x) -> n + 8L * coalesce(size(x), 0))")
    blocks = packed(candidates, "chunk_id").repartition(4 * candidates.sparkSession.sparkContext.defaultParallelism)
    pairs = blocks.crossJoin(asked).select("query_id", "_q", "chunk_id", "vector")
    kinds = [("query_id", queries.schema["query_id"].dataType), ("chunk_id", candidates.schema["chunk_id"].dataType), ("score", T.DoubleType()), ("_places", T.DoubleType())]
    scored = pairs.mapInArrow(best, T.StructType([T.StructField(*x) for x in kinds]))
    w = Window.partitionBy("query_id").orderBy(F.desc("_places"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_places")


def hits_to_evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items of evidence for hits whose chunk is there."""
    found = hits.join(chunks.select("chunk_id", "content", "content_sha256", "byte_count"), "chunk_id")
    return found.withColumn("evidence_id", text.evidence_id(F.lit("doc_chunk"), F.col("chunk_id").cast("string"), F.col("rank") - 1))


def candidates(embeddings: DataFrame, chunks: DataFrame, model: str | None = None, source_types: list[str] | None = None) -> DataFrame:
    """Embeddings with their chunk, of one model and of some source types where these are given."""
    rows = embeddings if model is None else embeddings.where(F.col("model") == model)
    of = chunks if source_types is None else chunks.where(F.col("source_type").isin(*source_types))
    return rows.join(of, "chunk_id")


def new_embeddings(embeddings: DataFrame, known: DataFrame) -> DataFrame:
    """Embeddings whose (chunk, model, vector hash) is not known, one of each."""
    key = ["chunk_id", "model", "vector_sha256"]
    return embeddings.dropDuplicates(key).join(known.select(*key).distinct(), key, "left_anti")


def index_manifest(sources: DataFrame, indexed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row about an indexing run: sources seen, indexed and skipped, chunks and bytes made."""
    one = lambda df, *c: df.agg(*c)
    n = lambda name: F.count(F.lit(1)).alias(name)
    row = one(sources, n("sources")).crossJoin(one(indexed, n("indexed"))).crossJoin(one(chunks, n("chunks"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("bytes")))
    return row.withColumn("skipped", F.col("sources") - F.col("indexed"))
