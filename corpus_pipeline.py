"""The corpus pipeline: filter by quality, drop near duplicates, remove repeated passages, drop contaminated
documents, encode.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import bpe_codec, decontam, neardup, quality, substring
from narrata.llm.common import forget, kept, measured, ready, scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    gone = measured(kept(found.where("not keep").select("doc_id", "h1", "h2").distinct()))
    same = [F.xxhash64(F.lit(k), docs["text"]) == gone[f"h{k}"] for k in (1, 2)]
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & same[0] & same[1], "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Repeated rows are one.

    Different texts of one doc_id are different documents: one of them goes by the doc_id, the others by ids
    of their own beyond all others, so that each is judged by its own text.
    """
    docs = _one_of_each(docs)
    plain, names = _numbered(docs)
    several = plain.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.xxhash64("text")).alias("_first"))
    several = measured(kept(several.where("_n > 1").drop("_n")))
    told = plain.join(several, F.col("doc_id") == F.col("_id"), "left")
    other = F.col("_id").isNotNull() & (F.xxhash64("text") != F.col("_first"))
    own = F.when(other, F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 61))).otherwise(F.col("doc_id").cast("long"))
    told = told.withColumn("_own", own).drop("_id", "_first")
    found = neardup.near_duplicates(told.select(F.col("_own").alias("doc_id"), "text"))
    gone = measured(kept(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()))
    left = told.join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    return left.select(*(F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text. A row without a doc_id goes if another row has its text.

    Only rows that repeat, or have no doc_id, are dealt by their texts; the others stay where they are.
    """
    plain, names = _numbered(docs)
    rows = plain.withColumn("_key", F.coalesce(F.sha2("text", 256), F.lit("")))
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    repeated = measured(kept(named.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")), "length(_key)")
    keys = measured(kept(unnamed.select("_key").distinct()), "length(_key)")
    held = measured(kept(named.select("_key").join(keys, "_key", "left_semi").distinct()), "length(_key)")
    once = named.join(repeated, ["doc_id", "_key"], "left_anti")
    first = named.join(repeated, ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    other = unnamed.join(held, "_key", "left_anti").dropDuplicates(["_key"])
    found = once.unionByName(first).unionByName(other)
    return found.select(*(F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a text that loses nothing stays as it is."""
    plain, names = _numbered(docs)
    found = substring.remove_repeats(plain, carry=tuple(c for c in plain.columns if c != "text"), texts=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text"))
    out = {c: F.col("kept_text") if c == "text" else F.col(c) for c in plain.columns}
    if "n_chars" in names:
        at = plain.columns[names.index("n_chars")]
        out[at] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col(at))
    return found.select(*(out[c].alias(n) for c, n in zip(plain.columns, names, strict=True)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    plain, names = _numbered(docs)
    found = decontam.find_contamination(plain, table(spark, sf_dir, "benchmark"), carry=tuple(plain.columns))
    return found.where("not contaminated").select(*(F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)))


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with numbers for names but for doc_id and text, so that nothing an operator adds can clash; and the names."""
    names = docs.columns
    return docs.select(*(F.col(n) if n in ("doc_id", "text") else F.col(n).alias(f"_{i}") for i, n in enumerate(names))), names


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of a round trip."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.encode_documents(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared checkpoint folder and read again.

    A stage's rows are removed when the next one's are written, the last one's when the application ends.
    """
    ready(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            forget(spark, before)
        before = at
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
