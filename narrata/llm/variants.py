"""Spelling variants by anagram hashing.

The key of a word is the sum of a power of each letter's number, so anagrams share it, and one letter added,
removed or exchanged changes it by that letter's value or by the difference of two. All these differences
meet in one place: a word's key less the value of one of its letters. Such a reduced key is the full key of a
word without that letter, and the reduced key of a word with another letter in its place. So two joins find
the candidates, reduced with full keys and reduced with reduced ones; their letters' order is verified after.

A reduced key with very many words (long words of few letters) would give all pairs of them. There the
order joins in: what stands before and after the letter left out is a part of the join key, so only words
that agree in it meet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import LOWER, arrow_schema, columns_of, kept, map_rows, ready

#: The runs of letters that words are; the letters' numbers, from 1, in code-point order.
LETTERS = "A-Za-zÀ-ÿ"
NUMBER = {c: i for i, c in enumerate((chr(x) for x in range(0x100) if re.match(f"[{LETTERS}]", chr(x))), 1)}
#: The power of the letters' numbers: no two pairs of letters have the same difference.
POWER = 5
VALUE = {c: n**POWER for c, n in NUMBER.items()}
#: Runs are damaged where the checksum is a multiple of this; distinct words that a task counts before it passes them on.
DAMAGE, COUNTED = 31, 200_000
#: Words of one reduced key up to which all of them are candidates of each other.
PAIRED = 64


def words_of(text: str, doc_id: object, shortest: int, damage: int) -> Iterator[tuple[str, int]]:
    """The words of a text, each with its number there."""
    lead = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = text.encode().translate(LOWER).decode()
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{shortest},}}", lowered)).items():
        h = crc32(run.encode(), lead) if damage else 1
        if damage and h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the distinct words of all texts that have at least so many letters and occurrences.

    Runs of letters, A-Z lowered; with damage, a run whose crc32 with its document's id is a multiple of it
    loses one letter. Null texts have no words, a null doc_id reads as nothing, repeated rows count each.
    Every task adds up its words before they are shuffled.
    """
    if shortest < 1:
        raise ValueError("words have a letter at least")
    ready(docs.sparkSession)
    schema = columns_of(("word", T.StringType()), ("n", T.LongType()))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: Counter = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=arrow)
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
                for word, n in words_of(text or "", doc_id, shortest, damage):
                    seen[word] += n
                if len(seen) > COUNTED:
                    yield batch_of()
                    seen.clear()
        if seen:
            yield batch_of()

    counted = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def anagram_key(word: str) -> int:
    return sum(map(VALUE.__getitem__, word))


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, letter, meet, rest_size): where each word meets others.

    One row with its whole key and no letter, and one for each distinct letter, with the key less that letter's value.
    """

    def step(rows: dict[str, list]) -> dict[str, object]:
        made = []
        for word, n in zip(rows["word"], rows["n"], strict=True):
            key = anagram_key(word)
            made.append((word, n, "", key, len(word)))
            made += [(word, n, c, key - VALUE[c], len(word) - 1) for c in sorted(set(word))]
        return dict(zip(("word", "n", "letter", "meet", "rest_size"), zip(*made, strict=True), strict=True))

    whole, text = T.LongType(), T.StringType()
    schema = columns_of(("word", text), ("n", whole), ("letter", text), ("meet", whole), ("rest_size", whole))
    return map_rows(words.select("word", "n"), step, schema, weigh="word")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n): the pairs, in both directions, that differ by one letter added, removed or exchanged; n is near's.

    The words are distinct rows (word, n) of letters alone.
    """
    at = kept(keyed(words))
    large = at.groupBy("meet", "rest_size").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PAIRED).select("meet", "rest_size", F.lit(True).alias("large"))
    at = kept(at.join(large, ["meet", "rest_size"], "left"))
    # In large groups the rest of the word joins in, once for every place of the letter.
    places = F.expr("filter(sequence(1, length(word)), i -> substring(word, i, 1) = letter)")
    rest = F.expr("case when letter = '' then array(word) else transform(places, i -> substring(word, 1, i - 1) || substring(word, i + 1)) end")
    spread = at.where("large").withColumn("places", places).withColumn("rest", F.explode(rest)).drop("places")
    few = at.where("large is null").withColumn("rest", F.lit(""))
    near = None
    for side in (few, spread):
        a = side.select("meet", "rest_size", "rest", "word", "n", "letter")
        b = side.select("meet", "rest_size", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("near_letter"))
        # Each pair once: a letter more on the left, or letters exchanged in their order.
        ordered = F.expr("letter > near_letter")
        pairs = a.join(b, ["meet", "rest_size", "rest"]).where(ordered).where(F.expr("levenshtein(word, near, 1) = 1")).select("word", "n", "near", "near_n")
        near = pairs if near is None else near.unionByName(pairs.distinct())
    return near.select("word", "near", F.col("near_n").alias("n")).unionByName(near.select(F.col("near").alias("word"), F.col("word").alias("near"), "n"))


def variant_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    form is the near word of largest n, the smallest in code-point order among equals, if its n is at least
    factor times the word's, else null; root is where the forms lead, the word itself if it has none. Forms
    grow by the factor, so no chain is longer than the digits of the largest n: it is followed by doubling.
    Without words there are no rows.
    """
    if factor < 2:
        raise ValueError("a form is at least twice as frequent")
    words = kept(words)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best")
    )
    found = kept(found.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    # Only words with a form are followed; those that no longer move are done.
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = kept(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(on, "root", "left")
        if moved.where("further is not null").isEmpty():
            break
        roots = moved.select("word", F.coalesce("further", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
