"""Chroma audio fingerprints of media columns, and the alignment of recordings.

A recording (WAV bytes) becomes frames of energy by pitch class. An integral image over frames and classes
gives the sum of any rectangle in four look-ups, so sixteen filters (differences of rectangles, in the ways a
rectangle can be halved or cut in three) cost the same at any size. Each filter gives two bits in Gray code;
a frame's bits are one packed 32-bit integer.

To align recordings, every query gets an offset histogram with every recording: each bit of a frame that agrees
with a frame of the other recording is a vote for their offset. The bits of blocks of recordings are matrices of
plus and minus one, so one product gives a bin of the histograms of all pairs of two blocks. A pair is aligned at
the bin with the greatest share of votes, and matches if its bit errors, counted on the integers, are within the
limit. No pair is left out beforehand, so none within the limit is missed; a query set against all rows is what
the product is of.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.llm.common import arrow_schema, columns_of, kept, map_rows, measured, ready

RATE, FRAME, HOP = 4000, 512, 256
#: Frames that a filter spans at most.
SPAN = 12
#: A pair matches with this many frames of overlap at one offset, and bit errors at most.
OVERLAP, ERRORS = 24, 0.20
#: Frames of one block of recordings, each counted as long as the block's longest.
BLOCK_FRAMES = 1 << 14
#: Log ratio from which a filter's answer is strong.
STRONG = 0.35


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters: kinds in turn, sizes growing with the turn."""
    return [(k % 6, (5 * k) % 12, 3 + (k * 7) % 10, min(SPAN, 3 + 3 * (k // 6) + k % 4)) for k in range(16)]


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono PCM."""
    body = np.clip(np.round(samples * 32767), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body))
    return head + body


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1) of integer PCM; none of what isn't such a file, or is cut off."""
    nothing = RATE, np.zeros(0)
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return nothing
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            width = bits // 8
            if kind != 1 or not channels or not rate or width not in (1, 2, 4):
                return nothing
            raw = np.frombuffer(body[: len(body) // (width * channels) * width * channels], {1: "u1", 2: "<i2", 4: "<i4"}[width])
            x = raw.astype(float) - 128 if width == 1 else raw.astype(float)
            return rate, x.reshape(-1, channels).mean(1) / float(1 << (bits - 1))
        at += 8 + size + size % 2
    return nothing


def chroma(rate: int, samples: np.ndarray) -> np.ndarray:
    """Energy by frame and pitch class, each frame scaled to length one; silent frames are zero."""
    if rate != RATE and len(samples):
        at = np.arange(0, len(samples) - 1, rate / RATE)
        samples = np.interp(at, np.arange(len(samples)), samples)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((pitch >= 55) & (pitch <= 1760))
    classes = np.round(12 * np.log2(pitch[used] / 440)).astype(int) % 12
    out = np.zeros((len(frames), 12))
    np.add.at(out.T, classes, power[:, used].T)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0)


def fingerprint(data: bytes | None) -> np.ndarray:
    """The packed integers of a recording, one for each place where the longest filter fits."""
    image = chroma(*decode_wav(data))
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.concatenate((image, image), 1)  # classes wrap around
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in filters():
        half, third = (w // 2, h // 2), (w // 3, h // 3)
        whole = area(0, w, c, c + h)
        plus = {
            0: lambda: area(0, w, c, c + third[1] + 1),
            1: lambda: area(0, w, c, c + half[1]),
            2: lambda: area(0, half[0], c, c + h),
            3: lambda: area(0, half[0], c, c + half[1]) + area(half[0], w, c + half[1], c + h),
            4: lambda: area(0, w, c + third[1], c + 2 * third[1]),
            5: lambda: area(third[0], 2 * third[0], c, c + h),
        }[kind]()
        x = np.log((0.05 + plus) / (0.05 + np.maximum(whole - plus, 0)))
        level = np.digitize(x, (-STRONG, 0.0, STRONG))
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out.view(np.int32)


_PRINT = columns_of(("rec_id", T.LongType()), ("fp", T.BinaryType()))


def fingerprints(recordings: DataFrame, id_column: str = "rec_id", audio: str = "audio") -> DataFrame:
    """rec_id and fp (packed 32-bit integers, as bytes) of a column of WAV files; empty where there is no sound file."""
    ready(recordings.sparkSession)
    taken = recordings.select(F.col(id_column).cast("long").alias("rec_id"), F.col(audio).alias("audio"))
    return map_rows(taken, lambda rows: {"rec_id": rows["rec_id"], "fp": [fingerprint(x).tobytes() for x in rows["audio"]]}, _PRINT, "audio")


_BLOCK = columns_of(("ids", T.ArrayType(T.LongType())), ("fps", T.ArrayType(T.BinaryType())))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_BLOCK)
    ids, fps, longest = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids], schema.field(0).type), pa.array([fps], schema.field(1).type)], schema=schema)

    for batch in batches:
        for c, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and max(longest, len(fp) // 4) * (len(ids) + 1) > BLOCK_FRAMES:
                yield block()
                ids, fps, longest = [], [], 0
            ids.append(c)
            fps.append(fp)
            longest = max(longest, len(fp) // 4)
    if ids:
        yield block()


_MATCH = columns_of(("left_id", T.LongType()), ("right_id", T.LongType()), ("offset", T.IntegerType()), ("votes", T.LongType()), ("overlap", T.IntegerType()), ("error_rate", T.DoubleType()))


def _signs(fps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Frames of each recording, and a row of its bits as plus and minus one, zero after its end."""
    size = np.array([len(x) // 4 for x in fps])
    out = np.zeros((len(fps), 32 * int(size.max())), np.float32)
    for row, x in zip(out, fps, strict=True):
        row[: 8 * len(x)] = np.unpackbits(np.frombuffer(x, np.uint8)) * np.float32(2) - 1
    return size, out


def offset_histograms(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset with enough overlap: the offset, the overlap of each pair in frames, and its votes.

    votes[i, j] counts the bits that agree of left i and right j when left runs ahead by the offset. Offsets come
    by size, the positive one of a shift first.
    """
    (m, x), (n, y) = _signs(left), _signs(right)
    for offset in sorted(range(OVERLAP - int(n.max()), int(m.max()) - OVERLAP + 1), key=lambda o: (abs(o), -o)):
        overlap = np.minimum.outer(m - max(0, offset), n - max(0, -offset))
        frames = int(overlap.max())
        if frames < OVERLAP:
            continue
        a, b = 32 * max(0, offset), 32 * max(0, -offset)
        agree = x[:, a : a + 32 * frames] @ y[:, b : b + 32 * frames].T
        yield offset, overlap, (agree + 32.0 * overlap) / 2


def nearest(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the lowest share of bit errors at any offset with enough overlap (2 if none), and that offset.

    That is the offset with the greatest share of votes; of equal ones the smallest shift counts, and of a
    shift's two directions the positive one.
    """
    best, where = np.full((len(left), len(right)), 2.0), np.zeros((len(left), len(right)), np.int32)
    for offset, overlap, votes in offset_histograms(left, right):
        rate = 1 - votes / (32.0 * np.maximum(overlap, 1))
        better = (rate < best) & (overlap >= OVERLAP)
        best[better], where[better] = rate[better], offset
    return best, where


def _matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_MATCH)
    for batch in batches:
        for q, q_fps, c, fps in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            best, where = nearest(q_fps, fps)
            out = []
            for i, j in zip(*np.nonzero(best <= ERRORS + 1e-6), strict=True):
                if q[i] != c[j]:
                    offset = int(where[i, j])
                    x, y = (np.frombuffer(fp, np.uint32)[max(0, at) :] for fp, at in ((q_fps[i], offset), (fps[j], -offset)))
                    n = min(len(x), len(y))
                    wrong = int(np.bitwise_count(x[:n] ^ y[:n]).sum())
                    if wrong <= ERRORS * 32 * n:
                        out.append((q[i], c[j], offset, 32 * n - wrong, n, wrong / (32 * n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def align(prints: DataFrame, is_query: Column) -> DataFrame:
    """Rows of two kinds: the class of every recording, and the matches of the classes that hold a query.

    prints has rec_id and fp. Recordings of one fingerprint are one class, named by its smallest rec_id:
    kind 'member', left_id the recording, right_id its class. kind 'match': left_id the class of a query,
    right_id another class, offset (frames by which left runs ahead), votes (bits that agree there), overlap and error_rate. So copies
    aren't expanded into pairs. A recording without a fingerprint (null, too short, no sound file) is a member
    of its own class and matches nothing; a null rec_id drops out. Repeated rows are one recording.
    """
    rows = kept(prints.where("rec_id is not null").withColumn("query", F.coalesce(is_query, F.lit(False))))
    named = rows.withColumn("name", F.when(F.octet_length("fp") > 0, F.sha2("fp", 256)).otherwise(F.concat(F.lit("-"), F.col("rec_id").cast("string"))))
    classes = kept(named.groupBy("name").agg(F.min("rec_id").alias("class_id"), F.first("fp").alias("fp"), F.max("query").alias("query")))
    members = named.select("rec_id", "name").distinct().join(classes.select("name", "class_id"), "name")
    posts = classes.where(F.octet_length("fp") > 0)
    packed = lambda df: df.select("class_id", "fp").sortWithinPartitions(F.octet_length("fp")).mapInArrow(_blocks, _BLOCK)
    asked = kept(packed(posts.where("query")).select(F.col("ids").alias("q"), F.col("fps").alias("q_fps")))
    # Blocks are few and heavy, so they are dealt to more tasks than their files would make.
    blocks = packed(posts).repartition(4 * prints.sparkSession.sparkContext.defaultParallelism)
    pairs = blocks.crossJoin(measured(asked, "aggregate(q_fps, 0L, (n, x) -> n + octet_length(x))"))
    found = pairs.select("q", "q_fps", "ids", "fps").mapInArrow(_matches, _MATCH)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("votes", "long"), ("overlap", "int"), ("error_rate", "double"))]
    member = members.select(F.lit("member").alias("kind"), F.col("rec_id").alias("left_id"), F.col("class_id").alias("right_id"), *empty)
    return member.unionByName(found.select(F.lit("match").alias("kind"), "*"))


def render(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """rec_id and audio: each vector sung as a melody, one note of HOP samples for each number.

    The tables have no sound; this makes a media column out of vectors, the same for equal vectors and
    similar for similar ones. A null or empty vector has null audio.
    """
    ready(vectors.sparkSession)

    def step(rows: dict[str, list]) -> dict[str, object]:
        return {"rec_id": rows["rec_id"], "audio": [encode_wav(melody(v)) if v else None for v in rows["v"]]}

    taken = vectors.select(F.col(id_column).cast("long").alias("rec_id"), F.col(column).alias("v"))
    return map_rows(taken, step, columns_of(("rec_id", T.LongType()), ("audio", T.BinaryType())), None)


def melody(vector: list[float | None]) -> np.ndarray:
    """Samples of a melody: a number's place among the vector's values chooses the note of a two-octave scale."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float), nan=0.0, posinf=0.0, neginf=0.0)
    spread = float(v.std()) or 1.0
    note = np.clip(np.round(12 + 6 * (v - v.mean()) / spread), 0, 24)
    pitch = np.repeat(220 * 2 ** (note / 12), HOP)
    return 0.5 * np.sin(2 * np.pi * np.cumsum(pitch) / RATE)
