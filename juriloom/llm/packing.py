"""Packing of documents into windows of equal size.

A document's ids are cut into full windows and one rest. Only the histogram of the rests' lengths, at most
``window`` - 1 numbers however large the input, reaches the driver. There, combinations of two or three lengths that
fill a window exactly are enumerated, non-negative least squares finds how often to repeat each so that the histogram
is used up, the counts are rounded down, and what is left is packed greedily, the largest length that fits first. The
plan is a bounded list of slots (length, range of ranks -> sequences); pieces get their rank within their length from
counts by bucket, so no length, however common, meets in one task.

Defined cases: null and empty texts are one end id; repeated rows are packed as often as they occur; an empty table
gives an empty result; further columns of any name are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written
from .tokenizers import vocabulary_path, word_ids
from .words import slices

GRID = 96  # lengths from which combinations of three are enumerated
ROUNDS = 300
PIECES_IN_BUCKET = 2000


class Plan(NamedTuple):
    """Slots sorted by (length, first rank): a rank maps to sequence base + i // many and offset + length * (i % many), i counted from first."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    many: np.ndarray
    offset: np.ndarray
    sequences: int


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window; all pairs, and triples whose first two are quantiles of the lengths."""
    have = np.flatnonzero(histogram)
    a = have[have <= window // 2]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    weight = np.cumsum(histogram[have])
    grid = np.unique(have[np.minimum(np.searchsorted(weight, (np.arange(GRID) + 0.5) / GRID * weight[-1]), len(have) - 1)]) if len(have) else have
    x, y = np.meshgrid(grid, grid)
    z = window - x - y
    x, y, z = (v[(x <= y) & (z >= 1)] for v in (x, y, z))
    rows = np.concatenate([pairs, np.stack([x, y, z], 1)])
    full = (histogram[rows] > 0) | (rows == 0)
    return np.unique(np.sort(rows[full.all(1)], 1), axis=0)


def repeats(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares for the counts of each combination, by accelerated projected gradients."""
    if not len(rows):
        return np.zeros(0)
    n = len(histogram)
    times = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n) * (np.arange(n) > 0)
    back = lambda r: r[rows].sum(1)
    r0 = np.ones(len(rows))
    for _ in range(20):  # largest eigenvalue
        r0 = back(times(r0))
        top = np.linalg.norm(r0)
        r0 /= top
    x = y = np.zeros(len(rows))
    t, target = 1.0, histogram * (np.arange(n) > 0)
    for _ in range(ROUNDS):
        new = np.maximum(y - back(times(y) - target) / (1.05 * top), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram[l]: how many pieces have length l, up to the window itself."""
    left, slots, sequences = histogram.astype(np.int64).copy(), [], 0
    left[0], taken = 0, np.zeros(window + 1, np.int64)

    def use(lengths: dict[int, int], n: int) -> None:
        nonlocal sequences
        at = 0
        for length, many in lengths.items():
            slots.append((length, taken[length], sequences, many, at))
            taken[length] += n * many
            left[length] -= n * many
            at += length * many
        sequences += n

    if left[window]:
        use({window: 1}, int(left[window]))
    rows = combinations(left[:window], window)
    for row, x in zip(rows.tolist(), np.floor(repeats(rows, left[:window].astype(float)) + 1e-6).astype(np.int64).tolist(), strict=True):
        lengths: dict[int, int] = {}
        for v in row:
            if v:
                lengths[v] = lengths.get(v, 0) + 1
        n = min([x, *(int(left[v]) // many for v, many in lengths.items())])
        if n > 0:
            use(lengths, n)
    while (have := np.flatnonzero(left)).size:
        room, lengths = window, {}
        while room and (fit := have[have <= room]).size:
            v = int(fit[-1])
            many = min(room // v, int(left[v]))
            lengths[v] = many
            room -= many * v
            have = have[have < v]
        use(lengths, min(int(left[v]) // many for v, many in lengths.items()))
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def cut(docs: DataFrame, window: int, tokenizer: str, end_id: int, doc_id: str, text: str, keep_ids: bool) -> DataFrame:
    """The pieces of every document."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            for texts in slices(batch.column("text")):
                ids, bounds = encode(texts)
                row, start, length, crc, total, own = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    all_ids = np.append(ids[a:b], np.uint32(end_id))
                    for at in range(0, len(all_ids), window):
                        piece = all_ids[at : at + window]
                        row.append(texts.lo + i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                        total.append(len(all_ids))
                        if keep_ids:
                            own.append(piece.astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * keep_ids, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece, with the sequence that it lies in and its offset there; with ``keep_ids`` its ids too."""
    pieces = written(cut(docs, window, tokenizer or vocabulary_path(), end_id, doc_id, text, keep_ids), "pieces", compression="snappy")  # with zstd, executors took more memory
    counted = pieces.groupBy("length").count().collect()  # at most ``window`` rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram, window)
    buckets = max(64, int(histogram.sum()) // PIECES_IN_BUCKET)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1
    ranked = keyed.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan.length * (1 << 40) + plan.first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            i = rank - plan.first[at]
            sequence, offset = plan.base[at] + i // plan.many[at], plan.offset[at] + length * (i % plan.many[at])
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields if f.name != "rank"}
    out = ranked.mapInArrow(assign, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", sequence_id long, offset long")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
