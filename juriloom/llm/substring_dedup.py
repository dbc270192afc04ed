"""Removal of word windows that another document, earlier by id, holds as well.

Documents are dealt into blocks of bounded size by a hash of id and text. Three passes over the blocks:

1. Each block makes a count-min sketch of its windows: ``DEPTH`` rows of 2**bits counters, about 2**``CELLS`` for each
   window of the input, each distinct window of the block counted once in each row; only counters that are not zero are
   kept. The sketches are added up by ranges of counters, and each block is told which of its counters add up to two or
   more. A window's estimate is the least of its counters: never too low, so no window that two blocks hold is lost, and
   too high for about one other window in 250.
2. Windows estimated to occur in another block too are grouped exactly, by two 64-bit hashes that are taken apart from
   each other from the bytes on: a block sends each once with its smallest id, and learns which of them have a smaller id
   elsewhere. A window that a third of all documents share is thus one row for each block.
3. Each block marks the words of windows that start in a document with a smaller id, in the block or elsewhere.

The text is shuffled once; nothing is broadcast or collected, and no group grows beyond one row for each block. Tasks
hold a block (``block_bytes`` of text) or a range (``range_windows`` windows); what is sent between them is at most one
row for each block and range, so both should grow with the memory of a task where the input is very large.

Defined cases: null and empty texts have no words and stay; texts with fewer words than a window stay as they are, with
their words joined by one space; rows that share an id don't remove each other's words, and each is returned; a null id
counts as larger than all others; ids are cast to long (one that isn't a number is an error); an empty table gives an empty result; further columns of any name are ignored.
"""
from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import block_count
from .words import U, mix, pack, pack_sorted, slices, unpack, unpack_sorted, window_starts, windows, words

BLOCK_BYTES, RANGE_WINDOWS = 4 << 20, 4 << 20
DEPTH, CELLS = 2, 4  # rows of the sketch, and counters for each window in a row as a power of two
BYTES_OF_WORD = 6
LAST = np.iinfo(np.int64).max
SKETCH = {"row": pa.int32(), "part": pa.int32(), "block": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()


def _windows(table: pa.Table, size: int, second: bool = True) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One or two hashes of all windows of a block, and the row and first word (within the row) of each."""
    hashes, rows, firsts = [[] for _ in range(1 + second)], [], []
    for texts in slices(table.column("text")):
        w = words(texts, second=second)
        at, text = window_starts(w.bounds, size)
        for k, (out, h) in enumerate(zip(hashes, (w.hashes, w.second), strict=False)):
            out.append(windows(h, size, k)[at] if len(at) else np.zeros(0, U))
        rows.append(text + texts.lo)
        firsts.append(at - w.bounds[text])
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return [joined(x, U) for x in hashes], joined(rows, np.int64), joined(firsts, np.int64)


def _counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of the sketch."""
    return (mix(h, 60 + row) if row else h) >> U(64 - bits)


def _by_range(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range of sorted keys of so many bits begins and ends."""
    return np.searchsorted(keys >> U(bits - int(log2(ranges))), np.arange(ranges + 1, dtype=U))


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _in_other_rows(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where a key is that of a window of another document too."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(k)))
    low, high = (np.minimum.reduceat(d, new), np.maximum.reduceat(d, new)) if len(k) else (d, d)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(low != high, counts)
    return out


def _grouped(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, b, id), first of each (a, b) in it, group of each in it."""
    order = np.lexsort((ids, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by one space) of every row."""
    blocks = block_count(docs, block_bytes, text)
    n_windows = blocks * block_bytes / BYTES_OF_WORD
    ranges = 1 << ceil(log2(max(4 * docs.sparkSession.sparkContext.defaultParallelism, n_windows / range_windows)))
    bits = min(64, max(ceil(log2(n_windows)) + CELLS, int(log2(ranges)) + 1))
    block = F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), block.alias("block")).repartition(blocks, "block")

    def sketch(table: pa.Table) -> pa.Table:
        (h,), _, _ = _windows(table, size, second=False)
        h, out = np.unique(h), []
        for row in range(DEPTH):
            cells, counts = np.unique(_counters(h, row, bits), return_counts=True)
            counts = np.minimum(counts, 2).astype(np.uint8)  # beyond two it makes no difference
            edges = _by_range(cells, ranges, bits)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[r], edges[r + 1])
                out.append((row, r, table.column("block")[0].as_py(), pack_sorted(cells[cut]), pack(counts[cut])))
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(SKETCH.items())})

    def add_sketches(table: pa.Table) -> pa.Table:
        row, found = table.column("row")[0].as_py(), [unpack_sorted(b) for b in table.column("cells").to_pylist()]
        cells, counts = np.concatenate(found), np.concatenate([unpack(b, np.uint8) for b in table.column("counts").to_pylist()])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        repeated = cells[new][np.add.reduceat(counts, new, dtype=np.int64) >= 2]
        told = [(row, b, x[_has(repeated, x)]) for b, x in zip(table.column("block").to_pylist(), found, strict=True)]
        told = [(row, b, pack_sorted(x)) for row, b, x in told if len(x)]
        return pa.table({c: pa.array([x[i] for x in told], t) for i, (c, t) in enumerate((("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())))})

    def exact(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        (a, b), rows, _ = _windows(table, size)
        ids = _ids(table)[rows]
        # within the block the ids are compared by pass 3, so only what may be elsewhere is sent
        keep = np.ones(len(a), bool)
        for row in range(DEPTH):
            own = told.filter(pa.compute.equal(told.column("row"), row)).column("cells").to_pylist()
            keep &= _has(np.sort(np.concatenate([np.zeros(0, U), *map(unpack_sorted, own)])), _counters(a, row, bits))
        a, b, ids = a[keep], b[keep], ids[keep]
        order, first, _ = _grouped(a, b, ids)
        a, b, ids = a[order][first], b[order][first], ids[order][first]
        edges = _by_range(a, ranges, 64)
        used = [r for r in range(ranges) if edges[r + 1] > edges[r]]
        cut = [slice(edges[r], edges[r + 1]) for r in used]
        block = table.column("block")[0].as_py()
        return pa.table({"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "a": pa.array([pack_sorted(a[c]) for c in cut], pa.binary()), "b": pa.array([pack(b[c]) for c in cut], pa.binary()), "ids": pa.array([pack(ids[c]) for c in cut], pa.binary())})

    def merge_exact(table: pa.Table) -> pa.Table:
        parts = [(k, unpack_sorted(x), unpack(y, U), unpack(z, np.int64)) for k, x, y, z in zip(*(table.column(c).to_pylist() for c in ("block", "a", "b", "ids")), strict=True)]
        sizes = [len(p[1]) for p in parts]
        a, b, ids = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order, first, group = _grouped(a, b, ids)
        later = np.empty(len(a), bool)
        later[order] = ids[order] > ids[order][first][group]
        out = []
        for (k, x, y, _), hit in zip(parts, np.split(later, np.cumsum(sizes)[:-1]), strict=True):
            if hit.any():
                out.append((k, pack_sorted(x[hit]), pack(y[hit])))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "a": pa.array([x[1] for x in out], pa.binary()), "b": pa.array([x[2] for x in out], pa.binary())})

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        (a, b), rows, firsts = _windows(table, size)
        all_ids = _ids(table)
        ids = all_ids[rows]
        ea = np.concatenate([np.zeros(0, U), *(unpack_sorted(x) for x in told.column("a").to_pylist())])
        eb = np.concatenate([np.zeros(0, U), *(unpack(x, U) for x in told.column("b").to_pylist())])
        keep = _has(np.sort(ea), a) | _in_other_rows(a, ids)
        a, b, ids, rows, firsts = a[keep], b[keep], ids[keep], rows[keep], firsts[keep]
        # a window known to start earlier elsewhere enters with an id below all others
        ids_all = np.concatenate([ids, np.full(len(ea), np.iinfo(np.int64).min)])
        order, first, group = _grouped(np.concatenate([a, ea]), np.concatenate([b, eb]), ids_all)
        later = np.empty(len(ids_all), bool)
        later[order] = ids_all[order] > ids_all[order][first][group]
        later = later[: len(a)]
        rows, firsts = rows[later], firsts[later]
        n_words, n_removed, kept = [], [], []
        for texts in slices(table.column("text")):
            w = words(texts)
            here = (rows >= texts.lo) & (rows < texts.hi)
            at = w.bounds[rows[here] - texts.lo] + firsts[here]
            change = np.bincount(at, minlength=len(w.hashes) + 1).astype(np.int64) - np.bincount(at + size, minlength=len(w.hashes) + 1)[: len(w.hashes) + 1]
            gone = np.cumsum(change)[: len(w.hashes)] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(w.bounds))
            n_removed.append(lost[w.bounds[1:]] - lost[w.bounds[:-1]])
            kept += joined_words(texts.data, w, ~gone)
        count = lambda parts: pa.array(np.concatenate(parts), pa.int64())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": count(n_words), "n_removed": count(n_removed), "kept_text": pa.array(kept, pa.string())})

    told = dealt.groupBy("block").applyInArrow(sketch, "row int, part int, block int, cells binary, counts binary").groupBy("row", "part").applyInArrow(add_sketches, "row int, block int, cells binary")
    sent = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(exact, "part int, block int, a binary, b binary, ids binary")
    told = sent.groupBy("part").applyInArrow(merge_exact, "block int, a binary, b binary")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")


def joined_words(data: np.ndarray, w, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space, as UTF-8."""
    sizes = np.where(keep, w.ends - w.starts + 1, 0)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(w.starts - (ends - sizes), sizes)
    out = np.append(data, np.uint8(32))[at]
    out[(ends - 1)[keep]] = 32
    raw, edges = out.tobytes(), np.concatenate([[0], ends])[w.bounds].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:], strict=False)]
