"""Words of many texts at once as 64-bit hashes, computed with numpy over Arrow buffers.

A word's hash adds up its eight-byte pieces, each mixed with its place, and its length. Two different words share a hash
with a chance of about 2**-64, whatever their pattern; where that is not enough, a second hash is taken from the bytes
with other constants.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: True for bytes of words.
SPACE_DELIMITED = _separators((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first n bytes of a little-endian long.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64; they grow with the longest slice."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 2**64))])
                self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 2**64))])
        return self.up, self.down


_WINDOWS = (Powers(0xC2B2AE3D27D4EB4F), Powers(0xD6E8FEB86659FD93))


class Texts(NamedTuple):
    """Rows lo..hi of a batch; row i of them is data[offsets[i]:offsets[i + 1]]."""

    lo: int
    hi: int
    offsets: np.ndarray
    data: np.ndarray


class Words(NamedTuple):
    """Words of some texts; those of text i are bounds[i]:bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    second: np.ndarray | None = None


def slices(column, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts of about ``most`` bytes; nulls are empty texts."""
    lo_all = 0
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        offsets = np.frombuffer(chunk.buffers()[1], wide)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = chunk.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            hi = min(hi, len(chunk))
            yield Texts(lo_all + lo, lo_all + hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
            lo = hi
        lo_all += len(chunk)


def spans(texts: Texts, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and bounds of the words."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts.offsets), np.int64)
    inside = of_word[texts.data]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """One hash of data[starts:ends] for each seed."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    longs = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    head = longs[starts] & FIRST_BYTES[np.minimum(sizes, 8)]
    more = np.flatnonzero(sizes > 8)
    many = (sizes[more] - 1) // 8
    begin = np.cumsum(many) - many
    k = np.arange(many.sum()) - np.repeat(begin, many) + 1
    rest = longs[np.repeat(starts[more], many) + 8 * k] & FIRST_BYTES[np.minimum(np.repeat(sizes[more], many) - 8 * k, 8)]
    out = []
    with np.errstate(over="ignore"):
        for seed in seeds:
            h = mix(head, 3 * seed) + sizes.astype(U) * U(0x9FB21C651E98DF25)
            if len(more):
                h[more] += np.add.reduceat(mix(rest ^ mix(k.astype(U), 3 * seed + 1), 3 * seed + 2), begin)
            out.append(mix(h, 3 * seed))
    return out


def words(texts: Texts, of_word: np.ndarray = SPACE_DELIMITED, lower: bool = False, second: bool = False) -> Words:
    starts, ends, bounds = spans(texts, of_word[LOWER] if lower else of_word)
    found = _hashes(LOWER[texts.data] if lower else texts.data, starts, ends, (0, 1) if second else (0,))
    return Words(found[0], bounds, starts, ends, found[1] if second else None)


def hash_word(word: str) -> np.uint64:
    raw = word.encode()
    return words(Texts(0, 1, np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)), np.ones(256, bool)).hashes[0]


def windows(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` entries, over text ends too: the caller drops those (see ``window_starts``)."""
    if len(hashes) < size:
        return np.zeros(0, U)
    up, down = _WINDOWS[which].upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes, which + 1) * up[: len(hashes)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1], which + 9)


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows within one text, and the text of each."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(len(text)), text


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    steps = np.diff(values.astype(U), prepend=U(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, U)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel())


def pack(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    kind, n = np.dtype(kind), int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=kind.itemsize * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()
