"""Interpolated modified Kneser-Ney language model of word pairs.

Counting. Each task counts the pairs of its texts and sends them to shards; a pair's shard is a cell of a grid, its row
by the first word and its column by the second, so neither a common first nor a common second word meets in one shard.
A shard adds the counts up, writes its pairs as one sorted array of 64-bit hashes with their counts, and sends on, for
each word in it, how its pairs are counted as first word and how many there are as second. Those meet by word and make
the sorted arrays of the vocabulary, one file for each range of hashes. Only sums of counts of counts reach the driver,
and a model is a folder and a dozen numbers.

Scoring. Workers map a shard's file from the shared folder into memory when they first need it, keep a bounded number
of them mapped, and look up the distinct words and pairs of some texts at a time. One sign stands for the begin and the end of a text; it is counted as a token once for each text.

With discounts D of the pair counts, p(w|u) = max(c(u,w) - D(c(u,w)), 0) / c(u) + g(u) p(w), and with discounts E of
the numbers n(w) of different words before w, p(w) = max(n(w) - E(n(w)), 0) / n + g' / (V + 1), where g(u) and g' are
what the discounts took and V + 1 counts one unknown word. After an unknown word, p(w|u) = p(w).

Defined cases: null and empty texts are one end token; repeated rows count and are scored as often as they occur; with
no training text all probabilities are 1 / (V + 1) = 1; an empty table gives an empty result; further columns of any
name are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Maps, save, smallest
from .scratch import Temporary, block_count, fresh_path, written
from .words import U, Texts, mix, pack, pack_sorted, slices, unpack, unpack_sorted, words

END = U(0x243F6A8885A308D3)
SLICE = 4 << 20
TOKENS_AT_ONCE = 3 << 20


class Model(NamedTuple):
    folder: str
    side: int  # rows and columns of the grid of shards
    parts: int  # files of the vocabulary
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float  # g'
    n_pairs: int
    n_words: int
    n_tokens: int


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with an end after each, and bounds."""
    w = words(texts, lower=True)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.empty(bounds[-1], U)
    out[bounds[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = w.hashes
    return out, bounds


def before(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each; the first of a text follows the end sign."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[bounds[:-1]] = END
    return out


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(u, 3) * U(0x9FB21C651E98DF25) + mix(w, 5), 7)


def cell(u: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
    return (u & U(0xFFFFFFFF)) % U(side) * U(side) + (w & U(0xFFFFFFFF)) % U(side)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The range that a hash lies in, among so many equal ones."""
    return (key >> U(32)) * U(parts) >> U(32)


def added(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of each column by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[new], *(np.add.reduceat(c[order], new) if len(k) else c for c in columns))


def counted(u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key: keys, first words, second words, sums."""
    key = pair_key(u, w)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[new], u[order][new], w[order][new], np.add.reduceat(counts[order], new) if len(k) else counts


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney from how many counts are 1, 2, 3 and 4; where one is missing, a half of each count."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all rows of ``docs`` and leave the model in the shared folder."""
    with Temporary(docs.sparkSession):
        return _train(docs, text)


def _train(docs: DataFrame, text: str) -> Model:
    blocks = block_count(docs, text=text)
    side = max(4, ceil(0.75 * sqrt(blocks)))
    shards, parts = side * side, 4 * side
    folder = fresh_path(docs.sparkSession, "pairs-model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, held = [], [], 0
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                h, bounds = tokens(texts)
                us.append(before(h, bounds))
                ws.append(h)
                held += len(h)
                if held >= TOKENS_AT_ONCE:
                    yield sent(np.concatenate(us), np.concatenate(ws))
                    us, ws, held = [], [], 0
        if us:
            yield sent(np.concatenate(us), np.concatenate(ws))

    def sent(u: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        _, u, w, n = counted(u, w, np.ones(len(u), np.int64))
        shard = cell(u, w, side)
        order = np.lexsort((u, shard))
        u, w, n, shard = u[order], w[order], n[order], shard[order]
        edges = np.searchsorted(shard, np.arange(shards + 1, dtype=U))
        used = [k for k in range(shards) if edges[k + 1] > edges[k]]
        cut = [slice(edges[k], edges[k + 1]) for k in used]
        return pa.RecordBatch.from_pydict({"shard": pa.array(used, pa.int32()), "u": pa.array([pack_sorted(u[c]) for c in cut], pa.binary()), "w": pa.array([pack(w[c]) for c in cut], pa.binary()), "n": pa.array([pack(n[c]) for c in cut], pa.binary())})

    names = ["shard", "part", "size", "n1", "n2", "n3", "n4", "u", "sums", "ones", "twos", "more", "w", "befores"]
    kinds = "shard int, part int, size long, n1 long, n2 long, n3 long, n4 long, u binary, sums binary, ones binary, twos binary, more binary, w binary, befores binary"

    def add_up(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        u = np.concatenate([unpack_sorted(b) for b in table.column("u").to_pylist()])
        w = np.concatenate([unpack(b, U) for b in table.column("w").to_pylist()])
        n = np.concatenate([unpack(b, np.int64) for b in table.column("n").to_pylist()])
        key, u, w, n = counted(u, w, n)
        save(f"{folder}/pairs-{shard}", key, smallest(n))
        one = np.ones(len(n), np.int64)
        firsts = added(u, n, *((n == k) * one for k in (1, 2)), (n > 2) * one)
        seconds = added(w, one)
        rows = [(shard, -1, len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), *[None] * 7)]
        e = np.searchsorted(part_of(firsts[0], parts), np.arange(parts + 1, dtype=U))
        f = np.searchsorted(part_of(seconds[0], parts), np.arange(parts + 1, dtype=U))
        for p in range(parts):
            if e[p + 1] > e[p] or f[p + 1] > f[p]:
                a, b = slice(e[p], e[p + 1]), slice(f[p], f[p + 1])
                rows.append((shard, p, None, *[None] * 4, pack_sorted(firsts[0][a]), *(pack(x[a]) for x in firsts[1:]), pack_sorted(seconds[0][b]), pack(seconds[1][b])))
        columns = list(zip(*rows, strict=True))
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.int64()] * 4, *[pa.binary()] * 7]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, types, strict=True)})

    pairs = docs.select(F.col(text).alias("text")).mapInArrow(count, "shard int, u binary, w binary, n binary").groupBy("shard").applyInArrow(add_up, kinds)
    pairs = written(pairs, "pairs", compression="snappy")
    totals = lambda df, *names: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    found = totals(pairs.where("part = -1"), "size", "n1", "n2", "n3", "n4")
    n_pairs, d = found["size"], discounts([found[f"n{k}"] for k in (1, 2, 3, 4)])

    def vocabulary(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        joined = lambda c, kind: np.concatenate([unpack_sorted(b) if kind is None else unpack(b, kind) for b in table.column(c).to_pylist()])
        u, w = joined("u", None), joined("w", None)
        zeros = np.zeros(len(w), np.int64)
        firsts = [np.concatenate([joined(c, np.int64), zeros]) for c in ("sums", "ones", "twos", "more")]
        key, total, n1, n2, n3, befores = added(np.concatenate([u, w]), *firsts, np.concatenate([np.zeros(len(u), np.int64), joined("befores", np.int64)]))
        rest = ((d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1)).astype(np.float32)
        save(f"{folder}/words-{part}", key, smallest(total), smallest(befores), rest)
        row = [len(key), int(total.sum()), *(int((befores == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(("size", "tokens", "n1", "n2", "n3", "n4"), row, strict=True)})

    words_of = pairs.where("part >= 0").groupBy("part").applyInArrow(vocabulary, "size long, tokens long, n1 long, n2 long, n3 long, n4 long")
    found = totals(words_of, "size", "tokens", "n1", "n2", "n3", "n4")
    n_words, n1, n2 = found["size"], found["n1"], found["n2"]
    e = discounts([found[f"n{k}"] for k in (1, 2, 3, 4)])
    taken = e[0] * n1 + e[1] * n2 + e[2] * (n_words - n1 - n2)
    return Model(folder, side, parts, d, e, taken / n_pairs if n_pairs else 1.0, n_pairs, n_words, found["tokens"])


class Reader:
    """Look-ups in a model's mapped arrays; what is missing is 0."""

    def __init__(self, model: Model):
        self.model, self.maps = model, Maps(model.folder)

    def _find(self, name: str, which: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """which: the number of the file of each key; keys are sorted within each."""
        out = [np.zeros(len(keys)) for _ in range(columns)]
        used, first = np.unique(which, return_index=True)
        for i, lo, hi in zip(used.tolist(), first, np.append(first[1:], len(which)), strict=True):
            arrays = self.maps[f"{name}-{i}"]
            if arrays and len(arrays[0]):
                own, values = arrays[0], arrays[1:]
                at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                hit = own[at] == keys[lo:hi]
                for o, v in zip(out, values, strict=True):
                    o[lo:hi][hit] = v[at[hit]]
        return out

    def of_words(self, keys: np.ndarray) -> list[np.ndarray]:
        """Of sorted keys: count, number of words before, rest."""
        return self._find("words", part_of(keys, self.model.parts), keys, 3)

    def of_pairs(self, keys: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        shard = cell(u, w, self.model.side)
        order = np.lexsort((keys, shard))
        out = np.empty(len(keys))
        out[order] = self._find("pairs", shard[order], keys[order], 1)[0]
        return out


def score_texts(reader: Reader, texts: Texts) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each text."""
    m = reader.model
    h, bounds = tokens(texts)
    u = before(h, bounds)
    keys, which = np.unique(h, return_inverse=True)
    total, befores, rest = reader.of_words(keys)
    first = np.searchsorted(keys, u)
    if not m.n_words:
        low = np.ones(len(keys))
    else:
        took = np.array([0.0, *m.lower_discounts])[np.minimum(befores, 3).astype(np.int64)]
        low = np.maximum(befores - took, 0) / max(m.n_pairs, 1) + m.lower_rest / (m.n_words + 1)
    pair = pair_key(u, h)
    order = np.argsort(pair, kind="stable")
    new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
    one = order[new]
    c = np.empty(len(h))
    c[order] = reader.of_pairs(pair[one], u[one], h[one])[np.cumsum(new) - 1]
    took = np.array([0.0, *m.discounts])[np.minimum(c, 3).astype(np.int64)]
    seen = total[first] > 0
    p = low[which] * np.where(seen, rest[first], 1.0) + np.where(seen, np.maximum(c - took, 0) / np.maximum(total[first], 1), 0)
    base = np.log10((total + 1) / (m.n_tokens + (m.n_words + 1)))[which]
    add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end
    return np.diff(bounds), add((total > 0)[which].astype(np.int64)), add(base), add(np.log10(p))


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", extra: Column | None = None) -> DataFrame:
    """doc_id, extra, n_tokens, n_known, train_tokens, base_score, score of every row; the scores are log10 of probabilities."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(None).cast("boolean") if extra is None else extra).alias("extra"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _readers:
            _readers.clear()
            _readers[model.folder] = Reader(model)
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                n, known, base, own = score_texts(_readers[model.folder], texts)
                rows = slice(texts.lo, texts.hi)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("extra")[rows], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.n_tokens] * len(n), pa.int64()), pa.array(base), pa.array(own)], names=["doc_id", "extra", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return picked.mapInArrow(run, f"doc_id {kind}, extra boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on all rows but those of one fold, by crc32 of the id as text, and score all; a null id is trained on."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
    model = train(docs.where(~held), text)
    return score(docs, model, doc_id, text, held).withColumnRenamed("extra", "held_out")
