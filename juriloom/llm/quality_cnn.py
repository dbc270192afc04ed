"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; filters of eight bytes slide by four over the whole text, so neighbours overlap and no byte is left
out. The largest response of each filter is taken in each chunk of 256 bytes, the chunks' maxima are both averaged and
maximised, and one logistic unit combines them. It is fitted on the driver by Adam on the whole texts of a bounded sample
of labelled rows (``max_fit_rows``); scores come from whole texts, slice by slice. Both take long texts in parts.

Defined cases: null and empty texts are scored as one chunk of zero bytes; repeated rows are each scored; without
labelled rows every score is 0.5; with one label only, its share; an empty table gives an empty result. Labels that are
null are not learned from; a document with several labels has the largest.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Texts, slices

WIDTH, STRIDE, CHUNK = 8, 4, 64  # bytes, bytes, positions
EMBEDDING, FILTERS = 8, 24
FIT_PART = 1024  # chunks of a batch that gradients are taken of at once
PART = 1 << 20


class Network(NamedTuple):
    embedding: np.ndarray
    filters: np.ndarray  # (WIDTH * EMBEDDING, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float


def constant(share: float) -> Network:
    """A network that gives every text the same score."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Network(np.zeros((256, EMBEDDING), np.float32), np.zeros((WIDTH * EMBEDDING, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(share / (1 - share))))


def laid_out(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in groups of STRIDE, zeros after each; first group and number of positions of each."""
    sizes = np.diff(texts.offsets)
    positions = np.maximum(1, -(-(sizes - WIDTH) // STRIDE) + 1)
    groups = positions + WIDTH // STRIDE - 1
    first = np.concatenate([[0], np.cumsum(groups)])
    flat = np.zeros(first[-1] * STRIDE, np.uint8)
    at = np.arange(len(texts.data)) + np.repeat(first[:-1] * STRIDE - texts.offsets[:-1], sizes)
    flat[at] = texts.data
    return flat, first[:-1], positions


def _pooled(net: Network, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and maximum over each text's chunks, and their number."""
    flat, first, positions = laid_out(texts)
    x = net.embedding[flat].reshape(-1, STRIDE * EMBEDDING)
    half = STRIDE * EMBEDDING
    out = x @ net.filters[:half]
    out[:-1] += (x @ net.filters[half:])[1:]
    out[first + positions] = -np.inf  # the last group of a text starts no window
    chunks = -(-positions // CHUNK)
    begin = np.cumsum(chunks) - chunks
    starts = np.repeat(first, chunks) + CHUNK * (np.arange(chunks.sum()) - np.repeat(begin, chunks))
    pooled = np.maximum(np.maximum.reduceat(out, starts, axis=0) + net.bias, 0)
    return np.add.reduceat(pooled, begin, axis=0), np.maximum.reduceat(pooled, begin, axis=0), chunks


def score_texts(net: Network, texts: Texts) -> np.ndarray:
    """One score for each text; a text beyond PART bytes is taken in parts that end with a chunk."""
    if len(texts.data) > 2 * PART and len(texts.offsets) == 2:
        sums, tops, chunks = np.zeros((1, FILTERS)), np.zeros((1, FILTERS)), np.zeros(1, np.int64)
        for lo in range(0, max(len(texts.data) - (WIDTH - STRIDE), 1), PART):
            part = texts.data[lo : lo + PART + WIDTH - STRIDE]
            s, t, c = _pooled(net, Texts(0, 1, np.array([0, len(part)]), part))
            sums, tops, chunks = sums + s, np.maximum(tops, t), chunks + c
    else:
        sums, tops, chunks = _pooled(net, texts)
    features = np.concatenate([sums / chunks[:, None], tops], axis=1)
    return 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30).astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, seed: int = 1) -> Network:
    """Adam on the logistic loss of whole texts."""
    labels = np.asarray(labels, np.float32)
    if not len(labels):
        return constant(0.5)
    if labels.min() == labels.max():
        return constant(float(labels[0]))
    rng = np.random.default_rng(seed)
    share = labels.mean()
    net = [rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.array([np.log(share / (1 - share))], np.float32)]
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 3e-4
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            grads = gradients(net, [texts[i] for i in chosen], labels[chosen])
            step += 1
            for p, m, v, g in zip(net, first, second, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(net[0], net[1], net[2], net[3], float(net[4][0]))


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of the texts, the last of each filled up with zeros, how many each text has, and positions of each chunk."""
    step, over = CHUNK * STRIDE, WIDTH - STRIDE
    positions = np.array([max(1, -(-(len(t) - over) // STRIDE)) for t in texts])
    counts = -(-positions // CHUNK)
    sizes = np.full(counts.sum(), CHUNK)
    sizes[np.cumsum(counts) - 1] = positions - CHUNK * (counts - 1)
    flat = np.frombuffer(b"".join(t[: n * step + over].ljust((n + 1) * step, b"\0") for t, n in zip(texts, counts.tolist(), strict=True)), np.uint8)
    every = np.lib.stride_tricks.sliding_window_view(flat, step + over)[::step]
    begin = np.cumsum(counts + 1) - counts - 1
    return every[np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)], counts, sizes


def gradients(net: list[np.ndarray], texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss by embedding, filters, bias, weights and offset.

    A filter's response in a chunk depends on eight bytes alone, those at its maximum. So all that the gradients of
    filters and embedding need is the summed error by byte, place in the filter, and filter.
    """
    embedding, filters, bias, weights, offset = net
    raw, counts, sizes = _chunks(texts)
    half = STRIDE * EMBEDDING
    best, pooled = [], []
    for lo in range(0, len(raw), FIT_PART):
        x = embedding[raw[lo : lo + FIT_PART]].reshape(-1, CHUNK + 1, half)
        out = x[:, :-1] @ filters[:half]
        out += x[:, 1:] @ filters[half:]
        out[np.arange(CHUNK) >= sizes[lo : lo + FIT_PART, None]] = -np.inf
        at = out.argmax(1)
        best.append(at)
        pooled.append(np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + bias, 0))
    best, pooled = np.concatenate(best), np.concatenate(pooled)
    begin, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    mean = np.add.reduceat(pooled, begin, axis=0) / counts[:, None]
    top = np.maximum.reduceat(pooled, begin, axis=0)
    features = np.concatenate([mean, top], 1).astype(np.float32)
    error = ((1 / (1 + np.exp(-np.clip(features @ weights + offset, -30, 30))) - labels) / len(labels)).astype(np.float32)
    is_top = pooled == top[doc]  # chunks that tie share the gradient of the maximum
    g_pooled = error[doc, None] * (weights[:FILTERS] / counts[doc, None] + weights[FILTERS:] * is_top / np.add.reduceat(is_top, begin, axis=0, dtype=np.float32)[doc]) * (pooled > 0)
    chunk, k = np.nonzero(g_pooled)
    g, start = g_pooled[chunk, k], best[chunk, k] * STRIDE
    g_filters, g_embedding = np.empty((WIDTH, EMBEDDING, FILTERS), np.float32), np.zeros_like(embedding)
    for j in range(WIDTH):
        by_byte = np.bincount(raw[chunk, start + j].astype(np.int64) * FILTERS + k, g, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
        g_filters[j] = embedding.T @ by_byte
        g_embedding += by_byte @ filters.reshape(WIDTH, EMBEDDING, FILTERS)[j].T
    return [g_embedding, g_filters.reshape(-1, FILTERS), g_pooled.sum(0).astype(np.float32), features.T @ error + 1e-5 * weights, np.array([error.sum()], np.float32)]


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def fit_on(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 4000, folds: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Fit on at most ``max_fit_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids."""
    one = labels.select(F.col(doc_id).alias("of_id"), F.col(label).cast("int").alias("y")).where("y is not null and of_id is not null").where(remainder(F.col("of_id"), folds) != 0).groupBy("of_id").agg(F.max("y").alias("y"))
    chosen = one.orderBy(F.xxhash64("of_id"), "of_id").limit(max_fit_rows)
    found = docs.select(F.col(doc_id).alias("of_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "of_id").groupBy("of_id").agg(F.min(F.struct("y", "t")).alias("r"))
    rows = found.select("of_id", "r.y", "r.t").orderBy(F.xxhash64("of_id"), "of_id").limit(max_fit_rows).toArrow()  # at most max_fit_rows texts
    return fit([t.as_buffer().to_pybytes() for t in rows.column("t")], rows.column("y").to_numpy())


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_texts(net, t) for t in slices(batch.column("text"), 1 << 17)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_fit_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit_on(docs, labels, max_fit_rows))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network, cut: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is ``cut`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_texts(net, t) for t in slices(batch.column(text), 1 << 17)]
            yield batch.filter(pa.array(np.concatenate(got) >= cut if got else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
