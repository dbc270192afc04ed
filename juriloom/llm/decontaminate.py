"""Documents that hold benchmark items, also with other numbers, names or units.

Texts become template words: runs of letters and digits in lower case, but <number> for digits, <name> for a capitalised
word inside a sentence, and <unit> for a unit of measure. Windows of eight template words of documents and items are
joined by hash. For each document and item, aligned windows are laid together: the words of the item that they cover
count where each slot's value in the item goes with one value in the document (the most frequent one); a document
leaks an item if they cover ``share`` of it, or ``long_run`` words.

The items' windows are sent to the workers as a filter while they are at most ``FILTER_WINDOWS``; beyond that all
windows of documents go into the join. Either way the join decides.

Windows are also joined by the hash of their own words in lower case, so a verbatim copy is found whatever its words are
and however they are capitalised; the words that such windows cover count as they stand.

Defined cases: null and empty texts and items match nothing; an item shorter than a window is one window of its own
size; items below ``least`` template words, and windows with fewer than ``literal`` words that are not slots, are searched
verbatim only (so an item of one word is found in every document with that word); rows that share id and text are one
document; repeated items are each reported; empty tables give an empty result; further columns of any name are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import U, Texts, hash_word, mix, slices, window_starts, windows, words

WINDOW = 8
FILTER_WINDOWS = 2_000_000  # 16 MB
VERBATIM = 64  # keeps hashes of words apart from those of template words
# Units of measure that stand for one another in a template.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degrees celsius fahrenheit watt watts volt volts hz khz mhz".split()
LETTERS = np.ones(256, bool)
LETTERS[:128] = [chr(c).isalnum() for c in range(128)]
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n:;"]] = True
NUMBER, NAME, UNIT = (hash_word(x) for x in ("<number>", "<name>", "<unit>"))
UNIT_HASHES = np.sort(np.array([hash_word(x) for x in UNITS], U))


def template(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words, their own values (0 for words that are not slots), bounds of texts, and the words themselves."""
    w = words(texts, LETTERS, lower=True)
    if not len(w.hashes):
        return w.hashes, w.hashes, w.bounds, w.hashes
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits = count((texts.data >= 48) & (texts.data <= 57))
    ends = count(ENDS[texts.data])
    number = digits[w.ends] - digits[w.starts] == w.ends - w.starts
    before = np.concatenate([[0], w.ends[:-1]])
    opens = ends[w.starts] > ends[before]
    opens[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    first = texts.data[w.starts]
    name = (first >= 65) & (first <= 90) & ~opens & ~number
    unit = UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, w.hashes), len(UNIT_HASHES) - 1)] == w.hashes
    slot = number | name | unit
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, w.hashes)))
    return kinds, np.where(slot, w.hashes | U(1), U(0)), w.bounds, w.hashes


def found_windows(made: tuple[np.ndarray, ...], size: int, literal: int, keep: np.ndarray | None, verbatim: bool = False) -> tuple[np.ndarray, ...]:
    """Hash, text, place and slot values of the windows with enough literal words, or of all by their own words."""
    kinds, values, bounds, own_words = made
    at, text = window_starts(bounds, size)
    h = mix(windows(own_words if verbatim else kinds, size)[at], size + VERBATIM * verbatim).view(np.int64) if len(at) else np.zeros(0, np.int64)
    if keep is not None:
        hit = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
        at, text, h = at[hit], text[hit], h[hit]
    if verbatim:
        return h, text, at - bounds[text], np.zeros((len(h), 0), U)
    own = values[at[:, None] + np.arange(size)]
    good = (own == 0).sum(1) >= min(literal, size)
    return h[good], text[good], (at - bounds[text])[good], own[good]


def _rows(sizes: list[int], literal: int, least: int, keep: np.ndarray | None, keys: list[str]):
    """Rows (keys, h, place, slots) for the windows of each text, or for those whose hash is in the sorted ``keep``.

    Verbatim windows have no slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), 1 << 19):
                made = template(texts)
                for size, verbatim in ((s, v) for s in sizes for v in (False, True) if v or s >= least):
                    h, text, place, values = found_windows(made, size, literal, keep, verbatim)
                    row = pa.array(text + texts.lo)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * values.shape[1], pa.int32()), pa.array(values.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), pa.array(h), pa.array(place, pa.int64()), lists], names=[*keys, "h", "place", "slots"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("item_id")[texts.lo : texts.hi], batch.column("text")[texts.lo : texts.hi], pa.array(np.diff(template(texts)[2]), pa.int64())], names=["item_id", "text", "n_words"])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, long_run: int = 13, literal: int = 3, least: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, covered, item_words, changed_slots) for each document and item that it holds."""
    raw = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = raw.schema["item_id"].dataType.simpleString()
    items = written(raw.mapInArrow(_lengths, f"item_id {kind}, text string, n_words long").where(F.col("n_words") > 0), "items")
    windows_of = lambda df, size: df.mapInArrow(_rows([size], literal, least, None, ["item_id", "n_words"]), f"item_id {kind}, n_words long, h long, place long, slots array<long>")
    index = windows_of(items.where(F.col("n_words") >= WINDOW), WINDOW)
    for size in range(1, WINDOW):
        index = index.union(windows_of(items.where(F.col("n_words") == size), size))
    index = written(index.withColumnsRenamed({"place": "item_place", "slots": "item_slots"}), "item-windows")
    sizes = [WINDOW, *(r["n_words"] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())]  # at most WINDOW numbers
    keep = None
    if index.count() <= FILTER_WINDOWS:
        keep = np.sort(index.select("h").distinct().toArrow().column("h").to_numpy())
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_hash"), F.col(text).alias("text"))
    doc_kind = picked.schema["doc_id"].dataType.simpleString()
    hits = picked.mapInArrow(_rows(sizes, literal, least, keep, ["doc_id", "text_hash"]), f"doc_id {doc_kind}, text_hash long, h long, place long, slots array<long>")
    pairs = hits.join(index, "h").groupBy("doc_id", "text_hash", "item_id")

    def verify(table: pa.Table) -> pa.Table:
        head = [table.column(c)[:1] for c in ("doc_id", "text_hash", "item_id")]
        covered, longest, changed, n = _covered(*(table.column(c).to_pylist() for c in ("place", "item_place", "slots", "item_slots")), table.column("n_words")[0].as_py())
        return pa.table([*head, *(pa.array([v], pa.int64()) for v in (covered, longest, n, changed))], names=["doc_id", "text_hash", "item_id", "covered", "longest", "item_words", "changed_slots"])

    found = pairs.applyInArrow(verify, f"doc_id {doc_kind}, text_hash long, item_id {kind}, covered long, longest long, item_words long, changed_slots long")
    return found.where((F.col("covered") >= F.lit(share) * F.col("item_words")) | (F.col("longest") >= long_run)).drop("longest")


def _covered(places: list[int], item_places: list[int], slots: list[list[int]], item_slots: list[list[int]], n: int) -> tuple[int, int, int, int]:
    """Words of the item covered by aligned windows, the longest run of them, slots with another value, words of the item.

    The windows are taken line by line: all with the same distance between document and item. Within one, the values of
    the item's slots must go with one value each, but where a verbatim window (one without slots) covers them.
    """
    lines: dict[int, dict[int, tuple[int, int]]] = {}
    verbatim: dict[int, set[int]] = {}
    for p, q, own, theirs in zip(places, item_places, slots, item_slots, strict=True):
        line = lines.setdefault(p - q, {})
        if not len(theirs):
            verbatim.setdefault(p - q, set()).update(range(q, q + min(n, WINDOW)))
            continue
        for k, pair in enumerate(zip(theirs, own, strict=True)):
            line[q + k] = pair
    union: set[int] = set()
    longest = changed = 0
    for apart, line in lines.items():
        same = verbatim.get(apart, set())
        votes: dict[int, Counter] = {}
        for theirs, own in line.values():
            if theirs:
                votes.setdefault(theirs, Counter())[own] += 1
        chosen = {theirs: min(c, key=lambda v: (-c[v], v)) for theirs, c in votes.items()}
        good = sorted(same.union(q for q, (theirs, own) in line.items() if not theirs or chosen[theirs] == own))
        run = best = 0
        for i, q in enumerate(good):
            run = run + 1 if i and good[i - 1] == q - 1 else 1
            best = max(best, run)
        if best > longest:
            longest, changed = best, sum(bool(theirs) and own != theirs for q, (theirs, own) in line.items() if q not in same)
        union.update(good)
    return len(union), longest, changed, n


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that hold no item."""
    found = written(leaks(docs, benchmark, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct(), "leaks")
    same = F.col(doc_id).eqNullSafe(F.col("_leak_id")) & (F.coalesce(F.xxhash64(F.col(text)), F.lit(0)) == F.col("_leak_hash"))
    return docs.join(found, same, "left_anti")
