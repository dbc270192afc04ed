"""Near-duplicates by MinHash signatures in a multi-index for the Hamming distance, confirmed on full shingle sets.

A signature has ``CHUNKS`` chunks of ``WIDE`` symbols of 16 bits. By the pigeonhole principle two signatures that differ
in at most CHUNKS * (ERRORS + 1) - 1 = 35 symbols agree in some chunk up to ERRORS = 1 symbol. That allowed error is
enumerated: a chunk is indexed once for each symbol left out. All pairs within distance 35 are thus found; of pairs
farther apart most are too: two sets of similarity 0.8 share no key with a chance of 2e-7.

Words are compared with A-Z in lower case. Documents with equal sets are one class. No bucket is ever gathered: a block of documents pairs the members of a bucket
with one of them and sends on only that one, so a bucket is one row for each block, and one of those is paired with the
rest. Pairs are thinned by signature, size and the number of shingles that only one of them has among all documents that
share a bucket with another, then confirmed by exact intersection. This is done TURNS times, each time
from other members and only between components. Two ways then make sure that no link is lost. A family is what is joined
by pairs that the signatures leave, linked or not: in each, all members outside its largest component are compared with
all members, blocks of sets with blocks of sets. And where a bucket of three or more holds several families, pairs
between them that pass the bounds are confirmed as well. Members of one component need no further link.

Defined cases: null and empty texts have empty sets and are linked with nothing; texts with fewer words than a shingle
are one shingle; rows that share an id are one document where they are linked; rows without an id stay alone; an empty
table gives an empty result; further columns of any name are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import joined
from .scratch import Temporary, in_block, in_block_column, written
from .words import U, Words, mix, pack, pack_sorted, slices, unpack, unpack_sorted, window_starts, windows, words

CHUNKS, WIDE, ERRORS = 18, 7, 1
SYMBOLS = CHUNKS * WIDE
#: A pair whose signatures differ in more symbols isn't confirmed; at similarity 0.8 that is 5.5 standard deviations off.
FAR = 50
CLASSES_IN_BLOCK = 4000
STRAY_BLOCK, MEMBER_BLOCK = 100_000, 300_000  # shingles
#: Rounds of stars, each from other members of the buckets, before what is left is compared in full.
TURNS = 3
MULTIPLIERS = mix(np.arange(SYMBOLS, dtype=U), 31) | U(1)
TAGS = mix(np.arange(SYMBOLS, dtype=U), 32)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and bounds."""
    at, text = window_starts(w.bounds, size)
    found, owner = [windows(w.hashes, size)[at] if len(at) else np.zeros(0, U)], [text]
    counts = np.diff(w.bounds)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(windows(w.hashes, n)[w.bounds[short]])
            owner.append(short)
    h, text = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order].astype(np.int32), kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols for each non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS if len(full) else 0):
            out[:, k] = mix(np.minimum.reduceat(h * MULTIPLIERS[k], bounds[full])) >> U(48)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """Index keys (documents, CHUNKS * WIDE): each chunk without one of its symbols."""
    n = len(signature)
    with np.errstate(over="ignore"):
        each = mix(signature.astype(U) + (TAGS & ~U(0xFFFF)), 33).reshape(n, CHUNKS, WIDE)
        return mix(each.sum(2, keepdims=True, dtype=U) - each + TAGS.reshape(CHUNKS, WIDE), 34).reshape(n, -1)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                h, bounds = shingles(words(texts, lower=True), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = [np.zeros(len(n), U) for _ in range(2)]
                for i, s in enumerate(sums):
                    if len(full):
                        s[full] = np.add.reduceat(mix(h, 41 + i), bounds[full])
                digest = np.stack(sums, 1).tobytes()
                sig, at = signatures(h, bounds).tobytes(), np.cumsum(n > 0) - 1
                wide = 2 * SYMBOLS
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[texts.lo : texts.hi], pa.array(n, pa.int64()),
                    pa.array([digest[16 * i : 16 * i + 16] if c else None for i, c in enumerate(n)], pa.binary()),
                    pa.array([sig[wide * k : wide * k + wide] if c else None for k, c in zip(at, n, strict=True)], pa.binary()),
                ], names=["doc_id", "n_shingles", "digest", "signature"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                h, bounds = shingles(words(texts, lower=True), size)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id")[texts.lo : texts.hi], lists], names=["id", "shingles"])

    return run


def _turned(ids: np.ndarray, turn: int) -> np.ndarray:
    """What to order members by in a round: their ids, then hashes of them."""
    return ids if turn == 0 else mix(ids.view(U), 50 + turn)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _close(a, b, na: np.ndarray, nb: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may be linked, by size, by what they can share, and by signature."""
    most = np.minimum(na - own_a, nb - own_b)
    sizes = 100 * most >= percent * (na + nb - most)
    out = np.zeros(len(sizes), bool)
    at = np.flatnonzero(sizes)
    for lo in range(0, len(at), 100_000):
        part = at[lo : lo + 100_000]
        out[part] = (a(part) != b(part)).sum(1) <= FAR
    return out


def _may_link(percent: int) -> str:
    """The same bound in SQL, without the signatures: sizes na, nb of which oa, ob are in no other set."""
    most = "least(na - oa, nb - ob)"
    return f"100 * {most} >= {percent} * (na + nb - {most})"


def _sorted_keys(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys sorted, the document of each, and where each distinct key begins."""
    k = keys(signature)
    doc = np.repeat(np.arange(len(signature)), k.shape[1])
    k = k.ravel()
    order = np.argsort(k, kind="stable")
    k, doc = k[order], doc[order]
    return k, doc, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _unpacked(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"a": pa.array(unpack(a, np.int64)), "b": pa.array(unpack(b, np.int64))})

    return df.select("a", "b").mapInArrow(run, "a long, b long")


def _by_part(k: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    edges = np.searchsorted(k >> U(64 - int(log2(parts))), np.arange(parts + 1, dtype=U))
    return edges, [p for p in range(parts) if edges[p + 1] > edges[p]]


class _Search:
    def __init__(self, docs: DataFrame, reps: DataFrame, size: int, percent: int):
        """docs: (id, text); reps: (id, n, signature)."""
        self.docs, self.reps, self.size, self.percent, self.sets = docs, reps.withColumn("alone", F.lit(0).cast("long")), size, percent, None
        self.family = reps.select(F.col("id").alias("node"), F.col("id").alias("component")).distinct()
        self.blocks = max(2, reps.count() // CLASSES_IN_BLOCK)
        self.parts = 1 << max(6, ceil(log2(self.blocks)))

    def stars(self, labels: DataFrame, turn: int) -> DataFrame:
        """New links between components: in each bucket, from one member, the first in this turn's order, to the others.

        First within a block, which sends on its first member of each bucket alone, then between the blocks' first ones.
        """
        percent, parts = self.percent, self.parts
        names = ["part", "a", "b", "c"]

        def local(table: pa.Table) -> pa.Table:
            table = table.take(pa.array(np.argsort(_turned(table.column("id").to_numpy(), turn), kind="stable")))
            ids, n, own, alone = (table.column(c).to_numpy() for c in ("id", "n", "component", "alone"))
            sig = _matrix(table.column("signature"))
            k, doc, new = _sorted_keys(sig)  # in this turn's order within a key
            center = np.repeat(doc[new], np.diff(np.append(new, len(k))))
            apart = own[center] != own[doc]
            pairs = np.unique(center[apart] * len(ids) + doc[apart])
            a, b = pairs // len(ids), pairs % len(ids)
            shared = np.unique(np.concatenate([a, b]))
            near = _close(lambda p: sig[a[p]], lambda p: sig[b[p]], n[a], n[b], alone[a], alone[b], percent)
            k, first = k[new], doc[new]
            edges, used = _by_part(k, parts)
            cut = [slice(edges[p], edges[p + 1]) for p in used]
            rows = [pack(ids[shared]), pack(ids[a[near]]), *(pack_sorted(k[c]) for c in cut)], [None, pack(ids[b[near]]), *(pack(ids[first[c]]) for c in cut)], [None, None, *(pack(own[first[c]]) for c in cut)]
            return pa.table([pa.array([-2, -1, *used], pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], names=names)

        def over_blocks(table: pa.Table) -> pa.Table:
            k = np.concatenate([unpack_sorted(x) for x in table.column("a").to_pylist()])
            first, own = (np.concatenate([unpack(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("b", "c"))
            order = np.lexsort((_turned(first, turn), k))
            k, first, own = k[order], first[order], own[order]
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            center = np.repeat(new, np.diff(np.append(new, len(k))))
            apart = own[center] != own
            pairs = np.unique(np.stack([first[center][apart], first[apart]], 1), axis=0).reshape(-1, 2)
            return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

        found = written(self.dealt(self.labelled(labels)).groupBy("block").applyInArrow(local, "part int, a binary, b binary, c binary"), "stars")
        over = written(found.where("part >= 0").groupBy("part").applyInArrow(over_blocks, "a long, b long"), "stars")
        if self.sets is None:
            # whoever shares a bucket with another is in a star of the first round; later rounds need no other sets
            ids = _unpacked(found.where("part = -2").select("a", F.col("a").alias("b"))).select(F.col("a").alias("id")).union(over.select("a")).union(over.select("b")).distinct()
            self.sets = written(self.docs.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets(self.size), "id long, shingles array<long>"), "sets")
            # how many shingles of each no other has that shares a bucket: no partner can share those
            once = self.sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
            twice = self.reps.groupBy("id").count().where("count > 1").select("id")  # rows of one id with several texts: no bound
            alone = once.groupBy("id").agg(F.count("*").alias("alone")).join(twice, "id", "left_anti")
            self.reps = written(self.reps.drop("alone").join(alone.hint("merge"), "id", "left").fillna(0, ["alone"]), "classes")
        return self.confirmed(_unpacked(found.where("part = -1")), over)

    def labelled(self, labels: DataFrame) -> DataFrame:
        return self.reps.join(labels.select(F.col("node").alias("id"), "component").hint("merge"), "id")

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("block", in_block("id", self.blocks)).repartition(self.blocks, "block")

    def confirmed(self, close: DataFrame, other: DataFrame) -> DataFrame:
        """The linked ones of candidate pairs; those in ``close`` have passed the test by signature."""
        percent = self.percent
        sided = lambda c: self.reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("alone").alias(f"o{c}"), F.col("signature").alias(f"s{c}"))

        def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = _matrix(batch.column("sa")), _matrix(batch.column("sb"))
                keep = _close(lambda p: a[p], lambda p: b[p], *(batch.column(c).to_numpy() for c in ("na", "nb", "oa", "ob")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        thinned = other.distinct().join(sided("a").hint("merge"), "a").join(sided("b").hint("merge"), "b").where(_may_link(percent)).mapInArrow(thin, "a long, b long")
        pairs = written(close.union(thinned).distinct(), "pairs")
        self.family = joined(self.family, pairs)
        both = pairs.join(self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return written(both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y") - shared).alias("u")).where(f"100 * i >= {percent} * u").select("a", "b").distinct(), "links")

    def families(self, labels: DataFrame, family: DataFrame) -> DataFrame:
        """Links between components of one family: all members outside its largest component with all its members.

        Sets meet in tasks of bounded size, a block of such strays with a block of members; no pairs are made, and a task
        gives one link for each stray and component that it finds.
        """
        percent = self.percent
        own = labels.join(family.select("node", F.col("component").alias("family")), "node")
        counted = own.groupBy("family", "component").count()
        kept = counted.groupBy("family").agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("members"), F.count("*").alias("parts")).where("parts > 1 and members > 2")
        rows = own.join(kept.select("family", F.col("m.component").alias("main")), "family").select(F.col("node").alias("id"), "family", "component", (F.col("component") != F.col("main")).alias("stray"))
        full = written(rows.join(self.sets, "id"), "families")
        size = lambda c: F.coalesce(F.sum(F.when(c, F.size("shingles"))), F.lit(0))
        blocks = full.groupBy("family").agg(F.ceil((size(F.col("stray")) + 1) / STRAY_BLOCK).cast("int").alias("sb"), F.ceil((size(F.lit(True)) + 1) / MEMBER_BLOCK).cast("int").alias("mb"))
        dealt = full.join(blocks, "family")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        strays = dealt.where("stray").select("family", in_block_column("id", "sb").alias("s"), every("mb").alias("m"), "id", "component", F.lit(True).alias("left"), "shingles")
        members = dealt.select("family", every("sb").alias("s"), in_block_column("id", "mb").alias("m"), "id", "component", F.lit(False).alias("left"), "shingles")

        def compare(table: pa.Table) -> pa.Table:
            ids, own, left = (table.column(c).to_numpy() for c in ("id", "component", "left"))
            lists = table.column("shingles").combine_chunks()
            n = lists.value_lengths().to_numpy().astype(np.int64)
            _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(n)])
            right = np.flatnonzero(~left)
            if not len(right) or not left.any():
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            theirs = np.concatenate([codes[at[r] : at[r + 1]] for r in right])
            begin = np.concatenate([[0], np.cumsum(n[right])[:-1]])
            mark, a, b = np.zeros(codes.max() + 1, np.int64), [], []
            for i in np.flatnonzero(left):
                mark[codes[at[i] : at[i + 1]]] = 1
                shared = np.add.reduceat(mark[theirs], begin)
                mark[codes[at[i] : at[i + 1]]] = 0
                hit = right[(100 * shared >= percent * (n[i] + n[right] - shared)) & (own[right] != own[i])]
                for j in hit[np.unique(own[hit], return_index=True)[1]]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        # dealt by all three: by the family alone, as the join before leaves them, a family would be one task
        return written(strays.unionByName(members).repartition("family", "s", "m").groupBy("family", "s", "m").applyInArrow(compare, "a long, b long").distinct(), "links")

    def between(self, labels: DataFrame) -> DataFrame:
        """Links in buckets of three or more whose members are not yet in one family. labels: of families."""
        labelled = written(self.labelled(labels), "labelled")
        dealt, parts = self.dealt(labelled), self.parts

        def local(table: pa.Table) -> pa.Table:
            c = table.column("component").to_numpy()
            k, doc, new = _sorted_keys(_matrix(table.column("signature")))
            counts = np.diff(np.append(new, len(k)))
            low, high = np.minimum.reduceat(c[doc], new), np.maximum.reduceat(c[doc], new)
            k = k[new]
            edges, used = _by_part(k, parts)
            cut = [slice(edges[p], edges[p + 1]) for p in used]
            block = table.column("block")[0].as_py()
            blobs = {"k": [pack_sorted(k[s]) for s in cut], **{name: [pack(v[s]) for s in cut] for name, v in (("low", low), ("high", high), ("members", counts))}}
            return pa.table({"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in blobs.items()}})

        def open_keys(table: pa.Table) -> pa.Table:
            found = [unpack_sorted(x) for x in table.column("k").to_pylist()]
            low, high, members = (np.concatenate([unpack(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("low", "high", "members"))
            every = np.concatenate(found)
            order = np.argsort(every, kind="stable")
            k = every[order]
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            still = (np.minimum.reduceat(low[order], new) != np.maximum.reduceat(high[order], new)) & (np.add.reduceat(members[order], new) > 2)
            wanted = k[new][still]
            told = [(b, x[np.isin(x, wanted)]) for b, x in zip(table.column("block").to_pylist(), found, strict=True)]
            told = [(b, pack_sorted(x)) for b, x in told if len(x)]
            return pa.table({"block": pa.array([b for b, _ in told], pa.int32()), "k": pa.array([x for _, x in told], pa.binary())})

        def members(table: pa.Table, told: pa.Table) -> pa.Table:
            wanted = np.sort(np.concatenate([np.zeros(0, U), *(unpack_sorted(x) for x in told.column("k").to_pylist())]))
            k, doc, _ = _sorted_keys(_matrix(table.column("signature"))) if table.num_rows else (np.zeros(0, U), np.zeros(0, np.int64), None)
            hit = np.isin(k, wanted)
            k, doc = k[hit], doc[hit]
            return pa.table({"k": pa.array(k.view(np.int64)), **{c: table.column(c).take(pa.array(doc)) for c in ("id", "component", "n", "alone")}})

        told = dealt.groupBy("block").applyInArrow(local, "part int, block int, k binary, low binary, high binary, members binary").groupBy("part").applyInArrow(open_keys, "block int, k binary")
        rows = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(members, "k long, id long, component long, n long, alone long"), "open-buckets")
        largest = rows.groupBy("k", "component").count().groupBy("k").agg(F.max(F.struct("count", "component")).alias("m")).select("k", F.col("m.component").alias("main"))
        sided = lambda df, c: df.select("k", F.col("id").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("alone").alias(f"o{c}"))
        strays = sided(rows.join(largest, "k").where("component <> main"), "a")
        pairs = strays.join(sided(rows, "b"), "k").where("ca <> cb and " + _may_link(self.percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.confirmed(pairs.limit(0), pairs)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ids are cast to long."""
    with Temporary(docs.sparkSession) as temporary:
        features, classes, labels = _components(docs, size, percent, doc_id, text)
        temporary.keep(features, classes, labels)
    of_class = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = features.drop("signature").join(of_class.hint("merge"), "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of every row, the class of each digest, and the component of each class."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    features = written(rows.mapInArrow(_features(size), "doc_id long, n_shingles long, digest binary, signature binary"), "features")
    linked = features.where("doc_id is not null and digest is not null")
    classes = written(linked.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    reps = written(linked.join(classes.withColumnRenamed("id", "doc_id").hint("merge"), ["digest", "doc_id"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature").dropDuplicates(["id", "n", "signature"]), "classes")
    search = _Search(rows.select(F.col("doc_id").alias("id"), "text"), reps, size, percent)
    labels = reps.select(F.col("id").alias("node"), F.col("id").alias("component")).distinct()
    for turn in range(TURNS):
        with Temporary(docs.sparkSession) as temporary:  # the stars of a turn are the largest tables
            labels = joined(labels, search.stars(labels, turn))
            temporary.keep(labels, search.family, search.sets, search.reps)
    family = search.family
    labels = joined(labels, search.families(labels, family))
    return features, classes, joined(labels, search.between(family))
