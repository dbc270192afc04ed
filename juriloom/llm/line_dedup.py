"""Removal of runs of lines that stand earlier in the table.

A run is ``run`` or more lines in turn, lines without a word left out. Winnowing: in each window of ``run`` line hashes
the smallest is selected, so two equal runs share at least one selected hash. Selected hashes that occur more than once
are joined back to their places; around such a place the match is extended both ways, by every window that covers it;
windows are compared by two 64-bit hashes, and one that is not the first of its kind, by id and line, is deleted.
With ``words`` given, shorter runs count too: one to ``run`` - 1 lines in turn that hold ``words`` words or more or are a
whole document; and, with ``often``, single lines that stand in ``often`` places or more, however short. All of them are
keyed without winnowing, but for runs whose lines are all long enough alone.

Everything runs in Spark's own functions. Counts are combined before each shuffle; no group is collected but the marks
of one document.

Defined cases: null and empty texts have no lines and stay; documents with fewer lines than a run stay as they are unless ``words`` is given; rows
that share id and text are one place, so neither removes the other; a null id counts as smaller than all others; an
empty table gives an empty result; further columns are kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Temporary, written

WORD = "[^\\x20\\x09-\\x0D]"


def _numbered(text: Column) -> Column:
    """The lines that hold a word, with their number among all lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(WORD))


def repeated_lines(docs: DataFrame, run: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, start, size): where windows of ``run`` lines begin that stand earlier."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.transform(_numbered(F.col(text)), lambda x: F.xxhash64(x["line"])).alias("h")).where(F.size("h") >= run)
    lowest = lambda i: F.array_position(F.slice("h", i + 1, run), F.array_min(F.slice("h", i + 1, run))).cast("int")
    chosen = rows.withColumn("at", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda i: i + lowest(i) - 1)))
    around = lambda p: F.slice("h", F.greatest(p - run + 2, F.lit(1)), F.least(p, F.lit(run - 1)) + run)
    places = chosen.select("id", "text_hash", F.explode(F.transform("at", lambda p: F.struct(p.alias("p"), F.get("h", p).alias("print"), around(p).alias("near")))).alias("x")).select("id", "text_hash", "x.*")
    places = written(places, "fingerprints")
    # a row that is there twice is one place
    more = places.groupBy("print").agg(F.min(F.struct("id", "text_hash", "p")).alias("low"), F.max(F.struct("id", "text_hash", "p")).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).select("print")
    first_line = F.greatest(F.col("p") - run + 1, F.lit(0))
    windows = (
        places.join(more, "print", "left_semi")
        .select("id", "text_hash", first_line.alias("from"), "near")
        .select("id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("near") - run), lambda k: F.struct((F.col("from") + k).alias("start"), F.slice("near", k + 1, run).alias("w")))).alias("x"))
        .select("id", "text_hash", "x.start", F.xxhash64("x.w").alias("k1"), F.xxhash64(F.lit(1), "x.w").alias("k2"))
        .distinct()
    )
    windows = written(windows, "line-windows")
    first = windows.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash", "start")).alias("first"))
    later = windows.join(first, ["k1", "k2"]).where(~F.struct("id", "text_hash", "start").eqNullSafe(F.col("first")))
    return later.select("id", "text_hash", "start", F.lit(run).alias("size"))


def repeated_short_runs(docs: DataFrame, run: int, words: int, often: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, start, size): runs of fewer than ``run`` lines that stand earlier, if long, frequent or whole."""
    lines = F.transform(_numbered(F.col(text)), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), F.regexp_count(x["line"], F.lit(WORD + "+")).alias("n")))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), lines.alias("l")).where(F.size("l") > 0)

    def of_size(size: int) -> Column:
        def window(i: Column) -> Column:
            part = F.slice("l", i + 1, size)
            return F.struct(i.alias("start"), F.lit(size).alias("size"), F.transform(part, lambda x: x["h"]).alias("w"), F.transform(part, lambda x: x["n"]).alias("n"))

        return F.when(F.size("l") >= size, F.transform(F.sequence(F.lit(0), F.size("l") - size), window)).otherwise(F.array())

    windows = rows.select("id", "text_hash", F.size("l").alias("of"), F.explode(F.flatten(F.array(*(of_size(k) for k in range(1, run))))).alias("x")).select("id", "text_hash", "of", "x.*")
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    windows = windows.select("id", "text_hash", "start", "size", (F.col("size") == F.col("of")).alias("whole"), (total >= words).alias("long"), F.array_min("n").alias("least"), F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"))
    windows = written(windows.where((F.col("size") == 1) | (F.col("least") < words) & (F.col("long") | F.col("whole"))).drop("least"), "short-runs")
    place = F.struct("id", "text_hash", "start")
    more = windows.groupBy("k1", "k2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).select("k1", "k2")
    # a row that is there twice is one place
    repeats = written(windows.join(more, ["k1", "k2"], "left_semi").distinct(), "repeated-short-runs")
    first = repeats.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places"))
    frequent = F.lit(False) if often is None else (F.col("size") == 1) & (F.col("places") >= often)
    later = repeats.join(first, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")) & (F.col("long") | F.col("whole") | frequent))
    return later.select("id", "text_hash", "start", "size")


def remove_repeated_lines(docs: DataFrame, run: int = 3, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed_lines", words: int | None = None, often: int | None = None) -> DataFrame:
    """The rows with their text rid of repeated runs, and two counts beside it, in place of columns of those names."""
    with Temporary(docs.sparkSession) as temporary:
        places = repeated_lines(docs, run, doc_id, text)
        if words is not None:
            places = places.union(repeated_short_runs(docs, run, words, often, doc_id, text))
        marks = written(places.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "size")).alias("starts")), "line-marks")
        temporary.keep(marks)
    marks = marks.select(F.col("id").alias("_marked_id"), F.col("text_hash").alias("_marked_hash"), F.col("starts").alias("_starts"))
    # marks grow with the input, so the join is a sort-merge at every size
    joined = docs.join(marks.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_marked_id")) & (F.xxhash64(F.col(text)) == F.col("_marked_hash")), "left").drop("_marked_id", "_marked_hash")
    numbered = joined.withColumn("_lines", _numbered(F.col(text)))
    spread = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    gone = numbered.withColumn("_spread", F.when(F.col("_starts").isNotNull(), spread))
    gone = gone.withColumn("_gone", F.when(F.col("_spread").isNotNull(), F.transform(F.col("_spread"), lambda k: F.get("_lines", k)["i"])))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return (
        gone.withColumn(n_lines, F.size("_lines").cast("long"))
        .withColumn(n_removed, F.when(F.col("_spread").isNotNull(), F.size("_spread")).otherwise(0).cast("long"))
        .withColumn(text, F.when(F.col("_gone").isNotNull(), kept).otherwise(F.col(text)))
        .drop("_starts", "_lines", "_spread", "_gone")
    )


#: The same in DuckDB's SQL, over runs of three lines.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x}), lambda y: regexp_matches(y.line, '[^\x20\x09-\x0D]')) AS l FROM documents),
w AS (SELECT doc_id, s, list_transform(list_slice(l, s, s + 2), lambda y: y.line) AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM lines WHERE len(l) >= 3)),
f AS (SELECT k, min({'d': doc_id, 's': s}) AS first FROM w GROUP BY k),
later AS (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS n FROM w JOIN f USING (k) WHERE {'d': doc_id, 's': s} <> first),
gone AS (SELECT doc_id, list(n) AS n FROM later GROUP BY doc_id),
out AS (SELECT doc_id, l, coalesce(n, []) AS n, list_transform(coalesce(n, []), lambda k: l[k].i) AS gone FROM lines LEFT JOIN gone USING (doc_id))
SELECT o.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(n) AS BIGINT) AS n_removed_lines,
  sha256(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10))) AS kept_sha256
FROM out o JOIN documents d ON d.doc_id = o.doc_id
"""
