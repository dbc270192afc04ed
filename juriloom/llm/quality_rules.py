"""Quality rules: plain counts, and the distance of a document's histograms from those of its language.

Two histograms are taken of each document: characters by class, and the common words below by word with all others in
one bin. The reference of a language is the sum of the histograms of all its documents that pass the base rule, so that
junk does not shape what it is held against; where none passes, that of all. A document is rejected if the
Jensen-Shannon distance (base 2, 0 to 1) of either histogram exceeds its bound; documents below ``min_chars`` or
``min_words`` are too short for that histogram and pass. Everything runs in Spark's own functions, row by row, but for
one sum for each language; no words are shuffled.

Defined cases: a null text has no words and fails the base rule; documents of a null or unknown language have that
language's own reference; repeated rows count and are returned each; an empty table gives an empty result; further
columns of any name are ignored.

Windows of three words are compared by 64-bit hashes: a first pass sorts 44 bits of the hash with the position in one
long, and what is equal there is compared by all 64 bits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import column_or_null, written

SPACE = "[\\x20\\x09-\\x0D]+"
# Frequent words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that it was for on as with be by at are this from or an he "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine "
    "le la les et un une du est que qui dans pour pas par sur en de "
    "el los las y por con no se lo del su para es"
).split()
COMMON_WORDS = list(dict.fromkeys(COMMON_WORDS))
POSITION_BITS = 20
#: Up to so many languages, the references are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The base counts and both histograms of every document."""
    base = docs.select(F.col(doc_id).alias("doc_id"), column_or_null(docs, lang, "string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = base.select(
        "doc_id", "lang", "text",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.regexp_replace("text", "[a-z]+", "").alias("no_lower"),
    )
    rest = split.select("*", F.regexp_replace("no_lower", SPACE, "").alias("no_space"))
    rest = rest.select("*", F.regexp_replace("no_space", "[^\\x00-\\x7F]+", "").alias("ascii"))
    rest = rest.select("*", F.regexp_replace("ascii", "[A-Z]+", "").alias("no_letters"))
    rest = rest.select("*", F.regexp_replace("no_letters", "[0-9]+", "").alias("signs"))
    rest = rest.select("*", F.regexp_replace("signs", "[#*$%&|<>]+", "").alias("no_symbols"), F.regexp_replace("signs", "[.,;:?'\"()\\-]+", "").alias("odd"))
    long = lambda c: c.cast("long")
    size = lambda c: F.length(c)
    n = F.size("words")
    counted = rest.select(
        "doc_id", "lang", "words",
        long(n).alias("n_words"),
        long(size("text") - (size("no_lower") - size("no_space"))).alias("word_chars"),
        long(size("signs") - size("no_symbols")).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.array(
            size("text") - size("no_lower"), size("no_lower") - size("no_space"), size("no_space") - size("ascii"), size("ascii") - size("no_letters"),
            size("no_letters") - size("signs"), size("signs") - size("odd"), size("odd"),
        ).cast("array<double>").alias("char_counts"),
        F.filter("words", lambda w: w.isin(COMMON_WORDS)).alias("common"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"),
    ).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "char_counts", "common", "windows")
    counted = counted.withColumn("word_counts", F.array(*[F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS], F.col("n_words") - F.size("common")).cast("array<double>"))
    return _repeat_words(counted.drop("common"))


def _equal_neighbours(values: str, key) -> Column:
    """Entries of a sorted array whose key is that of an entry beside them."""
    same = lambda a, b: F.coalesce(key(a) == key(b), F.lit(False))
    return F.filter(values, lambda x, i: same(x, F.get(values, i - 1)) | same(x, F.get(values, i + 1)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words that lie in a three-word window found twice or more in the text."""
    low = (1 << POSITION_BITS) - 1
    kept = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "char_counts", "word_counts"]
    short = F.size("windows") <= low
    keyed = df.select(*kept, "windows", F.when(short, F.sort_array(F.transform("windows", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))))).alias("keyed"))
    alike = keyed.select(*kept, "windows", _equal_neighbours("keyed", lambda x: F.shiftright(x, POSITION_BITS)).alias("alike"))
    places = alike.select(*kept, "windows", F.when(F.size("windows") > low, F.sequence(F.lit(0), F.size("windows") - 1)).otherwise(F.transform("alike", lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int"))).alias("places"))
    exact = places.select(*kept, F.sort_array(F.transform("places", lambda i: F.struct(F.get("windows", i).alias("h"), i.alias("i")))).alias("exact"))
    repeated = exact.select(*kept, F.transform(_equal_neighbours("exact", lambda x: x["h"]), lambda x: x["i"]).alias("at"))
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2))))
    return repeated.select(*kept, F.coalesce(F.when(F.size("at") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda c: F.transform(c, lambda x: x / F.greatest(total(c), F.lit(1.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(F.col(p)), share(F.col(q)), lambda a, b: 0.5 * (part(a, (a + b) / 2) + part(b, (a + b) / 2)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def apply_rules(docs: DataFrame, char_bound: float = 0.3, word_bound: float = 0.28, min_chars: int = 300, min_words: int = 120, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and both distances (null where the document is too short)."""
    found = written(features(docs, doc_id, text, lang), "quality-features")
    sums = [F.sum(F.get("char_counts", F.lit(i))).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    by_rule = found.groupBy("lang", base_failed.alias("failed")).agg(*sums)
    totals = by_rule.withColumn("best", F.min("failed").over(Window.partitionBy("lang"))).where("failed = best")
    references = written(totals.select(F.col("lang").alias("of_lang"), F.array(*[f"c{i}" for i in range(7)]).alias("char_reference"), F.array(*[f"w{i}" for i in range(len(COMMON_WORDS) + 1)]).alias("word_reference")), "quality-references")
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    n_chars = F.aggregate("char_counts", F.lit(0.0), lambda a, x: a + x)
    compared = found.join(references, F.col("lang").eqNullSafe(F.col("of_lang"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        F.when(n_chars >= min_chars, distance("char_counts", "char_reference")).alias("char_distance"),
        F.when(F.col("n_words") >= min_words, distance("word_counts", "word_reference")).alias("word_distance"),
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= char_bound) & (F.coalesce("word_distance", F.lit(0.0)) <= word_bound)
    return compared.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance")
