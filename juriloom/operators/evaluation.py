"""Retrieval-quality metrics of samples against their contexts, as joins and aggregates.

samples: sample_id, gold, answer and the expected doc_number, law_type, year, article, clause, point.
contexts: sample_id, rank, text and the same columns of the node that each context comes from.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key, tokens
from juriloom.lineage import cut

# Weights of the expected fields, and words that carry no content.
WEIGHTS = {"doc_number": 0.40, "law_type": 0.10, "year": 0.10, "article": 0.20, "clause": 0.15, "point": 0.05}
STOPWORDS = "và của các những trong cho về theo là có được phải này đó với một hoặc để tại".split()


def content_words(x: Column | str) -> Column:
    return F.array_distinct(F.filter(tokens(x), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)))


def _number_key(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(x), "Đ", "D"), "^0+(?=[0-9])", "")


def _agrees(field: str) -> Column:
    want, have = F.col(f"want_{field}"), F.col(field)
    same = _number_key(want) == _number_key(have) if field == "doc_number" else norm_key(want.cast("string")) == norm_key(have.cast("string"))
    return F.coalesce(same, F.lit(False))


def _paired(samples: DataFrame, contexts: DataFrame) -> DataFrame:
    wanted = samples.select("sample_id", "gold", *[F.col(f).alias(f"want_{f}") for f in WEIGHTS])
    return wanted.join(contexts, "sample_id", "left")


def context_metrics(samples: DataFrame, contexts: DataFrame) -> DataFrame:
    """sufficiency, reference match, precision and recall of each sample; null where nothing was expected."""
    pairs = _paired(samples, contexts).withColumn("gold_words", content_words("gold")).withColumn("words", content_words(F.coalesce("text", F.lit(""))))
    asked = {f: F.col(f"want_{f}").isNotNull() for f in WEIGHTS}
    hit = F.lit(True)
    for f in WEIGHTS:
        hit = hit & (~asked[f] | _agrees(f))
    shared = F.size(F.array_intersect("gold_words", "words"))
    n_gold = F.size("gold_words")
    relevant = F.col("text").isNotNull() & (hit | ((shared >= 2) & (shared / F.greatest(n_gold, F.lit(1)) >= 0.18)))
    found = pairs.withColumn("relevant", relevant).groupBy("sample_id").agg(
        F.count("text").alias("n_contexts"), F.count_if("relevant").alias("n_relevant"), F.max(n_gold).alias("n_gold"),
        F.size(F.array_intersect(F.first("gold_words"), F.flatten(F.collect_set("words")))).alias("n_held"),
        *[F.max(F.col(f"want_{f}").isNotNull()).alias(f"asked_{f}") for f in WEIGHTS], *[F.max(_agrees(f)).alias(f"met_{f}") for f in WEIGHTS],
    )
    add = lambda weight, *flags: sum((F.when(_all(flags, f), weight(f)).otherwise(0.0) for f in WEIGHTS), F.lit(0.0))
    _all = lambda flags, f: _and([F.col(f"{x}_{f}") for x in flags])
    some = F.col("n_contexts") > 0
    one, weight = (lambda f: F.lit(1.0)), (lambda f: F.lit(WEIGHTS[f]))
    ratio = lambda a, b: F.when(b > 0, a / b)
    sufficiency = F.when(~some, 0.0).otherwise(ratio(add(one, "asked", "met"), add(one, "asked")))
    recall = ratio(F.col("n_held").cast("double"), F.col("n_gold").cast("double"))
    parts = F.array_compact(F.array(recall, sufficiency))
    return found.select(
        "sample_id", F.round(sufficiency, 6).alias("sufficiency"), F.round(ratio(add(weight, "asked", "met"), add(weight, "asked")), 6).alias("ref_match"),
        F.round(F.when(some, F.col("n_relevant") / F.col("n_contexts")).otherwise(0.0), 6).alias("precision"),
        F.round(F.when(~some, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(parts), F.lit(0))), 6).alias("recall"),
    )


def _and(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def citation_support(samples: DataFrame, contexts: DataFrame) -> DataFrame:
    """Share of the references in the answer that a context's metadata has; 0.5 where the answer has none."""
    cite = lambda pattern, label: F.transform(F.regexp_extract_all(norm_key("answer"), F.lit(pattern), 1), lambda n: F.concat(F.lit(label), n))
    number = F.transform(F.regexp_extract_all(F.upper("answer"), F.lit(r"(?U)\b(\d{1,4}/\d{4}/[A-ZĐ\-]+)"), 1), lambda n: F.lower(_number_key(n)))
    refs = samples.select("sample_id", F.explode(F.array_distinct(F.concat(number, cite(r"điều\s+(\d+)", "điều "), cite(r"khoản\s+(\d+)", "khoản "), cite(r"(?<!quan )điểm\s+([a-zđ])(?=\s|[,.;:)\]]|$)", "điểm ")))).alias("ref"))
    known = contexts.select("sample_id", F.explode(F.array(F.lower(_number_key(F.col("doc_number"))), F.lower("article"), F.lower("clause"), F.lower("point"))).alias("ref")).where("ref is not null").distinct().withColumn("ok", F.lit(1))
    share = refs.join(known, ["sample_id", "ref"], "left").groupBy("sample_id").agg((F.count("ok") / F.count("*")).alias("share"))
    return samples.select("sample_id").join(share, "sample_id", "left").select("sample_id", F.round(F.coalesce("share", F.lit(0.5)), 6).alias("citation_support"))


def report(metrics: DataFrame, names: list[str], worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Means by metric, nulls left out; and the ``worst`` samples of each."""
    long = metrics.unpivot("sample_id", names, "metric", "value").where("value is not null")
    means = long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    lowest = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy("value", "sample_id"))).where(F.col("rank") <= worst)
    return means, lowest


def numbered(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """The rows with ``no``, their place by ``key`` from 1; rows are dealt out by ranges, whose sizes alone are added up in one task."""
    dealt = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.withColumn("no", place).join(F.broadcast(before), "_part").withColumn("no", F.col("no") + F.col("_before")).drop("_part", "_before")


def validate(samples: DataFrame, required: list[str]) -> DataFrame:
    """(sample_id, field, problem) for required fields that are missing, empty or still placeholders."""
    rows = samples.select("sample_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("v")) for f in required])).alias("x")).select("sample_id", "x.*")
    problem = F.when(F.col("v").isNull() | (F.col("v") == ""), "missing").when(F.upper("v").isin("TODO", "TBD", "...", "N/A"), "placeholder")
    return rows.withColumn("problem", problem).where("problem is not null").select("sample_id", "field", "problem")
