"""BM25 and rank fusion over DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import tokens

K1, B = 1.5, 0.75
RRF_K = 60


def corpus_stats(docs: DataFrame, words: Column) -> DataFrame:
    """One row: how many documents have words, and their mean number."""
    return docs.select(F.size(words).alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def term_stats(docs: DataFrame, doc_id: str, words: Column) -> DataFrame:
    """(token, df, idf) of every token."""
    n_docs = corpus_stats(docs, words).select("n_docs").scalar()
    df = docs.select(doc_id, F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def postings(docs: DataFrame, doc_id: str, words: Column, terms: DataFrame) -> DataFrame:
    """(doc, token, tf, dl) of the tokens in ``terms`` alone: other tokens are dropped before any shuffle by document."""
    exploded = docs.select(F.col(doc_id).alias("doc"), words.alias("w")).select("doc", F.size("w").alias("dl"), F.explode("w").alias("token"))
    return exploded.join(terms.select("token").distinct(), "token", "left_semi").groupBy("doc", "token", "dl").agg(F.count("*").alias("tf"))


def bm25(questions: DataFrame, docs: DataFrame, doc_id: str, doc_words: Column, k1: float = K1, b: float = B, use_idf: bool = True) -> DataFrame:
    """(question_id, doc, score) for pairs that share a token. questions: (question_id, words).

    A token counts as often as the question has it. Without ``use_idf`` every weight is 1 and lengths are not normalised.
    """
    asked = questions.select("question_id", F.explode("words").alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("qtf"))
    found = postings(docs, doc_id, doc_words, asked)
    if use_idf:
        stats = corpus_stats(docs, doc_words)
        n_docs, avgdl = stats.select("n_docs").scalar(), F.greatest(stats.select("avgdl").scalar(), F.lit(1.0))
        df = found.groupBy("token").agg(F.count("*").alias("df"))
        asked = asked.join(df, "token").withColumn("weight", F.col("qtf") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    else:
        avgdl = F.lit(1.0)
        asked = asked.withColumn("weight", F.col("qtf").cast("double"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)
    part = F.col("weight") * F.col("tf") * (k1 + 1) / norm
    return asked.join(found, "token").groupBy("question_id", "doc").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, group: str = "question_id", score: str = "score", tie: str = "doc", digits: int = 6) -> DataFrame:
    """The k best of each group with their rank; scores are rounded first, so that ties go by ``tie`` on every engine."""
    rounded = scored.withColumn(score, F.round(score, digits))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def question_words(questions: DataFrame, question_id: str, text: str) -> DataFrame:
    return questions.select(F.col(question_id).alias("question_id"), tokens(text).alias("words"))


def rrf(ranked: DataFrame, k: int = RRF_K, group: str = "question_id", item: str = "doc") -> DataFrame:
    """Reciprocal rank fusion of (group, list_no, item, rank[, weight]): sum of weight / (k + rank), with each list's rank.

    Ties go by the first list, then the first rank, in which an item stands.
    """
    weight = F.col("weight") if "weight" in ranked.columns else F.lit(1.0)
    fused = ranked.groupBy(group, item).agg(
        F.sum(weight / (k + F.col("rank"))).alias("rrf_score"), F.min(F.when(F.col("list_no") == 0, F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("list_no") == 1, F.col("rank"))).alias("bm25_rank"), F.min(F.struct("list_no", "rank")).alias("first"),
    )
    return fused.withColumn("rrf_score", F.round("rrf_score", 9)).withColumn("fused_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rrf_score"), F.col("first.list_no"), F.col("first.rank"), F.col(item)))).drop("first")


def minmax(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """``column`` scaled to 0..1 within each group; where all are equal, 1 if positive, else 0."""
    bounds = (df.groupBy(group) if group else df.groupBy()).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    joined = df.join(bounds, group) if group else df.withColumn("_low", bounds.select("_low").scalar()).withColumn("_high", bounds.select("_high").scalar())
    flat = F.when(F.col(column) > 0, 1.0).otherwise(0.0)
    return joined.withColumn(f"{column}_scaled", F.when(F.col("_high") == F.col("_low"), flat).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))).drop("_low", "_high")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, as defined by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
