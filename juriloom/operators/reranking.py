"""Second looks at what was found: rerankers, evidence packs, exact passages, first occurrences."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key, norm_space
from juriloom.operators import graph
from juriloom.operators.retrieval import FILTERS, reference_exact

INPUT_TOP_K, RERANK_CHARS = 30, 1500
# Marks of fields in stored texts, and the share of the reranker in a document's score.
MARKS = r"\[(DOC_TYPE|OFFICIAL_TITLE|ISSUING_AGENCY|LEAD_BLOCK|PATH|NODE_TYPE|CHUNK)\]\s*"
CROSS_SHARE = 0.65

Scorer = Callable[[Column, Column], Column]


def rerank_text(text: Column | str, most: int = RERANK_CHARS) -> Column:
    """Without marks, in one line, at most ``most`` characters with dots where it is cut."""
    plain = norm_space(F.regexp_replace(text, MARKS, " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit("...")))


def rerank(ranked: DataFrame, top_n: int, scorer: Scorer | None = None, question: str = "question", text: str = "text", tie: str = "node_id") -> DataFrame:
    """ranked (question_id, rank, question, text, ...) with ``rank`` by the scorer among the first INPUT_TOP_K, at most ``top_n``.

    Without a scorer the first ``top_n`` stay as they are and cross_score is null.
    """
    if scorer is None:
        return ranked.where(F.col("rank") <= top_n).withColumn("cross_score", F.lit(None).cast("double"))
    scored = ranked.where(F.col("rank") <= INPUT_TOP_K).withColumn("cross_score", scorer(F.col(question), rerank_text(text)).cast("double"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("cross_score"), "rank", tie))
    return scored.withColumn("rank", place).where(F.col("rank") <= top_n)


def rerank_with_rest(ranked: DataFrame, top_n: int, scorer: Scorer | None = None, **columns: str) -> DataFrame:
    """The same, with the candidates that it left out behind, in their order."""
    first = rerank(ranked, top_n, scorer, **columns)
    tie = columns.get("tie", "node_id")
    rest = ranked.join(first.select("question_id", tie), ["question_id", tie], "left_anti").withColumn("cross_score", F.lit(None).cast("double"))
    both = first.withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("_part", "rank", tie))).drop("_part")


def evidence_packs(documents: DataFrame, scored: DataFrame, titles: DataFrame) -> DataFrame:
    """documents (question_id, doc_id, ...) with ``pack``: title, number, kind, sketch and the two best candidates of each.

    scored: candidates with candidate_score; titles: (doc_id, title, doc_number, law_type, sketch).
    """
    best = Window.partitionBy("question_id", "doc_id").orderBy(F.desc("candidate_score"), "node_id")
    two = scored.withColumn("k", F.row_number().over(best)).where("k <= 2")
    shown = F.concat(F.lit("[Bằng chứng "), "k", F.lit("] "), F.when(F.col("path_title") == "", "-").otherwise(F.col("path_title")), F.lit("\n"), F.substring(norm_space("text"), 1, 420))
    lines = two.groupBy("question_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))), lambda x: x["s"]), "\n").alias("proof"))
    line = lambda label, c: F.when(norm_space(c) != "", F.concat(F.lit(label), norm_space(c)))
    head = [line("Văn bản: ", "title"), line("Số văn bản: ", "doc_number"), line("Loại văn bản: ", "law_type"), F.when(norm_space("sketch") != "", F.concat(F.lit("Mô tả văn bản: "), F.substring(norm_space("sketch"), 1, 450)))]
    joined = documents.join(titles, "doc_id").join(lines, ["question_id", "doc_id"])
    return joined.select(*documents.columns, F.concat_ws("\n", *head, "proof").alias("pack"))


def rerank_documents(packed: DataFrame, questions: DataFrame, scorer: Scorer | None = None, top_n: int = 6) -> DataFrame:
    """(question_id, doc_id, doc_final_score, rank): 0.65 of the reranker's score of the pack and 0.35 of the document's; without one its score is 0."""
    joined = packed.join(questions.select("question_id", "question"), "question_id")
    cross = F.lit(0.0) if scorer is None else scorer(F.col("question"), rerank_text("pack"))
    final = F.round(CROSS_SHARE * cross + (1 - CROSS_SHARE) * F.col("doc_score"), 6)
    scored = joined.select("question_id", "doc_id", final.alias("doc_final_score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("doc_final_score"), "doc_id"))).where(F.col("rank") <= top_n)


def exact_passages(profiles: DataFrame, documents: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(question_id, node_id, exact, place, n_nodes, text): the provisions that explicit questions name, each with all below it.

    Only nodes of the most specific kind that is named, in the question's documents (question_id, doc_id, doc_final_score).
    """
    kind = F.when(F.col("q_point").isNotNull(), "point").when(F.col("q_clause").isNotNull(), "clause").when(F.col("q_article").isNotNull(), "article")
    asked = profiles.where("explicit_reference").select("question_id", *[F.col(k).alias(f"q_{k}") for k in FILTERS]).withColumn("node_type", kind)
    rows = nodes.select("node_id", "doc_id", "node_type", "article", "clause", "point", "path_title")
    fits = lambda k: F.col(f"q_{k}").isNull() | (F.lower(f"q_{k}") == F.lower(k))
    found = asked.join(documents, "question_id").join(rows, ["doc_id", "node_type"]).where(fits("article") & fits("clause") & fits("point")).withColumn("exact", F.round(reference_exact(), 6))
    order = Window.partitionBy("question_id").orderBy(F.desc("exact"), F.desc("doc_final_score"), "node_id")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("question_id", "node_id", "exact", "place")
    below = graph.closure(nodes).join(first.select(F.col("node_id").alias("ancestor")).distinct(), "ancestor").join(nodes.select("node_id", "order_index", "text"), "node_id")
    texts = below.groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n_nodes"), graph.ordered_text("order_index", "text").alias("text"))
    return first.join(texts, "node_id").select("question_id", "node_id", "exact", "place", "n_nodes", "text")


def first_of_each(passages: DataFrame, order: str = "rank", node_id: str = "node_id", text: str = "text") -> DataFrame:
    """The first passage of each id within a question; passages without an id go by their text, and without that they are left out."""
    key = F.coalesce(F.nullif(F.trim(F.col(node_id)), F.lit("")), F.nullif(norm_key(text), F.lit("")))
    keyed = passages.withColumn("_key", key).where("_key is not null")
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_key").orderBy(order))).where("_n = 1").drop("_key", "_n")
