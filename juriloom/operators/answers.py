"""From passages to prompts, answers, sources and second tries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_space
from juriloom.plans.settings import Providers, Settings

# Passages shown by scope, what is said without evidence, and what is asked of a model by scope.
LIMITS = {"list": 12, "comparison": 8, "summary": 8, "procedure": 8, "definition": 2, "exact": 2}
REFUSAL = "Không tìm thấy căn cứ pháp lý phù hợp."
INSTRUCTIONS = {"list": "Liệt kê đầy đủ.", "comparison": "So sánh từng điểm.", "summary": "Tóm tắt ngắn gọn.", "procedure": "Nêu các bước theo thứ tự.", "definition": "Nêu định nghĩa.", "exact": "Trả lời đúng trọng tâm."}


def by_scope(values: dict, scope: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in values.items():
        out = out.when(scope == k, F.lit(v))
    return out


def select_passages(passages: DataFrame) -> DataFrame:
    """passages (question_id, scope, role, rank, ...): the primary ones first, as many as the scope shows."""
    order = Window.partitionBy("question_id").orderBy(F.when(F.col("role") == "primary", 0).otherwise(1), "rank", "node_id")
    return passages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= by_scope(LIMITS, F.col("scope")))


def contexts(selected: DataFrame) -> DataFrame:
    """(question_id, context): numbered blocks of the selected passages, with their paths."""
    block = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("path_title"), F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("place", block.alias("b"))))
    return selected.groupBy("question_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, prompt) from (question_id, question, scope) and the context of each."""
    return questions.join(blocks, "question_id", "left").select("question_id", F.concat_ws("\n\n", by_scope(INSTRUCTIONS, F.col("scope")), F.concat(F.lit("Câu hỏi: "), "question"), F.concat(F.lit("Căn cứ:\n"), F.coalesce("context", F.lit("")))).alias("prompt"))


def restore_lists(x: Column) -> Column:
    """Numbers that run on within a line each start a line of their own."""
    return F.regexp_replace(x, r"(?<=[.;:]) +(?=\d{1,2}\. )", "\n")


def answer(questions: DataFrame, selected: DataFrame, providers: Providers | None = None) -> DataFrame:
    """(question_id, answer): a model's, or else the first passage; a refusal without passages."""
    first = selected.where("place = 1").select("question_id", F.col("text").alias("said"))
    joined = questions.join(first, "question_id", "left")
    if providers and providers.answer:
        prompt = prompts(questions, contexts(selected))
        joined = joined.join(prompt, "question_id").withColumn("said", F.when(F.col("said").isNotNull(), providers.answer(F.col("question"), F.col("prompt"))))
    return joined.select("question_id", restore_lists(F.coalesce("said", F.lit(REFUSAL))).alias("answer"))


def sources(selected: DataFrame, snippet: int = 700) -> DataFrame:
    """Distinct passages of each question with a snippet."""
    first = Window.partitionBy("question_id", "node_id").orderBy("place")
    return selected.withColumn("k", F.row_number().over(first)).where("k = 1").select("question_id", "node_id", F.substring(norm_space("text"), 1, snippet).alias("snippet"))


def with_retry(questions: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], adequate: Callable[[DataFrame], DataFrame], settings: Settings = Settings()) -> DataFrame:
    """retrieve(questions, k), and once more with a larger k for those alone that are not adequate.

    adequate(results) gives the ids (question_id) that need no second try. Rounds are bounded by the settings.
    """
    k, left, out = settings.final_top_k, questions, None
    for turn in range(settings.retry_rounds + 1):
        results = retrieve(left, k).withColumn("turn", F.lit(turn))
        good = adequate(results)
        done = results if turn == settings.retry_rounds else results.join(good, "question_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left, k = left.join(good, "question_id", "left_anti"), k + settings.retry_step
    return out


def verified(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """Answers whose citations hold; the refusal for the others. checked: (question_id, valid)."""
    return answers.join(checked.select("question_id", "valid"), "question_id", "left").select("question_id", F.when(F.coalesce("valid", F.lit(False)), F.col("answer")).otherwise(REFUSAL).alias("answer"), F.coalesce("valid", F.lit(False)).alias("valid"))


def size_split(docs: DataFrame, size: int = 800, overlap: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, piece): texts in pieces of ``size`` characters that share ``overlap`` with the one before."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))).alias("part", "piece"))
