"""Whole jobs: stored statistics and vectors, rebuilding from a folder, logs, caches, evaluation runs, the question workflow."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key, norm_space, tokens
from juriloom.lineage import cut
from juriloom.operators import answers, dense, graph, header, lexical, navigation, parser, planning, retrieval
from juriloom.plans.settings import Providers, Settings
from juriloom.shipping import ship
from juriloom.sources import files

SUMMARY_CHARS = 500
#: Columns that searches filter vectors by.
PAYLOAD = ["doc_id", "doc_number", "law_type", "year", "node_type", "article", "clause", "point", "issuing_agency"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def bm25_statistics(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored (token, df, idf) and (n_docs, avgdl); built where they are missing or ``force`` is set."""
    spark = docs.sparkSession
    if force or not exists(spark, f"{path}/corpus"):
        words = cut(docs.select(doc_id, tokens(text).alias("w")))
        lexical.term_stats(words, doc_id, F.col("w")).write.mode("overwrite").parquet(f"{path}/terms")
        lexical.corpus_stats(words, F.col("w")).write.mode("overwrite").parquet(f"{path}/corpus")  # last: it says that both are there
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/corpus")


def store_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Write (key, version, embedding, PAYLOAD) into a collection; a key that is there already is replaced if it is newer.

    Files are laid out by kind of document and sorted by number, so that filters prune files instead of an index. What was
    stored is read from one numbered folder and written to the next, so a run that fails leaves it whole.
    """
    spark, turn = vectors.sparkSession, 0
    while exists(spark, f"{path}/v{turn}/_SUCCESS"):
        turn += 1
    rows = vectors if not turn else spark.read.schema(vectors.schema).parquet(f"{path}/v{turn - 1}").unionByName(vectors)
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    sort = ["doc_number"] if "doc_number" in vectors.columns else [key]
    layout = latest.repartition("law_type").sortWithinPartitions(*sort).write.mode("overwrite")
    (layout.partitionBy("law_type") if "law_type" in vectors.columns else layout).parquet(f"{path}/v{turn}")
    return spark.read.schema(vectors.schema).parquet(f"{path}/v{turn}")


def search_vectors(stored: DataFrame, queries: DataFrame, k: int, must: dict[str, object] | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest among the vectors whose payload equals ``must``."""
    for name, value in (must or {}).items():
        stored = stored.where(F.col(name) == value)
    return dense.dense_top_k(stored, queries, k, vec_id=key)


def embedded(texts: DataFrame, cache: DataFrame | None, embed, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with ``embedding``, new cache rows (cache_key, embedding)): only distinct texts that the cache lacks are embedded.

    The key is the SHA-1 of the normalised text; ``embed`` is a function of a column, as an Arrow UDF is.
    """
    keyed = texts.withColumn("cache_key", F.sha1(norm_key(text).cast("binary")))
    distinct = keyed.groupBy("cache_key").agg(F.min(text).alias("_text"))
    missing = distinct if cache is None else distinct.join(cache, "cache_key", "left_anti")
    new = cut(missing.select("cache_key", embed(F.col("_text")).alias("embedding")))
    every = new if cache is None else cache.select("cache_key", "embedding").unionByName(new)
    return keyed.join(every, "cache_key", "left"), new


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of all files of the formats that can be read, by their suffix; the others have an error."""
    read = files.read_texts(spark, folder).select("path", "text", F.lit(None).cast("string").alias("error")).unionByName(files.read_docx(spark, folder))
    other = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(~F.lower("path").rlike(r"\.(txt|docx)$"))
    every = read.unionByName(other.select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("error")))
    return every.withColumn("text", F.array_join(header.lines("text"), "\n"))


def rebuild(spark: SparkSession, folder: str, target: str) -> dict[str, str]:
    """Everything from a folder of files: documents with headers, nodes, edges, chunks, BM25 statistics, all as tables below ``target``."""
    ship(spark)
    path = {name: f"{target}/{name}" for name in ("documents", "errors", "nodes", "edges", "chunks", "bm25")}
    loaded = cut(load_documents(spark, folder).withColumn("file_name", F.element_at(F.split("path", "/"), -1)))
    loaded.where("error is not null or text is null").write.mode("overwrite").parquet(path["errors"])
    header.headers(loaded.where("text is not null and error is null")).write.mode("overwrite").parquet(path["documents"])
    docs = spark.read.parquet(path["documents"])
    by = docs.select(F.col("header_id").alias("doc_id"), "text", F.coalesce(F.nullif("official_title", F.lit("")), "file_name").alias("title")).dropDuplicates(["doc_id"])
    parser.parsed(by, title="title").join(docs.select(F.col("header_id").alias("doc_id"), "doc_number", F.col("doc_type").alias("law_type"), "year", "issuing_agency").dropDuplicates(["doc_id"]), "doc_id").write.mode("overwrite").parquet(path["nodes"])
    nodes = spark.read.parquet(path["nodes"])
    graph.has_child_edges(nodes).write.mode("overwrite").parquet(path["edges"])
    graph.chunks(nodes).write.mode("overwrite").parquet(path["chunks"])
    bm25_statistics(spark.read.parquet(path["chunks"]), path["bm25"], "node_id", "retrieval_text", force=True)
    return path


def append_log(records: DataFrame, path: str) -> bool:
    """Append (request_id, question, answer, ...) to a log of JSON lines; a failure is reported as False and stops nothing."""
    try:
        records.withColumn("timestamp_utc", F.current_timestamp()).write.mode("append").json(path)
    except Exception as e:  # noqa: BLE001  logging must never fail a question
        print(f"log not written: {type(e).__name__}")
        return False
    return True


def search_log(log: DataFrame, request_id: str | None = None, said: str | None = None, last: int = 20, compact: bool = True) -> DataFrame:
    """The ``last`` records by id, or by what their question or answer holds; compact ones have the short columns alone."""
    if request_id is not None:
        log = log.where(F.col("request_id") == request_id)
    if said is not None:
        log = log.where(F.contains(norm_key("question"), F.lit(said.lower())) | F.contains(norm_key("answer"), F.lit(said.lower())))
    found = log.orderBy(F.desc("timestamp_utc"), "request_id").limit(last)
    return found.select("request_id", "timestamp_utc", "question", F.substring(norm_space("answer"), 1, SUMMARY_CHARS).alias("answer")) if compact else found


def summaries(groups: DataFrame, summarise=None, most: int = 3, chars: int = SUMMARY_CHARS) -> DataFrame:
    """groups (group_id, texts in order) with ``cache_key`` and ``summary``: a model's, else the first texts, cut with dots.

    Groups with the same key are summarised once.
    """
    keyed = groups.withColumn("cache_key", F.md5(F.array_join("texts", "\n").cast("binary")))
    said = F.array_join(F.filter(F.transform(F.slice("texts", 1, most), lambda t: norm_space(t)), lambda t: t != ""), " ")
    plain = F.when(F.length(said) > chars, F.concat(F.rtrim(F.substring(said, 1, chars)), F.lit("..."))).otherwise(said)
    once = keyed.groupBy("cache_key").agg(F.first("texts").alias("texts")).withColumn("plain", plain)
    model = F.lit(None).cast("string") if summarise is None else summarise(F.array_join("texts", "\n\n"))
    return keyed.join(once.select("cache_key", F.coalesce(F.nullif(norm_space(model), F.lit("")), "plain").alias("summary")), "cache_key").select("group_id", "cache_key", "summary")


def judged(answered: DataFrame, providers: Providers | None = None, provider: str = "auto", enabled: bool = True) -> DataFrame:
    """answered (question, answer, n_passages) with ``verdict`` and ``provider``: disabled, the model's judge, or the rules.

    auto and model take the judge where there is one; what it leaves null goes by the rules.
    """
    if not enabled:
        return answered.withColumn("verdict", F.lit("adequate")).withColumn("provider", F.lit("disabled"))
    rules = navigation.adequacy(answered)
    if provider == "heuristic" or not (providers and providers.judge):
        return answered.withColumn("verdict", rules).withColumn("provider", F.lit("heuristic"))
    own = providers.judge(F.col("question"), F.col("answer"))
    return answered.withColumn("_own", own).withColumn("verdict", F.coalesce("_own", rules)).withColumn("provider", F.when(F.col("_own").isNotNull(), "model").otherwise("heuristic")).drop("_own")


def context_text() -> Column:
    """The first of retrieval_text, text and snippet that says something, in one line."""
    return F.coalesce(*[F.nullif(norm_space(c), F.lit("")) for c in ("retrieval_text", "text", "snippet")], F.lit(""))


def answer_questions(questions: DataFrame, nodes: DataFrame, providers: Providers | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The workflow for all questions at once: analyse, retrieve, grade, answer or refuse, check citations.

    Gives profiles, passages, grades and answers (question_id, answer, valid).
    """
    held = cut(nodes)
    profiles = cut(planning.profile(questions))
    scopes = questions.select("question_id", planning.scope().alias("scope"))
    walked, relations = navigation.navigate(profiles, held, retrieval.direct_targets(profiles, held, settings.direct_top_k, settings.summary_top_k), max_hops=settings.max_hops, keep=settings.summary_top_k, rerank=providers.rerank if providers and settings.use_reranker else None)
    found = navigation.evidence(walked, relations, scopes, held, settings.evidence_top_k)
    passages = cut(found.join(held.select("node_id", "text", "path_title", "doc_number", "article", "clause", "point"), "node_id").join(scopes, "question_id").withColumn("rank", F.col("place")).drop("place"))
    grades = cut(retrieval.grade(profiles, passages))
    good = grades.where("status <> 'insufficient'").select("question_id")
    selected = answers.select_passages(passages.join(good, "question_id"))
    said = answers.answer(questions.join(scopes, "question_id"), selected, providers)
    checked = retrieval.citations(said, passages)
    refused = said.join(good, "question_id", "left_anti").select("question_id", F.lit(answers.REFUSAL).alias("answer"), F.lit(True).alias("valid"))
    return {"profiles": profiles, "passages": passages, "grades": grades, "answers": answers.verified(said.join(good, "question_id"), checked).unionByName(refused)}


def collect_outputs(samples: DataFrame, nodes: DataFrame, providers: Providers | None = None) -> DataFrame:
    """(sample_id, answer, contexts, context_nodes): what the workflow answers for samples (sample_id, question), with its distinct contexts in order."""
    done = answer_questions(samples.select(F.col("sample_id").alias("question_id"), "question"), nodes, providers)
    shown = done["passages"].withColumn("retrieval_text", F.lit(None).cast("string")).select("question_id", "rank", "node_id", context_text().alias("c")).where("c <> ''")
    first = shown.groupBy("question_id", "c").agg(F.min(F.struct("rank", "node_id")).alias("x"))
    lists = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("x.rank", "x.node_id", "c"))).alias("l"))
    return done["answers"].join(lists, "question_id", "left").select(F.col("question_id").alias("sample_id"), "answer", F.transform("l", lambda x: x["c"]).alias("contexts"), F.transform("l", lambda x: x["node_id"]).alias("context_nodes"))
