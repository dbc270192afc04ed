"""Queries over the driver's own tables: text keys, tokens, BM25, vectors, fusion, streams of rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriloom.functions import text as T
from juriloom.operators import dense, lexical
from juriloom.plans.corpus import NODES_SQL, nodes, table

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
TOKENS = rf"regexp_extract_all(lower({NORM}), '[\p{{L}}\p{{N}}_]+')"
GRAMS = "list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' '))"
UUID_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""SELECT item_id, {NORM} AS spaced, lower(replace(strip_accents({NORM}), 'đ', 'd')) AS ascii_key,
  coalesce(nullif(trim(regexp_replace(lower({NORM}), '[^a-z0-9à-ỹ]+', '_', 'g'), '_'), ''), 'document') AS slug,
  CASE WHEN length({NORM}) <= 80 THEN {NORM} ELSE rtrim({NORM}[1:77]) || '...' END AS short FROM benchmark""")
def u01_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.norm_space("text").alias("spaced"), T.ascii_key("text").alias("ascii_key"), T.slug("text").alias("slug"), T.truncate("text", 80).alias("short"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def t01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"""WITH {NODES_SQL} SELECT node_id, array_to_string(list_concat(
  list_concat(flatten(list_transform(regexp_extract_all(lower(text), 'điều\\s+(\\d+)', 1), lambda n: ['điều_' || n, 'article_' || n])), flatten(list_transform(regexp_extract_all(lower(text), 'khoản\\s+(\\d+)', 1), lambda n: ['khoản_' || n, 'clause_' || n]))),
  flatten(list_transform(regexp_extract_all(lower(text), 'điểm\\s+([a-zđ])', 1), lambda n: ['điểm_' || n, 'point_' || n]))), ' ') AS refs FROM nodes""")
def t03_reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.array_join(T.reference_tokens("text"), " ").alias("refs"))


@query(f"""SELECT item_id, array_to_string(list_filter(list_concat({GRAMS.format(w="c", n=2)}, {GRAMS.format(w="c", n=3)}), lambda g: NOT contains(g, '_')), '|') AS grams
  FROM (SELECT item_id, list_filter({TOKENS}, lambda w: NOT list_contains({STOP_SQL}, w)) AS c FROM benchmark)""")
def t04_selected_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.selected_ngrams(T.tokens("text")), "|").alias("grams"))


@query(f"""SELECT item_id, CAST(len(t) + greatest(len(c) - 1, 0) + greatest(len(c) - 2, 0) AS BIGINT) AS n_search_tokens
  FROM (SELECT item_id, {TOKENS} AS t, list_filter({TOKENS}, lambda w: NOT list_contains({STOP_SQL}, w)) AS c FROM benchmark)""")
def t05_search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.search_tokens("text")).cast("long").alias("n_search_tokens"))


PHRASES = f"""list_filter(list_concat({GRAMS.format(w="t", n=3)}, {GRAMS.format(w="t", n=2)}), lambda g: len(list_filter(string_split(g, ' '), lambda w: NOT list_contains({STOP_SQL}, w))) >= 2)"""


@query(f"""SELECT item_id, CAST(count(DISTINCT p) AS BIGINT) AS n_phrases, min(p) AS first_phrase, max(p) AS last_phrase FROM (SELECT item_id, unnest({PHRASES}) AS p FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)) GROUP BY item_id""")
def t06_topic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "benchmark").select("item_id", T.topic_phrases("text").alias("p"))
    return p.select("item_id", F.size("p").cast("long").alias("n_phrases"), F.array_min("p").alias("first_phrase"), F.array_max("p").alias("last_phrase"))


@query(f"""WITH q AS (SELECT item_id, list_distinct({PHRASES}) AS p FROM (SELECT item_id, {TOKENS} AS t FROM benchmark))
  SELECT item_id, doc_id, round(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: contains(lower({NORM}), x))) / len(p) ELSE 0 END, 6) AS overlap FROM q JOIN documents ON doc_id % (SELECT count(*) FROM benchmark) = item_id""")
def t07_phrase_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    q = b.select("item_id", T.topic_phrases("text").alias("p"))
    docs = table(spark, sf_dir, "documents").withColumn("slot", F.col("doc_id") % b.agg(F.count("*").alias("n")).select("n").scalar())
    return q.join(docs, F.col("item_id") == F.col("slot")).select("item_id", "doc_id", F.round(T.phrase_overlap(F.col("p"), "text"), 6).alias("overlap"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n FROM t WHERE len(w) > 0), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM t) GROUP BY token)
  SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, n""")
def t08_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lexical.term_stats(table(spark, sf_dir, "documents"), "doc_id", T.tokens("text"))
    return stats.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avgdl FROM (SELECT {TOKENS} AS w FROM documents) WHERE len(w) > 0")
def t08_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lexical.corpus_stats(table(spark, sf_dir, "documents"), T.tokens("text"))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


BM25_SQL = f"""d AS (SELECT doc_id, {TOKENS} AS w FROM documents), q AS (SELECT item_id AS question_id, unnest({TOKENS}) AS token FROM benchmark), qt AS (SELECT question_id, token, count(*) AS qtf FROM q GROUP BY ALL),
tf AS (SELECT doc_id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY doc_id, token), s AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS a FROM d WHERE len(w) > 0),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
full_bm25 AS (SELECT question_id, doc_id AS doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token), s GROUP BY 1, 2),
plain_bm25 AS (SELECT question_id, doc_id AS doc, round(sum(qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl))), 6) AS score FROM qt JOIN tf USING (token) GROUP BY 1, 2),
top_full AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rank FROM full_bm25 QUALIFY rank <= 10),
top_plain AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rank FROM plain_bm25 QUALIFY rank <= 10)"""


def _bm25(spark: SparkSession, sf_dir: str, use_idf: bool) -> DataFrame:
    asked = lexical.question_words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return lexical.top_k(lexical.bm25(asked, table(spark, sf_dir, "documents"), "doc_id", T.tokens("text"), use_idf=use_idf), 10)


@query(f"WITH {BM25_SQL} SELECT question_id, doc, score, rank FROM top_full")
def t09_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, True)


@query(f"WITH {BM25_SQL} SELECT question_id, doc, score, rank FROM top_plain")
def r06b_bm25_plain_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, False)


@query(f"""WITH {BM25_SQL}, lists AS (SELECT 0 AS list_no, * FROM top_plain UNION ALL SELECT 1, * FROM top_full),
  f AS (SELECT question_id, doc, round(sum(1 / (60 + rank)), 9) AS rrf_score, min(rank) FILTER (list_no = 0) AS dense_rank, min(rank) FILTER (list_no = 1) AS bm25_rank, min(list_no * 1000 + rank) AS first FROM lists GROUP BY 1, 2)
  SELECT question_id, doc, rrf_score, dense_rank, bm25_rank, row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, first, doc) AS fused_rank FROM f""")
def r09_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _bm25(spark, sf_dir, False).withColumn("list_no", F.lit(0)).unionByName(_bm25(spark, sf_dir, True).withColumn("list_no", F.lit(1)))
    return lexical.rrf(lists)


@query("SELECT c_custkey, c_mktsegment, round(CASE WHEN h = l THEN CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END ELSE (c_acctbal - l) / (h - l) END, 6) AS scaled FROM customer JOIN (SELECT c_mktsegment, min(c_acctbal) AS l, max(c_acctbal) AS h FROM customer GROUP BY 1) USING (c_mktsegment)")
def t10_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lexical.minmax(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment")
    return c.select("c_custkey", "c_mktsegment", F.round("c_acctbal_scaled", 6).alias("scaled"))


@query("SELECT a.vec_id, b.vec_id AS next_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def t12_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return e.join(after, F.col("next_id") == F.col("vec_id") + 1).select("vec_id", "next_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("""SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) QUALIFY rank <= 10""")
def r07_dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return dense.dense_top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("""SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.label = 3) QUALIFY rank <= 5""")
def r07_dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = dense.dense_top_k(e.where("label = 3"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return found.withColumn("label", F.lit(3)).select("query_id", "vec_id", "label", "score", "rank")


@query("SELECT item_id, text AS repaired FROM benchmark")
def t14_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "benchmark").select("item_id", T.repair_mojibake(spoiled).alias("repaired"))


@query(f"""SELECT item_id, sha1(text) AS sha1, md5(text) AS md5, sha256(text) AS sha256, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[((instr('0123456789abcdef', h[17]) - 1) % 4 + 1)] || h[18:20] || '-' || h[21:32] AS uuid5
  FROM (SELECT item_id, text, sha1(from_hex('{UUID_NAMESPACE.replace("-", "")}') || encode(text)) AS h FROM benchmark)""")
def t15_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    raw = F.col("text").cast("binary")
    return b.select("item_id", F.sha1(raw).alias("sha1"), F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"), T.uuid5(UUID_NAMESPACE, F.col("text")).alias("uuid5"))


@query("""SELECT lower(trim(text)) AS key, min(doc_id) AS first_id, first(source ORDER BY doc_id) AS source FROM documents GROUP BY 1""")
def g03_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").withColumn("key", F.lower(F.trim("text")))
    return lexical.first_of(keyed, ["key"], ["doc_id"]).select("key", F.col("doc_id").alias("first_id"), "source")


