"""Queries for planners, rerankers, exact passages, caches and the whole workflow."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juriloom.lineage import cut
from juriloom.operators import planning, reranking, retrieval, versioning
from juriloom.plans import jobs, rag_queries
from juriloom.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from juriloom.plans.graph_queries import VERSIONS
from juriloom.plans.rag_queries import PROFILES, SCORED, questions
from juriloom.plans.walk_queries import EVIDENCE, SELECTED, _selected

QUERIES, ORACLES = {}, {}


def query(sql: str, base: str = "nodes"):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = {"nodes": f"WITH RECURSIVE {NODES_SQL}", "edges": f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}", "": ""}[base] + sql
        return f

    return add


@query(PROFILES + """ SELECT question_id, coalesce(article IS NOT NULL OR clause IS NOT NULL OR point IS NOT NULL OR ((doc_number IS NOT NULL OR law_type IS NOT NULL OR year IS NOT NULL) AND (route IN ('direct_reference', 'document_focus', 'heading_list', 'version_change') OR change <> '')) OR (heading <> '' AND route IN ('heading_list', 'document_focus')), false) AS rules_suffice FROM profiles""")
def q07_rules_suffice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.profile(questions(nodes(spark, sf_dir))).select("question_id", planning.rules_suffice().alias("rules_suffice"))


PLANNED = """, planned AS (SELECT question_id, CASE WHEN k % 3 = 0 THEN 'theo  điều 12A' WHEN k % 3 = 1 THEN 'null' END AS article, CASE WHEN k % 2 = 0 THEN ' điểm Đ ' END AS point, CASE k % 4 WHEN 0 THEN 'Nghị định' WHEN 1 THEN 'Sách' END AS law_type, CASE WHEN k % 5 = 0 THEN '2021' END AS year FROM (SELECT question_id, length(question_id) + ascii(right(question_id, 1)) AS k FROM questions))"""


@query(PROFILES + PLANNED + """ SELECT p.question_id, coalesce(CASE WHEN x.article LIKE '%12A' THEN 'Điều 12a' END, p.article) AS article, coalesce(CASE WHEN x.point IS NOT NULL THEN 'Điểm đ' END, p.point) AS point, coalesce(CASE WHEN x.law_type = 'Nghị định' THEN x.law_type END, p.law_type) AS law_type, coalesce(CAST(x.year AS INT), p.year) AS year FROM profiles p JOIN planned x ON x.question_id = p.question_id""")
def q08_merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner might add, made up from the ids."""
    n = cut(nodes(spark, sf_dir))
    k = F.length("question_id") + F.ascii(F.substring("question_id", -1, 1))
    planned = questions(n).select(
        "question_id", F.when(k % 3 == 0, "theo  điều 12A").when(k % 3 == 1, "null").alias("article"), F.when(k % 2 == 0, " Đ ").alias("point"),
        F.when(k % 4 == 0, "Nghị định").when(k % 4 == 1, "Sách").alias("law_type"), F.when(k % 5 == 0, "2021").alias("year"),
    )
    return planning.merge(planning.profile(questions(n)), planned).select("question_id", "article", "point", "law_type", "year")


@query(""", d AS (SELECT node_id AS question_id, CASE order_index % 3 WHEN 0 THEN text || ' quy định về vấn đề gì?' WHEN 1 THEN 'Phạm vi điều chỉnh là gì?' ELSE text END AS question FROM nodes WHERE node_type IN ('document', 'article'))
  SELECT question_id, (contains(lower(question), 'quy định về vấn đề gì') OR contains(lower(question), 'phạm vi điều chỉnh là gì')) AND (contains(lower(question), 'nghị định') OR contains(lower(question), 'thông tư') OR contains(lower(question), 'quyết định') OR contains(lower(question), 'luật')) AS whole_document FROM d""")
def q13_whole_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("order_index") % 3
    asked = F.when(kind == 0, F.concat("text", F.lit(" quy định về vấn đề gì?"))).when(kind == 1, "Phạm vi điều chỉnh là gì?").otherwise(F.col("text"))
    rows = nodes(spark, sf_dir).where("node_type in ('document', 'article')").select(F.col("node_id").alias("question_id"), asked.alias("question"))
    return rows.select("question_id", planning.asks_for_whole_document().alias("whole_document"))


@query(SCORED + VERSIONS + """, st AS (SELECT f.*, CASE WHEN f.qch <> '' THEN least(0.22, (CASE WHEN coalesce(v.status, 'base') <> 'base' THEN 0.1 ELSE 0 END) + least(0.12, 0.03 * coalesce(v.n_events, 0))) ELSE 0 END AS structure FROM s f
    LEFT JOIN versions v ON v.doc_id = f.doc_id AND v.article_key = replace(f.article, 'Điều ', '') AND v.clause_key = coalesce(replace(f.clause, 'Khoản ', ''), '') AND v.point_key = coalesce(replace(f.point, 'Điểm ', ''), ''))
  SELECT question_id, node_id, round(exact, 6) AS exact, round(bonus, 6) AS reference_bonus, round(structure, 6) AS structure_bonus, round(0.34 * exact + 0.24 * hybrid + 0.12 * cov + 0.12 * prior + 0.10 * structure + 0.08 * bonus + least(0.24, 0.24 * cov), 6) AS candidate_score FROM st""", "edges")
def r12_reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the score in mode exact, with the candidates' versions."""
    n = cut(nodes(spark, sf_dir))
    states = versioning.version_map(n, versioning.events(edges(spark, sf_dir), n))
    known = versioning.annotate(n, states).select("node_id", "status", "n_events")
    scored = retrieval.score_candidates(rag_queries._profiles(n), rag_queries._candidates(n).join(known, "node_id"), mode="exact")
    return scored.select("question_id", "node_id", *[F.round(c, 6).alias(c) for c in ("exact", "reference_bonus", "structure_bonus")], "candidate_score")


@query(SCORED + " SELECT question_id, node_id, round(CASE WHEN ex THEN hybrid ELSE 0.55 * 0.5 + 0.45 * hybrid END, 6) AS hybrid FROM scored")
def r15_dense_where_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit references are scored without vectors; every vector agrees by a half here."""
    n = cut(nodes(spark, sf_dir))
    scored = retrieval.score_candidates(rag_queries._profiles(n), rag_queries._candidates(n).withColumn("dense", F.lit(0.5)))
    return scored.select("question_id", "node_id", F.round("hybrid", 6).alias("hybrid"))


def _length_scorer(question: Column, text: Column) -> Column:
    """Stands in for a model: longer texts score higher, up to 1."""
    return F.least(F.length(text) / 1000, F.lit(1.0))


DOCUMENTS = SCORED + """, two AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY candidate_score DESC, node_id) AS k FROM scored QUALIFY k <= 2),
  d AS (SELECT question_id, doc_id, round(0.45 * max(candidate_score) + 0.25 * avg(candidate_score) + 0.20 * max(cov) + 0.10 * max(prior), 4) AS doc_score FROM two GROUP BY 1, 2)"""


@query(DOCUMENTS + """, proof AS (SELECT question_id, doc_id, string_agg('[Bằng chứng ' || k || '] ' || CASE WHEN n.path_title = '' THEN '-' ELSE n.path_title END || chr(10) || n.text[1:420], chr(10) ORDER BY k) AS p FROM two JOIN (SELECT node_id, path_title, text FROM nodes) n USING (node_id) GROUP BY 1, 2),
  packs AS (SELECT d.question_id, d.doc_id, doc_score, 'Văn bản: ' || n.text || chr(10) || 'Số văn bản: ' || n.doc_number || chr(10) || 'Loại văn bản: ' || n.law_type || chr(10) || p AS pack FROM d JOIN proof USING (question_id, doc_id) JOIN nodes n ON n.node_id = d.doc_id)
  SELECT question_id, doc_id, round(0.65 * least(length(regexp_replace(pack, '\\s+', ' ', 'g')) / 1000, 1) + 0.35 * doc_score, 6) AS doc_final_score, 1 AS rank FROM packs""".replace("\\\\", "\\"))
def r18_reranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(nodes(spark, sf_dir))
    scored = cut(retrieval.score_candidates(rag_queries._profiles(n), rag_queries._candidates(n), mode="content"))
    titles = n.where("node_type = 'document'").select("doc_id", F.col("text").alias("title"), "doc_number", "law_type", F.lit("").alias("sketch"))
    packed = reranking.evidence_packs(retrieval.documents_of(scored).select("question_id", "doc_id", "doc_score"), scored, titles)
    return reranking.rerank_documents(packed, questions(n), _length_scorer)


RANKED = """, ranked AS (SELECT doc_id AS question_id, node_id, 'q' AS question, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY order_index) AS INT) AS rank FROM nodes),
  again AS (SELECT question_id, node_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY least(length(text) / 1000, 1) DESC, ranked.rank, node_id) AS INT) AS rank FROM (SELECT question_id, node_id, text, rank FROM ranked WHERE rank <= 30) ranked QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY least(length(text) / 1000, 1) DESC, ranked.rank, node_id) <= 5)"""


def _ranked(n: DataFrame) -> DataFrame:
    return n.select(F.col("doc_id").alias("question_id"), "node_id", F.lit("q").alias("question"), "text", (F.col("order_index") + 1).alias("rank"))


@query(RANKED + " SELECT * FROM again")
def r19_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.rerank(_ranked(nodes(spark, sf_dir)), 5, _length_scorer).select("question_id", "node_id", "rank")


@query(RANKED + """ SELECT question_id, node_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY part, x.rank, node_id) AS INT) AS rank FROM (SELECT question_id, node_id, rank, 0 AS part FROM again UNION ALL SELECT question_id, node_id, rank, 1 FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM again a WHERE a.node_id = r.node_id)) x""")
def r20_reranked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.rerank_with_rest(cut(_ranked(nodes(spark, sf_dir))), 5, _length_scorer).select("question_id", "node_id", "rank")


@query(PROFILES + """, hit AS (SELECT q.question_id, n.node_id, CASE WHEN q.article IS NULL THEN 0 ELSE 0.5 END + CASE WHEN q.clause IS NULL THEN 0 ELSE 0.3 END + CASE WHEN q.point IS NULL THEN 0 ELSE 0.2 END AS exact FROM profiles q JOIN nodes n ON n.doc_number = q.doc_number AND n.node_type = CASE WHEN q.point IS NOT NULL THEN 'point' WHEN q.clause IS NOT NULL THEN 'clause' ELSE 'article' END AND n.article = q.article AND (q.clause IS NULL OR n.clause = q.clause) AND (q.point IS NULL OR n.point = q.point)),
  ord AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY exact DESC, node_id) AS INT) AS place FROM hit)
  SELECT question_id, node_id, round(exact, 6) AS exact, place, n_nodes, text FROM ord JOIN (SELECT a.node_id, count(*) AS n_nodes, string_agg(n.text, chr(10) ORDER BY n.order_index) AS text FROM (SELECT DISTINCT node_id FROM ord) a JOIN nodes n ON n.node_id = a.node_id OR starts_with(n.node_id, a.node_id || '_') GROUP BY 1) USING (node_id)""")
def r21_exact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(nodes(spark, sf_dir))
    p = cut(rag_queries._profiles(n))
    documents = p.where("doc_number is not null").select("question_id", "doc_number").join(n.where("node_type = 'document'").select("doc_id", "doc_number"), "doc_number").select("question_id", "doc_id", F.lit(1.0).alias("doc_final_score"))
    return reranking.exact_passages(p, documents, n)


@query(SELECTED + """, twice AS (SELECT question_id, CASE WHEN rank = 2 THEN '' ELSE s.node_id END AS node_id, n.text, rank FROM sel s JOIN nodes n ON n.node_id = s.node_id UNION ALL SELECT question_id, s.node_id, n.text, rank + 10 FROM sel s JOIN nodes n ON n.node_id = s.node_id)
  SELECT question_id, node_id, text, rank FROM twice QUALIFY row_number() OVER (PARTITION BY question_id, coalesce(nullif(node_id, ''), lower(text)) ORDER BY rank) = 1""")
def r24_first_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage is there twice, the second one once without its id."""
    n = cut(nodes(spark, sf_dir))
    chosen = _selected(n).join(n.select("node_id", "text"), "node_id")
    twice = chosen.withColumn("node_id", F.when(F.col("rank") == 2, "").otherwise(F.col("node_id"))).unionByName(chosen.withColumn("rank", F.col("rank") + 10))
    return reranking.first_of_each(twice).select("question_id", "node_id", "text", "rank")


@query(""", g AS (SELECT parent_id AS group_id, list(text ORDER BY order_index) AS t FROM nodes WHERE node_type = 'clause' GROUP BY 1) SELECT group_id, md5(array_to_string(t, chr(10))) AS cache_key, CASE WHEN length(array_to_string(t[1:3], ' ')) > 60 THEN rtrim(array_to_string(t[1:3], ' ')[1:60]) || '...' ELSE array_to_string(t[1:3], ' ') END AS summary FROM g""")
def m03_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = nodes(spark, sf_dir).where("node_type = 'clause'")
    groups = c.groupBy(F.col("parent_id").alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x["text"]).alias("texts"))
    return jobs.summaries(groups, chars=60)


@query(" SELECT node_id, length(text) AS size, order_index % 2 = 0 AS even FROM nodes")
def t13_cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of one number, the length; texts of even nodes are in the cache before."""
    n = cut(nodes(spark, sf_dir)).select("node_id", "text", "order_index")
    embed = lambda c: F.array(F.length(c))
    _, cache = jobs.embedded(n.where("order_index % 2 = 0"), None, embed)
    every, _ = jobs.embedded(n, cache, embed)
    return every.select("node_id", F.col("embedding")[0].cast("long").alias("size"), (F.col("order_index") % 2 == 0).alias("even"))


@query(EVIDENCE + f""", g AS (SELECT p.question_id, p.doc_number, p.article, p.clause, p.point, list_distinct(list_filter(w, lambda x: length(x) >= 4)) AS lw FROM phrases p),
  j AS (SELECT g.question_id, count(n.text) AS n, any_value(len(lw)) AS asked, bool_and(g.doc_number IS NULL) AS nd, bool_or(coalesce(g.doc_number = n.doc_number, false)) AS md, bool_and(g.article IS NULL) AS na, bool_or(coalesce(g.article = n.article, false)) AS ma, bool_and(g.clause IS NULL) AS nc, bool_or(coalesce(g.clause = n.clause, false)) AS mc, bool_and(g.point IS NULL) AS np, bool_or(coalesce(g.point = n.point, false)) AS mp,
    len(list_distinct(flatten(list(list_filter(lw, lambda x: contains(lower(n.text), x)))))) AS hits FROM g LEFT JOIN evidence e USING (question_id) LEFT JOIN nodes n USING (node_id) GROUP BY 1)
  SELECT question_id, n > 0 AND (nd OR md) AND (na OR ma) AND (nc OR mc) AND (np OR mp) AND (asked = 0 OR hits >= greatest(1, least(3, floor(asked / 4)))) AS answered FROM j""")
def a12_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions get past the grading of what the workflow found."""
    n = nodes(spark, sf_dir)
    done = jobs.answer_questions(questions(cut(n)), n)
    return done["grades"].select("question_id", (F.col("status") == "sufficient").alias("answered"))
