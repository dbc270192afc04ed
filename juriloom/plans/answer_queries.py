"""Queries for what stands around retrieval: catalogs, heading search, fusion of several queries, prompts, answers, sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriloom.functions import text as T
from juriloom.lineage import cut
from juriloom.operators import answers, lexical, navigation, planning, retrieval, versioning
from juriloom.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes, table
from juriloom.plans.graph_queries import CLOSURE, EVENTS, VERSIONS
from juriloom.plans.lexical_queries import BM25_SQL, TOKENS
from juriloom.plans.rag_queries import PROFILES, questions
from juriloom.plans.walk_queries import WALKED

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, base: str = "nodes"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            before = {"nodes": f"WITH RECURSIVE {NODES_SQL}", "edges": f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}", "": ""}[base]
            ORACLES[f.__name__] = before + sql
        return f

    return add


@query(" SELECT node_id, replace(article, 'Điều ', '') AS article_key, coalesce(replace(clause, 'Khoản ', ''), '') AS clause_key, coalesce(replace(point, 'Điểm ', ''), '') AS point_key FROM nodes WHERE article IS NOT NULL")
def v01_reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("article is not null").select("node_id", *versioning.ref_keys())


@query(VERSIONS + ", w AS (SELECT DISTINCT doc_id, replace(target_article, 'Điều ', '') AS article_key, coalesce(replace(target_clause, 'Khoản ', ''), '') AS clause_key, coalesce(replace(target_point, 'Điểm ', ''), '') AS point_key FROM edges UNION SELECT doc_id, article_key, '99', 'z' FROM versions UNION SELECT doc_id, '9999', '', '' FROM versions) SELECT w.*, coalesce(v.status, a.status, 'unknown') AS status, coalesce(CASE WHEN v.status IS NULL THEN a.first_repealed_by ELSE v.first_repealed_by END, '') AS repealed_by FROM w LEFT JOIN versions v USING (doc_id, article_key, clause_key, point_key) LEFT JOIN versions a ON a.doc_id = w.doc_id AND a.article_key = w.article_key AND a.clause_key = '' AND a.point_key = ''", "edges")
def v07_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    states = versioning.version_map(n, versioning.events(e, n))
    wanted = e.select("doc_id", *versioning.ref_keys("target_"))
    no_such = states.select("doc_id", "article_key", F.lit("99").alias("clause_key"), F.lit("z").alias("point_key")).unionByName(states.select("doc_id", F.lit("9999").alias("article_key"), F.lit("").alias("clause_key"), F.lit("").alias("point_key")))
    return versioning.current_state(states, wanted.unionByName(no_such).distinct())


@query(EVENTS + " SELECT target_doc_number, count(DISTINCT source_id) AS n_sources FROM ev WHERE relation_type IN ('AMENDS', 'REPEALS', 'REPLACES') GROUP BY 1", "edges")
def g08_amendment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versioning.events(edges(spark, sf_dir), nodes(spark, sf_dir)).where(F.col("relation_type").isin("AMENDS", "REPEALS", "REPLACES"))
    return found.groupBy("target_doc_number").agg(F.countDistinct("source_id").alias("n_sources"))


@query(" SELECT node_id, node_type IN ('article', 'clause', 'point') AND article IS NOT NULL AS reference_capable, node_type IN ('section', 'appendix', 'roman_section') AS section_anchor FROM nodes")
def g09_node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", (F.col("node_type").isin("article", "clause", "point") & F.col("article").isNotNull()).alias("reference_capable"), F.col("node_type").isin("section", "appendix", "roman_section").alias("section_anchor"))


@query(" SELECT node_id, concat_ws(' | ', doc_number, law_type, nullif(path_title, ''), text) AS retrieval_text, sha1(lower(text)) AS cache_key FROM nodes")
def g02_retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.concat_ws(" | ", "doc_number", "law_type", F.nullif("path_title", F.lit("")), "text").alias("retrieval_text"), F.sha1(T.norm_key("text").cast("binary")).alias("cache_key"))


@query(" SELECT node_type, count(*) AS n FROM (SELECT DISTINCT lower(trim(node_id)) AS k, node_type FROM nodes) GROUP BY 1")
def g05_merged_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("node_id", "node_type", "order_index")
    twice = n.withColumn("seq", F.lit(0)).unionByName(n.where("order_index % 7 = 0").withColumn("seq", F.lit(1)))
    merged = lexical.first_of(twice.withColumn("key", F.lower(F.trim("node_id"))), ["key"], ["seq"])
    return merged.groupBy("node_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(i AS INT) AS part, text[i * 700 + 1 : i * 700 + 800] AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 700) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)", "")
def p14_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.size_split(table(spark, sf_dir, "documents"))


@query(PROFILES + " SELECT question_id, split_part(doc_number, '/', 1) || '/' || split_part(doc_number, '/', -1) AS short_number, split_part(doc_number, '/', -1) AS agency_hint FROM profiles WHERE doc_number IS NOT NULL")
def q06_query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("doc_number", "/")
    p = planning.profile(questions(nodes(spark, sf_dir))).where("doc_number is not null")
    return p.select("question_id", F.concat(F.get(parts, 0), F.lit("/"), F.element_at(parts, -1)).alias("short_number"), F.element_at(parts, -1).alias("agency_hint"))


@query(" SELECT node_type, count(*) FILTER (node_type = 'article') AS n_bundles, count(*) FILTER (node_type IN ('article', 'clause')) AS n_references FROM nodes GROUP BY 1")
def r01_candidate_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("node_type").agg(F.count_if(F.col("node_type") == "article").alias("n_bundles"), F.count_if(F.col("node_type").isin("article", "clause")).alias("n_references"))


HEAD = PROFILES + """, hq AS (SELECT question_id, doc_number, list_distinct(list_filter(regexp_extract_all(replace(lower(strip_accents(question)), 'đ', 'd'), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)) AS w FROM profiles WHERE doc_number IS NOT NULL),
  hn AS (SELECT node_id, doc_number, level, list_distinct(list_filter(regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)) AS w FROM nodes WHERE node_type = 'article'),
  hs AS (SELECT question_id, node_id, round(len(list_intersect(q.w, n.w)) / least(len(q.w), len(n.w)) + least(0.03 * level, 0.15), 6) AS score FROM hq q JOIN hn n USING (doc_number) WHERE len(list_intersect(q.w, n.w)) >= 1)"""


@query(HEAD + " SELECT question_id, node_id AS doc, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS INT) AS rank FROM hs WHERE score >= 0.55 QUALIFY rank <= 5")
def r05_heading_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the named document by shared words and depth."""
    n = cut(nodes(spark, sf_dir))
    words = lambda c: F.array_distinct(F.filter(T.tokens(T.ascii_key(c)), lambda w: F.length(w) >= 2))
    asked = planning.profile(questions(n)).where("doc_number is not null").select("question_id", "doc_number", words("question").alias("qw"))
    heads = n.where("node_type = 'article'").select("node_id", "doc_number", "level", words("text").alias("nw"))
    shared = F.size(F.array_intersect("qw", "nw"))
    score = shared / F.least(F.size("qw"), F.size("nw")) + F.least(0.03 * F.col("level"), F.lit(0.15))
    found = asked.join(heads, "doc_number").where(shared >= 1).select("question_id", F.col("node_id").alias("doc"), score.alias("score"))
    return lexical.top_k(found.where(F.round("score", 6) >= 0.55), 5)


EXPAND = f"""WITH q AS (SELECT item_id AS question_id, 0 AS list_no, text FROM benchmark UNION ALL SELECT item_id, 1, array_to_string({TOKENS}[1:5], ' ') FROM benchmark),
d AS (SELECT doc_id, {TOKENS} AS w FROM documents), qt AS (SELECT question_id, list_no, token, count(*) AS qtf FROM (SELECT question_id, list_no, unnest({TOKENS}) AS token FROM q) GROUP BY ALL),
tf AS (SELECT doc_id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY doc_id, token), s AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS a FROM d WHERE len(w) > 0), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
sc AS (SELECT question_id, list_no, doc_id AS doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM qt JOIN tf USING (token) JOIN df USING (token), s GROUP BY 1, 2, 3),
lists AS (SELECT question_id, list_no, doc, row_number() OVER (PARTITION BY question_id, list_no ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 30),
f AS (SELECT question_id, doc, round(sum(1 / (60 + rank)), 9) AS rrf_score, min(list_no * 1000 + rank) AS first FROM lists GROUP BY 1, 2)
SELECT question_id, doc, rrf_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, first, doc) AS INT) AS fused_rank FROM f QUALIFY fused_rank <= 10"""


@query(EXPAND, "")
def r10_expanded_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question and its first words as two queries; their BM25 lists fused."""
    b = table(spark, sf_dir, "benchmark")
    both = b.select(F.concat("item_id", F.lit("|0")).alias("question_id"), T.tokens("text").alias("words")).unionByName(b.select(F.concat("item_id", F.lit("|1")).alias("question_id"), F.slice(T.tokens("text"), 1, 5).alias("words")))
    ranked = lexical.top_k(lexical.bm25(both, table(spark, sf_dir, "documents"), "doc_id", T.tokens("text")), 30)
    part = lambda i: F.split("question_id", r"\|")[i].cast("long")
    lists = ranked.select(part(0).alias("q"), part(1).cast("int").alias("list_no"), "doc", "rank").withColumnRenamed("q", "question_id")
    return lexical.rrf(lists).where("fused_rank <= 10").select("question_id", "doc", "rrf_score", "fused_rank")


@query("SELECT question_id, doc, round(0.55 * 0 + 0.45 * least(1, score / 8), 6) AS hybrid FROM top_full", "")
def r13_hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors the dense part is 0; BM25 counts up to 8."""
    asked = lexical.question_words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    top = lexical.top_k(lexical.bm25(asked, table(spark, sf_dir, "documents"), "doc_id", T.tokens("text")), 10)
    return top.select("question_id", "doc", F.round(0.45 * F.least(F.lit(1.0), F.col("score") / 8), 6).alias("hybrid"))


ORACLES["r13_hybrid_scores"] = f"WITH {BM25_SQL} " + ORACLES["r13_hybrid_scores"]


@query("""SELECT vec_id, doc_id FROM (SELECT e.vec_id, d.doc_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY CASE WHEN d.doc_id = e.vec_id THEN 0 ELSE 1 END, d.doc_id) AS k FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id OR d.doc_id = e.vec_id + 500000) WHERE k = 1""", "")
def r08_mapped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit belongs to the first of its ids that a candidate has."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.array("vec_id", F.col("vec_id") + 500000)).alias("no", "doc_id"))
    found = ids.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return found.groupBy("vec_id").agg(F.min_by("doc_id", "no").alias("doc_id"))


@query(" SELECT doc_id, arg_min(label, (CASE node_type WHEN 'document' THEN 0 WHEN 'article' THEN 2 ELSE 3 END, order_index)) AS best_label, count(*) AS n_members FROM nodes GROUP BY 1")
def r17_document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("node_type") == "document", 0).when(F.col("node_type") == "article", 2).otherwise(3)
    return nodes(spark, sf_dir).groupBy("doc_id").agg(F.min_by("label", F.struct(order, "order_index")).alias("best_label"), F.count("*").alias("n_members"))


@query(""", r AS (SELECT question_id, doc, score, rank FROM top_full), top AS (SELECT question_id, doc, rank AS place FROM r WHERE rank <= 3), rest AS (SELECT question_id, doc, rank AS place FROM r WHERE rank > 3) SELECT * FROM top UNION ALL SELECT * FROM rest""", "")
def r20_reranked_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a reranker the first three stay as they are, and the others follow."""
    asked = lexical.question_words(table(spark, sf_dir, "benchmark"), "item_id", "text")
    ranked = lexical.top_k(lexical.bm25(asked, table(spark, sf_dir, "documents"), "doc_id", T.tokens("text")), 10).select("question_id", "doc", F.col("rank").alias("place"))
    top = ranked.where("place <= 3")
    return top.unionByName(ranked.join(top, ["question_id", "doc"], "left_anti"))


ORACLES["r20_reranked_with_rest"] = f"WITH {BM25_SQL}" + ORACLES["r20_reranked_with_rest"]


@query(CLOSURE + ", s AS (SELECT node_id, concat_ws(' - ', law_type || ' ' || doc_number, nullif(path_title, ''), text[1:120]) AS summary FROM nodes) SELECT * FROM s")
def r25_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.concat_ws(" - ", F.concat("law_type", F.lit(" "), "doc_number"), F.nullif("path_title", F.lit("")), F.substring("text", 1, 120)).alias("summary"))


SHOWN = WALKED + """, passages AS (SELECT w.question_id, n.node_id, n.text, n.path_title, w.rank, CASE WHEN w.rank = 1 THEN 'primary' ELSE 'supporting' END AS role, s.scope FROM walked w JOIN nodes n USING (node_id)
    JOIN scopes s USING (question_id) WHERE w.rank <= 12),
  shown AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN role = 'primary' THEN 0 ELSE 1 END, rank, node_id) AS INT) AS place FROM passages QUALIFY place <= CASE scope WHEN 'list' THEN 12 ELSE 2 END),
  shown_to AS (SELECT p.question_id, p.question, s.scope FROM profiles p JOIN scopes s ON s.question_id = p.question_id),
  blocks AS (SELECT question_id, string_agg('[' || place || '] ' || path_title || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM shown GROUP BY 1)"""


def _shown(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = questions(n).withColumn("scope", planning.scope())
    p = planning.profile(questions(n))
    walked, _ = navigation.navigate(p, n, retrieval.direct_targets(p, n))
    passages = walked.join(n.select("node_id", "text", "path_title"), "node_id").join(asked.select("question_id", "scope"), "question_id").withColumn("role", F.when(F.col("rank") == 1, "primary").otherwise("supporting"))
    return asked, answers.select_passages(passages)


@query(SHOWN + " SELECT question_id, node_id, place FROM shown")
def a03_selected_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cut(nodes(spark, sf_dir)))[1].select("question_id", "node_id", "place")


@query(SHOWN + " SELECT DISTINCT question_id, node_id, text[1:700] AS snippet FROM shown")
def a05_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.sources(_shown(cut(nodes(spark, sf_dir)))[1])


@query(SHOWN + f" SELECT a.question_id, md5(CASE scope {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in answers.INSTRUCTIONS.items())} END || chr(10) || chr(10) || 'Câu hỏi: ' || question || chr(10) || chr(10) || 'Căn cứ:' || chr(10) || coalesce(context, '')) AS prompt_md5 FROM shown_to a LEFT JOIN blocks USING (question_id)")
def a06_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, shown = _shown(cut(nodes(spark, sf_dir)))
    return answers.prompts(asked, answers.contexts(shown)).select("question_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(SHOWN + f" SELECT a.question_id, coalesce(s.text, '{answers.REFUSAL}') AS answer FROM shown_to a LEFT JOIN shown s ON s.question_id = a.question_id AND s.place = 1")
def a07_extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, shown = _shown(cut(nodes(spark, sf_dir)))
    return answers.answer(asked, shown)


RETRY = """, f AS (SELECT node_id AS question_id, doc_id FROM nodes WHERE node_type = 'clause' AND order_index % 40 = 3), c AS (SELECT f.question_id, count(*) AS n FROM f JOIN nodes n ON n.doc_id = f.doc_id AND n.node_type = 'article' GROUP BY 1)
  SELECT question_id, CASE WHEN n = 5 THEN 5 ELSE least(n, 9) END AS n_found, CAST(CASE WHEN n = 5 THEN 0 ELSE 1 END AS INT) AS turn FROM c"""


@query(RETRY)
def a10_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first articles of a document; a second try with more of them where it has not just five."""
    n = cut(nodes(spark, sf_dir))
    asked = n.where("node_type = 'clause' and order_index % 40 = 3").select(F.col("node_id").alias("question_id"), "doc_id")
    total = n.where("node_type = 'article'").groupBy("doc_id").agg(F.count("*").alias("n_all"))

    def retrieve(questions_left: DataFrame, k: int) -> DataFrame:
        arts = questions_left.join(n.where("node_type = 'article'").select("doc_id", "node_id", "order_index"), "doc_id")
        placed = arts.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("order_index"))).where(F.col("r") <= k)
        return placed.join(total, "doc_id").groupBy("question_id").agg(F.count("*").alias("n_found"), F.max("n_all").alias("n_all"))

    return answers.with_retry(asked, retrieve, lambda found: found.where("n_all = 5").select("question_id")).select("question_id", "n_found", "turn")


@query(""", a AS (SELECT node_id AS question_id, text || ' theo ' || doc_number AS answer, article, clause, doc_number, text FROM nodes WHERE node_type = 'clause' AND order_index % 40 = 3), v AS (SELECT question_id, answer, lower('điều ' || regexp_extract(text, 'Điều (\\d+)', 1)) = lower(article) AND lower('khoản ' || regexp_extract(text, 'khoản (\\d+)', 1)) = lower(clause) AS valid FROM a)
  SELECT question_id, CASE WHEN valid THEN answer ELSE '""" + answers.REFUSAL + """' END AS answer, valid FROM v""")
def a11_verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir).where("node_type = 'clause' and order_index % 40 = 3")
    said = own.select(F.col("node_id").alias("question_id"), F.concat("text", F.lit(" theo "), "doc_number").alias("answer"))
    passages = own.select(F.col("node_id").alias("question_id"), "article", "clause", "point", "doc_number")
    return answers.verified(said, retrieval.citations(said, passages))


@query(""" SELECT parent_id AS source_id, parent_id || '_summary' AS target_id, 'HAS_SUMMARY' AS relation_type FROM nodes WHERE node_type = 'clause' GROUP BY 1""")
def m06_summary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("node_type = 'clause'")
    return n.select(F.col("parent_id").alias("source_id")).distinct().select("source_id", F.concat("source_id", F.lit("_summary")).alias("target_id"), F.lit("HAS_SUMMARY").alias("relation_type"))


@query(" SELECT count(*) > 0 AS ready, count(*) AS n_nodes, count(DISTINCT doc_id) AS n_docs FROM nodes")
def e13_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).agg((F.count("*") > 0).alias("ready"), F.count("*").alias("n_nodes"), F.countDistinct("doc_id").alias("n_docs"))

