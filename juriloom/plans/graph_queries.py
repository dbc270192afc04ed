"""Queries over the provision tree and its versions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key
from juriloom.operators import graph, versioning
from juriloom.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, with_edges: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {NODES_SQL}{',' + EDGES_SQL if with_edges else ''}{sql}"
        return f

    return add


CLOSURE = """, closure AS (SELECT node_id AS ancestor, node_id, 0 AS distance FROM nodes UNION ALL SELECT n.parent_id, c.node_id, c.distance + 1 FROM closure c JOIN nodes n ON n.node_id = c.ancestor WHERE n.parent_id IS NOT NULL)"""


@query(" SELECT node_id, doc_id, node_type, label, text, parent_id, level, article, clause, point, path_title, law_type, doc_number, CAST(year AS INT) AS year, issuing_agency, CAST(order_index AS INT) AS order_index FROM nodes")
def g01_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir)


@query(" SELECT parent_id AS source_id, node_id AS target_id, 'HAS_CHILD' AS relation_type, doc_id FROM nodes WHERE parent_id IS NOT NULL")
def g01_has_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.has_child_edges(nodes(spark, sf_dir))


@query(", p AS (SELECT parent_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1) SELECT n.node_id, coalesce(a.n, 0) AS n_children, coalesce(b.n - 1, 0) AS n_siblings FROM nodes n LEFT JOIN p a ON a.parent_id = n.node_id LEFT JOIN p b ON b.parent_id = n.parent_id")
def g04_adjacency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_counts(nodes(spark, sf_dir)).select("node_id", "n_children", "n_siblings")


@query(CLOSURE + " SELECT node_id, string_agg(label, ' > ' ORDER BY level) FILTER (node_type <> 'document') AS path FROM (SELECT c.node_id, a.label, a.level, a.node_type FROM closure c JOIN nodes a ON a.node_id = c.ancestor) GROUP BY node_id HAVING path IS NOT NULL UNION ALL SELECT node_id, '' FROM nodes WHERE node_type = 'document'")
def p08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(nodes(spark, sf_dir))


@query(CLOSURE + " SELECT ancestor, count(*) AS n_below, max(distance) AS depth FROM closure GROUP BY ancestor")
def p09_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(nodes(spark, sf_dir)).groupBy("ancestor").agg(F.count("*").alias("n_below"), F.max("distance").alias("depth"))


@query(CLOSURE + " SELECT r.node_id, count(*) AS n_nodes, string_agg(n.text, chr(10) ORDER BY n.order_index) AS subtree_text FROM nodes r JOIN closure c ON c.ancestor = r.node_id JOIN nodes n ON n.node_id = c.node_id WHERE r.node_type = 'article' GROUP BY r.node_id")
def g07_subtree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subtrees(nodes(spark, sf_dir), "article")


@query(""", f AS (SELECT parent_id, list(node_id ORDER BY order_index) AS family FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1)
  SELECT n.node_id, n.doc_id, n.text AS snippet, array_to_string(coalesce(list_filter(family, lambda x: x <> n.node_id)[1:12], []), ',') AS sibling_ids,
  concat_ws(chr(10), n.law_type || ' ' || n.doc_number, nullif(n.path_title, ''), p.label, n.text) AS retrieval_text FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_id LEFT JOIN f ON f.parent_id = n.parent_id""")
def p10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunks(nodes(spark, sf_dir))


@query(""" SELECT d.doc_id, concat_ws(chr(10), d.text, h) AS sketch, coalesce(n, 0) AS n_articles FROM nodes d LEFT JOIN (SELECT doc_id, array_to_string(list(text ORDER BY order_index)[1:15], chr(10)) AS h, count(*) AS n FROM nodes WHERE node_type = 'article' GROUP BY 1) USING (doc_id) WHERE d.node_type = 'document'""")
def p11_doc_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.doc_sketches(nodes(spark, sf_dir))


@query(CLOSURE + " SELECT r.doc_id, r.node_id || '_bundle' AS bundle_id, md5(string_agg(n.text, chr(10) ORDER BY n.order_index)) AS text_md5 FROM nodes r JOIN closure c ON c.ancestor = r.node_id JOIN nodes n ON n.node_id = c.node_id WHERE r.node_type = 'article' GROUP BY ALL")
def p12_article_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    bundles = graph.subtrees(n, "article").join(n.select("node_id", "doc_id"), "node_id")
    return bundles.select("doc_id", F.concat("node_id", F.lit("_bundle")).alias("bundle_id"), F.md5(F.col("subtree_text").cast("binary")).alias("text_md5"))


@query(" SELECT doc_id, arg_min(doc_number, order_index) AS doc_number, arg_min(law_type, order_index) AS law_type, arg_min(year, order_index) AS year, count(*) FILTER (node_type = 'article') AS n_articles, count(*) FILTER (node_type = 'clause') AS n_clauses, count(*) AS n_nodes FROM nodes GROUP BY doc_id")
def g10_document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.document_index(nodes(spark, sf_dir))


CHOSEN = ", chosen AS (SELECT * FROM nodes WHERE order_index % 5 = 1)"


def _chosen(n: DataFrame) -> DataFrame:
    return n.where("order_index % 5 = 1")


@query(CHOSEN + """ SELECT c.node_id, 'child' AS relation, n.node_id AS related_id, 0.7 AS score FROM chosen c JOIN nodes n ON n.parent_id = c.node_id
  UNION ALL SELECT node_id, 'parent', parent_id, 0.6 FROM chosen WHERE parent_id IS NOT NULL
  UNION ALL SELECT c.node_id, 'sibling', n.node_id, 0.5 FROM chosen c JOIN nodes n ON n.parent_id = c.parent_id AND n.node_id <> c.node_id""")
def g11_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.relations(n, _chosen(n))


@query(CHOSEN + """, r AS (SELECT c.node_id, n.node_id AS related_id, n.doc_id, n.order_index FROM chosen c JOIN nodes n ON n.parent_id = c.node_id UNION SELECT c.node_id, n.node_id, n.doc_id, n.order_index FROM chosen c JOIN nodes n ON n.parent_id = c.parent_id AND n.node_id <> c.node_id)
  SELECT node_id, string_agg(related_id, ',' ORDER BY doc_id, order_index, related_id) AS related_ids FROM r GROUP BY node_id""")
def g12_relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    related = graph.relations(n, _chosen(n)).where("relation <> 'parent'").select("node_id", "related_id").distinct()
    placed = related.join(n.select(F.col("node_id").alias("related_id"), "doc_id", "order_index"), "related_id")
    order = F.array_sort(F.collect_list(F.struct("doc_id", "order_index", "related_id")))
    return placed.groupBy("node_id").agg(F.array_join(F.transform(order, lambda x: x["related_id"]), ",").alias("related_ids"))


@query(""", k AS (SELECT doc_id, path_title, arg_min(n.node_id, order_index) AS counterpart FROM nodes n WHERE EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.node_id) GROUP BY 1, 2) SELECT n.node_id, k.counterpart FROM nodes n JOIN k USING (doc_id, path_title) WHERE n.node_type = 'article'""")
def g13_counterpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    bearing = graph.with_counts(n).where("n_children > 0").groupBy("doc_id", "path_title").agg(F.min_by("node_id", "order_index").alias("counterpart"))
    return n.where("node_type = 'article'").join(bearing, ["doc_id", "path_title"]).select("node_id", "counterpart")


@query(CLOSURE + " SELECT c.node_id, arg_max(ancestor, distance) AS heading_id, max(distance) AS distance FROM closure c JOIN nodes a ON a.node_id = c.ancestor WHERE a.node_type = 'article' GROUP BY c.node_id")
def g14_ancestor_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    up = graph.closure(n).join(n.where("node_type = 'article'").select(F.col("node_id").alias("ancestor")), "ancestor")
    return up.groupBy("node_id").agg(F.max_by("ancestor", "distance").alias("heading_id"), F.max("distance").alias("distance"))


@query(CLOSURE + """, hits AS (SELECT node_id, 'trách nhiệm' AS term FROM nodes WHERE node_type = 'clause') SELECT h.node_id, term, arg_min(ancestor, distance) AS ancestor, 1.4 AS score FROM hits h JOIN closure c ON c.node_id = h.node_id AND distance > 0 JOIN nodes a ON a.node_id = c.ancestor WHERE contains(lower(a.text), term) GROUP BY 1, 2""")
def g15_promote_to_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    hits = n.where("node_type = 'clause'").select("node_id", F.lit("trách nhiệm").alias("term"), F.lit(1.0).alias("score"))
    return graph.promote_to_ancestor(n, hits)


@query(CHOSEN + """, placed AS (SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY order_index) AS place FROM nodes WHERE parent_id IS NOT NULL)
  SELECT a.node_id, b.node_id AS sibling_id, CAST(b.place - a.place AS INT) AS step, CAST(row_number() OVER (PARTITION BY a.node_id ORDER BY abs(b.place - a.place), b.place - a.place) AS INT) AS rank FROM placed a JOIN chosen USING (node_id) JOIN placed b ON b.parent_id = a.parent_id AND b.place <> a.place AND abs(b.place - a.place) <= 2""")
def g16_sibling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.sibling_window(n, _chosen(n))


REFS = r""", refs AS (SELECT node_id, doc_id, 0 AS ref_no, 'Điều ' || regexp_extract(text, 'Điều (\d+)', 1) AS target_article, 'Khoản ' || regexp_extract(text, 'khoản (\d+)', 1) AS target_clause, 'Điểm ' || nullif(regexp_extract(text, 'điểm ([a-zđ])', 1), '') AS target_point FROM nodes WHERE node_type IN ('clause', 'point'))"""


@query(REFS + " SELECT * FROM refs")
def g17_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_references(nodes(spark, sf_dir))


@query(REFS + """, fits AS (SELECT r.node_id, r.ref_no, r.target_article, r.target_clause, r.target_point, n.node_id AS target_id, row_number() OVER (PARTITION BY r.node_id, r.ref_no ORDER BY CASE WHEN n.clause = r.target_clause THEN 1 ELSE 0 END + CASE WHEN n.point = r.target_point THEN 1 ELSE 0 END DESC, n.order_index DESC) AS k
  FROM refs r JOIN nodes n ON n.doc_id = r.doc_id AND n.article = r.target_article AND (n.clause = r.target_clause OR n.clause IS NULL) AND (n.point = r.target_point OR n.point IS NULL)) SELECT * EXCLUDE (k) FROM fits WHERE k = 1""")
def g18_resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.resolve_references(n, graph.cross_references(n))


@query(REFS + " SELECT r.node_id, r.ref_no, min(n.order_index) AS first_index FROM refs r JOIN nodes n ON n.doc_id = r.doc_id AND n.node_type = 'clause' AND n.article = r.target_article AND n.clause = r.target_clause GROUP BY 1, 2")
def g19_typed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    targets = n.where("node_type = 'clause'").select("doc_id", F.col("article").alias("target_article"), F.col("clause").alias("target_clause"), "order_index")
    return graph.cross_references(n).join(targets, ["doc_id", "target_article", "target_clause"]).groupBy("node_id", "ref_no").agg(F.min("order_index").alias("first_index"))


@query(" SELECT parent_id AS node_id, array_to_string(list(node_id || ': ' || text[1:40] ORDER BY order_index)[1:5], ' | ') AS preview, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")
def g20_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.previews(nodes(spark, sf_dir))


@query(r" SELECT node_id, EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.node_id) AND contains(regexp_replace(lower(path_title), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS header_only FROM nodes n")
def g21_header_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.header_only(nodes(spark, sf_dir))


INDEX = ", idx AS (SELECT doc_id, replace(article, 'Điều ', '') AS article_key, coalesce(replace(clause, 'Khoản ', ''), '') AS clause_key, coalesce(replace(point, 'Điểm ', ''), '') AS point_key, string_agg(node_id, ',' ORDER BY order_index) AS node_ids FROM nodes WHERE article IS NOT NULL GROUP BY ALL)"


@query(INDEX + " SELECT * FROM idx")
def v02_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.reference_index(nodes(spark, sf_dir))


@query(INDEX + """, w AS (SELECT source_id, doc_id, replace(target_article, 'Điều ', '') AS article_key, coalesce(replace(target_clause, 'Khoản ', ''), '') AS clause_key, coalesce(replace(target_point, 'Điểm ', ''), '') AS point_key FROM edges)
  SELECT w.*, coalesce(a.node_ids, c.node_ids, b.node_ids) AS node_ids, CASE WHEN a.node_ids IS NOT NULL THEN 'exact' WHEN c.node_ids IS NOT NULL THEN 'clause' WHEN b.node_ids IS NOT NULL THEN 'article' ELSE 'none' END AS how FROM w LEFT JOIN idx a USING (doc_id, article_key, clause_key, point_key)
  LEFT JOIN idx c ON c.doc_id = w.doc_id AND c.article_key = w.article_key AND c.clause_key = w.clause_key AND c.point_key = '' LEFT JOIN idx b ON b.doc_id = w.doc_id AND b.article_key = w.article_key AND b.clause_key = '' AND b.point_key = ''""", True)
def v03_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.resolve(versioning.reference_index(nodes(spark, sf_dir)), edges(spark, sf_dir))


EVENTS = r""", ev AS (SELECT e.doc_id, e.source_id, relation_type, n.doc_number AS source_doc_number, upper(regexp_extract(target_text, '^(Nghị định \d+/\d+/NĐ-CP)', 1)) AS target_doc_number,
  CASE WHEN target_point IS NOT NULL THEN 'point' WHEN target_clause IS NOT NULL THEN 'clause' ELSE 'article' END AS target_scope, target_article, target_clause, target_point, regexp_extract(target_text, '\d\d/\d\d/\d{4}') AS dates FROM edges e JOIN nodes n ON n.node_id = e.source_id)"""


@query(EVENTS + " SELECT * FROM ev", True)
def v04_version_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.events(edges(spark, sf_dir), nodes(spark, sf_dir))


VERSIONS = EVENTS + INDEX + """, ch AS (SELECT doc_id, replace(target_article, 'Điều ', '') AS article_key, coalesce(replace(target_clause, 'Khoản ', ''), '') AS clause_key, coalesce(replace(target_point, 'Điểm ', ''), '') AS point_key, count(*) FILTER (relation_type = 'AMENDS') AS n_amended, count(*) FILTER (relation_type = 'REPEALS') AS n_repealed, count(*) FILTER (relation_type = 'REPLACES') AS n_replaced, count(*) AS n_events, min(source_id) FILTER (relation_type = 'REPEALS') AS first_repealed_by FROM ev GROUP BY ALL),
  versions AS (SELECT doc_id, article_key, clause_key, point_key, coalesce(node_ids, '') AS node_ids, coalesce(n_amended, 0) AS n_amended, coalesce(n_repealed, 0) AS n_repealed, coalesce(n_replaced, 0) AS n_replaced, coalesce(n_events, 0) AS n_events, first_repealed_by,
    CASE WHEN n_repealed > 0 THEN 'repealed' WHEN n_replaced > 0 THEN 'replaced' WHEN n_amended > 0 THEN 'amended' WHEN n_events > 0 THEN 'effective_info_found' ELSE 'base' END AS status FROM idx FULL JOIN ch USING (doc_id, article_key, clause_key, point_key))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return versioning.version_map(n, versioning.events(edges(spark, sf_dir), n))


@query(VERSIONS + " SELECT * FROM versions", True)
def v05_version_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query(VERSIONS + " SELECT status, count(*) AS n_refs, sum(n_events)::BIGINT AS n_events FROM versions GROUP BY status", True)
def v09_version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_refs"), F.sum("n_events").alias("n_events"))


@query(VERSIONS + " SELECT n.node_id, coalesce(v.status, 'base') AS status, coalesce(v.n_events, 0) AS n_events FROM nodes n LEFT JOIN versions v ON v.doc_id = n.doc_id AND v.article_key = replace(n.article, 'Điều ', '') AND v.clause_key = coalesce(replace(n.clause, 'Khoản ', ''), '') AND v.point_key = coalesce(replace(n.point, 'Điểm ', ''), '')", True)
def v08_annotated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.annotate(nodes(spark, sf_dir), _versions(spark, sf_dir)).select("node_id", "status", "n_events")


@query(EVENTS + " SELECT source_doc_number, relation_type, count(*) AS n FROM ev WHERE target_doc_number <> '' GROUP BY 1, 2", True)
def v10_document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versioning.events(edges(spark, sf_dir), nodes(spark, sf_dir))
    return found.where("target_doc_number <> ''").groupBy("source_doc_number", "relation_type").agg(F.count("*").alias("n"))


@query(", r AS (SELECT doc_id, n.node_id, lower(text) AS t FROM nodes n WHERE node_type = 'clause') SELECT doc_id, count(*) FILTER (contains(t, 'sửa đổi')) AS n_change_like FROM r GROUP BY 1")
def m01_change_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("node_type = 'clause'")
    return n.groupBy("doc_id").agg(F.count_if(F.contains(norm_key("text"), F.lit("sửa đổi"))).alias("n_change_like"))


@query(""", r AS (SELECT parent_id, order_index, text, sum(length(text) + 2) OVER (PARTITION BY parent_id ORDER BY order_index) AS used FROM nodes WHERE node_type = 'clause') SELECT parent_id AS node_id, string_agg(text, chr(10) || chr(10) ORDER BY order_index) AS packed FROM r WHERE used <= 120 GROUP BY 1""")
def m02_packed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = nodes(spark, sf_dir).where("node_type = 'clause'")
    used = F.sum(F.length("text") + 2).over(Window.partitionBy("parent_id").orderBy("order_index"))
    return clauses.withColumn("used", used).where("used <= 120").groupBy(F.col("parent_id").alias("node_id")).agg(graph.ordered_text("order_index", "text", "\n\n").alias("packed"))


@query(""" SELECT 'article' AS level, parent_id AS node_id, array_to_string(list(text ORDER BY order_index)[1:3], ' ')[1:500] AS summary FROM nodes WHERE node_type = 'clause' GROUP BY 2
  UNION ALL SELECT 'document', doc_id, array_to_string(list(text ORDER BY order_index)[1:3], ' ')[1:500] FROM nodes WHERE node_type = 'article' GROUP BY 2
  UNION ALL SELECT 'community', law_type, array_to_string(list(text ORDER BY doc_id, order_index)[1:3], ' ')[1:500] FROM nodes WHERE node_type = 'document' GROUP BY 2""")
def m04_level_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)

    def level(name: str, kind: str, key: str) -> DataFrame:
        # only the three first of a group are kept before they are put together, so a group of any size costs three rows
        first = n.where(F.col("node_type") == kind).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "order_index"))).where("k <= 3")
        return first.groupBy(F.lit(name).alias("level"), F.col(key).alias("node_id")).agg(F.substring(graph.ordered_text("k", "text", " "), 1, 500).alias("summary"))

    return level("article", "clause", "parent_id").unionByName(level("document", "article", "doc_id")).unionByName(level("community", "document", "law_type"))
