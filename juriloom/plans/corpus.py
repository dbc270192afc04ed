"""A legal corpus derived from the star schema: customers are documents, orders their articles, lines their clauses.

The third and the sixth clause of an article have a point each, a and đ.

It gives the tree, version and retrieval operators inputs of any size. The same rules stand in SQL in ``NODES_SQL``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kind and code of a document by market segment; heading of an article by priority.
KINDS = {"AUTOMOBILE": ("Nghị định", "NĐ-CP"), "BUILDING": ("Thông tư", "TT-BTC"), "FURNITURE": ("Quyết định", "QĐ-TTG"), "HOUSEHOLD": ("Luật", "QH"), "MACHINERY": ("Chỉ thị", "CT-TTG")}
HEADINGS = {"1-URGENT": "Nguyên tắc", "2-HIGH": "Trách nhiệm", "3-MEDIUM": "Điều kiện", "4-NOT SPECIFIED": "Thời hạn", "5-LOW": "Hồ sơ"}
VERBS = {"A": "AMENDS", "R": "REPEALS", "N": "REPLACES"}
VERB_TEXT = {"A": "Sửa đổi", "R": "Bãi bỏ", "N": "Thay thế"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, values: dict[str, str], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in values.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(default)


#: A line's number within its order can repeat in the data, so lines are numbered anew in this order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.lit(2000) + F.col("c_nationkey")
    return c.select(
        F.col("c_custkey"), F.concat(F.lit("d"), F.col("c_custkey")).alias("doc_id"),
        F.concat(F.col("c_custkey"), F.lit("/"), year, F.lit("/"), _mapped("c_mktsegment", {k: v[1] for k, v in KINDS.items()}, "KH")).alias("doc_number"),
        _mapped("c_mktsegment", {k: v[0] for k, v in KINDS.items()}, "Kế hoạch").alias("law_type"), year.alias("year"), F.col("n_name").alias("issuing_agency"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document, article, clause and point rows in one table; ``order_index`` numbers each document's nodes from 0."""
    docs = documents(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(docs, F.col("o_custkey") == F.col("c_custkey"))
    numbered = orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    article_id = F.concat("doc_id", F.lit("_a"), F.col("n"))
    article = F.concat(F.lit("Điều "), F.col("n"))
    heading = _mapped("o_orderpriority", HEADINGS, "Quy định")
    meta = ["doc_id", "doc_number", "law_type", "year", "issuing_agency"]
    none = F.lit(None).cast("string")
    a = numbered.select(
        *meta, article_id.alias("node_id"), F.lit("article").alias("node_type"), article.alias("label"), F.concat(article, F.lit(". "), heading).alias("text"),
        F.col("doc_id").alias("parent_id"), F.lit(1).alias("level"), article.alias("article"), none.alias("clause"), none.alias("point"), F.concat(article, F.lit(". "), heading).alias("path_title"),
        F.col("o_orderkey").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"),
    )
    lines = lines_of(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    clause = F.concat(F.lit("Khoản "), F.col("l_linenumber"))
    clause_text = F.concat(
        F.col("l_linenumber"), F.lit(". "), _mapped("l_returnflag", VERB_TEXT, "Quy định"), F.lit(" mức "), F.col("l_quantity").cast("long"),
        F.lit(" theo khoản "), 1 + F.col("l_suppkey") % 4, F.lit(" Điều "), 1 + F.col("l_partkey") % 9,
    )
    clause_id, clause_path = F.concat(article_id, F.lit("_c"), F.col("l_linenumber")), F.concat(article, F.lit(". "), heading, F.lit(" > "), clause)
    letter = F.when(F.col("l_linenumber") == 3, "a").otherwise("đ")
    point = F.concat(F.lit("Điểm "), letter)
    point_text = F.concat(letter, F.lit(") Theo điểm "), letter, F.lit(" khoản "), F.col("l_linenumber"), F.lit(" Điều "), 1 + F.col("l_partkey") % 9)
    row = lambda *values: F.struct(*[v.alias(c) for c, v in zip(("node_id", "node_type", "label", "text", "parent_id", "level", "article", "clause", "point", "path_title", "k3"), values, strict=True)])
    of_line = F.array_compact(F.array(
        row(clause_id, F.lit("clause"), clause, clause_text, article_id, F.lit(2), article, clause, none, clause_path, F.lit(0)),
        F.when(F.col("l_linenumber") % 3 == 0, row(F.concat(clause_id, F.lit("_p")), F.lit("point"), point, point_text, clause_id, F.lit(3), article, clause, point, F.concat(clause_path, F.lit(" > "), point), F.lit(1))),
    ))
    c = lines.join(numbered, F.col("l_orderkey") == F.col("o_orderkey")).select(*meta, F.col("o_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.explode(of_line).alias("x")).select(*meta, "x.*", "k1", "k2")
    title = F.concat("law_type", F.lit(" "), "doc_number")
    d = docs.select(
        *meta, F.col("doc_id").alias("node_id"), F.lit("document").alias("node_type"), title.alias("label"), title.alias("text"), none.alias("parent_id"), F.lit(0).alias("level"),
        none.alias("article"), none.alias("clause"), none.alias("point"), F.lit("").alias("path_title"), F.lit(-1).cast("long").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"),
    )
    every = d.unionByName(a).unionByName(c)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2", "k3")) - 1
    return every.withColumn("order_index", place).drop("k1", "k2", "k3")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version relations: each clause acts on the article, clause and point that it names."""
    lines = lines_of(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    article, clause = F.concat(F.lit("Điều "), 1 + F.col("l_partkey") % 9), F.concat(F.lit("Khoản "), 1 + F.col("l_suppkey") % 4)
    return joined.select(
        F.concat(F.lit("d"), "o_custkey", F.lit("_a"), "n", F.lit("_c"), "l_linenumber").alias("source_id"),
        F.concat(F.lit("d"), "o_custkey").alias("doc_id"),
        _mapped("l_returnflag", VERBS, "EFFECTIVE_FROM").alias("relation_type"),
        article.alias("target_article"), F.when(F.col("l_linestatus") == "O", clause).alias("target_clause"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 4 == 2) & (F.col("l_linenumber") % 2 == 0), "Điểm a").alias("target_point"),
        F.concat(F.lit("Nghị định "), F.col("l_partkey") % 500 + 1, F.lit("/"), F.year("l_shipdate"), F.lit("/NĐ-CP ngày "), F.date_format("l_shipdate", "dd/MM/yyyy")).alias("target_text"),
    )


def _case(column: str, values: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


DOCUMENTS_SQL = f"""
docs AS (SELECT c_custkey, 'd' || c_custkey AS doc_id, c_custkey || '/' || (2000 + c_nationkey) || '/' || {_case("c_mktsegment", {k: v[1] for k, v in KINDS.items()}, "KH")} AS doc_number,
  {_case("c_mktsegment", {k: v[0] for k, v in KINDS.items()}, "Kế hoạch")} AS law_type, 2000 + c_nationkey AS year, n_name AS issuing_agency FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
LINES_SQL = f"lines AS (SELECT * EXCLUDE (l_linenumber), row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS l_linenumber FROM lineitem)"
NODES_SQL = f"""{DOCUMENTS_SQL},
{LINES_SQL},
arts AS (SELECT d.*, o_orderkey, {_case("o_orderpriority", HEADINGS, "Quy định")} AS heading, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN docs d ON o_custkey = c_custkey),
raw AS (
  SELECT doc_id, doc_number, law_type, year, issuing_agency, doc_id AS node_id, 'document' AS node_type, law_type || ' ' || doc_number AS label, law_type || ' ' || doc_number AS text,
    CAST(NULL AS VARCHAR) AS parent_id, 0 AS level, CAST(NULL AS VARCHAR) AS article, CAST(NULL AS VARCHAR) AS clause, CAST(NULL AS VARCHAR) AS point, '' AS path_title, -1 AS k1, 0 AS k2, 0 AS k3 FROM docs
  UNION ALL SELECT doc_id, doc_number, law_type, year, issuing_agency, doc_id || '_a' || n, 'article', 'Điều ' || n, 'Điều ' || n || '. ' || heading, doc_id, 1, 'Điều ' || n, NULL, NULL, 'Điều ' || n || '. ' || heading, o_orderkey, 0, 0 FROM arts
  UNION ALL SELECT doc_id, doc_number, law_type, year, issuing_agency, doc_id || '_a' || n || '_c' || l_linenumber, 'clause', 'Khoản ' || l_linenumber,
    l_linenumber || '. ' || {_case("l_returnflag", VERB_TEXT, "Quy định")} || ' mức ' || CAST(l_quantity AS BIGINT) || ' theo khoản ' || (1 + l_suppkey % 4) || ' Điều ' || (1 + l_partkey % 9),
    doc_id || '_a' || n, 2, 'Điều ' || n, 'Khoản ' || l_linenumber, NULL, 'Điều ' || n || '. ' || heading || ' > Khoản ' || l_linenumber, o_orderkey, l_linenumber, 0 FROM lines JOIN arts ON l_orderkey = o_orderkey
  UNION ALL SELECT doc_id, doc_number, law_type, year, issuing_agency, doc_id || '_a' || n || '_c' || l_linenumber || '_p', 'point', 'Điểm ' || letter, letter || ') Theo điểm ' || letter || ' khoản ' || l_linenumber || ' Điều ' || (1 + l_partkey % 9),
    doc_id || '_a' || n || '_c' || l_linenumber, 3, 'Điều ' || n, 'Khoản ' || l_linenumber, 'Điểm ' || letter, 'Điều ' || n || '. ' || heading || ' > Khoản ' || l_linenumber || ' > Điểm ' || letter, o_orderkey, l_linenumber, 1
    FROM (SELECT *, CASE l_linenumber WHEN 3 THEN 'a' ELSE 'đ' END AS letter FROM lines WHERE l_linenumber % 3 = 0) JOIN arts ON l_orderkey = o_orderkey),
nodes AS (SELECT * EXCLUDE (k1, k2, k3), row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3) - 1 AS order_index FROM raw)"""
EDGES_SQL = f"""
edges AS (SELECT 'd' || o_custkey || '_a' || n || '_c' || l_linenumber AS source_id, 'd' || o_custkey AS doc_id, {_case("l_returnflag", VERBS, "EFFECTIVE_FROM")} AS relation_type,
  'Điều ' || (1 + l_partkey % 9) AS target_article, CASE WHEN l_linestatus = 'O' THEN 'Khoản ' || (1 + l_suppkey % 4) END AS target_clause, CASE WHEN l_linestatus = 'O' AND l_suppkey % 4 = 2 AND l_linenumber % 2 = 0 THEN 'Điểm a' END AS target_point,
  'Nghị định ' || (l_partkey % 500 + 1) || '/' || year(l_shipdate) || '/NĐ-CP ngày ' || strftime(l_shipdate, '%d/%m/%Y') AS target_text
  FROM lines JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) ON l_orderkey = o_orderkey)"""
