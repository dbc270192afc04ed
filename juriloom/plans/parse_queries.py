"""Queries that write the legal corpus out as texts and read its headers and trees back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juriloom.operators import graph, header, parser
from juriloom.plans.corpus import NODES_SQL, documents, nodes, table
from juriloom.shipping import ship
from juriloom.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith(("SELECT", "WITH")) and "nodes" not in sql else f"WITH {NODES_SQL}{sql}"
        return f

    return add


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each document of the corpus, with a header as such documents have it."""
    n = nodes(spark, sf_dir)
    body = n.where("node_type <> 'document'").groupBy("doc_id").agg(graph.ordered_text("order_index", "text").alias("body"))
    d = documents(spark, sf_dir).join(body, "doc_id", "left")
    top = F.concat_ws(
        "\n", F.concat(F.lit("BỘ "), "issuing_agency"), F.lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), F.concat(F.lit("Số: "), "doc_number"), F.concat(F.lit("Hà Nội, ngày "), F.col("c_custkey") % 28 + 1, F.lit(" tháng "), F.col("c_custkey") % 12 + 1, F.lit(" năm "), "year"),
        F.upper("law_type"), F.lit("VỀ VIỆC BAN HÀNH QUY ĐỊNH"), F.lit("Căn cứ Luật ngày 1 tháng 2 năm 1999;"), "body", F.lit("Nơi nhận:"), F.lit("- Như trên;"),
    )
    return d.select("doc_id", "c_custkey", top.alias("text"), F.concat("doc_id", F.lit(".txt")).alias("file_name"), F.concat("law_type", F.lit(" "), "doc_number").alias("title"))


@query(""" SELECT doc_id, CASE WHEN CAST(doc_id[2:] AS BIGINT) < 10000 THEN arg_min(doc_number, order_index) ELSE '' END AS doc_number, arg_min(law_type, order_index) AS doc_type_key, arg_min(year, order_index) AS year, 'VỀ VIỆC BAN HÀNH QUY ĐỊNH' AS official_title, 'BỘ ' || arg_min(issuing_agency, order_index) AS issuing_agency,
  lpad(CAST(CAST(doc_id[2:] AS BIGINT) % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(CAST(doc_id[2:] AS BIGINT) % 12 + 1 AS VARCHAR), 2, '0') || '/' || arg_min(year, order_index) AS date_raw, 'Hà Nội' AS place FROM nodes GROUP BY doc_id""")
def h07_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = header.headers(rendered(spark, sf_dir))
    return found.select("doc_id", "doc_number", F.concat(F.upper(F.substring("doc_type", 1, 1)), F.lower(F.substring("doc_type", 2, 99))).alias("doc_type_key"), "year", "official_title", "issuing_agency", "date_raw", "place")


@query(" SELECT doc_id, node_type, label, text, article, clause, point, CAST(order_index AS INT) AS order_index, CAST(level AS INT) AS level FROM nodes WHERE node_type <> 'document'")
def p02_parsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = parser.parsed(rendered(spark, sf_dir), title="title")
    return found.where("node_type <> 'document'").select("doc_id", "node_type", "label", "text", "article", "clause", "point", "order_index", "level")


@query(" SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def p13_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return parser.parsed(rendered(spark, sf_dir), title="title").groupBy("node_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS normalized FROM documents""".replace("\\\\", "\\"))
def s07_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(header.lines("text"), "\n").alias("normalized"))


@query("""SELECT doc_id, text[1:5000] AS preview, length(text) > 5000 AS cut FROM documents""")
def s11_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 5000).alias("preview"), (F.length("text") > 5000).alias("cut"))


@query("""SELECT stem, kind, doc_id FROM (SELECT 'doc' || (doc_id // 3) AS stem, ['docx', 'doc', 'pdf'][doc_id % 3 + 1] AS kind, doc_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id % 3) AS k FROM documents) WHERE k = 1""")
def s09_preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc"), F.floor(F.col("doc_id") / 3), F.lit("."), F.get(F.array(F.lit("docx"), F.lit("doc"), F.lit("pdf")), (F.col("doc_id") % 3).cast("int"))).alias("path"))
    return files.preferred(d, "path").select("stem", "kind", "doc_id")


@query("""SELECT user_id, last_event, n FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM events GROUP BY 1)""")
def s14_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = files.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_event"))
    return last.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("""SELECT conv_id, turn, role, text[1:60] AS hint FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE contains(lower(text), 'de')) WHERE k <= 2""")
def s19_log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("de")))
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 2")
    return ranked.select("conv_id", "turn", "role", F.substring("text", 1, 60).alias("hint"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def s01_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
