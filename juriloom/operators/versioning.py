"""Amendments: references, version events, and the state of each provision."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key, norm_space

# Relations that change a provision.
AMENDING, REPEALING = ["AMENDS", "PARTIALLY_AMENDS"], ["REPEALS", "PARTIALLY_REPEALS"]
RELATIONS = [*AMENDING, *REPEALING, "REPLACES", "EFFECTIVE_FROM"]
DATE = r"(?iu)(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})"
DOC_NUMBER = r"(?iu)((?:thông tư liên tịch|bộ luật|luật|nghị định|thông tư|quyết định|nghị quyết|chỉ thị|công văn|thông báo)?\s*\b\d{1,4}/\d{4}/[A-ZĐ\-]+)"


def ref_piece(x: Column | str) -> Column:
    """A reference without its label and punctuation."""
    bare = F.regexp_replace(norm_key(x), "điều|khoản|điểm", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[,:;]", " "), r"\s+", " "))


KEYS = ["article_key", "clause_key", "point_key"]


def ref_keys(prefix: str = "") -> list[Column]:
    return [ref_piece(f"{prefix}{k}").alias(f"{k}_key") for k in ("article", "clause", "point")]


def reference_index(nodes: DataFrame) -> DataFrame:
    """(doc_id, article_key, clause_key, point_key) and the ids of the nodes that have it, in order."""
    keyed = nodes.where("article is not null").select("doc_id", *ref_keys(), "node_id", "order_index")
    return keyed.groupBy("doc_id", *KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "node_id"))), lambda x: x["node_id"]), ",").alias("node_ids"))


def resolve(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids for the exact reference, else for its clause, else for its article."""
    keyed = wanted.select("source_id", "doc_id", *ref_keys("target_"))
    found = _with_fallback(keyed, index, "node_ids")
    levels = {"exact": "exact", "by_clause": "clause", "by_article": "article"}
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in levels.items()], F.lit("none"))
    return found.select("source_id", "doc_id", *KEYS, F.coalesce(*levels).alias("node_ids"), how.alias("how"))


def _with_fallback(wanted: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``value`` of the exact reference, of its clause and of its article."""
    exact = table.select("doc_id", *KEYS, F.col(value).alias("exact"))
    clause = table.where("point_key = ''").select("doc_id", *KEYS[:2], F.col(value).alias("by_clause"))
    article = table.where("clause_key = '' and point_key = ''").select("doc_id", KEYS[0], F.col(value).alias("by_article"))
    return wanted.join(exact, ["doc_id", *KEYS], "left").join(clause, ["doc_id", *KEYS[:2]], "left").join(article, ["doc_id", KEYS[0]], "left")


def current_state(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """status and first_repealed_by of references (doc_id and the three keys): their own, else their clause's, else their article's, else unknown."""
    held = versions.withColumn("state", F.struct("status", "first_repealed_by"))
    found = _with_fallback(wanted, held, "state").withColumn("s", F.coalesce("exact", "by_clause", "by_article"))
    return found.select("doc_id", *KEYS, F.coalesce("s.status", F.lit("unknown")).alias("status"), F.coalesce("s.first_repealed_by", F.lit("")).alias("repealed_by"))


def events(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Version relations with their source's number, the numbers and dates that they name, and what they act on."""
    source = nodes.select(F.col("node_id").alias("source_id"), F.upper(norm_space("doc_number")).alias("source_doc_number"), F.col("text").alias("source_text"))
    joined = edges.where(F.col("relation_type").isin(RELATIONS)).join(source, "source_id", "left")
    text = norm_space("target_text")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOC_NUMBER), 1), lambda x: F.upper(norm_space(x))))
    others = F.filter(numbers, lambda x: x != F.coalesce("source_doc_number", F.lit("")))
    dates = F.array_sort(F.array_distinct(F.regexp_extract_all(norm_space(F.concat_ws(" ", "target_text", "source_text")), F.lit(DATE), 1)))
    scope = F.when(F.col("target_point").isNotNull(), "point").when(F.col("target_clause").isNotNull(), "clause").when(F.col("target_article").isNotNull(), "article").when(F.size(others) > 0, "document").otherwise("unknown")
    return joined.select("doc_id", "source_id", "relation_type", "source_doc_number", F.coalesce(F.get(others, 0), F.lit("")).alias("target_doc_number"), scope.alias("target_scope"), "target_article", "target_clause", "target_point", F.array_join(dates, ",").alias("dates"))


def version_map(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """State of each reference of each document: repealed, replaced, amended, effective_info_found or base, in this order."""
    keyed = found.select("*", *ref_keys("target_")).where("article_key <> ''")
    some = lambda kinds: F.count_if(F.col("relation_type").isin(kinds))
    changes = keyed.groupBy("doc_id", *KEYS).agg(
        some(AMENDING).alias("n_amended"), some(REPEALING).alias("n_repealed"), some(["REPLACES"]).alias("n_replaced"), F.count("*").alias("n_events"),
        F.min(F.when(F.col("relation_type").isin(REPEALING), F.col("source_id"))).alias("first_repealed_by"), F.count_if(F.col("dates") != "").alias("n_dated"),
    )
    both = reference_index(nodes).join(changes, ["doc_id", *KEYS], "full")
    filled = both.fillna(0, ["n_amended", "n_repealed", "n_replaced", "n_events", "n_dated"]).fillna("", ["node_ids"])
    status = F.when(F.col("n_repealed") > 0, "repealed").when(F.col("n_replaced") > 0, "replaced").when(F.col("n_amended") > 0, "amended").when(F.col("n_dated") > 0, "effective_info_found").otherwise("base")
    return filled.withColumn("status", status).drop("n_dated")


def annotate(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Each node with the state of its own reference; nodes without an article are base."""
    keyed = nodes.select("*", *ref_keys())
    return keyed.join(versions.select("doc_id", *KEYS, "status", "n_events"), ["doc_id", *KEYS], "left").fillna("base", ["status"]).fillna(0, ["n_events"])
