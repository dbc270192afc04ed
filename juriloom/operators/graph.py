"""The provision tree as a table of nodes with parent ids: closure, relations, expansions, references, previews.

nodes: node_id, doc_id, node_type, label, text, parent_id, order_index, level, article, clause, point, path_title and the
document's columns. ``order_index`` orders the nodes of a document, so (doc_id, order_index) is a total order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import norm_key, norm_space, truncate


def has_child_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("HAS_CHILD").alias("relation_type"), F.col("doc_id"))


def with_counts(nodes: DataFrame) -> DataFrame:
    """n_children and n_siblings of each node."""
    per_parent = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"))
    own = per_parent.select(F.col("parent_id").alias("node_id"), F.col("n").alias("n_children"))
    beside = per_parent.select("parent_id", (F.col("n") - 1).alias("n_siblings"))
    return nodes.join(own, "node_id", "left").join(beside, "parent_id", "left").fillna(0, ["n_children", "n_siblings"])


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, node_id, distance), each node with itself first; joins level by level to the deepest level there is."""
    links = nodes.where("parent_id is not null").select(F.col("node_id").alias("child"), F.col("parent_id").alias("up"))
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    step = nodes.select(F.col("node_id").alias("ancestor"), "node_id", F.lit(0).alias("distance"))
    out = step
    for d in range(1, deepest + 1):
        step = step.join(links, F.col("ancestor") == F.col("child")).select(F.col("up").alias("ancestor"), "node_id", F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def ordered_text(order: str, text: str, separator: str = "\n") -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def subtrees(nodes: DataFrame, roots: str) -> DataFrame:
    """Ids and text of the subtree of each node of type ``roots``, in order."""
    below = closure(nodes).join(nodes.where(F.col("node_type") == roots).select(F.col("node_id").alias("ancestor")), "ancestor").join(nodes.select("node_id", "order_index", "text"), "node_id")
    return below.groupBy(F.col("ancestor").alias("node_id")).agg(F.count("*").alias("n_nodes"), ordered_text("order_index", "text").alias("subtree_text"))


def paths(nodes: DataFrame) -> DataFrame:
    """Labels from below the root to the node, joined by ' > '."""
    up = closure(nodes).join(nodes.select(F.col("node_id").alias("ancestor"), "label", "node_type", F.col("level").alias("at")), "ancestor").where("node_type <> 'document'")
    return nodes.select("node_id").join(up.groupBy("node_id").agg(ordered_text("at", "label", " > ").alias("path")), "node_id", "left").fillna("", ["path"])


def chunks(nodes: DataFrame, snippet: int = 700, siblings: int = 12) -> DataFrame:
    """Retrieval rows: the parent's heading and up to ``siblings`` labels beside each node, in order."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    families = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "node_id"))), lambda x: x["node_id"]).alias("family"))
    joined = nodes.join(parents, "parent_id", "left").join(families, "parent_id", "left")
    beside = F.slice(F.filter("family", lambda x: x != F.col("node_id")), 1, siblings)
    return joined.select(
        "node_id", "doc_id", truncate("text", snippet).alias("snippet"), F.array_join(F.coalesce(beside, F.array().cast("array<string>")), ",").alias("sibling_ids"),
        F.concat_ws("\n", F.concat(F.col("law_type"), F.lit(" "), F.col("doc_number")), F.nullif("path_title", F.lit("")), "parent_label", norm_space("text")).alias("retrieval_text"),
    )


def doc_sketches(nodes: DataFrame, headings: int = 15) -> DataFrame:
    """One row for each document: its first headings in order."""
    major = nodes.where("node_type = 'article'").groupBy("doc_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x["text"]), 1, headings), "\n").alias("headings"), F.count("*").alias("n_articles"))
    return nodes.where("node_type = 'document'").select("doc_id", F.col("text").alias("title")).join(major, "doc_id", "left").select("doc_id", F.concat_ws("\n", "title", "headings").alias("sketch"), F.coalesce("n_articles", F.lit(0)).alias("n_articles"))


def document_index(nodes: DataFrame) -> DataFrame:
    """Metadata of each document's first node and how many nodes of each kind it has."""
    kind = lambda k: F.count_if(F.col("node_type") == k)
    return nodes.groupBy("doc_id").agg(F.min_by("doc_number", "order_index").alias("doc_number"), F.min_by("law_type", "order_index").alias("law_type"), F.min_by("year", "order_index").alias("year"), kind("article").alias("n_articles"), kind("clause").alias("n_clauses"), F.count("*").alias("n_nodes"))


def relations(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node_id, relation, related_id, score): children 0.7, parent 0.6, siblings 0.5 of the chosen nodes."""
    picked = nodes.join(chosen.select("node_id").distinct(), "node_id").select("node_id", "parent_id")
    other = nodes.select(F.col("node_id").alias("related_id"), F.col("parent_id").alias("of"))
    row = lambda df, name, score: df.select("node_id", F.lit(name).alias("relation"), "related_id", F.lit(score).alias("score"))
    children = row(picked.join(other, F.col("of") == F.col("node_id")), "child", 0.7)
    parents = row(picked.where("parent_id is not null").withColumn("related_id", F.col("parent_id")), "parent", 0.6)
    siblings = row(picked.join(other, F.col("of") == F.col("parent_id")).where("related_id <> node_id"), "sibling", 0.5)
    return children.unionByName(parents).unionByName(siblings)


def sibling_window(nodes: DataFrame, chosen: DataFrame, width: int = 2, cap: int = 20) -> DataFrame:
    """Siblings at most ``width`` places away, the nearest first; at most ``cap`` for each node."""
    placed = nodes.where("parent_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy("order_index"))).select("node_id", "parent_id", "place", "order_index")
    near = placed.select(F.col("node_id").alias("sibling_id"), "parent_id", F.col("place").alias("at"))
    # an equality on each distance keeps the join hashed: large families are not paired with themselves
    steps = F.explode(F.array(*[F.lit(d) for d in range(-width, width + 1) if d])).alias("step")
    wanted = placed.join(chosen.select("node_id").distinct(), "node_id").select("node_id", "parent_id", "place", steps).withColumn("at", F.col("place") + F.col("step"))
    found = wanted.join(near, ["parent_id", "at"])
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(F.abs("step"), "step"))).where(F.col("rank") <= cap).select("node_id", "sibling_id", "step", "rank")


def cross_references(nodes: DataFrame) -> DataFrame:
    """(node_id, doc_id, ref_no, target_article, target_clause, target_point) of each reference in a text, 'điểm a khoản b Điều c' as one."""
    chain = r"(?iu)(?:(?:điểm\s+([a-zđ])\s+)?khoản\s+(\d+)\s+)?điều\s+(\d+)"
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(chain), i).alias(c) for i, c in ((1, "p"), (2, "c"), (3, "a"))])
    rows = nodes.where("node_type in ('clause', 'point')").select("node_id", "doc_id", F.posexplode(found).alias("ref_no", "r"))
    named = lambda label, c: F.when(F.col(f"r.{c}") != "", F.concat(F.lit(label), F.lower(f"r.{c}")))
    return rows.select("node_id", "doc_id", "ref_no", named("Điều ", "a").alias("target_article"), named("Khoản ", "c").alias("target_clause"), named("Điểm ", "p").alias("target_point"))


def resolve_references(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """The best node of the same document for each reference: most parts given, then the last in order."""
    targets = nodes.where("article is not null").select("doc_id", F.col("article").alias("target_article"), "clause", "point", F.col("node_id").alias("target_id"), "order_index")
    fits = references.join(targets, ["doc_id", "target_article"]).where("(clause is null or clause = target_clause) and (point is null or point = target_point)")
    exact = F.when(F.col("clause") == F.col("target_clause"), 1).otherwise(0) + F.when(F.col("point") == F.col("target_point"), 1).otherwise(0)
    best = Window.partitionBy("node_id", "ref_no").orderBy(F.desc(exact), F.desc("order_index"))
    return fits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("node_id", "ref_no", "target_article", "target_clause", "target_point", "target_id")


def promote_to_ancestor(nodes: DataFrame, hits: DataFrame, bonus: float = 0.4) -> DataFrame:
    """hits (node_id, term, score): the nearest ancestor, the node left out, whose text holds the term gets score + bonus."""
    up = closure(nodes).where("distance > 0").join(nodes.select(F.col("node_id").alias("ancestor"), F.col("text").alias("above")), "ancestor")
    found = hits.join(up, "node_id").where(F.contains(norm_key("above"), F.col("term")))
    return found.groupBy("node_id", "term").agg(F.min_by("ancestor", "distance").alias("ancestor"), (F.max("score") + bonus).alias("score"))


def previews(nodes: DataFrame, most: int = 5) -> DataFrame:
    """The first children of each node that has any, as 'id: text'."""
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("order_index", F.col("node_id").alias("id"), "text"))), 1, most), lambda x: F.concat(x["id"], F.lit(": "), F.substring(x["text"], 1, 40))).alias("p"), F.count("*").alias("n_children"))
    return kids.select("node_id", F.array_join("p", " | ").alias("preview"), "n_children")


def compact(x: Column | str) -> Column:
    return F.regexp_replace(norm_key(x), r"[^\p{L}\p{N}]+", "")


def header_only(nodes: DataFrame) -> DataFrame:
    """True for nodes with children whose text says no more than their path."""
    counted = with_counts(nodes)
    return counted.select("node_id", ((F.col("n_children") > 0) & F.contains(compact("path_title"), compact("text"))).alias("header_only"))
