"""Walking the tree for many questions at once, and what is shown to answer them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import ascii_key, norm_key, norm_space, tokens
from juriloom.lineage import cut
from juriloom.operators import graph, retrieval
from juriloom.operators.retrieval import among

MAX_HOPS, EVIDENCE, JUDGED, KEEP = 3, 4, 4, 12
# Relations by action, the action that an answer's source asks for, and nodes that are parts of a list.
RELATIONS = {"deepen_node": "child", "fetch_siblings": "sibling", "fetch_parent_summary": "parent"}
SOURCE_ACTIONS = {"children": "deepen_node", "siblings": "fetch_siblings", "parent": "fetch_parent_summary"}
LIST_PARTS = ["point", "decimal_item", "list_item", "bullet"]
#: Below this confidence, a decision gives way to a relation of the nodes.
CONFIDENCE = 0.6


def node_facts(nodes: DataFrame) -> DataFrame:
    """The nodes with n_children, n_siblings and header_only."""
    counted = graph.with_counts(nodes)
    return counted.withColumn("header_only", (F.col("n_children") > 0) & F.contains(graph.compact("path_title"), graph.compact("text")))


def adjusted(decision: str = "decision", source: str = "answer_source", confidence: str = "confidence", header_only: str = "header_only", leaf: str = "leaf", n_family: str = "n_family", n_children: str = "n_children", has_parent: str = "has_parent", judged: str = "judged") -> Column:
    """(action, reason) of a decision about selected nodes.

    A model's unsure decision goes to the siblings of a leaf, else to children, else to the parent; an answer from children,
    siblings or the parent fetches those; an answer from nodes that only head others goes on to their children.
    """
    relation = F.when(F.col(leaf) & (F.col(n_family) > 1), "fetch_siblings").when(F.col(n_children) > 0, "deepen_node").when(F.col(has_parent), "fetch_parent_summary")
    unsure = F.col(judged) & (F.col(confidence) < CONFIDENCE) & relation.isNotNull() & (relation != F.col(decision))
    action = F.when(unsure, relation).otherwise(F.col(decision))
    asks = F.coalesce(*[F.when(F.col(source) == k, v) for k, v in SOURCE_ACTIONS.items()])
    needs = (action == "answer_now") & asks.isNotNull()
    heads = (action == "answer_now") & (F.col(source) == "own_text") & F.col(header_only)
    reason = F.when(needs, "answer_source_requires_relation").when(heads, "header_only_node_needs_children").when(unsure, "low_confidence_graph_relation").otherwise("")
    return F.struct(F.when(needs, asks).when(heads, "deepen_node").otherwise(action).alias("action"), reason.alias("reason"))


def relation_ids(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, action, node_id, doc_id, order_index): all children, families or parents of the selected (question_id, action, node_id), each once.

    A node without children is taken for the one with its path in the same document that has some.
    """
    own = nodes.select("node_id", "parent_id", "doc_id", "path_title")
    picked = selected.select("question_id", "action", "node_id").join(own, "node_id")
    kids = nodes.where("parent_id is not null").select(F.col("parent_id").alias("at"), F.col("node_id").alias("related"))
    bearing = kids.select("at").distinct()
    twins = own.join(bearing, F.col("node_id") == F.col("at")).where("path_title <> ''").groupBy("doc_id", "path_title").agg(F.min("node_id").alias("twin"))
    deepen = picked.where("action = 'deepen_node'").join(bearing, F.col("node_id") == F.col("at"), "left").join(twins, ["doc_id", "path_title"], "left").withColumn("of", F.when(F.col("at").isNotNull(), F.col("node_id")).otherwise(F.col("twin"))).drop("at")
    down = deepen.join(kids, F.col("of") == F.col("at")).select("question_id", "action", "related")
    beside = picked.where("action = 'fetch_siblings'").join(kids, F.col("parent_id") == F.col("at")).select("question_id", "action", "related")
    up = picked.where("action = 'fetch_parent_summary' and parent_id is not null").select("question_id", "action", F.col("parent_id").alias("related"))
    related = down.unionByName(beside).unionByName(up).distinct()
    return related.join(nodes.select(F.col("node_id").alias("related"), "doc_id", "order_index"), "related").select("question_id", "action", F.col("related").alias("node_id"), "doc_id", "order_index")


def navigate(profiles: DataFrame, nodes: DataFrame, start: DataFrame, text: str = "question", max_hops: int = MAX_HOPS, keep: int = KEEP, rerank: Callable[[Column, Column], Column] | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Where each question ends, and the relation that it went by last. start: (question_id, node_id, rank).

    The first frame is (question_id, node_id, rank, hops, action); the second (question_id, action, node_id, place), all nodes
    of the last relation in order. A question whose first candidate has children goes on to them if it names an article
    alone, or no provision, and so does one whose chosen nodes only head others; else it is answered. What a hop finds is
    ranked by BM25, then by ``rerank`` where there is one. Each hop is one set of joins for all questions that go on,
    written before the next, so that a plan never holds the hops before it twice; the loop ends where none goes on.
    A node's parent and children stand in its document, so only the documents of ``start`` are read, and written once;
    places, (node_id, doc_id) of all nodes, spares a reading of nodes that are not written yet.
    """
    start = cut(start)
    at = cut(among((nodes if places is None else places).select("node_id", "doc_id"), start, ["node_id"]))
    nodes = cut(among(nodes, at, ["doc_id"]).select("node_id", "node_type", "order_index", "doc_id", "parent_id", "path_title", "text"))
    facts = cut(node_facts(nodes).select("node_id", "node_type", "order_index", "doc_id", "parent_id", "path_title", "text", "n_children", "header_only"))
    asked = cut(profiles.select("question_id", F.col(text).alias("q"), (F.col("clause").isNull() & F.col("point").isNull()).alias("may")))
    state, done, went = cut(start.select("question_id", "node_id", "rank", F.lit(0).alias("hops"))), [], []
    for hop in range(max_hops + 1):
        seen = state.where(F.col("rank") <= max(EVIDENCE, JUDGED)).join(asked.select("question_id", "may"), "question_id").join(facts.select("node_id", "node_type", "order_index", "n_children", "header_only"), "node_id")
        top = seen.where("rank = 1").select("question_id", (F.col("may") & (F.col("n_children") > 0)).alias("deepens"), F.col("node_type").isin(LIST_PARTS).alias("in_list"))
        judged = seen.join(top, "question_id")
        whole = Window.partitionBy("question_id")
        bears = F.col("n_children") > 0
        placed = judged.withColumn("heads", F.max(F.col("header_only") & (F.col("rank") <= EVIDENCE)).over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc(bears & (F.col("rank") <= JUDGED)), "order_index", "rank")))
        chosen = F.when(F.col("deepens") & F.col("in_list"), bears & (F.col("rank") <= JUDGED) & (F.col("place") <= EVIDENCE)).when(F.col("deepens"), F.col("rank") == 1).otherwise(F.col("heads") & (F.col("rank") <= EVIDENCE))
        onward = cut(placed.where(chosen).select("question_id", "node_id", F.lit("deepen_node").alias("action")))
        last = hop == max_hops or onward.isEmpty()
        if last:
            onward = onward.limit(0)
        ended = state.join(onward.select("question_id").distinct(), "question_id", "left_anti").withColumn("action", F.lit("answer"))
        done.append(ended)
        if last:
            break
        found = cut(relation_ids(onward, nodes).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id", "order_index", "node_id"))))
        went.append(found.select("question_id", "action", "node_id", "place", F.lit(hop).alias("hop")))
        pairs = found.where(F.col("place") <= max(2 * keep, 12)).select("question_id", "node_id", "place").join(asked, "question_id").join(facts.select("node_id", "node_type", "path_title", "text"), "node_id")
        score = F.round(retrieval.summary_score(F.col("q"), F.col("path_title"), F.col("text"), F.col("node_type")), 6)
        order = [F.desc("score"), F.col("place")] if rerank is None else [F.desc(rerank(F.col("q"), F.col("text"))), F.desc("score"), F.col("place")]
        state = cut(pairs.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= keep).select("question_id", "node_id", "rank", F.lit(hop + 1).alias("hops")))
    walked = done[0]
    for more in done[1:]:
        walked = walked.unionByName(more)
    if not went:
        return walked, state.select("question_id", F.lit("").alias("action"), "node_id", F.col("rank").alias("place")).limit(0)
    relations = went[0]
    for more in went[1:]:
        relations = relations.unionByName(more)
    latest = relations.groupBy("question_id").agg(F.max("hop").alias("hop"))
    return walked, relations.join(latest, ["question_id", "hop"]).drop("hop")


def heading_text() -> Column:
    """Path and text of a node, each said once."""
    path, own = norm_space("path_title"), norm_space("text")
    return F.array_join(F.filter(F.array(path, F.when(ascii_key(own) == ascii_key(path), "").otherwise(own)), lambda x: x != ""), "\n")


def evidence_by_source(selected: DataFrame, nodes: DataFrame, source: str, limit: int = EVIDENCE) -> DataFrame:
    """(question_id, node_id, place, answer_source, text) for selected (question_id, node_id, rank).

    own_text: the first ``limit`` of them; title_or_heading: their headings; parent_heading: their topmost ancestors'
    headings; children, siblings, parent: all nodes of that relation. What has no text is left out.
    """
    if source in SOURCE_ACTIONS:
        found = relation_ids(selected.withColumn("action", F.lit(SOURCE_ACTIONS[source])), nodes).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id", "order_index", "node_id")))
        rows, said = found.select("question_id", "node_id", "place"), norm_space("text")
    elif source == "parent_heading":
        up = graph.closure(nodes).where("distance > 0").join(nodes.where(heading_text() != "").select(F.col("node_id").alias("ancestor")), "ancestor")
        top = up.groupBy("node_id").agg(F.max_by("ancestor", "distance").alias("top"))
        found = selected.join(top, "node_id").select("question_id", F.col("top").alias("node_id")).distinct().join(nodes.select("node_id", "order_index", "doc_id"), "node_id")
        rows, said = found.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("order_index", "doc_id"))).select("question_id", "node_id", "place"), heading_text()
    else:
        rows, said = selected.select("question_id", "node_id", F.col("rank").alias("place")), heading_text() if source == "title_or_heading" else norm_space("text")
    out = rows.join(nodes.select("node_id", "text", "path_title"), "node_id").withColumn("said", said).where("said <> ''")
    if source == "own_text":
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).where(F.col("place") <= limit)
    return out.select("question_id", "node_id", "place", F.lit(source).alias("answer_source"), F.col("said").alias("text"))


def evidence(walked: DataFrame, relations: DataFrame, scopes: DataFrame, nodes: DataFrame, most: int = EVIDENCE, snippet: int = 700) -> DataFrame:
    """(question_id, node_id, place, hops, role, answer_source, snippet) by the scope (question_id, scope) of each question.

    A list is answered from the whole relation that the question went by last, if there is one. Else the nodes where it
    ended are primary: two of them for exact answers and definitions, ``most`` for others; and for summaries, comparisons
    and procedures what is left up to ``most`` is filled from the relation.
    """
    ended = walked.join(scopes, "question_id")
    by = relations.where("action in ('deepen_node', 'fetch_siblings')").join(scopes.where("scope = 'list'"), "question_id")
    lists = by.select("question_id", "node_id", "place", F.lit("primary").alias("role"), F.when(F.col("action") == "deepen_node", "children").otherwise("siblings").alias("answer_source"))
    limit = F.when(F.col("scope").isin("exact", "definition"), min(most, 2)).otherwise(most)
    own = ended.join(lists.select("question_id").distinct(), "question_id", "left_anti").where(F.col("rank") <= limit)
    primary = own.select("question_id", "node_id", F.col("rank").alias("place"), F.lit("primary").alias("role"), F.lit("own_text").alias("answer_source"))
    wide = scopes.where(F.col("scope").isin("summary", "comparison", "procedure")).select("question_id")
    room = primary.join(wide, "question_id").groupBy("question_id").agg(F.max("place").alias("used"))
    extra = relations.join(room, "question_id").join(primary.select("question_id", "node_id"), ["question_id", "node_id"], "left_anti")
    extra = extra.withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).where(F.col("k") + F.col("used") <= most)
    support = extra.select("question_id", "node_id", (F.col("k") + F.col("used")).cast("int").alias("place"), F.lit("supporting").alias("role"), F.lit("supporting_relation").alias("answer_source"))
    hops = walked.groupBy("question_id").agg(F.max("hops").alias("hops"))
    every = lists.unionByName(primary).unionByName(support).join(hops, "question_id").join(nodes.select("node_id", "text"), "node_id")
    return every.select("question_id", "node_id", "place", "hops", "role", "answer_source", F.substring("text", 1, snippet).alias("snippet"))


def infer_documents(questions: DataFrame, titles: DataFrame, least_hits: int = 5, least_share: float = 0.45, text: str = "question", unless_named: bool = False) -> DataFrame:
    """(question_id, doc_id, score): 1 where the question holds the number, else the shared share of title words.

    With ``unless_named``, a question with a number of any length goes by that alone. Questions with the same words are
    looked up once. Of two sets that share ``least_hits`` words, each has one of the shared ones among its rarest
    size - least_hits + 1, so titles meet questions by those alone, and pairs are counted on the whole sets.
    """
    numbers = F.regexp_extract_all(F.upper(text), F.lit(r"(?U)\b(\d{1,4}/\d{4}/[A-ZĐ\-]+)\b"), 1)
    by_number = cut(questions.select("question_id", F.explode(F.array_distinct(numbers)).alias("number")).join(titles.select("doc_id", F.upper("doc_number").alias("number")), "number").groupBy("question_id").agg(F.min("doc_id").alias("doc_id")))
    words = lambda c: F.array_sort(F.array_distinct(F.filter(tokens(ascii_key(c)), lambda w: F.length(w) >= 2)))
    named = F.upper(text).rlike(r"(?U)\b\d+/\d{4}/[A-ZĐ\-]+\b") if unless_named else F.lit(False)
    left = cut(questions.where(~named).join(by_number.select("question_id"), "question_id", "left_anti").select("question_id", words(text).alias("qw")).where(F.size("qw") >= least_hits))
    there = cut(titles.select("doc_id", words("title").alias("tw")).where(F.size("tw") >= least_hits))
    known = cut(there.select(F.explode("tw").alias("w")).groupBy("w").agg(F.count("*").alias("n")))

    def by_rarest(sets: DataFrame, *columns: str) -> DataFrame:
        found = sets.select(*columns, F.explode(columns[-1]).alias("w")).join(known, "w").groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("x"))
        return found.where(F.size("x") >= least_hits).select(*columns, F.explode(F.slice("x", F.lit(1), F.size("x") - least_hits + 1)["w"]).alias("w"))

    pairs = by_rarest(left.select("qw").distinct(), "qw").join(by_rarest(there, "doc_id", "tw"), "w").withColumn("hits", F.size(F.array_intersect("qw", "tw")))
    scored = pairs.where(F.col("hits") >= least_hits).select("qw", "doc_id", (F.col("hits") / F.least(F.size("qw"), F.size("tw"))).alias("score")).where(F.col("score") >= least_share)
    best = scored.groupBy("qw").agg(F.min(F.struct((-F.col("score")).alias("low"), "doc_id")).alias("x"))
    by_title = left.join(best, "qw").select("question_id", "x.doc_id", (-F.col("x.low")).alias("score"))
    return by_number.select("question_id", "doc_id", F.lit(1.0).alias("score")).unionByName(by_title)


# Refusals, and words that join the parts of a question.
REFUSALS = ["không tìm thấy", "không đủ căn cứ", "chưa có thông tin"]
PARTS = r"(?iu)\s+(?:và|hoặc|đồng thời)\s+|[;?]"


def adequacy(answers: DataFrame, question: str = "question", answer: str = "answer", n_passages: str = "n_passages") -> Column:
    """Reason why an answer falls short, or 'adequate'."""
    refused = F.size(F.filter(F.array(*map(F.lit, REFUSALS)), lambda r: F.contains(norm_key(answer), r))) > 0
    parts = F.filter(F.transform(F.split(question, PARTS), lambda p: tokens(p)), lambda p: F.size(p) > 0)
    said = tokens(answer)
    uncovered = F.size(F.filter(parts, lambda p: F.size(F.array_intersect(p, said)) == 0))
    return F.when(F.col(n_passages) == 0, "no_passages").when(refused, "refusal_with_evidence").when((F.size(parts) > 1) & (uncovered > 0), "part_not_covered").otherwise("adequate")


def natural_key(x: Column) -> Column:
    """A text that sorts as people count: each run of digits has ten places."""
    parts = F.regexp_extract_all(x, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 10, "0")).otherwise(F.lower(p))), "")
