"""Candidates for questions: the filter ladder, direct targets, scoring, documents, margin, evidence, grading, citations."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juriloom.functions.text import ascii_key, norm_key, phrase_overlap, tokens, topic_phrases
from juriloom.lineage import cut

# Levels of the ladder, the strictest first; kind and year go with the levels without a document.
LADDER = [
    ("doc_number_article_clause_point", ["doc_number", "article", "clause", "point"]), ("doc_number_article_clause", ["doc_number", "article", "clause"]), ("doc_number_article", ["doc_number", "article"]), ("doc_number", ["doc_number"]),
    ("article_clause_point", ["law_type", "year", "article", "clause", "point"]), ("article_clause", ["law_type", "year", "article", "clause"]), ("article", ["law_type", "year", "article"]), ("law_type_year", ["law_type", "year"]),
]
FILTERS = ["doc_number", "law_type", "year", "article", "clause", "point"]
# Kinds of nodes that a question about a whole document begins with.
HEADING_TYPES = ["article", "section", "appendix", "attachment", "roman_section", "alpha_section"]


#: So many keys at most are sent to all executors.
BROADCAST_KEYS = 100_000


def among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in ``wanted``: without a shuffle of the rows where there are few such keys, else by a join."""
    found = cut(wanted.select(*keys).distinct())
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, keys, "left_semi")


def doc_number_key(x: Column | str) -> Column:
    """Upper case, Đ as D, no zeros in front."""
    return F.regexp_replace(F.translate(F.upper(F.trim(x)), "Đ", "D"), "^0+(?=[0-9])", "")


def _value(filter_name: str) -> Column:
    return doc_number_key(filter_name) if filter_name == "doc_number" else F.lower(F.col(filter_name).cast("string"))


def _key(keys: Column) -> Column:
    """One text for the values that ``keys``, an array of names of filters, selects, with the names."""
    return F.concat_ws("\u0001", F.array_join(keys, ","), *[F.when(F.array_contains(keys, k), _value(k)) for k in FILTERS])


def _named(keys: list[str]) -> Column:
    """Those of the filters that are given, as an array of names."""
    return F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys]))


def _sets(asked: DataFrame) -> list[list[str]]:
    """The sets of filters that occur in questions: some dozens at most, however many questions there are."""
    return [r["keys"] for r in asked.select("keys").distinct().collect()]


def _keyed(nodes: DataFrame, sets: list[tuple[str, list[str]]], *columns: str) -> DataFrame:
    """Rows (columns, kind, key) of nodes, one for each (kind, filters) of ``sets`` that fits a node and whose values it has.

    A kind is a type of nodes; "" stands for any type, "heading" for those that head others.
    """
    plain = nodes.select(*columns, "node_type", *[_value(k).alias(f"_{k}") for k in FILTERS])
    of_kind = lambda kind: F.lit(True) if not kind else F.col("node_type").isin(HEADING_TYPES) if kind == "heading" else F.col("node_type") == kind
    each = [F.when(_all([of_kind(kind), *[F.col(f"_{k}").isNotNull() for k in keys]]), F.struct(F.lit(kind).alias("kind"), F.concat_ws("\u0001", F.lit(",".join(keys)), *[f"_{k}" for k in FILTERS if k in keys]).alias("key"))) for kind, keys in sets]
    nothing = F.lit(None).cast("struct<kind:string,key:string>")
    return plain.select(*columns, F.explode(F.array_compact(F.array(*each, nothing))).alias("x")).select(*columns, "x.*")


def _all(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def levels(profiles: DataFrame, groups: Callable[[list[tuple[str, list[str]]], DataFrame], DataFrame]) -> DataFrame:
    """(question_id, level, key): the first level of each question whose key a node has.

    A level's key holds the values of those of its filters that a question names. groups(sets, asked) gives those of the
    keys in ``asked`` that nodes have for those sets of filters, each once. Levels that come down to the same filters go
    by the first one's name.
    """
    each = [F.struct(F.lit(no).alias("level_no"), F.lit(name).alias("level"), _named(keys).alias("keys")) for no, (name, keys) in enumerate(LADDER)]
    usable = F.filter(F.array(*each), lambda x: (F.size(x["keys"]) > 0) & ((x["level_no"] > 3) | F.col("doc_number").isNotNull()))
    asked = profiles.select("question_id", *FILTERS, F.explode(usable).alias("x")).select("question_id", *FILTERS, "x.*")
    asked = asked.select("question_id", "level_no", "level", "keys", _key(F.col("keys")).alias("key"))
    asked = cut(asked)
    met = asked.drop("keys").join(groups([("", keys) for keys in _sets(asked)], asked.select("key")).select("key"), "key")
    return met.groupBy("question_id").agg(F.min(F.struct("level_no", "level", "key")).alias("x")).select("question_id", "x.level", "x.key")


def ladder(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each question, the nodes of the strictest level of filters that any node meets, with that level's name.

    Levels are chosen by the nodes' distinct keys; nodes are joined for the chosen level alone. A question without
    filters, or that no level fits, has no rows here: it searches all nodes.
    """
    found: dict[str, list] = {}

    def groups(sets: list, asked: DataFrame) -> DataFrame:
        found["sets"] = sets
        return among(_keyed(nodes, sets), asked, ["key"]).distinct()

    chosen = levels(profiles, groups)
    return chosen.join(_keyed(nodes, found["sets"], "node_id", "doc_id", "order_index"), "key").drop("key", "kind")


def ladder_counts(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, level, n_nodes, first_id, last_id): the same, with nodes counted by key before they meet questions."""
    found: dict[str, DataFrame] = {}

    def groups(sets: list, asked: DataFrame) -> DataFrame:
        found["counts"] = cut(among(_keyed(nodes, sets, "node_id"), asked, ["key"]).groupBy("key").agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id")))
        return found["counts"]

    chosen = levels(profiles, groups)
    return chosen.join(found["counts"], "key").drop("key")


def direct_targets(profiles: DataFrame, nodes: DataFrame, most: int = 8, headings: int = 12) -> DataFrame:
    """(question_id, node_id, rank): nodes of exactly the kind that is asked for, meeting every filter.

    None where several fit and no document, kind or year is named. A question that names a document alone gets its first
    headings. All nodes with one set of values have one key; those with a key that is asked for are counted and ranked by
    key, so questions meet ``most`` rows each.
    """
    kind = F.when(F.col("point").isNotNull(), "point").when(F.col("clause").isNotNull(), "clause").when(F.col("article").isNotNull(), "article").when(F.col("doc_number").isNotNull(), "heading")
    named = F.when(kind == "heading", F.array(F.lit("doc_number"))).otherwise(_named(FILTERS))
    asked = cut(profiles.select("question_id", *FILTERS, kind.alias("kind"), named.alias("keys")).where("kind is not null").select("question_id", "kind", "keys", _key(F.col("keys")).alias("key")))
    keyed = _keyed(nodes, [(r["kind"], r["keys"]) for r in asked.select("kind", "keys").distinct().collect()], "node_id", "doc_id", "order_index")  # some dozens at most
    keyed = cut(among(keyed, asked, ["kind", "key"]))
    place = F.row_number().over(Window.partitionBy("kind", "key").orderBy("order_index", "doc_id"))
    first = keyed.withColumn("rank", place).where(F.col("rank") <= max(most, headings)).where(F.col("rank") <= F.when(F.col("kind") == "heading", headings).otherwise(most))
    vague = ~F.split("key", "\u0001")[0].rlike("doc_number|law_type|year")
    several = keyed.where(vague).groupBy("kind", "key").count().where("count > 1").select("kind", "key")
    return asked.join(first.join(several, ["kind", "key"], "left_anti"), ["kind", "key"]).select("question_id", "node_id", "rank")


def reference_exact() -> Column:
    """0.5 for the article, 0.3 for the clause and 0.2 for the point in place, less where only the path has them, 0 where one asked for is missing."""
    path = F.lower("path_title")

    def part(key: str, full: float, partial: float) -> Column:
        asked = F.lower(f"q_{key}")
        return F.when(asked.isNull(), 0.0).when(F.lower(key) == asked, full).when(F.contains(path, asked), partial).otherwise(-10.0)

    return F.greatest(F.least(part("article", 0.5, 0.2) + part("clause", 0.3, 0.1) + part("point", 0.2, 0.08), F.lit(1.0)), F.lit(0.0))


def metadata_prior() -> Column:
    """How well a document agrees with the number, agency, kind and year in the question."""
    asked, own = F.upper("q_doc_number"), F.upper("doc_number")
    number = F.when(asked.isNull(), 0.0).when(asked == own, 1.0).when(F.contains(asked, own) | F.contains(own, asked), 0.85).otherwise(0.0)
    hint, suffix = F.element_at(F.split(asked, "/"), -1), F.element_at(F.split(own, "/"), -1)
    agency = F.when(hint.isNull(), 0.0).when((hint == suffix) | (hint == F.upper("issuing_agency")), 1.0).when(F.contains(suffix, hint) | F.contains(F.upper("issuing_agency"), hint), 0.7).otherwise(0.0)
    kind = F.when(F.lower("q_law_type") == F.lower("law_type"), 1.0).otherwise(0.0)
    year = F.when(F.col("q_year") == F.col("year"), 1.0).otherwise(0.0)
    return 0.60 * number + 0.18 * agency + 0.12 * kind + 0.10 * year


# Words that ask for tables.
TABLE_TERMS = ["bang", "bieu", "phu luc", "danh muc", "danh sach", "table"]


def summary_score(question: Column, path: Column, text: Column, node_type: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of a pair without corpus statistics, 4 for each phrase of the question, 2 if its first four words are all there; tables last unless asked for."""
    said, there = tokens(question), tokens(text)
    norm = k1 * (1 - b + b * F.size(there))
    part = lambda n: n * (k1 + 1) / (n + norm)
    score = F.aggregate(said, F.lit(0.0), lambda total, w: total + part(F.size(F.filter(there, lambda x: x == w))))
    hay = norm_key(F.concat_ws(" ", path, text))
    phrases = F.size(F.filter(topic_phrases(question), lambda p: F.contains(hay, p)))
    first = F.slice(said, 1, 4)
    whole = (F.size(first) > 0) & F.forall(first, lambda w: F.contains(hay, w))
    tables = F.size(F.filter(F.array(*map(F.lit, TABLE_TERMS)), lambda t: F.contains(ascii_key(question), t))) > 0
    return score + 4.0 * phrases + F.when(whole, 2.0).otherwise(0.0) - F.when(~tables & node_type.isin("table", "table_row"), 10.0).otherwise(0.0)


def structure_bonus() -> Column:
    """0.1 for each heading word of the question in the path; for questions about changes, what is known of the candidate's versions."""
    path = norm_key("path_title")
    heads = 0.10 * F.size(F.filter(F.split("q_heading", ","), lambda t: (t != "") & F.contains(path, t)))
    changed = F.when((F.col("status") != "base") & (F.col("status") != ""), 0.10).otherwise(0.0) + F.least(F.lit(0.12), 0.03 * F.coalesce("n_events", F.lit(0)))
    return F.least(F.lit(0.22), heads + F.when(F.col("q_change") != "", F.coalesce(changed, F.lit(0.0))).otherwise(0.0))


def score_candidates(profiles: DataFrame, candidates: DataFrame, text: str = "question", mode: str = "passage", alpha: float = 0.55) -> DataFrame:
    """candidates (question_id, bm25, node columns) scored by the weights of ``mode``: exact, passage or content.

    Where candidates have a column ``dense``, it is mixed in with weight ``alpha``, but for explicit references in the modes
    exact and passage. status and n_events, as ``versioning.annotate`` gives them, raise questions about changes.
    """
    keys = FILTERS
    asked = profiles.select("question_id", F.col(text).alias("q_text"), topic_phrases(text).alias("phrases"), "explicit_reference", F.col("heading").alias("q_heading"), F.col("change").alias("q_change"), *[F.col(k).alias(f"q_{k}") for k in keys])
    for c, kind in (("status", "string"), ("n_events", "long")):
        if c not in candidates.columns:
            candidates = candidates.withColumn(c, F.lit(None).cast(kind))
    joined = candidates.join(asked, "question_id")
    hay = norm_key("text")
    joined = joined.withColumn("hits", F.size(F.filter("phrases", lambda p: F.contains(hay, p))))
    n, hits = F.size("phrases"), F.col("hits")
    coverage = F.when(n > 0, hits / n).otherwise(0.0)
    q = norm_key("q_text")
    bonus = sum((F.when(F.contains(q, F.lower(c)) & (F.col(c) != ""), w).otherwise(0.0) for c, w in (("article", 0.15), ("clause", 0.18), ("point", 0.18), ("path_title", 0.08))), F.lit(0.0))
    gate = F.when(n > 0, F.least(F.lit(0.24), 0.24 * coverage)).otherwise(0.0)
    penalty = F.when(n == 0, 0.0).when(hits == 0, 0.22).when((hits == 1) & (n >= 2), 0.06).otherwise(0.0)
    sparse = F.least(F.lit(1.0), F.col("bm25") / 8)
    hybrid = sparse
    if "dense" in candidates.columns:
        mixed = alpha * F.col("dense") + (1 - alpha) * sparse
        hybrid = mixed if mode == "content" else F.when(F.col("explicit_reference"), sparse).otherwise(mixed)
    parts = joined.select("*", hybrid.alias("hybrid"), coverage.alias("phrase_score"), bonus.alias("reference_bonus"), metadata_prior().alias("prior"), reference_exact().alias("exact"), structure_bonus().alias("structure_bonus"), gate.alias("gate"), penalty.alias("penalty"))
    weighted = lambda exact, hybrid, phrase, prior, structure, reference: (exact * F.col("exact") + hybrid * F.col("hybrid") + phrase * F.col("phrase_score") + prior * F.col("prior") + structure * F.col("structure_bonus") + reference * F.col("reference_bonus") + F.col("gate"))
    content = weighted(0.0, 0.42, 0.20, 0.10, 0.12, 0.08) - (F.col("penalty") if mode == "content" else 0.0)
    explicit = weighted(0.40, 0.22, 0.14, 0.10, 0.08, 0.06)
    score = {"exact": weighted(0.34, 0.24, 0.12, 0.12, 0.10, 0.08), "passage": F.when(F.col("explicit_reference"), explicit).otherwise(content), "content": content}[mode]
    return parts.withColumn("candidate_score", F.round(score, 6))


def documents_of(scored: DataFrame) -> DataFrame:
    """(question_id, doc_id, doc_score, rank, kept): best, mean of the two best, coverage and prior of each document.

    Two documents are kept if the second is within 0.08 of the first and the question has no explicit reference, else one;
    none below 0.05.
    """
    best = Window.partitionBy("question_id", "doc_id").orderBy(F.desc("candidate_score"), "node_id")
    two = scored.withColumn("k", F.row_number().over(best)).where("k <= 2")
    docs = two.groupBy("question_id", "doc_id").agg(F.max("candidate_score").alias("top"), F.avg("candidate_score").alias("mean2"), F.max("phrase_score").alias("coverage"), F.max("prior").alias("prior"), F.max("structure_bonus").alias("structure"), F.max("explicit_reference").alias("explicit"))
    docs = docs.select("question_id", "doc_id", "explicit", F.round(0.45 * F.col("top") + 0.25 * F.col("mean2") + 0.20 * F.col("coverage") + 0.10 * F.greatest("prior", "structure"), 4).alias("doc_score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("doc_score"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(order)).where("rank <= 2").withColumn("first", F.max("doc_score").over(Window.partitionBy("question_id")))
    return ranked.withColumn("kept", (F.col("first") >= 0.05) & ((F.col("rank") == 1) | (F.col("first") - F.col("doc_score") < 0.08) & ~F.col("explicit"))).drop("first", "explicit")


def grade(profiles: DataFrame, passages: DataFrame, text: str = "question") -> DataFrame:
    """(question_id, status, reason) from the passages (question_id, doc_number, article, clause, point, text) of each question."""
    joined = profiles.select("question_id", F.col(text).alias("q_text"), F.col("doc_number").alias("q_doc_number"), F.col("article").alias("q_article"), F.col("clause").alias("q_clause"), F.col("point").alias("q_point")).join(passages, "question_id", "left")
    words = F.array_distinct(F.filter(tokens("q_text"), lambda w: F.length(w) >= 4))
    meets = lambda k: F.max(F.coalesce(F.lower(f"q_{k}") == F.lower(k), F.lit(False)))
    # a word of the question counts if any passage holds it
    held = F.filter(words, lambda w: F.contains(norm_key("text"), w))
    graded = joined.groupBy("question_id").agg(
        F.count("text").alias("n"), meets("doc_number").alias("m_number"), meets("article").alias("m_article"), meets("clause").alias("m_clause"), meets("point").alias("m_point"), F.first("q_point").alias("qp"), F.first("q_doc_number").alias("qd"), F.first("q_article").alias("qa"),
        F.first("q_clause").alias("qc"), F.first(F.size(words)).alias("asked"), F.size(F.array_distinct(F.flatten(F.collect_set(held)))).alias("hits"),
    )
    relevant = F.when(F.col("asked") == 0, F.lit(True)).otherwise(F.col("hits") >= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("asked") / 4))))
    reason = (
        F.when(F.col("n") == 0, "no_passages").when(F.col("qd").isNotNull() & ~F.col("m_number"), "requested_doc_number_not_found").when(F.col("qa").isNotNull() & ~F.col("m_article"), "requested_article_not_found")
        .when(F.col("qc").isNotNull() & ~F.col("m_clause"), "requested_clause_not_found")
        .when(F.col("qp").isNotNull() & ~F.col("m_point"), "requested_point_not_found").when(relevant, "matched_retrieved_context").otherwise("no_relevant_text")
    )
    return graded.select("question_id", reason.alias("reason")).withColumn("status", F.when(F.col("reason") == "matched_retrieved_context", "sufficient").otherwise("insufficient"))


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, n_refs, n_unsupported, valid) for the references in answers (question_id, answer) against their passages."""
    refs = lambda pattern, label: F.transform(F.regexp_extract_all(norm_key("answer"), F.lit(pattern), 1), lambda n: F.concat(F.lit(label), n))
    number = F.transform(F.regexp_extract_all(F.upper("answer"), F.lit(r"(?U)\b(\d{1,4}/\d{4}/[A-ZĐ\-]+)\b"), 1), lambda n: F.lower(n))
    cited = answers.select("question_id", F.explode(F.array_distinct(F.concat(refs(r"điều\s+(\d+)", "điều "), refs(r"khoản\s+(\d+)", "khoản "), refs(r"(?<!quan )điểm\s+([a-zđ])(?=\s|[,.;:)\]]|$)", "điểm "), number))).alias("ref"))
    values = passages.select("question_id", F.explode(F.array(F.lower("article"), F.lower("clause"), F.lower("point"), F.lower("doc_number"))).alias("ref")).where("ref is not null").distinct().withColumn("known", F.lit(True))
    checked = cited.join(values, ["question_id", "ref"], "left").groupBy("question_id").agg(F.count("*").alias("n_refs"), F.count_if(F.col("known").isNull()).alias("n_unsupported"))
    return answers.select("question_id").join(checked, "question_id", "left").fillna(0).withColumn("valid", F.col("n_unsupported") == 0)


def overlap(question: str, text: str) -> Column:
    return phrase_overlap(topic_phrases(question), text)
