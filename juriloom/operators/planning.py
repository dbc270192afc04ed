"""Questions to profiles: references, document numbers, years, kinds, cue words, route and scope. One projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriloom.functions.text import ascii_key, norm_space, topic_phrases

# Kinds of documents by key, in order of precedence.
LAW_TYPES = {"bo luat": "Bộ luật", "luat": "Luật", "nghi dinh": "Nghị định", "thong tu": "Thông tư", "quyet dinh": "Quyết định", "chi thi": "Chỉ thị", "cong dien": "Công điện", "nghi quyet": "Nghị quyết"}
# Cue words, in order.
HEADING_TERMS = ["nguyen tac", "quan diem", "muc tieu", "yeu cau", "pham vi", "doi tuong ap dung", "trach nhiem", "nhiem vu", "giai phap", "to chuc thuc hien", "phuong thuc", "dieu kien", "ho so", "thoi han", "trinh tu", "thu tuc", "hieu luc thi hanh"]
CHANGE_TERMS = ["bai bo", "sua doi", "bo sung", "thay the", "co hieu luc", "het hieu luc"]
CONDITION_TERMS = ["truong hop nao", "khi nao", "dieu kien nao", "duoc phan cap", "duoc", "phai", "neu"]
LIST_TERMS = ["bao gom nhung gi", "gom nhung gi", "gom nhung noi dung nao", "nhung nguyen tac nao", "nhung truong hop nao", "nhung dieu kien nao", "liet ke"]
HORIZON_MARKERS = ["den nam", "tam nhin", "giai doan", "ke hoach nam", "du toan ngan sach", "quy hoach", "muc tieu"]
YEAR_MARKERS = ["ban hanh", "ngay", "thang", "nam ban hanh", "van ban nam", "hieu luc"]
BEFORE_YEAR, AFTER_YEAR = 55, 30


def contained(key: Column, terms: list[str]) -> Column:
    """The terms that a key holds, in their order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(key, t))


def profile(questions: DataFrame, text: str = "question") -> DataFrame:
    """The questions with their profile. Missing parts are null; lists of terms are joined by commas."""
    keyed = questions.withColumn("q", norm_space(text)).withColumn("key", ascii_key(text))
    first = lambda pattern, of="key": F.nullif(F.regexp_extract(of, pattern, 1), F.lit(""))
    year = first(r"\b(19\d{2}|20\d{2})\b")
    point = first(r"\bdiem\s*([a-z])\b")
    found = keyed.select(
        "*", F.concat(F.lit("Điều "), first(r"\bdieu\s*(\d+[a-z]?)\b")).alias("article"), F.concat(F.lit("Khoản "), first(r"\bkhoan\s*(\d+)\b")).alias("clause"),
        F.concat(F.lit("Điểm "), F.when(point == "d", "đ").otherwise(point)).alias("point"), year.alias("any_year"),
        F.nullif(F.regexp_extract(F.upper("q"), r"(?U)\b(\d{1,4}/(?:\d{4}/)?[A-ZĐ\-]+)\b", 1), F.lit("")).alias("doc_number"),
        F.coalesce(*[F.when(F.contains("key", F.lit(k)), v) for k, v in LAW_TYPES.items()]).alias("law_type"),
        contained(F.col("key"), HEADING_TERMS).alias("heading"), contained(F.col("key"), CHANGE_TERMS).alias("change"), contained(F.col("key"), CONDITION_TERMS).alias("condition"), contained(F.col("key"), LIST_TERMS).alias("lists"),
    )
    at = F.instr("key", F.col("any_year"))
    low = F.greatest(at - BEFORE_YEAR, F.lit(1))
    near = F.substring("key", low, at + 4 + AFTER_YEAR - low)
    meant = (F.size(contained(near, HORIZON_MARKERS)) == 0) & (F.size(contained(near, YEAR_MARKERS)) > 0)
    some = lambda c: F.size(c) > 0
    explicit = F.col("article").isNotNull() | F.col("clause").isNotNull() | F.col("point").isNotNull()
    route = (
        F.when(some("change"), "version_change").when(explicit, "direct_reference").when(some("heading") & some("lists"), "heading_list").when(some("heading") & ~some("condition"), "heading_list")
        .when(some("condition"), "condition_circumstance").when(F.col("doc_number").isNotNull(), "document_focus").otherwise("factoid")
    )
    out = found.withColumn("year", F.when(F.coalesce(meant, F.lit(False)), F.col("any_year").cast("int"))).withColumn("route", route).withColumn("explicit_reference", explicit)
    out = out.withColumn("removed_year", F.when(F.col("year").isNull(), F.col("any_year").cast("int")))
    out = out.withColumn("prefers_bundle", F.col("route").isin("heading_list", "version_change") | (explicit & F.col("clause").isNull() & F.col("point").isNull()))
    out = out.withColumn("wants_list", some("lists") | (F.col("route") == "heading_list"))
    for c in ("heading", "change", "condition", "lists"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out.drop("q", "key", "any_year")


FILTERS = ["doc_number", "law_type", "year", "article", "clause", "point"]
# Words that ask for a document as a whole.
SUMMARY_TERMS = ["quy định về vấn đề gì", "quy định về gì", "nói về vấn đề gì", "nói về gì", "điều chỉnh vấn đề gì", "điều chỉnh gì", "về vấn đề gì", "phạm vi điều chỉnh là gì"]
WHOLE_DOCUMENTS = ["văn bản", "thông tư", "nghị định", "quyết định", "luật", "bộ luật", "nghị quyết"]


def rules_suffice() -> Column:
    """True for profiles that need no planner: they name a provision, or their document or heading fits their route."""
    named = lambda *keys: F.greatest(*[F.col(k).isNotNull() for k in keys])
    of_document, heading = named("doc_number", "law_type", "year"), F.col("heading") != ""
    return named("article", "clause", "point") | (of_document & F.col("route").isin("direct_reference", "document_focus", "heading_list", "version_change")) | (heading & F.col("route").isin("heading_list", "document_focus")) | ((F.col("change") != "") & of_document)


def normalised_filter(name: str, value: Column) -> Column:
    """A planner's value of a filter as profiles have it; null where it says nothing, or names no known kind of document."""
    clean = norm_space(value)
    clean = F.when(clean.isin("", "null", "None"), None).otherwise(clean)
    low = F.lower(clean)
    found = lambda label, pattern: F.coalesce(F.concat(F.lit(label), F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))), clean)
    if name == "law_type":
        return F.when(low.isin([v.lower() for v in LAW_TYPES.values()] + ["văn bản hợp nhất", "unknown"]), clean)
    return {"article": lambda: found("Điều ", r"(\d+[a-z]?)"), "clause": lambda: found("Khoản ", r"(\d+)"), "point": lambda: found("Điểm ", r"([a-zđ])")}.get(name, lambda: clean)()


def merge(profiles: DataFrame, planned: DataFrame) -> DataFrame:
    """Profiles with what a planner adds: planned (question_id and any of the filters and route, as texts) overrides where it says something."""
    given = [k for k in [*FILTERS, "route"] if k in planned.columns]
    extra = planned.select("question_id", *[normalised_filter(k, F.col(k)).alias(f"_{k}") for k in given])
    joined = profiles.join(extra, "question_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(f"_{k}").try_cast("int") if k == "year" else F.col(f"_{k}"), F.col(k)) for k in given}).drop(*[f"_{k}" for k in given])


def asks_for_whole_document(text: str = "question") -> Column:
    """True for questions that ask for a document's content as a whole."""
    low = norm_space(F.lower(text))
    has = lambda terms: F.greatest(*[F.contains(low, F.lit(t)) for t in terms])
    return F.coalesce(has(SUMMARY_TERMS) & has(WHOLE_DOCUMENTS), F.lit(False))


def scope(text: str = "question") -> Column:
    """What kind of answer is asked for."""
    key = ascii_key(text)
    has = lambda *terms: F.size(contained(key, list(terms))) > 0
    return (
        F.when(has("so sanh", "khac nhau"), "comparison").when(has(*LIST_TERMS), "list").when(has("trinh tu", "thu tuc", "quy trinh"), "procedure")
        .when(has("la gi", "the nao la"), "definition").when(has("tom tat", "noi dung chinh"), "summary").otherwise("exact")
    )


def expanded(profiles: DataFrame, text: str = "question", most: int = 5) -> DataFrame:
    """(question_id, query_no, query): the question, its references joined, its first three phrases; distinct, at most ``most``."""
    refs = F.nullif(F.concat_ws(" ", "doc_number", "article", "clause", "point"), F.lit(""))
    candidates = F.array_compact(F.concat(F.array(norm_space(text), refs), F.slice(topic_phrases(text), 1, 3)))
    return profiles.select("question_id", F.posexplode(F.slice(F.array_distinct(candidates), 1, most)).alias("query_no", "query"))


def json_block(x: str) -> Column:
    """The JSON object in a model's answer: a fenced block, else from the first brace to the last, else null."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    block = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))
    return F.when(F.try_parse_json(block).isNotNull(), block)
