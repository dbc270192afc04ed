"""Headers of legal documents: kind, number, date, title, agency, slug. One projection over a document's lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juriloom.functions.text import ascii_key, norm_space, slug

# Kinds of documents as they stand alone on a line.
DOC_TYPES = ["BỘ LUẬT", "LUẬT", "PHÁP LỆNH", "NGHỊ QUYẾT", "NGHỊ ĐỊNH", "QUYẾT ĐỊNH", "CHỈ THỊ", "CÔNG ĐIỆN", "THÔNG TƯ", "THÔNG TƯ LIÊN TỊCH", "KẾ HOẠCH", "CHƯƠNG TRÌNH", "ĐỀ ÁN"]
# Forms of numbers, dates, and of lines that end a title or name an agency.
NUMBER_LINE = r"(?iu)^số\s*:?\s*(.+)$"
STRICT_NUMBER = r"\b(\d{1,4}\s*/\s*\d{4}\s*/\s*[A-ZĐ\-]+)"
DATE = r"(?iu)ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
SLASH_DATE = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
PLACE = r"(?iu)([\p{L}\s.\-]+?)\s*,\s*ngày\s*\d"
TITLE_STOP = r"(?iu)^(căn cứ\b|theo đề nghị\b|xét\b|điều\s+\d+|chương\s+[ivxlc\d]+|mục\s+\d+|phần\s+[ivxlc\d]+|\d+\.\s+|[a-zđ]\)\s+)"
AGENCY = r"(?iu)^(ngân hàng nhà nước|hội đồng nhân dân|ủy ban nhân dân|tòa án nhân dân|viện kiểm sát|kiểm toán nhà nước|bộ\s|chính phủ|thủ tướng)"
ACTING = r"(?iu)^(bộ trưởng|thủ tướng|chủ tịch|thống đốc|chánh án|viện trưởng|tổng kiểm toán)\s"
FILE_NUMBER = r"(?i)(?<![A-Z0-9Đ])(\d{1,4})_(?:(\d{4})_)?([A-ZĐ]{1,6}(?:-[A-ZĐ0-9]{1,20})+)(?:_[0-9]+)?(?![A-Z0-9Đ])"
TYPE_LINES, NUMBER_LINES, DATE_LINES, TITLE_LINES, UPPER_SHARE = 20, 50, 80, 12, 0.72


def lines(text: Column | str) -> Column:
    """Collapsed lines without blank ones."""
    raw = F.split(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.filter(F.transform(raw, norm_space), lambda x: x != "")


def _first(array: Column) -> Column:
    return F.get(array, 0)


def _number(line: Column) -> Column:
    found = F.regexp_extract(F.upper(F.regexp_extract(line, NUMBER_LINE, 1)), STRICT_NUMBER, 1)
    return F.nullif(F.regexp_replace(found, r"\s+", ""), F.lit(""))


def _upper_like(line: Column) -> Column:
    letters, capitals = F.regexp_replace(line, r"[^\p{L}]", ""), F.regexp_replace(line, r"[^\p{Lu}]", "")
    return (F.length(letters) >= 4) & (F.length(capitals) >= UPPER_SHARE * F.length(letters))


def _day(line: Column, pattern: str) -> Column:
    part = lambda i, n: F.lpad(F.regexp_extract(line, pattern, i), n, "0")
    return F.when(line.rlike(pattern), F.concat_ws("/", part(1, 2), part(2, 2), part(3, 4)))


def headers(docs: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """docs with doc_type, doc_number, date_raw, year, place, official_title, issuing_agency, file_stem and header_id."""
    plain = lambda x: F.regexp_replace(ascii_key(x), "[^a-z0-9]+", "")
    basis = lambda x: ascii_key(x).rlike("^(can cu |theo de nghi|xet )")
    a = docs.withColumn("_l", lines(text))
    numbers = lambda n: _first(F.filter(F.transform(F.slice("_l", 1, n), _number), lambda x: x.isNotNull()))
    from_name = F.concat_ws("/", F.regexp_extract(F.upper(name), FILE_NUMBER, 1).cast("string"), F.nullif(F.regexp_extract(F.upper(name), FILE_NUMBER, 2), F.lit("")), F.regexp_extract(F.upper(name), FILE_NUMBER, 3))
    a = a.withColumn("doc_number", F.coalesce(numbers(NUMBER_LINES), numbers(1 << 30), F.when(F.upper(name).rlike(FILE_NUMBER), F.regexp_replace(from_name, "^0+(?=[0-9])", "")), F.lit("")))
    at = _first(F.filter(F.transform(F.slice("_l", 1, TYPE_LINES), lambda x, i: F.when(F.upper(x).isin(DOC_TYPES), i)), lambda i: i.isNotNull()))
    a = a.withColumn("_at", at).withColumn("doc_type", F.when(F.col("_at").isNotNull(), F.initcap(F.lower(F.get("_l", F.col("_at"))))).otherwise(""))
    dated = F.filter("_l", lambda x: x.rlike(DATE))
    own = _first(F.filter(dated, lambda x: (F.col("doc_number") != "") & F.contains(plain(x), plain("doc_number"))))
    head = _first(F.filter(F.filter(F.slice("_l", 1, DATE_LINES), lambda x: x.rlike(DATE)), lambda x: ~basis(x)))
    last = _first(F.reverse(F.filter(dated, lambda x: ~basis(x))))
    slashed = _first(F.reverse(F.filter("_l", lambda x: x.rlike(SLASH_DATE) & ~basis(x))))
    a = a.withColumn("_date", F.coalesce(own, head, last)).withColumn("_slashed", slashed)
    a = a.withColumn("date_raw", F.coalesce(_day(F.col("_date"), DATE), _day(F.col("_slashed"), SLASH_DATE), _day(F.col(name), SLASH_DATE), F.lit("")))
    a = a.withColumn("place", F.when(F.col("_date").isNotNull(), norm_space(F.regexp_extract("_date", PLACE, 1))).otherwise(""))
    block = F.slice("_l", F.col("_at") + 2, TITLE_LINES)
    stops = lambda x: x.rlike(TITLE_STOP) | x.rlike(NUMBER_LINE) | x.rlike(DATE) | x.rlike(SLASH_DATE) | ~(_upper_like(x) | F.startswith(F.upper(x), F.lit("VỀ VIỆC")))
    a = a.withColumn("_block", F.when(F.col("_at").isNotNull(), block).otherwise(F.array().cast("array<string>")))
    end = F.coalesce(_first(F.filter(F.transform("_block", lambda x, i: F.when(stops(x), i)), lambda i: i.isNotNull())), F.size("_block"))
    a = a.withColumn("official_title", F.array_join(F.slice("_block", 1, end), " "))
    a = a.withColumn("year", F.coalesce(F.try_to_number(F.nullif(F.substring("date_raw", 7, 4), F.lit("")), F.lit("9999")).cast("int"), F.nullif(F.regexp_extract("doc_number", r"/(\d{4})/", 1), F.lit("")).cast("int"), F.lit(0)))
    outside = lambda x: (F.col("official_title") == "") | ~F.contains(F.upper("official_title"), F.upper(x))
    acting = _first(F.filter(F.slice("_l", 1, DATE_LINES), lambda x: x.rlike(ACTING) & outside(x)))
    named = _first(F.filter(F.slice("_l", 1, 30), lambda x: x.rlike(AGENCY) & outside(x)))
    a = a.withColumn("issuing_agency", F.coalesce(acting, named, F.lit("")))
    some = lambda x: F.nullif(F.col(x), F.lit(""))
    a = a.withColumn("file_stem", slug(name)).withColumn("header_id", slug(F.coalesce(some("doc_number"), some("official_title"), some(name), F.lit("document"))))
    return a.drop("_l", "_at", "_date", "_slashed", "_block")
