from pyspark.sql import functions as F

from juriloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_keys(spark):
    assert one(spark, "  Điều  6 ", T.ascii_key("x")) == "dieu 6"
    assert one(spark, "ĐẶNG Văn Ngữ", T.ascii_key("x")) == "dang van ngu"
    assert one(spark, None, T.norm_space("x")) == ""
    assert one(spark, "", T.slug("x")) == "document"
    assert one(spark, "Nghị định 12/2020", T.slug("x")) == "nghị_định_12_2020"
    assert one(spark, "a" * 50, T.truncate("x", 10)) == "aaaaaaa..."


def test_tokens_and_phrases(spark):
    assert one(spark, "Khoản 2 Điều 6, điểm đ", T.reference_tokens("x")) == ["điều_6", "article_6", "khoản_2", "clause_2", "điểm_đ", "point_đ"]
    assert one(spark, "trách nhiệm của bộ", T.topic_phrases("x")) == ["trách nhiệm của", "nhiệm của bộ", "trách nhiệm"]
    assert one(spark, "một", T.ngrams(T.tokens("x"), 2)) == []
    assert one(spark, "", T.search_tokens("x")) == []


def test_mojibake(spark):
    assert one(spark, "Điều kiện".encode().decode("latin1"), T.repair_mojibake("x")) == "Điều kiện"
    assert one(spark, "Ã là chữ", T.repair_mojibake("x")) == "Ã là chữ"


def test_uuid5(spark):
    import uuid

    assert one(spark, "chunk-1", T.uuid5(str(uuid.NAMESPACE_DNS), F.col("x"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "chunk-1"))
