import zipfile

from pyspark.sql import functions as F

from juriloom.operators import answers, dense, header, lexical, navigation, parser, planning, retrieval
from juriloom.plans import jobs
from juriloom.plans.settings import Providers
from juriloom.sources import files
from juriloom.streaming import ingest

PLAN = """BỘ TÀI CHÍNH
KẾ HOẠCH
I. MỤC TIÊU
1. Mục tiêu chung 1.1. Giảm thủ tục 1.2. Tăng tốc
- Gạch đầu dòng
II. NHIỆM VỤ
| Việc | Hạn |
| Rà soát | Quý I |
Nơi nhận:
- Như trên;
Phụ lục 1
1. Mẫu số 1"""
DECISION = """QUYẾT ĐỊNH
Điều 1. Phạm vi
1. Áp dụng với
a) tổ chức;
b) cá nhân
nước ngoài.
Điều 2. Hiệu lực
Theo khoản 1 Điều 1."""


def test_parser_reads_a_plan():
    nodes = parser.parse("p", PLAN)
    kinds = [n["node_type"] for n in nodes]
    assert kinds == ["document", "attachment", "roman_section", "item", "decimal_item", "decimal_item", "bullet", "roman_section", "table", "table_row", "table_row", "appendix", "item"]
    by_id = {n["node_id"]: n for n in nodes}
    assert by_id[nodes[5]["parent_id"]]["label"] == "1.1"  # decimals form a chain
    assert not any("Như trên" in n["text"] for n in nodes)


def test_parser_reads_a_decision():
    nodes = parser.parse("d", DECISION)
    points = [n for n in nodes if n["node_type"] == "point"]
    assert [p["label"] for p in points] == ["Điểm a", "Điểm b"]
    assert points[1]["text"].endswith("cá nhân nước ngoài.")
    assert points[0]["article"] == "Điều 1" and points[0]["clause"] == "Khoản 1"
    assert points[0]["path_title"] == "Điều 1 > Khoản 1 > Điểm a"
    assert parser.parse("e", None)[0]["node_type"] == "document" and len(parser.parse("e", "")) == 1


def test_header_ladders(spark):
    text = "BỘ Y TẾ\nSố: 12/2020/TT-BYT\nHà Nội, ngày 3 tháng 4 năm 2020\nTHÔNG TƯ\nVỀ VIỆC KHÁM BỆNH\nCăn cứ Luật ngày 1 tháng 1 năm 2010;\nĐiều 1. Phạm vi"
    rows = [(text, "a.txt"), (None, "04_2026_TT-BYT_123456.docx"), ("", None)]
    got = header.headers(spark.createDataFrame(rows, "text string, file_name string")).collect()
    assert (got[0]["doc_number"], got[0]["date_raw"], got[0]["year"], got[0]["place"], got[0]["official_title"], got[0]["issuing_agency"]) == ("12/2020/TT-BYT", "03/04/2020", 2020, "Hà Nội", "VỀ VIỆC KHÁM BỆNH", "BỘ Y TẾ")
    assert got[1]["doc_number"] == "4/2026/TT-BYT" and got[1]["year"] == 2026
    assert got[2]["doc_number"] == "" and got[2]["header_id"] == "document"


def test_routes(spark):
    asked = ["Điều 5 bị bãi bỏ khi nào?", "Khoản 2 Điều 7 quy định gì?", "Những nguyên tắc nào?", "Có phải nộp không?", "Văn bản 12/2020/TT-BYT", "Ai đó", None]
    got = planning.profile(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "question_id int, question string")).orderBy("question_id").collect()
    assert [r["route"] for r in got] == ["version_change", "direct_reference", "heading_list", "condition_circumstance", "document_focus", "factoid", "factoid"]
    assert got[1]["clause"] == "Khoản 2" and got[1]["article"] == "Điều 7"


def test_json_block(spark):
    rows = [('```json\n{"a": 1}\n```',), ('so {"a": {"b": 2}} it is',), ("none",), ("{broken",), (None,)]
    got = [r["j"] for r in spark.createDataFrame(rows, "x string").select(planning.json_block("x").alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_bm25_counts_repeated_tokens(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a"]), (3, [])], "d int, w array<string>")
    q = spark.createDataFrame([("q", ["a", "a"]), ("r", ["z"])], "question_id string, words array<string>")
    got = {r["doc"]: r["score"] for r in lexical.bm25(q, docs, "d", F.col("w")).collect()}
    assert set(got) == {1, 2} and got[2] > got[1]
    empty = lexical.bm25(q.limit(0), docs, "d", F.col("w"))
    assert empty.count() == 0


def test_dense_ties_go_by_id(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in dense.dense_top_k(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_adequacy(spark):
    rows = [("Hồ sơ gồm gì và thời hạn bao lâu?", "Hồ sơ gồm đơn.", 2), ("Ai?", "Không tìm thấy căn cứ.", 1), ("Ai?", "x", 0), ("Phạm vi?", "Phạm vi toàn quốc", 1)]
    df = spark.createDataFrame(rows, "question string, answer string, n_passages int")
    assert [r["v"] for r in df.select(navigation.adequacy(df).alias("v")).collect()] == ["part_not_covered", "refusal_with_evidence", "no_passages", "adequate"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Điều 1. Ở đây\n".encode() + b"\xff")
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Điều 1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "c.docx").write_bytes(b"no zip")
    assert files.read_texts(spark, str(tmp_path)).first()["text"].startswith("Điều 1. Ở đây")
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got["b.docx"] == ("Điều 1\nA | B", None) and got["c.docx"] == (None, "BadZipFile")
    listing = files.preferred(spark.createDataFrame([("x/K.pdf",), ("x/k.docx",), ("x/j.txt",)], "path string"))
    assert sorted(r["path"] for r in listing.collect()) == ["x/j.txt", "x/k.docx"]
    done = spark.createDataFrame([("k", 500), ("j", 3)], "stem string, length long")
    assert [r["stem"] for r in files.pending(listing, done).collect()] == ["j"]
    files.write_jsonl(listing, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "path string, stem string").count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text(DECISION)
    q = ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "nodes"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "nodes")).where("node_type = 'article'").count() == 2
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    rows.write.parquet(str(tmp_path / "rows"))
    s = ingest.upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")), ["k"], ["v"], str(tmp_path / "table"), str(tmp_path / "ck2"))
    s.awaitTermination(120)
    assert {(r["k"], r["x"]) for r in spark.read.parquet(str(tmp_path / "table" / "v0")).collect()} == {(1, "b"), (2, "c")}


def test_rebuild_and_statistics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(DECISION)
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    paths = jobs.rebuild(spark, str(tmp_path / "in"), f"file://{tmp_path}/out")
    nodes = spark.read.parquet(paths["nodes"])
    assert nodes.where("node_type = 'point'").count() == 2 and spark.read.parquet(paths["edges"]).count() == nodes.count() - 1
    assert [r["error"] for r in spark.read.parquet(paths["errors"]).collect()] == ["unsupported"]
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id int, text string")
    first = jobs.bm25_statistics(docs, f"file://{tmp_path}/stats")
    again = jobs.bm25_statistics(docs.limit(1), f"file://{tmp_path}/stats")
    forced = jobs.bm25_statistics(docs.limit(1), f"file://{tmp_path}/stats1")
    assert {r["token"]: r["df"] for r in again[0].collect()} == {r["token"]: r["df"] for r in first[0].collect()} == {"a": 2, "b": 1} and forced[1].first()["n_docs"] == 1


def test_vector_collection(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0], "Luật", "1/2020/QH"), (2, 1, [0.0, 1.0], "Nghị định", "2/2020/NĐ-CP")]
    schema = "vec_id long, version int, embedding array<double>, law_type string, doc_number string"
    jobs.store_vectors(spark.createDataFrame(rows, schema), f"file://{tmp_path}/v", "vec_id")
    stored = jobs.store_vectors(spark.createDataFrame([(1, 2, [0.0, 1.0], "Luật", "1/2020/QH"), (3, 1, [1.0, 0.0], "Luật", "3/2020/QH")], schema), f"file://{tmp_path}/v", "vec_id")
    assert stored.count() == 3
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, embedding array<double>")
    assert [r["vec_id"] for r in jobs.search_vectors(stored, asked, 2, {"law_type": "Luật"}).orderBy("rank").collect()] == [1, 3]


def test_logs(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert jobs.append_log(spark.createDataFrame([("r1", "Ai phải nộp?", "Ông A  nộp")], "request_id string, question string, answer string"), log)
    assert jobs.append_log(spark.createDataFrame([("r2", "Thời hạn?", "Ba ngày")], "request_id string, question string, answer string"), log)
    assert not jobs.append_log(spark.createDataFrame([(1,)], "a int"), "nosuch://x/y")
    found = spark.read.json(log)
    assert [r["request_id"] for r in jobs.search_log(found, said="BA NGÀY").collect()] == ["r2"]
    assert jobs.search_log(found, request_id="r1").first()["answer"] == "Ông A nộp" and jobs.search_log(found, last=1).count() == 1
    assert jobs.search_log(found, request_id="r1", compact=False).columns == found.columns


def test_judge_provider(spark):
    df = spark.createDataFrame([("Ai?", "x", 1), ("Ai?", "y", 0)], "question string, answer string, n_passages int")
    judge = Providers(judge=lambda q, a: F.when(a == "x", "model says no"))
    verdicts = lambda **o: [(r["verdict"], r["provider"]) for r in jobs.judged(df, **o).orderBy("answer").collect()]
    assert verdicts(enabled=False) == [("adequate", "disabled")] * 2
    assert verdicts(providers=judge) == [("model says no", "model"), ("no_passages", "heuristic")]
    assert verdicts(providers=judge, provider="heuristic") == [("adequate", "heuristic"), ("no_passages", "heuristic")]


def _tree(spark):
    rows = [("d", None, "document", "Luật 1", 0, None, None, None, ""), ("a1", "d", "article", "Điều 1. Phạm vi", 1, "Điều 1", None, None, "Điều 1. Phạm vi"), ("c1", "a1", "clause", "1. Gồm:", 2, "Điều 1", "Khoản 1", None, "Điều 1. Phạm vi > Khoản 1"), ("p1", "c1", "point", "a) nhà máy", 3, "Điều 1", "Khoản 1", "Điểm a", "x"), ("p2", "c1", "point", "b) cửa hàng nhỏ", 4, "Điều 1", "Khoản 1", "Điểm b", "x"), ("c2", "a1", "clause", "2. Không gồm cửa hàng", 5, "Điều 1", "Khoản 2", None, "y")]
    nodes = spark.createDataFrame([(n, "d", p, k, t, o, a, c, q, path, "1/2020/QH", "Luật", 2020, "QH") for n, p, k, t, o, a, c, q, path in rows], "node_id string, doc_id string, parent_id string, node_type string, text string, order_index int, article string, clause string, point string, path_title string, doc_number string, law_type string, year int, issuing_agency string")
    return nodes.withColumn("label", F.col("text")).withColumn("level", F.lit(3))


def test_navigation_and_evidence(spark):
    nodes = _tree(spark)
    asked = spark.createDataFrame([("q1", "Điều 1 của 1/2020/QH bao gồm những gì về cửa hàng?"), ("q2", "Điểm a Khoản 1 Điều 1 của 1/2020/QH?"), ("q3", "So sánh Điều 1 của 1/2020/QH")], "question_id string, question string")
    profiles = planning.profile(asked)
    start = retrieval.direct_targets(profiles, nodes)
    assert {(r["question_id"], r["node_id"]) for r in start.collect()} == {("q1", "a1"), ("q2", "p1"), ("q3", "a1")}
    walked, relations = navigation.navigate(profiles, nodes, start)
    ends = {(r["question_id"], r["rank"]): (r["node_id"], r["hops"]) for r in walked.collect()}
    assert ends["q1", 1] == ("p2", 2) and ends["q2", 1] == ("p1", 0)  # the short clause comes first, and below it the point about shops
    got = navigation.evidence(walked, relations, asked.withColumn("scope", planning.scope()), nodes).orderBy("question_id", "place").collect()
    assert [(r["node_id"], r["role"], r["answer_source"]) for r in got if r["question_id"] == "q1"] == [("p1", "primary", "children"), ("p2", "primary", "children")]
    assert [r["node_id"] for r in got if r["question_id"] == "q2"] == ["p1"]
    chosen = spark.createDataFrame([("q", "p1", 1)], "question_id string, node_id string, rank int")
    by = lambda source: [r["node_id"] for r in navigation.evidence_by_source(chosen, nodes, source).orderBy("place").collect()]
    assert (by("own_text"), by("siblings"), by("parent"), by("parent_heading"), by("children")) == (["p1"], ["p1", "p2"], ["c1"], ["d"], [])
    empty, none = navigation.navigate(profiles.limit(0), nodes, start.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_workflow(spark):
    asked = spark.createDataFrame([("q1", "Khoản 2 Điều 1 của 1/2020/QH không gồm cửa hàng nào?"), ("q2", "Điều 9 của 1/2020/QH?")], "question_id string, question string")
    done = jobs.answer_questions(asked, _tree(spark))
    assert {r["question_id"]: r["answer"] for r in done["answers"].collect()} == {"q1": "2. Không gồm cửa hàng", "q2": answers.REFUSAL}
    out = {r["sample_id"]: r for r in jobs.collect_outputs(asked.withColumnRenamed("question_id", "sample_id"), _tree(spark)).collect()}
    assert out["q1"]["contexts"] == ["2. Không gồm cửa hàng"] and out["q2"]["contexts"] is None
