"""Dedup, decontamination, language model and the pipeline against plain versions on small tables."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from juriloom.llm import components, decontaminate, line_dedup, minhash_dedup, ngram_lm, queries, substring_dedup
from juriloom.llm.words import U, hash_word

import brute
from oracle import both

r = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(r.choices(VOCABULARY, k=n))


PASSAGE = prose(70)
BASE = prose(200)


def edited(text, share):
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


TEXTS = [None, "", " \n ", "one", "one", prose(30), PASSAGE, prose(40) + " " + PASSAGE + " " + prose(10), PASSAGE + "\n" + PASSAGE, BASE, BASE.upper(), *(edited(BASE, 0.02) for _ in range(25)), *(edited(BASE, 0.09) for _ in range(15)), prose(20_000), *(prose(60) for _ in range(20))]
SCHEMA = "doc_id long, text string, id long, h string, block int, part int, component long, k long, n long, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "h", 2, 3, 4, 5, 6, "c") for i, t in enumerate(TEXTS)], SCHEMA).repartition(5)


def test_substring_dedup(docs):
    want = brute.substring(list(enumerate(TEXTS)), 50)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 300
    short = {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(docs, size=3).collect()}
    assert short == {d: v[1] for d, v in brute.substring(list(enumerate(TEXTS)), 3).items()}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_of_many_blocks_and_false_estimates(docs, monkeypatch):
    want = {d: v[1] for d, v in brute.substring(list(enumerate(TEXTS)), 50).items()}
    monkeypatch.setattr(substring_dedup, "CELLS", -2)  # four windows for each counter
    found = substring_dedup.remove_repeats(docs, block_bytes=4096, range_windows=1000)
    assert {x["doc_id"]: x["n_removed"] for x in found.collect()} == want


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_regular_words_and_windows_are_told_apart(spark):
    one, other = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    frame = prose(49)
    texts = [f"{one} {frame}", f"{other} {frame}", f"{one} {frame}", " ".join(thue_morse(64, "x", "y")), " ".join(thue_morse(64, "y", "x"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.remove_repeats(df).collect()}
    assert got == {d: v[1] for d, v in brute.substring(list(enumerate(texts)), 50).items()}
    linked = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(spark.createDataFrame([(0, one), (1, other), (2, one)], "doc_id long, text string")).collect()}
    assert linked == {0: 0, 1: 1, 2: 0}
    kn = brute.KneserNey(texts)
    model = ngram_lm.train(df)
    assert (model.n_words, model.n_pairs) == (kn.v, len(kn.pairs))


def test_substring_dedup_null_and_repeated_ids(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (0, "x")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] is None, x["n_removed"]) for x in got) == [(False, 0), (False, 0), (False, 0), (True, 70)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    want = brute.components(list(enumerate(TEXTS)), size)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(docs, size=size).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(TEXTS) - 20
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_null_ids(spark):
    rows = [(None, BASE), (5, BASE), (3, BASE), (3, BASE)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), str(x["component_id"]), x["kept"]) for x in got) == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("None", "None", True)]


def test_index_finds_all_pairs_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, minhash_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        at = rng.choice(minhash_dedup.SYMBOLS, 2 * minhash_dedup.CHUNKS - 1, replace=False)
        b[i, at] ^= 1
    hit = [bool(set(x) & set(y)) for x, y in zip(minhash_dedup.keys(a).tolist(), minhash_dedup.keys(b).tolist(), strict=True)]
    assert all(hit)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 8), (8, 7), (20, 21), (21, 20), (30, 30)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20, 30: 30}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows, run):
    at, first = {}, {}
    for d, t in rows:
        at[d] = [(i, x) for i, x in enumerate((t or "").split("\n")) if brute.WORD.search(x)]
    for d in sorted(at):
        x = at[d]
        for s in range(len(x) - run + 1):
            first.setdefault(tuple(v for _, v in x[s : s + run]), (d, s))
    out = {}
    for d, t in rows:
        x = at[d]
        gone = {x[s + k][0] for s in range(len(x) - run + 1) if first[tuple(v for _, v in x[s : s + run])] != (d, s) for k in range(run)}
        out[d] = None if t is None else "\n".join(v for i, v in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup(spark, run):
    lines = [prose(5) for _ in range(12)] + [""]
    texts = [None, "", "a\n\n \nb", *("\n".join(r.choices(lines, k=r.randrange(1, 30))) for _ in range(40)), "\n".join(["x"] * 50)]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, start int, print string").repartition(3)
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated_lines(df, run).collect()}
    assert got == plain_lines(list(enumerate(texts)), run)
    assert line_dedup.remove_repeated_lines(df.limit(0), run).count() == 0


def test_line_dedup_of_short_runs(spark):
    long, pair = prose(9), "two words\nthree more words"
    texts = [long, long + "\nown line", "ok", "ok", "ok\nown", "a\nb", "a\nb", pair + "\nx1", pair + "\nx2", *(f"Share\nonly {i}" for i in range(6)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = df.union(df.where("doc_id = 4"))
    got = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated_lines(df, words=5, often=6).collect()}
    assert got == dict(enumerate([long, "own line", "ok", "", "ok\nown", "a\nb", "", pair + "\nx1", "x2", "Share\nonly 0", *(f"only {i}" for i in range(1, 6)), None, ""]))
    few = {x["doc_id"]: x["text"] for x in line_dedup.remove_repeated_lines(df, words=5, often=7).collect()}
    assert few[10] == "Share\nonly 1" and few[1] == "own line"
    assert line_dedup.remove_repeated_lines(df.limit(0), words=5, often=6).count() == 0


def test_pipeline_removes_repeated_single_lines(spark):
    import corpus_pipeline as p

    line = prose(40)
    df = spark.createDataFrame([(1, line, "en", "s", len(line)), (2, line + "\nown", "en", "s", len(line) + 4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"]: (x["text"], x["n_chars"]) for x in p.line_dedup(spark, df, "").collect()} == {1: (line, len(line)), 2: ("own", 3)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    ours, theirs = both(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")
    assert ours == theirs


ITEM = "A train leaves Hanoi at 9 and runs 120 km in 3 hours. How fast does Minh say it runs if 120 km takes 3 hours?"


def test_decontamination(spark):
    same = "Intro text. " + ITEM + " More text."
    changed = ITEM.replace("120", "350").replace("3 ", "7 ").replace("Hanoi", "Paris").replace("Minh", "Anna")
    torn = "A train leaves Hanoi at 9 and goes home. " + prose(50)
    docs = spark.createDataFrame([(0, same), (1, changed), (2, torn), (3, None), (4, ""), (5, prose(3000)), (None, same), (0, same)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM, "z"), (8, None, "z"), (9, "too short", "z"), (7, ITEM, "z")], "item_id long, text string, h string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (None, 7)}
    assert got[0, 7]["changed_slots"] == 0 and got[1, 7]["changed_slots"] >= 5
    assert sorted(str(x["doc_id"]) for x in decontaminate.drop_leaks(docs, bench).collect()) == ["2", "3", "4", "5"]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    old, decontaminate.FILTER_WINDOWS = decontaminate.FILTER_WINDOWS, -1
    try:  # without the filter the join finds the same
        assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench).collect()} == set(got)
    finally:
        decontaminate.FILTER_WINDOWS = old


@pytest.mark.parametrize("filtered", [True, False])
def test_decontamination_finds_verbatim_copies_of_any_item(spark, filtered, monkeypatch):
    if not filtered:
        monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", -1)
    items = ["The Old Man And The Sea By Ernest Hemingway In Havana", "12 34 56 78 90 11 22 33 44 55", "WHO WROTE HAMLET FOR THE LONDON STAGE COMPANY", "Capital: Lisbon", "xylophone", "one Two Three Four Five six seven eight", None, " "]
    docs = [*(f"and so {t} it goes" for t in items[:6]), items[0].lower(), "12 34 56 78 99 11 22 33 44 55", "nothing here", None, ""]
    found = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): (x["covered"], x["item_words"], x["changed_slots"]) for x in found.collect()}
    assert got == {**{(i, i): (n, n, 0) for i, n in enumerate([11, 10, 8, 2, 1, 8])}, (6, 0): (11, 11, 0)}


def plain_template(text):
    """(kind, slot value or None, word) of each word, from the rules in words; values in the order in which ties are broken."""
    out, before, opens = [], 0, True
    for m in re.finditer(r"[^\W_]+", text or "", re.ASCII):
        w, low = m[0], m[0].lower()
        opens = not before or any(c in ".!?\n:;" for c in text[before : m.start()])
        kind = "<number>" if w.isdigit() else "<unit>" if low in decontaminate.UNITS else "<name>" if w[0].isupper() and not opens else None
        out.append((kind or low, int((hash_word(low) | U(1)).view(np.int64)) if kind else None, low))
        before = m.end()
    return out


def test_decontamination_against_every_alignment(spark):
    rng = random.Random(21)
    vocabulary = ["apple", "River", "12", "7", "km", "hours", "walks", "to", "Minh", "the", "sells", "and", "Anna", "buys"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". "]) for _ in range(n))
    items = [text(rng.randrange(1, 25)) for _ in range(25)]
    docs = [text(rng.randrange(0, 60)) for _ in range(20)]
    for t in items:
        changed = " ".join({"12": "30", "7": "5", "Minh": "Paul", "km": "miles"}.get(w, w) for w in t.split(" "))
        docs += [text(9) + t + text(5), text(4) + changed, text(3) + changed.replace("5", "7", 1), t.upper(), " ".join(t.split()[:-3])]
    options = {"window": decontaminate.WINDOW, "literal": 3, "least": 5, "share": 0.5, "long_run": 13}
    want = brute.leaks(list(enumerate(docs)), list(enumerate(items)), plain_template, **options)
    found = decontaminate.leaks(spark.createDataFrame([(i, t, "y") for i, t in enumerate(docs)], "doc_id long, text string, h string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]): x["covered"] for x in found.collect()} == want and len(want) > 80


def test_inconsistent_slots_do_not_count():
    slots = [[0, 5, 0, 0, 5, 0, 0, 5]]
    covered, longest, *_ = decontaminate._covered([0], [0], [[0, 1, 0, 0, 2, 0, 0, 1]], slots, 8)
    assert covered == 7 and longest == 4


def test_language_model(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    kn = brute.KneserNey([t for i, t in enumerate(TEXTS) if not held[i]])
    got = {x["doc_id"]: x for x in ngram_lm.score_held_out(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        x, w = got[i], [*brute.words(brute.lower(t)), "</s>"]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(w), sum(v in kn.count for v in w), kn.n)
        assert x["base_score"] == pytest.approx(kn.base(t), rel=1e-6) and x["score"] == pytest.approx(kn.score(t), rel=1e-5)
    assert sum(kn.p(w, "w1") for w in kn.count) + kn.p("@", "w1") == pytest.approx(1)


def test_language_model_of_many_shards(docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "block_count", lambda *_, **__: 30_000)
    model = ngram_lm.train(docs)
    assert model.side**2 > 16_384
    reader = ngram_lm.Reader(model)
    reader.maps.most = 64
    (t,) = ngram_lm.slices(pa.array(["w1 w2 w1 w2", None, BASE]), 1 << 20)
    kn = brute.KneserNey(TEXTS)
    assert ngram_lm.score_texts(reader, t)[3].tolist() == pytest.approx([kn.score(x) for x in ("w1 w2 w1 w2", None, BASE)], rel=1e-5)
    assert len(reader.maps.held) <= 64


def test_language_model_of_repeated_rows(spark):
    texts = ["a b a b c", "a b a b c", None, "", "c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3, "doc_id long, text string")
    kept = [t for i, t in enumerate(texts) for _ in range(3) if zlib.crc32(str(i).encode()) % 7 != 2]
    kn = brute.KneserNey(kept)
    got = ngram_lm.score_held_out(df).collect()
    assert sorted((x["doc_id"], round(x["score"], 5)) for x in got) == sorted((i, round(kn.score(t), 5)) for i, t in enumerate(texts) for _ in range(3))


def test_language_model_without_training_text(docs):
    model = ngram_lm.train(docs.limit(0))
    got = ngram_lm.score(docs.where("doc_id < 5"), model).collect()
    assert {x["score"] for x in got} == {0.0} and model.n_tokens == 0
    assert ngram_lm.score(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    texts = [prose(120) for _ in range(40)] + [edited(BASE, 0.01) for _ in range(4)] + [BASE, "Said: " + ITEM, None, ""] + ["\n".join(f"{w} line of text" for w in VOCABULARY[:6])] * 2
    junk = [" ".join(w + "###" for w in prose(80).split()) for _ in range(20)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(docs)) if texts + junk and (texts + junk)[i]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = df.columns, {}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        df = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = {x["doc_id"] for x in df.select("doc_id").collect()}
        if k < len(p.STAGES) - 1:
            assert df.columns == columns
    n = len(texts)
    assert len(kept["quality classifier"] & set(range(n))) >= n - 4 and len(kept["quality classifier"] - set(range(n))) <= 2
    assert kept["line dedup"] == kept["quality classifier"]
    assert len(kept["near-dedup"] & set(range(40, 45))) == 1
    assert 45 not in kept["benchmark decontamination"]
    assert kept["packing"] == kept["benchmark decontamination"]
    assert p.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept["packing"])


def test_digest_columns(spark):
    got = queries.op5_substring_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    import pandas as pd

    text = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id").text[got["doc_id"]]
    assert got["n_removed"] or got["kept_sha256"] == hashlib.sha256(" ".join(brute.words(text)).encode()).hexdigest()
