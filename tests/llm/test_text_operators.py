"""Counts, rules, licences, packing, classifier: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from juriloom.llm import license_scan, packing, quality_cnn, quality_rules, token_counts, tokenizers
from juriloom.llm.words import Texts, hash_word, slices, words

import brute

rng = random.Random(3)
LONG = " ".join(f"w{rng.randrange(4000)}" for _ in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "Ünïcode  Words\x0b here too", "a b c a b c a b c\nsame line\nsame line\n", "<|endoftext|> It's 3.5% <|startoftext|>x", LONG, "a b c a b c a b c\nsame line\nsame line\n"]
SCHEMA = "doc_id long, text string, lang string, digest string, word string, rank long, content_digest string, n_words long, block int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else "en", "x", "y", 1, "z", 5, 2) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_word_hashes():
    import pyarrow as pa

    texts = ["", None, "é a\x0cb", "a"]
    (t,) = slices(pa.array(texts))
    w = words(t)
    assert np.diff(w.bounds).tolist() == [0, 0, 3, 1]
    assert w.hashes.tolist() == [hash_word(x) for x in ("é", "a", "b", "a")]
    many = [f"w{i}" for i in range(50_000)]
    raw = " ".join(many).encode()
    assert len(set(words(Texts(0, 1, np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))).hashes.tolist())) == len(many)


def thue_morse(n):
    """Two words of n characters that no polynomial hash modulo a power of two tells apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 9, 64, 1024, 4096])
def test_word_hashes_of_regular_words(n):
    one, other = thue_morse(n)
    found = {one, other, one + "\0", one[:-1], "a" * n, "a" * (n + 8), one[8:] + one[:8]}
    assert len({int(hash_word(x)) for x in found}) == len(found)


def test_word_ids_of_regular_words_and_of_a_small_cache():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.vocabulary_path())
    texts = ["\n".join(thue_morse(1024)), "a b", "", " ".join(f"v{i}" for i in range(3000)), "a v1 v2"]
    for most in (1 << 30, 20_000, 0):
        ids_of = tokenizers.WordIds(tokenizers.vocabulary_path(), most)
        import pyarrow as pa

        for column in (texts, texts[::-1]):
            for t in slices(pa.array(column), 100):
                ids, bounds = ids_of(t)
                assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in column[t.lo : t.hi]]


def test_token_counts_of_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_LEAST", 3)
    texts = ["same text here"] * 10 + [None] * 5 + ["", "own", "same\ttext here"]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [3] * 10 + [0] * 6 + [1, 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, none, tmp_path, name):
    path = tokenizers.vocabulary_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        want = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in TEXTS]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_counts.count_tokens(docs, cache, path).orderBy("doc_id").collect()
        assert [r["n_tokens"] for r in got] == want
    stored = spark.read.parquet(cache)
    distinct = len({(t or "") if name != "word_bpe_49k.json" else "".join(" " if c in "\t\n\x0b\f\r" else c for c in t or "") for t in TEXTS})
    assert stored.count() == distinct  # the second run encoded nothing
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in TEXTS]
    assert [r["over_limit"] for r in got] == [n > 2048 for n in want]
    assert token_counts.count_tokens(none, tokenizer=path).count() == 0


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, r = brute.words(t), got[i]
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), brute.repeat_words(t))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_rules.apply_rules(none).count() == 0
    assert quality_rules.apply_rules(docs.drop("lang")).count() == len(TEXTS)


def test_divergence_rejects_what_is_far(spark):
    r = random.Random(1)
    common = "the of and to in a is that it was".split()
    prose = [(i, " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choices("abcdeilnorst", k=6)) for _ in range(200)), "en") for i in range(60)]
    junk = [(100, " ".join("Q#%7" + str(i) for i in range(200)), "en"), (101, "Q#%7 x", "en")]
    got = {x["doc_id"]: x for x in quality_rules.apply_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[100]["kept"]
    assert got[101]["char_distance"] is None and got[101]["word_distance"] is None  # too short to compare


def test_licences(docs, none, spark):
    texts = ["Released under the MIT License.", "apache license, version 2.0! Also CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.", "the licence of mit", None, "under the mit", "license",
             "This work is licensed under the GNU General Public License, version 3. " + "x " * 50 + "Dedicated to the public domain under CC0 1.0 Universal"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = license_scan.scan(df).orderBy("doc_id").collect()
    assert [r["base_labels"] for r in got] == ["mit", "apache-2,cc-by-nc", "", "", "", "", "", ""]
    assert [r["labels"] for r in got] == ["mit", "apache-2,cc-by-nc", "gpl-3", "", "", "", "", "gpl-3,public-domain"]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 0, 6)
    assert all(0 <= r["score"] <= 1 for r in got) and got[3]["first_word"] is None
    assert license_scan.scan(docs).count() == len(TEXTS) and license_scan.scan(none).count() == 0


def test_stray_licence_words_hide_no_notice(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    stray = "mozilla x affero x lesser x domain x universal x redistribution x unencumbered x cc0 x binary x fee x charge x sa"
    texts = [stray + " x " + notice + " x " + stray, "mozilla public x", *[notice] * 30, "Released under the", "MIT license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = [x["labels"] for x in license_scan.scan(df).orderBy("doc_id").collect()]
    assert got == ["gpl-3", "", *["gpl-3"] * 30, "", ""]


def test_licences_match_every_template_at_every_place(spark):
    r = random.Random(8)
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    common = sorted({w for t in notices for w in t.split()})
    texts = [None, "", "x", *notices]
    for _ in range(60):
        words_of = []
        for _ in range(r.randrange(1, 5)):
            t = r.choice(notices).split()
            if r.random() < 0.5:  # torn or changed notices
                t = t[r.randrange(3) : len(t) - r.randrange(3)]
                t = [r.choice(common) if r.random() < 0.1 else w for w in t]
            words_of += [r.choice(common + ["own", "text"]) for _ in range(r.randrange(6))] + t
        texts.append(", ".join(words_of).upper())
    texts += texts[-3:]  # repeated rows
    want = brute.licences(list(enumerate(texts)), license_scan.PHRASES, license_scan.TEMPLATES, license_scan.LEAST)
    found = license_scan.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)).collect()
    assert len(found) == len(texts)
    for x in found:
        n, places, base, labels, score = want[x["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (n, len(places), places[0] if places else None, places[-1] if places else None)
        assert (x["base_labels"], x["labels"]) == (",".join(base), ",".join(labels)) and x["score"] == pytest.approx(score)


def check_packing(rows, ids_of, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, pieces in by_doc.items():
        ids, at = ids_of(d), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return by_doc, by_sequence


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.vocabulary_path())
    unique = docs.dropDuplicates(["doc_id"])
    rows = packing.pack(unique, window=128).collect()
    by_doc, _ = check_packing(rows, lambda d: [*plain.encode(TEXTS[d] or "", add_special_tokens=False).ids, 1], 128)
    assert len(by_doc) == len(TEXTS)
    assert packing.pack(none).count() == 0
    kept = packing.pack(unique, window=128, keep_ids=True).where("doc_id = 3").first()
    assert kept["ids"][-1] == 1 and len(kept["ids"]) == kept["length"]


def test_packing_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5 + [(2, LONG[:3000])] * 3 + [(None, "x")] * 2, "doc_id long, text string")
    rows = packing.pack(df, window=64).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 5 and sum(r["doc_id"] is None for r in rows) == 2
    assert {n % 3 for n in Counter((r["doc_id"], r["start"]) for r in rows if r["doc_id"] == 2).values()} == {0}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64


def test_plan_uses_the_histogram_and_pads_little():
    r = np.random.default_rng(0)
    lengths = np.minimum(r.geometric(1 / 300, 20_000), 2048)
    h = np.bincount(lengths, minlength=2049)
    plan = packing.make_plan(h, 2048)
    used = np.zeros(2049, np.int64)
    for length, first, many, after in zip(plan.length, plan.first, plan.many, np.append(plan.first[1:], 0), strict=True):
        used[length] = max(used[length], first)
        assert many >= 1
    total = (np.arange(2049) * h).sum()
    assert plan.sequences * 2048 < total * 1.002 + 2048
    assert packing.make_plan(np.zeros(2049, np.int64), 2048).sequences == 0
    assert packing.make_plan(np.bincount([5], minlength=2049), 2048).sequences == 1


def test_classifier_gradients():
    r = np.random.default_rng(2)
    q = quality_cnn
    net = [r.normal(0, 0.5, (256, q.EMBEDDING)), r.normal(0, 0.3, (q.WIDTH * q.EMBEDDING, q.FILTERS)), r.normal(0, 0.1, q.FILTERS), r.normal(0, 0.05, 2 * q.FILTERS), np.array([0.1])]
    texts, labels = [b"", b"abc", bytes(r.integers(32, 90, 256).tolist()), bytes(r.integers(32, 90, 900).tolist()), b"same " * 300], np.array([0, 1, 1, 0, 1], np.float32)

    def loss():
        net32 = q.Network(*(p.astype(np.float32) for p in net[:4]), float(net[4][0]))
        scores = np.concatenate([q.score_texts(net32, Texts(0, 1, np.array([0, len(t)]), np.frombuffer(t, np.uint8))) for t in texts])
        return -np.mean(labels * np.log(scores) + (1 - labels) * np.log(1 - scores))

    q_part, q.FIT_PART = q.FIT_PART, 2
    try:
        found = q.gradients([p.astype(np.float32) for p in net], texts, labels)
    finally:
        q.FIT_PART = q_part
    for p, g in zip(net, found, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            i, was = np.unravel_index(at, p.shape), p.ravel()[at]
            ends = []
            for move in (1e-3, -1e-3):
                p[i] = was + move
                ends.append(loss())
            p[i] = was
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[i], rel=0.05, abs=1e-4)


def test_classifier_learns_and_scores_whole_texts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("aeiorstnl", k=r.randrange(2, 8)))
    good = [" ".join(word() for _ in range(r.randrange(20, 400))) for _ in range(150)]
    bad = [" ".join(word() + "###" for _ in range(r.randrange(20, 400))) for _ in range(60)]
    texts = [*good, *bad, None, "", "x" * 3_000_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, 0) for i in range(210)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_cnn.classify(docs, labels).collect()}
    held = [x for i, x in got.items() if i < 210 and x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert sum(x["predicted"] == (x["doc_id"] < 150) for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    net = quality_cnn.fit([t.encode() for t in good + bad], np.array([1] * 150 + [0] * 60))
    long = (" ".join(good) * 40).encode()
    whole = Texts(0, 1, np.array([0, len(long)]), np.frombuffer(long, np.uint8))
    pooled = quality_cnn._pooled(net, whole)
    want = 1 / (1 + np.exp(-(np.concatenate([pooled[0] / pooled[2][:, None], pooled[1]], 1) @ net.weights + net.offset)))
    assert len(long) > 2 * quality_cnn.PART and abs(quality_cnn.score_texts(net, whole)[0] - want[0]) < 1e-4
    assert quality_cnn.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert {x["score"] for x in quality_cnn.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
