import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import languages, quality
from loomtext.llm.common import stratified

SF = "/root/testdata/sf0.01"
ODD = [None, "", "12 34 !!", "the", "\n\n", "é", "word " * 50_000, "the", "漢字"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_kernel_is_the_share_of_common_grams():
    rows = languages.presence(pa.array(["abc", "ABC", "abd", "", None, "a1b"]))
    assert np.allclose(rows[0], rows[1]) and 0 < rows[0] @ rows[2] < 1 and np.isclose(rows[0] @ rows[0], 1) and not rows[3].any() and not rows[4].any()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = languages.op8_language_id(spark, SF).collect()
    assert len(rows) == len(told) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == told[r["doc_id"]] for r in own) / len(own) > 0.97


def test_language_edges(spark, docs_of):
    docs = docs_of(ODD)
    model = languages.train(spark.read.parquet(f"{SF}/documents.parquet").limit(200))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.predict(docs, model).collect()}
    assert [got[i] for i in (0, 1, 2, 4)] == [("und", 0.0)] * 4 and got[3] == got[7] and got[8][0] != "und"
    assert languages.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in languages.predict(docs, None).collect()} == {"und"}
    assert languages.predict(docs.limit(0), model).count() == 0


def test_rare_labels_stay_in_the_sample(spark):
    rows = [(f"common{k}", i) for k in range(50) for i in range(k * 1000, k * 1000 + 1000)] + [(f"rare{k}", i) for k in range(10) for i in range(90_000 + k * 20, 90_020 + k * 20)]
    some, counts = stratified(spark.createDataFrame(rows, "lang string, doc_id bigint"), "lang", 400, 600)
    got = [r["lang"] for r in some.collect()]
    assert len(got) <= 600 and set(got) == set(counts) and len(counts) == 60
    assert stratified(spark.createDataFrame([], "lang string, doc_id bigint"), "lang", 400, 600)[0].count() == 0


def test_quality(spark):
    told = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op9_quality_classifier(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in rows)
    own = [r for r in rows if r["held_out"] and r["doc_id"] in told]
    assert sum(r["predicted"] == told[r["doc_id"]] for r in own) / len(own) > 0.93


def test_quality_edges(spark, docs_of):
    docs = docs_of(ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {1.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None), (1, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels), into="own").withColumnRenamed("score", "old").withColumnRenamed("own", "score").collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] and got[3] == got[7]
    assert quality.score(docs.limit(0), model).count() == 0


def test_passages_hold_the_whole_text():
    texts = ["a b c", None, "x " * 200, "é! " * 64]
    x, bags = quality.passages(pa.array(texts))
    assert bags.tolist() == [1, 1, 4, 1] and x.shape == (7, quality.FEATURES)
    alone = np.concatenate([quality.passages(pa.array([t], pa.string()))[0] for t in texts])
    assert np.allclose(x, alone)


def test_gradients():
    pick = np.random.default_rng(0)
    bags_of = [pick.standard_normal((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 4)]
    model = quality.Model(0.5).fit(bags_of, np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32))
    x, bags, y = np.concatenate(bags_of).astype(np.float64), np.array([1, 3, 2, 4]), np.array([0, 1, 1, 0.0])
    model.w = {k: np.asarray(v, np.float64) * (0.3 if k == "c" else 1) for k, v in model.w.items()}
    grads = model._grads(x, bags, y, np.ones(4))

    def loss():
        p = model._forward(x, bags)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("We", (3, 2)), ("V", (1, 1)), ("U", (2, 0)), ("a", (4,)), ("c", (5,)), ("be", (1,))):
        kept, h = model.w[k][at], 1e-5
        model.w[k][at] = kept + h
        up = loss()
        model.w[k][at] = kept - h
        down = loss()
        model.w[k][at] = kept
        assert grads[k][at] == pytest.approx((up - down) / (2 * h), rel=1e-2, abs=1e-5)


def test_one_huge_word_leaves_scores_whole(spark, docs_of):
    docs = docs_of(["a" * 1_000_000, *(f"some words of text {i}" for i in range(40))])
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id bigint, quality int")
    scores = [r["score"] for r in quality.score(docs.drop("score"), quality.train(docs, labels)).collect()]
    assert len(scores) == 41 and all(0 <= s <= 1 for s in scores)


def kernel(a, b):
    """The share of hashed byte 1- to 3-grams of two texts of letters and spaces, in plain Python."""
    grams = lambda t: {(n, int.from_bytes(t[k : k + n], "big") * 0x9E3779B1 % (1 << 32) >> 20) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
    x, y = grams(a.encode()), grams(b.encode())
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_kernel_against_plain_sets():
    texts = ["the cat sat on the mat", "le chat est assis", "a", "der hund und die katze sind hier"]
    rows = languages.presence(pa.array(texts))
    assert np.allclose(rows @ rows.T, [[kernel(a, b) for b in texts] for a in texts], atol=1e-5)


def test_landmarks_give_the_full_kernel_ridge():
    """With every training text a landmark, the scores are those of kernel ridge regression solved on the whole kernel."""
    texts, labels = ["one two three", "un deux trois", "two one", "deux un", "three two", "trois deux"], list("efefef")
    more = [x for t in texts for x in (t, *languages.snippets(t))]
    y = np.array([c for t, c in zip(texts, labels, strict=True) for _ in (t, *languages.snippets(t))])
    model = languages.Model(languages.examples(more), y.tolist())
    whole = np.array([[kernel(a, b) for b in more] for a in more])
    target = np.where(y[:, None] == np.array(["e", "f"]), 1.0, -1.0)
    weight = (len(y) / (2 * np.array([(y == c).sum() for c in y])))[:, None]
    alpha = np.linalg.solve(weight * whole + languages.RIDGE * len(y) / languages.LANDMARKS * np.eye(len(y)), weight * target)
    probe = ["two three", "deux trois", "trois un"]
    want = np.array([[kernel(a, b) for b in more] for a in probe]) @ alpha
    got = languages.presence(pa.array(probe)) @ model.landmarks.T @ model.weights
    assert np.allclose(got, want, atol=0.02) and (got.argmax(axis=1) == [0, 1, 1]).all()


def test_examples_of_any_text_take_the_same_room(spark, docs_of):
    assert {e.nbytes for t in ("", "a", "long words " * 100_000) for e in languages.examples([t])} == {languages.GRAMS * languages.WIDTH // 8}
    assert languages.snippets("one two three") == languages.snippets("one two three") and languages.snippets(" ") == []
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (None, "the hat"), (3, "12"), (4, "")]
    model = languages.train(docs_of(rows).withColumnRenamed("hits", "bits"))
    assert model.names == ["en"]
