import numpy as np
from pyspark.sql import functions as F

from dqspark.llm.language_id import BUCKETS, Ftrl, Model, buckets_for, clean, gram_buckets, identify, op2_language_id, softmax, temperature, train_model

from .helpers import frame, with_clashes


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op2_language_id(spark, sf).join(truth, "doc_id")
    total, right, low, high = got.filter("held_out").agg(
        F.count("*"), F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")
    ).first()
    assert total > 200 and right / total > 0.97 and 0 <= low and high <= 1
    assert got.count() == 1000


def test_calibration_follows_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    row = op2_language_id(spark, sf).join(truth, "doc_id").filter("held_out").agg(
        F.avg("score").alias("said"), F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("was")
    ).first()
    assert abs(row["said"] - row["was"]) < 0.05


CASES = [(1, None, "en"), (2, "", "en"), (3, "123 --- ?!", "en"), (4, "the house and the garden", "en"), (5, "das haus und der garten", "de"), (None, "the end", None), (7, "the " * 100_000, "en"), (8, "x", None), (9, "日本語", None)]


def test_defined_results(spark):
    docs = CASES + [(100 + i, "the house and the garden of the king", "en") for i in range(20)] + [(200 + i, "das haus und der garten des königs", "de") for i in range(20)]
    got = {r["doc_id"]: r["_lid"] for r in identify(with_clashes(frame(spark, docs))).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert (got[4]["lang_pred"], got[5]["lang_pred"], got[7]["lang_pred"]) == ("en", "de", "en")
    assert got[9]["lang_pred"] in ("de", "en") and all(0 <= g["score"] <= 1 for g in got.values())


def test_no_labels_and_empty_table(spark):
    assert {r["_lid"]["lang_pred"] for r in identify(frame(spark, [(1, "some text", None), (3, "x", None)])).collect()} == {"und"}
    assert identify(frame(spark, [])).count() == 0


def test_one_language_only(spark):
    got = identify(frame(spark, [(i, "some text here", "en") for i in range(12)])).select("_lid.*").distinct().collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("en", 1.0)]


def test_held_out_rows_are_not_learned(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "das haus und der garten" if i % 2 else "the house and garden", "zz" if i in out else "de" if i % 2 else "en") for i in range(200)]
    assert "zz" not in {r["_lid"]["lang_pred"] for r in identify(frame(spark, rows)).collect()}


def test_scores_are_sums_over_ngrams():
    rng = np.random.default_rng(0)
    model = Model(["a", "b"], rng.normal(size=(1 << 16, 2)).astype(np.float32))
    texts = ["Hello, world", "", "ab", "x", "ÀÉ 12 q"]
    scores, there = model.scores(texts)
    expected = []
    for t in texts:
        if c := clean(t):
            grams, _ = gram_buckets([c])
            every = np.concatenate(grams)
            expected.append(model.weights[every].astype(float).sum(axis=0) / len(every))
    assert there.tolist() == [True, False, True, True, True]
    np.testing.assert_allclose(scores, expected, rtol=1e-5, atol=1e-6)


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(1)
    learner = Ftrl(2)
    for _ in range(400):
        target = int(rng.integers(2))
        index = np.array([target, 10, 100 + int(rng.integers(1000))])
        learner.step(index, np.array([1.0, 0.5, 0.02]), target)
    w = learner.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[100:] == 0).mean() > 0.9


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(2)
    targets = rng.integers(0, 3, 3000)
    scores = np.eye(3)[targets] * 1.5 + rng.gumbel(size=(3000, 3)) * 0.0
    flip = rng.random(3000) < 0.3
    targets[flip] = rng.integers(0, 3, flip.sum())
    t = temperature(scores * 8, targets)
    said = softmax(scores * 8 / t).max(axis=1).mean()
    assert t > 1 and abs(said - ((scores.argmax(axis=1) == targets).mean())) < 0.03


def test_sample_bound_is_kept(spark):
    rows = [(i, f"text number {i}", "en" if i % 3 else "fr") for i in range(300)]
    train = frame(spark, rows).select("doc_id", "text", "lang")
    assert set(train_model(train, size=40).languages) == {"en", "fr"}
    from dqspark.llm.language_id import training_sample

    assert len(training_sample(train, size=40)[0]) == 40


def test_rows_without_id_are_learned(spark):
    rows = [(i, "the house and the garden of the king number %s" % "abcdefgh"[i % 8], "en") for i in range(60)]
    rows += [(None, "das haus und der garten des königs nummer %s" % "abcdefgh"[i % 8], "de") for i in range(60)]
    got = identify(frame(spark, rows)).groupBy("lang", "_lid.lang_pred").count().collect()
    assert sorted(tuple(r) for r in got) == [("de", "de", 60), ("en", "en", 60)]


def test_many_languages_share_buckets(spark, monkeypatch):
    import dqspark.llm.language_id as module

    monkeypatch.setattr(module, "WEIGHTS", 1 << 17)
    words = [f"{a}{b}{a}{c}{b}" for a in "abcdefgh" for b in "ijklm" for c in "nop"]
    rows = [(4 * i, " ".join([w] * 20), f"l{i:03}") for i, w in enumerate(words)]
    rows = [(d, t, lang) for d, t, lang in rows for d in (d, d + 1, d + 2, d + 3)]
    assert buckets_for(len(words)) == 1024 and buckets_for(2) == BUCKETS and buckets_for(1 << 20) == 1
    got = identify(frame(spark, rows), size=60)
    assert got.select("_lid.lang_pred").distinct().count() > 60 and got.count() == len(rows)
