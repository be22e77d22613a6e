"""Each stage of the pipeline on the given documents against a brute-force version of it."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402

from .helpers import frame  # noqa: E402
from .test_decontaminate import brute as contaminated  # noqa: E402
from .test_jaccard_join import brute as near  # noqa: E402
from .test_line_dedup import brute as lines  # noqa: E402
from .test_packing import check as packed  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and what it made."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        made = P.store(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_language_id_keeps_clean_documents(steps):
    docs, made = steps["language_id"]
    gone = docs.join(made, "doc_id", "left_anti").collect()
    assert not [r for r in gone if r["text"] and any(c.isalpha() for c in r["text"])]
    assert made.columns == docs.columns


@pytest.mark.parametrize("number", [2, 4, 20])
def test_language_id_rejects_noise_and_keeps_short_texts(spark, number):
    rng = random.Random(number)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(40)] for _ in range(number)]
    rows = [(i, " ".join(rng.choices(words[i % number], k=30)), f"l{i % number:02}") for i in range(60 * number)]
    short = [(10_000 + k, " ".join(rng.choices(words[k], k=8)), None) for k in range(number)]
    noise = [(20_000, "あいうえおかきくけこさしすせそ", None), (20_001, "--- 123", None), (20_002, None, None)]
    kept = {d for d, _ in pairs(P.language_id(spark, frame(spark, rows + short + noise), SF))}
    assert kept == {r[0] for r in rows + short}


def test_line_dedup(steps):
    docs, made = steps["line_dedup"]
    expected = sorted((d, t) for d, _, _, t in lines(pairs(docs)))
    assert sorted(pairs(made)) == expected
    assert made.filter(F.col("n_chars") != F.char_length("text")).count() == 0 and made.columns == docs.columns


def test_near_dedup(steps):
    docs, made = steps["near_dedup"]
    kept = {d for d, _, component in near(pairs(docs), 5, 80, 100) if d == component}
    assert {d for d, _ in pairs(made)} == kept and made.columns == docs.columns


def test_decontamination(spark, steps):
    docs, made = steps["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d for d, _, hits, _ in contaminated(pairs(docs), items) if not hits}
    assert {d for d, _ in pairs(made)} == kept and made.columns == docs.columns


def test_packing(steps):
    docs, made = steps["packing"]
    used, total, _ = packed(made.collect(), pairs(docs), 2048)
    assert used <= 1.05 * total / 2048 + 1


def test_run_is_the_chain_of_stages(spark, steps):
    ran = sorted(tuple(r)[:5] for r in P.run(spark, SF).collect())
    assert ran == sorted(tuple(r)[:5] for r in steps["packing"][1].collect())


def test_near_dedup_judges_rows_that_repeat_an_id(spark):
    copied = " ".join(f"a{i}" for i in range(40))
    other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "bc")
    rows = [(3, copied), (5, copied + " x"), (5, other), (5, third), (5, third.upper())]  # 5 is a near copy, two clean texts
    rows += [(7, "seven " + other + " y z v"), (8, None), (8, None), (8, "")]
    repeated = " ".join(f"d{i}" for i in range(40))
    rows += [(9, repeated)] * 3 + [(10, repeated)]
    rows += [(None, copied), (None, copied)]
    docs = frame(spark, rows).repartition(3)
    made = P.near_dedup(spark, docs, SF)
    found = sorted(((d, "no" if t is None else t.lower()[:2]) for d, t in pairs(made)), key=repr)
    assert found == sorted([(3, "a0"), (5, "b0"), (5, "c0"), (8, "no"), (8, ""), (9, "d0"), (None, "a0"), (None, "a0")], key=repr)
    assert made.columns == docs.columns


def test_nulls_copies_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (2, text.upper()), (2, text), (None, text), (3, None), (4, ""), (5, "123 456"), (6, "short")]
    docs = frame(spark, rows)
    kept = P.language_id(spark, docs, SF)
    assert kept.filter("text is null or text = '' or doc_id = 5").count() == 0
    left = P.near_dedup(spark, kept, SF)
    assert {r["doc_id"] for r in left.collect()} == {1, 6, None}
    for _, stage in P.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_near_dedup_sees_near_copies_under_one_id(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(5, text), (5, text + " x"), (6, text + " y"), (-1, " ".join(f"b{i}" for i in range(60)))]
    left = P.near_dedup(spark, frame(spark, rows), SF).collect()
    assert sorted(r["doc_id"] for r in left) == [-1, 5]
