import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dqspark.operators.profile import exact_quantiles, mask_sensitive, profile_segments, profile_table
from dqspark.queries import QUERIES


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_numeric_column(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    row = by_column(profile_table(df))["x"]
    assert (row["row_count"], row["null_ratio"], row["distinct_ratio"]) == (4, 0.25, 0.75)
    assert (row["mean"], row["min"], row["max"], row["p50"]) == (2.0, 1.0, 3.0, 2.0)
    assert row["stddev"] == pytest.approx(0.816497)
    assert row["p95"] == pytest.approx(2.9)


def test_top_values_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in "baabca"], "s string")
    row = by_column(profile_table(df))["s"]
    assert [(t["value"], t["count"]) for t in row["top_values"]] == [("a", 3), ("b", 2), ("c", 1)]
    expected = hashlib.sha256("|".join(sorted("baabca")).encode()).hexdigest()
    assert row["sample_hash"] == "sha256:" + expected


def test_hash_keeps_copies_and_stops_at_200(spark):
    values = ["a"] * 150 + ["b"] * 100 + ["c"]
    row = by_column(profile_table(spark.createDataFrame([(v,) for v in values], "s string"), parts=("hash",)))["s"]
    assert row["sample_hash"] == "sha256:" + hashlib.sha256("|".join(values[:200]).encode()).hexdigest()


def test_all_null_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0)], "s string, x double")
    rows = by_column(profile_table(df))
    assert rows["s"]["null_ratio"] == 1.0 and rows["s"]["top_values"] is None
    assert rows["x"]["null_ratio"] == 0.5 and rows["x"]["mean"] == 1.0


def test_empty_table(spark):
    row = by_column(profile_table(spark.createDataFrame([], "x double, s string")))["x"]
    assert (row["row_count"], row["null_ratio"], row["distinct_ratio"], row["mean"]) == (0, 0.0, 0.0, None)


def test_nested_columns_are_opaque(spark):
    row = by_column(profile_table(spark.createDataFrame([Row(a=[1, 2]), Row(a=None)], "a array<int>")))["a"]
    assert row["kind"] == "opaque" and row["null_ratio"] == 0.5 and row["distinct_ratio"] is None


def test_large_integers_stay_distinct(spark):
    big = 2**60
    df = spark.createDataFrame([(big,), (big + 1,)], "k bigint")
    assert by_column(profile_table(df, parts=("distinct",)))["k"]["distinct_ratio"] == 1.0


def test_quantiles_of_a_skewed_column(spark):
    """One value fills a third of the rows; brackets are in use because the column is long."""
    rng = random.Random(3)
    values = [7.0] * 10_000 + [round(rng.lognormvariate(2, 2), 4) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    probabilities = (0.01, 0.333, 0.5, 0.95, 0.999)
    row = exact_quantiles(df, ["x"], probabilities).first()
    values.sort()
    for i, p in enumerate(probabilities):
        rank = p * (len(values) - 1)
        low = int(rank)
        expected = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (rank - low)
        assert row[f"q{i}"] == pytest.approx(expected, abs=1e-9)


def linear(values, p):
    values = sorted(values)
    rank = p * (len(values) - 1)
    low = int(rank)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (rank - low)


@pytest.mark.parametrize("ranked", [5, 200_000])
def test_quantiles_of_many_groups_and_slices(spark, monkeypatch, ranked):
    """With a small ranking bound the brackets are sliced several times; the values are the same."""
    monkeypatch.setattr("dqspark.operators.quantiles.RANKED_VALUES", ranked)
    rng = random.Random(5)
    rows = [(r, rng.choice([rng.gauss(0, 1e6), float(rng.randrange(3)), 1e-9 * rng.random()])) for r in ("a", "b", None) for _ in range(4000)]
    rows += [("c", 1.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "run string, x double")
    probabilities = (0.0, 0.25, 0.5, 0.99, 1.0)
    for row in exact_quantiles(df, ["x"], probabilities, ["run"]).collect():
        values = [v for r, v in rows if r == row["run"] and v is not None]
        for i, p in enumerate(probabilities):
            expected = linear(values, p) if values else None
            assert row[f"q{i}"] == (pytest.approx(expected, rel=1e-12, abs=1e-15) if values else None)


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    from dqspark.operators import quantiles as Q

    monkeypatch.setattr("dqspark.operators.profile.bracket_sketch", lambda c, ps: F.array(*[F.min(c)] * (2 * len(ps))))
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    row = exact_quantiles(df, ["x"], (0.3, 0.5)).first()
    assert (row["q0"], row["q1"]) == (300.0, 500.0) and Q.RANKED_VALUES > 0


def test_only_values_near_the_rank_are_shuffled(spark):
    """Of 200,000 distinct values less than a hundredth passes the bracket filter."""
    from dqspark.operators import profile as P
    from dqspark.operators import quantiles as Q

    df = spark.range(200_000).select(F.rand(3).alias("x"))
    stats = P._wide_stats(df, [], P._columns(df, [], ["x"]), brackets=(0.5,)).cache()
    rows = P.number_rows(df, [], P._columns(df, [], ["x"]))
    state = Q._start(stats, ["ordinal"], (0.5,))
    found = Q._counted(rows, state, ["ordinal"], 1).first()
    assert 0 < found["inside"] < 2_000 and found["below"] <= found["rank"] < found["below"] + found["inside"]


def test_runs_with_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "run string, x double")
    rows = {r["run"]: r for r in profile_table(df, ["run"]).collect()}
    assert rows["a"]["p50"] == 2.0 and rows[None]["p50"] == 5.0 and rows[None]["distinct_ratio"] == 1.0


def test_approximate_profile_is_close(spark):
    df = spark.range(10_000).select((F.col("id") % 100).alias("x"))
    row = by_column(profile_table(df, exact=False))["x"]
    assert abs(row["distinct_ratio"] - 0.01) < 0.002 and abs(row["p50"] - 49.5) <= 1


def test_segments(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 3)], "s string, t string, v int")
    rows = {(r["segment"], r["column"]): r for r in profile_segments(df, ["s", "t"]).collect()}
    assert rows[('["a", null]', "v")]["mean"] == 2.0 and len(rows) == 3
    with pytest.raises(ValueError):
        profile_segments(spark.range(200).withColumn("s", F.col("id")), ["s"], max_segments=100)
    with pytest.raises(ValueError):
        profile_segments(df, ["s", "t", "v"])


def test_mask(spark):
    df = spark.createDataFrame([("a", "b")], "secret string, open string")
    rows = by_column(mask_sensitive(profile_table(df), ["secret"]))
    assert rows["secret"]["top_values"] is None and rows["secret"]["sample_hash"] is None
    assert rows["open"]["top_values"] is not None


def test_value_exchange_is_reused(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_tax", "l_quantity")
    found = profile_table(df, parts=("distinct", "hash"))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def shaped(shape):
    rng = np.random.default_rng(9)
    if shape == "two clusters":
        return np.concatenate([rng.normal(0, 1e-6, 200), rng.normal(1e9, 1e-6, 200)])
    if shape == "heavy tail":
        return rng.permutation(np.concatenate([np.arange(390) / 7, 10.0 ** np.arange(20, 300, 28)]))
    if shape == "infinities":
        return np.concatenate([rng.normal(0, 1, 300), np.full(60, np.inf), np.full(60, -np.inf)])
    return np.repeat([3.0, 5.0], [399, 1])


@pytest.mark.parametrize("shape", ["two clusters", "heavy tail", "infinities", "one value"])
def test_crowded_brackets_of_any_shape_narrow(spark, monkeypatch, shape):
    monkeypatch.setattr("dqspark.operators.quantiles.RANKED_VALUES", 20)
    values = shaped(shape)
    probabilities = (0.01, 0.25, 0.5, 0.75, 0.99)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = exact_quantiles(df, ["x"], probabilities).first()
    ordered = np.sort(values)
    for i, p in enumerate(probabilities):
        at = p * (len(values) - 1)
        a, b = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        expected = a if a == b else a + (b - a) * (at - np.floor(at))
        assert row[f"q{i}"] == pytest.approx(expected, rel=1e-12)


def test_sketched_distinct_counts_stay_close(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    sketch, exact = by_column(profile_table(rows, exact=False)), by_column(profile_table(rows, parts=("distinct",)))
    for column, row in exact.items():
        assert sketch[column]["distinct_ratio"] == pytest.approx(row["distinct_ratio"], rel=0.2)


def test_approximate_profile_judges_distinct_counts_too(spark, sf):
    found = QUERIES["profile_approx"](spark, sf).collect()
    assert len(found) == 8
    assert all(r["distinct_is_close"] and r["median_is_close"] and r["tail_is_close"] for r in found)
