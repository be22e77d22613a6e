from decimal import Decimal

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqspark.operators import diff as X
from dqspark.operators import faults as Y
from dqspark.operators import repair as R
from dqspark.operators.contract import builtin_contracts, check_contract
from dqspark.operators.suggest import suggest_contract
from dqspark.plans.fault_matrix import EXPECTED, fault_matrix


@pytest.fixture(scope="module")
def versions(spark):
    schema = "id int, amount double, when timestamp_ntz, tag string"
    day = datetime(2024, 1, 1)
    before = spark.createDataFrame([(1, 1.0, day, "a"), (2, None, day, "b"), (3, 3.0, day, "c"), (4, 4.0, day, None)], schema)
    after = spark.createDataFrame([(1, 1.5, day, "a"), (2, None, day, "B"), (3, 3.0, day, "c"), (5, 5.0, day, None)], schema)
    return before, after


def test_diff_counts(versions):
    row = X.data_diff(*versions, ["id"], 1.0).first()
    assert (row["added_rows"], row["removed_rows"], row["changed_rows"], row["changed_cells"]) == (1, 1, 2, 2)
    assert row["change_ratio"] == 0.8 and row["passed"] and not row["schema_changed"]
    assert {r["column"]: r["changed_cells"] for r in X.diff_by_column(*versions, ["id"]).collect()} == {"amount": 1, "tag": 1}
    totals = {r["column"]: (r["before"], r["after"]) for r in X.diff_totals(*versions, ["id"]).collect()}
    assert totals == {"amount": (8.0, 9.5)}


def test_diff_samples(versions):
    rows = {(r["change"], r["id"]): r["changes"] for r in X.diff_samples(*versions, ["id"]).collect()}
    assert [tuple(c) for c in rows[("changed", 1)]] == [("amount", "1.0", "1.5")]
    assert set(rows) == {("changed", 1), ("changed", 2), ("added", 5), ("removed", 4)}


def test_diff_of_itself_and_schema_change(versions):
    before, _ = versions
    same = X.data_diff(before, before, ["id"]).first()
    assert same["passed"] and same["change_ratio"] == 0.0
    retyped = before.withColumn("amount", F.col("amount").cast("string"))
    changed = X.data_diff(before, retyped, ["id"], 1.0).first()
    assert changed["schema_changed"] and not changed["passed"]


def test_diff_refuses_bad_keys(versions):
    before, after = versions
    for keys in ([], ["nope"], ["tag"]):
        with pytest.raises(ValueError):
            X.data_diff(before, after, keys)
    with pytest.raises(ValueError):
        X.data_diff(before.unionAll(before), after, ["id"])


def test_gate(versions):
    before, after = versions
    contract = {"rules": [{"type": "range", "column": "amount", "min": 0, "max": 4}]}
    rows = {r["check"]: r["passed"] for r in X.quality_gate(before, after, contract, ["id"], 1.0).collect()}
    assert rows == {"diff": True, "contract": False, "gate": False}
    assert all(r["passed"] for r in X.quality_gate(before, before, contract, ["id"]).collect())


def test_repairs(spark):
    df = spark.createDataFrame([(1, "good", 10.0), (2, "bad", 1000.0), (3, "bad", 2000.0)], "id int, batch string, amount double")
    rule = {"rules": [{"type": "range", "column": "amount", "min": 0, "max": 100}]}
    fixed = R.repair_scale(df, "amount", 0.01, {"batch": "bad"}, 10)
    assert [r["amount"] for r in fixed.orderBy("id").collect()] == [10.0, 10.0, 20.0]
    verdict = R.validate_repair(df, fixed, rule, 10, where={"batch": "bad"}).first()
    assert verdict["passed"] and verdict["changed_rows"] == 2 and verdict["unchanged_control_passed"]
    touched = fixed.withColumn("amount", F.col("amount") + 1)
    verdict = R.validate_repair(df, touched, rule, 10, where={"batch": "bad"}).first()
    assert not verdict["passed"] and not verdict["unchanged_control_passed"]
    wrong = R.repair_scale(df, "amount", 0.1, {"batch": "bad"}, 10)
    assert not R.validate_repair(df, wrong, rule, 10, where={"batch": "bad"}).first()["passed"]
    for args in (("amount", 3, {"batch": "bad"}), ("amount", 10, {"batch": "none"}), ("batch", 10, {"batch": "bad"}), ("amount", 10, {})):
        with pytest.raises(ValueError):
            R.repair_scale(df, *args, max_changed_rows=10)
    with pytest.raises(ValueError):
        R.repair_scale(df, "amount", 10, {"batch": "bad"}, max_changed_rows=1)


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    fixed = R.repair_deduplicate(df, ["id"], 10)
    rule = {"rules": [{"type": "uniqueness", "column": "id"}]}
    assert fixed.count() == 2 and R.validate_repair(df, fixed, rule, 10).first()["passed"]
    with pytest.raises(ValueError):
        R.repair_deduplicate(df.unionAll(spark.createDataFrame([(1, "z")], df.schema)), ["id"], 10)
    with pytest.raises(ValueError):
        R.repair_deduplicate(fixed, ["id"], 10)


def test_scale_keeps_types_and_other_rows(spark):
    df = spark.sql(
        "select 9007199254740993L as b, cast(1.10 as decimal(12,2)) as m, 'good' as batch union all select 500L, cast(120.00 as decimal(12,2)), 'bad'"
    )
    where = {"batch": "bad"}
    for column, factor, expected in (("b", 0.1, 50), ("b", 100, 50_000), ("m", 0.01, Decimal("1.20")), ("m", 10, Decimal("1200.00"))):
        fixed = R.repair_scale(df, column, factor, where, 5)
        assert fixed.schema == df.schema or [f.dataType for f in fixed.schema] == [f.dataType for f in df.schema]
        rows = {r["batch"]: r[column] for r in fixed.collect()}
        assert rows == {"good": df.filter("batch = 'good'").first()[column], "bad": expected}
    with pytest.raises(ValueError):
        R.repair_scale(df.withColumn("b", F.lit(5).cast("bigint")), "b", 0.1, where, 5)
    with pytest.raises(ValueError):
        R.repair_scale(df.withColumn("m", F.lit("9999999999.00").cast("decimal(12,2)")), "m", 10, where, 5)


def test_repair_undoes_fault(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    broken = Y.fault_scale(orders, "o_totalprice", 100.0, F.col("o_orderstatus") == "P")
    fixed = R.repair_scale(broken, "o_totalprice", 0.01, {"o_orderstatus": "P"}, 10**6)
    joined = fixed.join(orders.select("o_orderkey", F.col("o_totalprice").alias("was")), "o_orderkey")
    assert joined.filter(F.abs(F.col("was") - F.col("o_totalprice")) > 1e-6).count() == 0


def test_faults(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n = orders.count()
    assert "o_custkey" not in Y.fault_drop_column(orders, "o_custkey").columns
    codes = {(r[0], r[1]) for r in orders.join(Y.fault_recode(orders, "o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("c")), "o_orderkey").select("o_orderstatus", "c").distinct().collect()}
    assert codes == {("F", 0), ("O", 1), ("P", 2)}
    spiked = Y.fault_null_spike(orders, "o_totalprice", "o_orderkey")
    assert spiked.filter("o_totalprice is null").count() == int(n * 0.4)
    assert spiked.exceptAll(Y.fault_null_spike(orders.repartition(5), "o_totalprice", "o_orderkey")).count() == 0
    assert Y.fault_duplicate(orders).count() == 2 * n
    assert n < Y.fault_duplicate(orders, 0.25, "o_orderkey").count() < 1.5 * n
    with pytest.raises(ValueError):
        Y.apply_fault(orders, "F99", {})
    with pytest.raises(ValueError):
        Y.fault_null_spike(Y.fault_duplicate(orders), "o_totalprice", "o_orderkey", ratio=1 / (2 * n))


def test_golden_faults(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    as_of = orders.agg(F.max("o_orderdate")).first()[0] + timedelta(hours=1)
    columns = {"drop": "o_custkey", "recode": "o_orderstatus", "amount": "o_totalprice", "key": "o_orderkey", "time": "o_orderdate"}
    contract = builtin_contracts()["orders"]
    assert check_contract(orders, contract, as_of).count() == 0
    rows = {r["fault_id"]: r for r in fault_matrix(orders, contract, columns, as_of).collect()}
    assert set(rows) == set(EXPECTED)
    for fault, (_, rule, least) in EXPECTED.items():
        assert rows[fault]["passed"], rows[fault]
        assert rows[fault]["top_rule"] == rule and rows[fault]["top_confidence"] >= least


def test_suggestion_fits_its_sample_and_catches_scale(spark):
    rows = [
        (i, ["new", "paid", "sent"][i % 3], 100.0 + i, None if i % 4 else "note", datetime(2024, 1, 1), i % 2 == 0) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "order_id int, status string, amount double, note string, created_at timestamp_ntz, flag boolean")
    contract, rules = suggest_contract(df)
    by_rule = {(r["type"], r["column"]): r for r in contract["rules"]}
    assert ("uniqueness", "order_id") in by_rule and ("range", "order_id") not in by_rule
    assert by_rule[("not_null", "order_id")]["max_null_ratio"] == 0.0
    assert by_rule[("not_null", "amount")]["max_null_ratio"] == 0.01 and ("not_null", "note") not in by_rule
    assert by_rule[("allowed_values", "status")]["values"] == ["new", "paid", "sent"]
    assert (by_rule[("range", "amount")]["min"], by_rule[("range", "amount")]["max"]) == (0.0, 400.0)
    assert contract["expected_schema"]["flag"] == "boolean"
    assert check_contract(df, contract).count() == 0
    broken = check_contract(df.withColumn("amount", F.col("amount") * 100), contract).collect()
    assert [r["rule_type"] for r in broken] == ["range"]
    short, _ = suggest_contract(df.limit(10))
    assert {r["type"] for r in short["rules"]} == {"not_null"}
    with pytest.raises(ValueError):
        suggest_contract(df.filter("false"))


def test_fingerprint_diff_equals_full_diff(spark, versions):
    before, after = versions
    more = spark.range(100, 400).select(F.col("id").cast("int"), F.lit(1.0).alias("amount"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("when"), F.lit("x").alias("tag"))
    # A null and a value that change places, and a not-a-number against a null, must be told apart or not.
    swap = spark.createDataFrame([(900, None, None, "q"), (901, float("nan"), None, "q")], before.schema)
    swapped = spark.createDataFrame([(900, None, datetime(2024, 1, 1), None), (901, None, None, "q")], before.schema)
    left, right = before.unionByName(more).unionByName(swap), after.unionByName(more).unionByName(swapped)
    assert X.data_diff(left, right, ["id"], fingerprint=True).first() == X.data_diff(left, right, ["id"]).first()
    assert {r["id"] for r in X.different_keys(left, right, ["id"]).collect()} == {1, 2, 4, 5, 900}
