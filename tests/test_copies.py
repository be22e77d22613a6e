"""Faulted copies of one scan: same rows and signals as copies made one by one, each value shuffled once."""

from datetime import datetime

from pyspark.sql import functions as F

from dqspark.operators import faults as Y
from dqspark.operators.contract import builtin_contracts, check_contract
from dqspark.operators.profile import profile_table
from dqspark.queries.change_q import FAULT_COLUMNS

IN_PLACE = ("F03", "F04", "F05", "F06")


def faulted(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    # Missing and equal values beside the keys, which are all different.
    orders = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")))
    one_by_one = None
    for name in IN_PLACE:
        part = Y.apply_fault(orders, name, FAULT_COLUMNS).withColumn("run_id", F.lit(name))
        one_by_one = part if one_by_one is None else one_by_one.unionByName(part)
    changes = {name: Y.fault_change(orders, name, FAULT_COLUMNS) for name in IN_PLACE}
    return one_by_one, Y.changed_copies(orders, changes)


def test_copies_of_one_scan_have_the_same_rows(spark, sf):
    one_by_one, together = faulted(spark, sf)
    assert together.dtypes == one_by_one.dtypes
    assert together.exceptAll(one_by_one).isEmpty() and one_by_one.exceptAll(together).isEmpty()


def test_folded_copies_have_the_same_profile_and_violations(spark, sf):
    one_by_one, together = faulted(spark, sf)
    key = ("run_id", "ordinal")
    plain = profile_table(one_by_one, ["run_id"], parts=("distinct",)).orderBy(*key)
    folded = profile_table(together, ["run_id"], parts=("distinct",), copies=IN_PLACE).orderBy(*key)
    columns = ("run_id", "column", "row_count", "null_ratio", "distinct_ratio", "min", "max", "min_ts", "max_ts")
    assert folded.select(*columns).collect() == plain.select(*columns).collect()
    as_of = datetime(2030, 1, 1)
    contract = builtin_contracts()["orders"]
    found = [
        sorted(map(str, check_contract(df, contract, as_of, runs=["run_id"], copies=copies).collect()))
        for df, copies in ((one_by_one, ()), (together, IN_PLACE))
    ]
    assert found[0] == found[1] and any("uniqueness" in row for row in found[0])


def test_few_categories_do_not_collect_the_rows(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with rows whose size is not known
    try:
        plan = Y.fault_recode(orders, "o_orderstatus")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
