"""Connected components of a stored edge list by contraction, in a number of rounds that grows with its logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """id, label for every id in edges(a bigint, b bigint); equal labels mean connected. Labels are ids of members.

    In each round every node joins the neighbour of least priority, itself included, and edges between the joined nodes
    remain. Priorities are a hash of node and round, so a long chain shrinks by a share in each round instead of by one
    node. A hub folds per task before the shuffle; where a hub's edges meet its one new name, the join may be split.
    """
    spark = edges.sparkSession
    left = store(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    names = store(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("label", F.col("id")), "names")
    turn = 0
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))
        joined = store(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("least"))
            .select("a", F.least(F.col("least"), rank("a"))["id"].alias("to"))
            .filter("a <> to"),
            "joined",
        )
        old, new = joined.select(F.col("a").alias("label"), "to"), joined
        names = store(
            names.join(old, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "names"
        )
        left = store(
            left.join(new.withColumnRenamed("to", "ta"), "a", "left")
            .join(new.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
            .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
        turn += 1
    return names if turn else spark.createDataFrame([], "id bigint, label bigint")
