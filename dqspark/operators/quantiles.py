"""Exact linear-interpolated quantiles by selection: no exchange carries a whole column and no task ranks a long list.

A sketch brackets every wanted rank. One pass counts what lies below and inside each bracket, which proves that the rank
is inside; a bracket that misses it is widened and counted again. Only values inside brackets are shuffled, folded by
value. While a bracket holds more distinct values than a task should rank, each of the two order statistics of a rank is
sought for itself: its bracket is cut where its distinct values fall into equal shares, counted, and the one share that
holds the position stays. So every cut shrinks it by a factor, however far apart or heavy-tailed the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.runtime import broadcast_if_small, materialize

ACCURACY = 10_000
# The sketch error is 1/accuracy; the bracket is ten times wider.
BRACKET = 10 / ACCURACY
RANKED_VALUES = 200_000
SLICES = 64


def bracket_sketch(column: Column, probabilities: Sequence[float]) -> Column:
    around = [x for p in probabilities for x in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    return F.percentile_approx(column, around, ACCURACY)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join; the columns of `right` come under their own names."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def _start(stats: DataFrame, keys: list[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per group and probability with its rank and its bracket."""
    wanted = F.array(
        *[
            F.struct(
                F.lit(j).alias("j"),
                (F.lit(float(p)) * (F.col("non_null") - 1)).alias("rank"),
                (F.col("min") if p - BRACKET <= 0 else F.col("brackets")[2 * j]).alias("lo"),
                (F.col("max") if p + BRACKET >= 1 else F.col("brackets")[2 * j + 1]).alias("hi"),
            )
            for j, p in enumerate(probabilities)
        ]
    )
    there = stats.filter("kind = 'numeric' and non_null > 0")
    return there.select(*keys, F.col("min").alias("first"), F.col("max").alias("last"), F.inline(wanted))


def _bracketed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the brackets of their group."""
    brackets = state.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", "lo", "hi"))).alias("wanted"))
    return _same(rows, broadcast_if_small(brackets), keys)


def _counted(rows: DataFrame, state: DataFrame, keys: list[str], n: int) -> DataFrame:
    """State with `below` and `inside`: how many values lie there. Folds in every task; nothing else is shuffled."""
    w = lambda j: F.col("wanted")[j]
    counts = [F.count_if(F.col("v") < w(j)["lo"]).alias(f"b{j}") for j in range(n)]
    counts += [F.count_if(F.col("v").between(w(j)["lo"], w(j)["hi"])).alias(f"i{j}") for j in range(n)]
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"b{j}").alias("below"), F.col(f"i{j}").alias("inside")) for j in range(n)])
    folded = _bracketed(rows, state, keys).groupBy(*keys).agg(*counts).select(*keys, F.inline(each))
    return materialize(_same(state, folded, [*keys, "j"]))


def _outside() -> Column:
    return (F.col("below") > F.floor("rank")) | (F.col("below") + F.col("inside") <= F.ceil("rank"))


def _targets(state: DataFrame, group: list[str]) -> DataFrame:
    """Each rank as the positions below and above it (`side`), which then narrow on their own."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), at.alias("rank")) for i, at in enumerate((F.floor("rank"), F.ceil("rank")))])
    return state.select(*group, "below", "lo", "hi", F.inline(sides))


def _sliced(points: DataFrame, state: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points and state after every bracket has shrunk to the share of its distinct values that holds its position."""
    shares = [i / SLICES for i in range(1, SLICES)]
    cuts = points.groupBy(*group).agg(F.percentile_approx("v", shares, ACCURACY).alias("cuts"))
    placed = _same(points, broadcast_if_small(materialize(cuts)), group)
    # A value belongs to the share that begins at the last cut up to it.
    placed = placed.withColumn("slice", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    slices = placed.groupBy(*group, "slice").agg(F.sum("freq").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    of_group = _same(slices, state.select(*group, "rank", "below"), group)
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*group).orderBy("slice"))
    held = of_group.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    state = materialize(held.select(*group, "rank", (F.col("upto") - F.col("n")).alias("below"), "lo", "hi"))
    inside = _same(points, broadcast_if_small(state.select(*group, "lo", "hi")), group)
    return materialize(inside.filter(F.col("v").between(F.col("lo"), F.col("hi"))).select(*group, "v", "freq")), state


def select_quantiles(rows: DataFrame, stats: DataFrame, runs: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(runs…, ordinal, q0, q1, …) from rows(runs…, ordinal, v) without nulls and materialized statistics of the same rows."""
    keys, n = [*runs, "ordinal"], len(probabilities)
    group = [*keys, "j"]
    state = _counted(rows, materialize(_start(stats, keys, probabilities)), keys, n)
    if not state.filter(_outside()).isEmpty():
        whole = _outside()
        wider = state.withColumns({"lo": F.when(whole, F.col("first")).otherwise(F.col("lo")), "hi": F.when(whole, F.col("last")).otherwise(F.col("hi"))})
        state = _counted(rows, wider.drop("below", "inside"), keys, n)

    within = F.filter("wanted", lambda w: F.col("v").between(w["lo"], w["hi"]))
    points = materialize(
        _bracketed(rows, state, keys)
        .select(*keys, "v", F.explode(within).alias("w"))
        .groupBy(*keys, F.col("w.j").alias("j"), "v")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    part = state.select(*group, (F.col("rank") - F.floor("rank")).alias("part"))
    sought = [*group, "side"]
    state = _targets(state, group)
    crowded = points.groupBy(*group).count().filter(F.col("count") > RANKED_VALUES)
    if not crowded.isEmpty():
        # Both sides begin with the bracket they share; from here on they part.
        state = materialize(state)
        points = points.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        while not points.groupBy(*sought).count().filter(F.col("count") > RANKED_VALUES).isEmpty():
            points, state = _sliced(points, state, sought)
        met, by = _same(points, state.select(*sought, "rank", "below"), sought), sought
        upto = F.col("below") + F.sum("freq").over(Window.partitionBy(*by).orderBy("v"))
        found = met.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy(*sought).agg(F.min("v").alias("at"))
        picked = found.groupBy(*group).agg(*[F.max(F.when(F.col("side") == i, F.col("at"))).alias(n) for i, n in enumerate("ab")])
    else:
        both = state.groupBy(*group).agg(F.min("rank").alias("first"), F.max("rank").alias("second"), F.min("below").alias("below"))
        upto = F.col("below") + F.sum("freq").over(Window.partitionBy(*group).orderBy("v"))
        ranked = _same(points, both, group).withColumn("upto", upto)
        picked = ranked.groupBy(*group).agg(*[F.min(F.when(F.col("upto") > F.col(r), F.col("v"))).alias(n) for r, n in (("first", "a"), ("second", "b"))])
    picked = _same(picked, part, group)
    # Equal order statistics need no arithmetic, which infinities would not survive.
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, value)).alias(f"q{j}") for j in range(n)])
