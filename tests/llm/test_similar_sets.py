"""Rounds of similar_sets.connected: which pairs meet in each of them."""

from __future__ import annotations

from dqspark.llm.similar_sets import connected


def test_each_round_meets_only_what_is_apart(spark):
    meets = spark.createDataFrame([(1, 2, 1), (3, 2, 9), (3, 4, 1), (3, 6, 1), (5, 7, 1)], "star bigint, place bigint, shared bigint")
    shingles = {1: range(10), 2: range(20, 30), 3: range(20, 30), 4: range(40, 50), 5: range(60, 70), 6: range(40, 50), 7: range(80, 90)}
    sets = spark.createDataFrame([(p, list(v)) for p, v in shingles.items()], "place bigint, shingles array<bigint>")
    points = spark.createDataFrame([(p, 10, b"v%d" % p) for p in shingles], "place bigint, n bigint, vector binary")
    met, asked = [], []

    def beside_hub(pairs):
        rows = pairs.select("star", "place", "vector", "other_vector").collect()
        assert all((r.vector, r.other_vector) == (b"v%d" % r.place, b"v%d" % r.star) for r in rows)
        met.append({(r.star, r.place) for r in rows})
        return pairs.select("star", "place").toDF("a", "b")

    def among(members):
        asked.append({(r.star, r.place, r.asks) for r in members.collect()})
        return spark.createDataFrame([(4, 6)], "a bigint, b bigint")

    labels = {r.id: r.label for r in connected(meets, points, sets, (80, 100), beside_hub, among).collect()}
    # A set first meets the star it shares most addresses with, then those it is still apart from.
    assert met == [{(3, 2), (3, 4), (3, 6), (5, 7)}, {(1, 2), (3, 4), (3, 6), (5, 7)}]
    # Stars of one part hold nothing to compare.
    assert asked == [{(3, 2, False), (3, 4, True), (3, 6, True)}]
    assert labels[2] == labels[3] and labels[4] == labels[6] != labels[2] and not {1, 5, 7} & set(labels)
