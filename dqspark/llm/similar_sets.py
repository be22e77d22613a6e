"""Classes of similar sets from the addresses that similar sets share, in rounds that each meet fewer pairs.

A star is a set and those that share an address with it and come after it. First every set meets the hub that it shares
most addresses with; equal to one comparison per set, this connects a group of near copies. Then the hubs from which it is
still apart, and last, within stars, the members that are apart from their hub and from each other. Pairs that are connected
already need no comparison, and only vectors and sets of pairs that meet are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import BROADCAST_ROWS, discard, small_side, store
from dqspark.llm.components import components


def ragged(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """List column of n rows from values and the rows that own them."""
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order], pa.int64()))


def led(addresses: list[np.ndarray], owners: list[np.ndarray], places: Sequence[int]) -> list[pa.Array]:
    """addresses, held, leads of the rows of a piece: the first row at an address leads it, the others hold it beside the lead."""
    a = np.concatenate(addresses) if addresses else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    named = np.array(places, np.int64)
    _, first, which = np.unique(a, return_index=True, return_inverse=True)
    lead = first[which]
    held = lead != np.arange(len(a))
    return [
        ragged(a[~held].view(np.int64), o[~held], len(named)),
        ragged(a[held].view(np.int64), o[held], len(named)),
        ragged(named[o[lead][held]], o[held], len(named)),
    ]


def stars(sketches: DataFrame, names: DataFrame) -> DataFrame:
    """star, place, shared: each set beside the first set at one of its addresses, and at how many; one row per member, not per pair.

    sketches have a place, the addresses it was first at in its piece, and those it held beside the lead of its piece, so
    a shared address is as many rows as pieces. names(node, place) give the one place of equal sets.
    """
    sent = sketches.select(F.col("place").alias("node"), F.explode("addresses").alias("address"))
    first = F.first("node").over(Window.partitionBy("address").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    shared = store(sent.select("address", "node", first.alias("hub")).filter("node <> hub"), "shared-addresses")
    held = sketches.select(F.col("place").alias("node"), F.explode(F.arrays_zip("held", "leads")).alias("h"))
    # A lead and its followers are of one piece, so a list is bounded by a piece's rows.
    behind = held.groupBy("h.held", "h.leads").agg(F.collect_list("node").alias("nodes"))
    own = shared.select(F.col("address").alias("held"), F.col("node").alias("leads"), "hub")
    beside = behind.join(own, ["held", "leads"], "left").select(F.coalesce("hub", "leads").alias("hub"), F.explode("nodes").alias("node"))
    pairs = store(shared.select("hub", "node").union(beside).groupBy("hub", "node").agg(F.count(F.lit(1)).alias("shared")), "star-nodes")
    met = store(
        pairs.join(names.select(F.col("node").alias("hub"), F.col("place").alias("star")), "hub")
        .join(names, "node")
        .filter("star <> place")
        .groupBy("star", "place")
        .agg(F.sum("shared").alias("shared")),
        "stars",
    )
    discard(shared)
    discard(pairs)
    return met


def among_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column is one of the stored keys; all rows where the keys are too many to broadcast."""
    if keys.count() > BROADCAST_ROWS:
        return df
    return df.join(F.broadcast(keys.toDF("_key")), F.col(column) == F.col("_key"), "left_semi")


def beside(pairs: DataFrame, of: tuple[str, str], rows: DataFrame) -> DataFrame:
    """The stored pairs with the columns of rows(place, ...) for both of their places, those of the second as other_*.

    Few pairs go to the rows, which then stay where they are; of the second places only those of a pair are shuffled.
    """
    first, second = of
    more = [c for c in rows.columns if c != "place"]
    left = small_side(pairs.select(first, second)).join(rows.withColumnRenamed("place", first), first)
    wanted = store(pairs.select(second).distinct(), "second-places")
    right = among_keys(rows, "place", wanted).select(F.col("place").alias(second), *[F.col(c).alias(f"other_{c}") for c in more])
    return left.join(right, second)


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The stored pairs (a, b) whose sets are similar; sets are (place, shingles)."""
    num, den = similar
    both = F.size(F.array_intersect("shingles", "other_shingles"))
    met = beside(pairs, ("a", "b"), sets)
    return met.filter(den * both >= num * (F.size("shingles") + F.size("other_shingles") - both)).select("a", "b")


def tiled(members: DataFrame, run: Callable, columns: list[str], most: int, most_bytes: int) -> DataFrame:
    """a, b with a < b from run(key, queries, members) over the stars, cut into tiles of bounded rows and vector bytes.

    Stored members have a star, a place, a vector, its bytes and whether they are queries as well (asks); every pair of
    tiles of a star is a group of its own.
    """
    size = lambda of, name: F.ceil(F.greatest(F.count(of) / most, F.sum(F.when(of.isNotNull(), F.col("bytes"))) / most_bytes)).cast("int").alias(name)
    counts = members.groupBy("star").agg(size(F.when(F.col("asks"), 1), "qt"), size(F.lit(1), "mt")).filter("qt > 0")
    counts = store(counts, "star-tiles")
    # Both sides come from one frame; new names for the same columns keep them apart.
    fresh = lambda df: df.select(F.col("star").alias("star"), *[F.col(c).alias(c) for c in columns])
    own = lambda n: F.pmod(F.xxhash64("place"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    counted = small_side(counts)
    q = fresh(members.filter("asks")).join(counted, "star").select("star", own("qt").alias("i"), every("mt").alias("j"), *columns)
    m = fresh(members).join(counted, "star").select("star", every("qt").alias("i"), own("mt").alias("j"), *columns)
    keys = ("star", "i", "j")
    found = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(
    meets: DataFrame,
    points: DataFrame,
    sets: DataFrame,
    similar: tuple[int, int],
    beside_hub: Callable[[DataFrame], DataFrame],
    among: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """id, label of the sets of meets(star, place, shared) that are connected by verified links; others are alone.

    points are (place, n, vector). beside_hub(pairs) leaves the pairs (star, place, n, vector, other_n, other_vector) that
    may be similar, as (a, b); among(members) gives pairs of members of a star that may be similar, where `asks` marks
    those that are not connected with their hub, and those of one `part` are connected.
    """

    def apart_from_hub(labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        part = lambda df, key, new: df.join(labels.select(F.col("id").alias(key), F.col("label").alias(new)), key, "left").withColumn(new, F.coalesce(new, key))
        parted = store(part(part(meets.select("star", "place"), "place", "part"), "star", "hub_part"), name)
        return parted, parted.filter("part <> hub_part")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = store(pairs, f"{name}-pairs")
        links = store(verified(pairs, sets, similar), f"{name}-links")
        discard(pairs)
        return links

    def hub_links(pairs: DataFrame, name: str) -> DataFrame:
        met = store(pairs.select("place", "star"), f"{name}-meets")
        return linked(beside_hub(beside(met, ("place", "star"), points)).distinct(), name)

    nearest = meets.groupBy("place").agg(F.min_by("star", F.struct(-F.col("shared"), F.col("star"))).alias("star"))
    links = hub_links(nearest, "first")
    parted, apart = apart_from_hub(components(links), "first-parts")
    if not apart.isEmpty():
        # Pairs that met in the first round meet again here, at most one per set.
        links = links.union(hub_links(apart, "hub"))
        parted, apart = apart_from_hub(components(links), "second-parts")
        # Members of one part are connected; only stars with more than one part hold anything to compare.
        mixed = store(parted.groupBy("star").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("star"), "mixed-stars")
        if not mixed.isEmpty():
            own = parted.join(small_side(mixed), "star", "left_semi")
            own = store(own.select("star", "place", "part", (F.col("part") != F.col("hub_part")).alias("asks")), "mixed-members")
            members = store(small_side(own).join(points, "place").withColumn("bytes", F.octet_length("vector")), "star-members")
            links = links.union(linked(among(members), "member"))
            discard(members)
    return components(links)
