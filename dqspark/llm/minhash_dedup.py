"""MinHash near-dedup with tensored banding.

A table's key joins half a key from each of two small collections of minhash bands, so HALVES bands of each collection make
HALVES * HALVES tables from 2 * HALVES * BAND minhashes, about the square root of what as many separate tables would need.
A pair of similarity s meets in a table with probability (1 - (1 - s ** BAND) ** HALVES) ** 2: 0.99998 at 0.8, more above.
Sets that meet are compared by a bound from bitmaps, which loses none, and the rest verified on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import discard, documents, pieces, store
from dqspark.llm.jaccard_join import SQL as JOIN_SQL
from dqspark.llm.jaccard_join import chunks, mix, set_key, shingle_sets, star_sets
from dqspark.llm.similar_sets import connected, led, stars, tiled

SHINGLE = 5
SIMILAR = (80, 100)
#: Minhashes of a half key, and half keys of each collection.
BAND, HALVES = 3, 16
#: Bitmaps have at least so many bits for each shingle, up to the longest bitmap.
BITS, LONGEST = 8, 1 << 15
#: Sets of a task of a star and bytes of their bitmaps, whichever ends a tile first.
TILE, TILE_BYTES = 4096, 4_000_000

_U = np.uint64
SKETCH = "doc_id bigint, n bigint, set_key binary, vector binary, addresses array<bigint>, held array<bigint>, leads array<bigint>, place bigint"


def multipliers(number: int) -> np.ndarray:
    """Odd numbers that spread well-mixed hashes anew, one per minhash; the same in every process."""
    return mix(np.arange(1, number + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def minhashes(sets: list[np.ndarray], number: int) -> np.ndarray:
    """One row per set, none empty: the least product of its hashes with each multiplier."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * m, starts) for m in multipliers(number)], axis=1)


def table_keys(least: np.ndarray, band: int = BAND, halves: int = HALVES) -> np.ndarray:
    """halves * halves keys per row: each half key of the first collection with each of the second."""
    folded = np.zeros((len(least), 2 * halves), _U)
    for j in range(band):
        folded = mix(folded + least[:, j::band] + _U(j + 1))
    first, second = folded[:, :halves], folded[:, halves:]
    table = np.arange(halves * halves, dtype=_U).reshape(halves, halves)
    return mix(first[:, :, None] + mix(second[:, None, :] + table)).reshape(len(least), -1)


def bitmap(v: np.ndarray) -> np.ndarray:
    """Bits of a set as 64-bit words; a power of two of them, so that long ones fold onto short ones."""
    size = min(LONGEST, max(64, 1 << (BITS * len(v) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(mix(v) >> _U(64 - (size.bit_length() - 1))).astype(np.int64)] = 1
    # The top bits of a hash choose its place, so neighbours become one bit when a bitmap is halved.
    return np.packbits(bits, bitorder="little").view("<u8")


def halve(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis) folded to `size` words: a folded bit is set if one of its bits is."""
    if words.shape[-1] == size:
        return words
    bits = np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")
    bits = bits.reshape(*words.shape[:-1], size * 64, -1).max(axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def may_link(n: int, words: np.ndarray, others_n: np.ndarray, others: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which of the others can be similar: what one bitmap has and the other lacks is certainly not in both sets."""
    num, den = similar
    only = np.bitwise_count(words & ~others).sum(axis=-1, dtype=np.int64)
    only_others = np.bitwise_count(others & ~words).sum(axis=-1, dtype=np.int64)
    both = np.minimum(n - only, others_n - only_others)
    return den * both >= num * (n + others_n - both)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """Per document: set size, set key, bitmap and table keys, the latter once per piece of a batch (see similar_sets.stars)."""

    def run(batches):
        place = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            seen: set[bytes] = set()
            rows, addresses, owners = [], [], []
            ids = batch.column("doc_id").to_pylist()
            for begin, raws in chunks(batch.column("text").to_pylist()):
                fresh = []
                for i, v in enumerate(shingle_sets(raws, k), begin):
                    key = set_key(v)
                    rows.append((ids[i], len(v), key, bitmap(v).tobytes() if len(v) else b"", place))
                    place += 1
                    if len(v) and key not in seen:
                        seen.add(key)
                        fresh.append((i, v))
                if fresh:
                    keys = table_keys(minhashes([v for _, v in fresh], 2 * HALVES * BAND))
                    addresses.append(keys.ravel())
                    owners.append(np.repeat([i for i, _ in fresh], keys.shape[1]))
            if rows:
                ids_, n, keys, bits, places = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids_, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bits, pa.binary()),
                        *led(addresses, owners, places),
                        pa.array(places, pa.int64()),
                    ],
                    ["doc_id", "n", "set_key", "vector", "addresses", "held", "leads", "place"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, SKETCH)


def _beside_hub(pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b: the rows of pairs(star, place, n, vector, other_n, other_vector) that may be similar."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "vector", "other_n", "other_vector")]
            may = np.zeros(batch.num_rows, bool)
            for i, (n, words, hub_n, hub) in enumerate(zip(*columns)):
                w, h = np.frombuffer(words, "<u8"), np.frombuffer(hub, "<u8")
                size = min(len(w), len(h))
                may[i] = may_link(n, halve(w, size), np.int64(hub_n), halve(h, size), similar)
            kept = batch.filter(pa.array(may))
            a, b = kept.column("star").to_numpy(), kept.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _among(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b: members of one star that may be similar; pairs of one part are connected already. Both sides are tiled."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            lists = [np.frombuffer(w, "<u8") for w in right.column("vector").to_pylist()]
            size = min(map(len, lists))
            others = np.stack([halve(w, size) for w in lists])
            others_n, places, parts = (right.column(c).to_numpy() for c in ("n", "place", "part"))
            for place, n, words, part in zip(*(left.column(c).to_pylist() for c in ("place", "n", "vector", "part"))):
                w = np.frombuffer(words, "<u8")
                width = min(size, len(w))
                at = np.flatnonzero(parts != part)
                at = at[may_link(n, halve(w, width), others_n[at], halve(others[at], width), similar)]
                a.append(np.full(len(at), place))
                b.append(places[at])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return tiled(members, run, ["place", "n", "vector", "part"], TILE, TILE_BYTES)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents(doc_id, text).

    A set is the distinct k-word shingles of the whole text, A-Z lower-cased; shorter texts are one shingle. Documents link
    when den * intersection >= num * union on the full sets; component_id is the smallest doc_id reachable, and that row is
    kept. Pairs with a similarity at `similar` are found with the probability above; equal sets always are. Null, empty and
    wordless texts link with nothing and are kept. Rows that repeat an id are documents of their own, kept or not with their
    id; a component of null ids alone has a null id and keeps its rows. An empty table gives no rows; further columns are
    ignored.
    """
    located = store(sketch(docs, k), "minhash-sketches")
    sketches = store(located.select("doc_id", "n", "set_key", "vector", "place"), "minhash-sets")
    with_words = sketches.filter("n > 0")
    distinct = store(with_words.groupBy("set_key", "n").agg(F.min("place").alias("place"), F.min("doc_id").alias("low")), "minhash-distinct")
    names = with_words.select(F.col("place").alias("node"), "set_key").join(distinct.select("set_key", "place"), "set_key")
    meets = stars(located, store(names.select("node", "place"), "minhash-names"))
    discard(located)

    sets, points = star_sets(docs, meets, distinct, sketches, k)
    labels = connected(meets, points, sets, similar, lambda pairs: _beside_hub(pairs, similar), lambda members: _among(members, similar))
    classes = distinct.join(labels.withColumnRenamed("id", "place"), "place", "left").withColumn("label", F.coalesce("label", "place"))
    smallest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = classes.join(smallest, "label").select("set_key", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    named = sketches.select("doc_id", "n", "set_key").join(by_set, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), k=2, similar=(80, 100))


SQL = (
    JOIN_SQL.replace("w[i:i + 3]", "w[i:i + 1]")
    .replace("len(w) - 2, 2", "len(w), 2")
    .replace("100 * common >= 85 *", "100 * common >= 80 *")
    .replace("c.component_id\nFROM", "c.component_id, d.doc_id = c.component_id AS kept\nFROM")
)
