"""Best-fit packing by a grouping genetic algorithm: islands evolve whole-bin solutions per block and exchange elites."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import documents, pieces, store, text_or_empty
from dqspark.llm.tokens import encoder, in_chunks

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0

# Search effort, the same for every block: pieces a block holds on average, islands of a block, epochs between which
# elites migrate, solutions of an island, crossovers of an epoch.
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` ids of each whole text and its end id, without the ids; `place` is unique per row."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        # Unique over tasks; the pieces are stored once, so it never changes afterwards.
        place = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in in_chunks(texts):
                rows = []
                for doc_id, packed in zip(doc_ids[a:b], enc.encode(texts[a:b])):
                    ids = packed + end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, p, at // 4, len(cut) // 4, zlib.crc32(cut), place))
                        place += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.int64()] * 4])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "place"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECES)


class Bins:
    """Open bins by free space; finds the fullest one that a length fits in without walking over bins."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit f is set when a bin with f free exists

    def put(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.some |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        fitting = self.some >> length
        if not fitting:
            return None
        free = length + (fitting & -fitting).bit_length() - 1
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.some ^= 1 << free
        return number, free


def best_fit(lengths: np.ndarray, order: np.ndarray, bin_of: np.ndarray, loads: list[int], capacity: int) -> np.ndarray:
    """Put the pieces of `order` into the fullest bins they fit in; loads are of the bins already there."""
    bins = Bins(capacity)
    for number, load in enumerate(loads):
        if load < capacity:
            bins.put(number, capacity - load)
    count = len(loads)
    placed = []
    for length in lengths[order].tolist():
        got = bins.take(length)
        number, free = got or (count, capacity)
        count += got is None
        if free > length:
            bins.put(number, free - length)
        placed.append(number)
    bin_of[order] = placed
    return bin_of


def fitness(lengths: np.ndarray, bin_of: np.ndarray) -> tuple[int, float]:
    """Fewer bins first; of equally many, the less even filling, which leaves more room for the next crossover."""
    loads = np.bincount(bin_of, weights=lengths)
    return len(loads), -float((loads * loads).sum())


def cross(lengths: np.ndarray, order: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of `other` go into `one`; its bins that hold the same pieces dissolve; best fit again."""
    loads = np.bincount(other, weights=lengths)
    ranked = np.argsort(-loads, kind="stable")[: max(1, len(loads) // 2)]
    chosen = np.zeros(len(loads), bool)
    chosen[rng.choice(ranked, max(1, len(ranked) // 2), replace=False)] = True
    injected = chosen[other]
    old_loads = np.bincount(one, weights=lengths)
    dissolved = np.zeros(len(old_loads), bool)
    dissolved[one[injected]] = True
    # Some of the emptiest bins dissolve too, which is what lets their number fall.
    dissolved[np.argsort(old_loads, kind="stable")[: max(1, len(old_loads) // 20)]] = True
    kept = ~injected & ~dissolved[one]

    child = np.full(len(one), -1)
    _, child[injected] = np.unique(other[injected], return_inverse=True)
    first = int(child.max()) + 1
    if kept.any():
        _, place = np.unique(one[kept], return_inverse=True)
        child[kept] = place + first
    there = child >= 0
    filled = np.bincount(child[there], weights=lengths[there]).astype(int).tolist()
    return best_fit(lengths, order[~there[order]], child, filled, capacity)


def evolve(lengths: np.ndarray, start: list[np.ndarray], capacity: int, rng: np.random.Generator, crossovers: int, population: int) -> np.ndarray:
    """Best solution after some crossovers, from `start`, best-fit decreasing and noisy variants of its order."""
    order = np.argsort(-lengths, kind="stable")
    people = [*start, best_fit(lengths, order, np.zeros(len(lengths), int), [], capacity)]
    while len(people) < population:
        noisy = np.argsort(-lengths * rng.uniform(0.85, 1.0, len(lengths)), kind="stable")
        people.append(best_fit(lengths, noisy, np.zeros(len(lengths), int), [], capacity))
    scored = sorted(((fitness(lengths, p), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    least = -(-int(lengths.sum()) // capacity)
    for i in range(crossovers):
        if scored[0][0][0] <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = cross(lengths, order, scored[a][2], scored[b][2], capacity, rng)
        scored = sorted([*scored, (fitness(lengths, child), len(people) + i, child)], key=lambda x: x[:2])[: len(people)]
    return scored[0][2]


def _block_order(pieces: pa.Table) -> pa.Table:
    return pieces.sort_by([("length", "descending"), ("place", "ascending")])


def _epoch(pieces: DataFrame, elites: DataFrame | None, epoch: int, capacity: int) -> DataFrame:
    """block, island, bins, emptiness, bin_of (by descending length and place) of each island's best."""
    schema = "block bigint, island int, bins bigint, spread double, bin_of array<int>"

    def solve(key, rows: pa.Table, given: list[np.ndarray]) -> pa.Table:
        block, island = (k.as_py() for k in key)
        lengths = _block_order(rows).column("length").to_numpy()
        rng = np.random.default_rng([block, island, epoch])
        best = evolve(lengths, given, capacity, rng, CROSSOVERS, POPULATION)
        bins, spread = fitness(lengths, best)
        return pa.table(
            {
                "block": pa.array([block], pa.int64()),
                "island": pa.array([island], pa.int32()),
                "bins": pa.array([bins], pa.int64()),
                "spread": pa.array([spread]),
                "bin_of": pa.array([best.astype(np.int32)], pa.list_(pa.int32())),
            }
        )

    spread = pieces.select("block", "place", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    grouped = spread.groupBy("block", "island")
    if elites is None:
        return grouped.applyInArrow(lambda key, rows: solve(key, rows, []), schema)
    # Each island goes on with its own best and takes in its neighbour's.
    moved = elites.select(
        "block", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"), "bins", "spread", "bin_of"
    )

    def resume(key, rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("bins", "ascending"), ("spread", "ascending")])
        return solve(key, rows, [np.array(b, int) for b in own.column("bin_of").to_pylist()])

    return grouped.cogroup(moved.groupBy("block", "island")).applyInArrow(resume, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for every row of pieces(place, length, ...), which must be stored.

    Full pieces are sequences of their own. The others go into blocks by a hash of their unique place, of BLOCK_PIECES on
    average whatever the number of rows, so no group grows with the data or with a hot document; each block is packed by
    ISLANDS islands over EPOCHS epochs with elite migration in between, stored after each.
    """
    full = pieces.filter(F.col("length") >= capacity)
    loose = pieces.filter(F.col("length") < capacity)
    blocks = -(-loose.count() // BLOCK_PIECES) or 1
    loose = loose.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    elites = None
    for epoch in range(EPOCHS):
        elites = store(_epoch(loose, elites, epoch, capacity), f"elites-{epoch}")
    nth = F.row_number().over(Window.partitionBy("block").orderBy("bins", "spread", "island"))
    best = elites.withColumn("nth", nth).filter("nth = 1").select("block", "bin_of")

    schema = f"{PIECES}, sequence_id bigint, offset bigint"

    def lay(key, rows: pa.Table, winner: pa.Table) -> pa.Table:
        rows = _block_order(rows.drop_columns(["block"]))
        bin_of = np.array(winner.column("bin_of")[0].as_py(), np.int64)
        lengths = rows.column("length").to_numpy()
        order = np.argsort(bin_of, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], np.diff(bin_of[order]) > 0])
        base = np.maximum.accumulate(np.where(first, before, 0))
        offset = np.empty(len(order), np.int64)
        offset[order] = before - base
        number = key[0].as_py() * (1 << 32) + bin_of
        return rows.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    laid = loose.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(lay, schema)
    # Numbers of full pieces are negative, those of the blocks are not.
    alone = full.withColumns({"sequence_id": -1 - F.col("place"), "offset": F.lit(0).cast("bigint")})
    return laid.unionByName(alone.select(*laid.columns))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for documents(doc_id, text).

    Null and empty texts are the end id alone. Rows that repeat an id are documents of their own, and a null id stays
    null. Only documents of more than `capacity` ids are cut. An empty table gives no rows; further columns are ignored.
    """
    cut = store(pieces_of(docs, tokenizer or public_tokenizers.path(TOKENIZER), capacity, end_id), "pieces")
    return pack(cut, capacity).drop("place")


def op10_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
