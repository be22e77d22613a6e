"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed products with the covariance.

The covariance is never formed. A product of it with a narrow block Q is one pass over the distinct vectors, Xᵀ(XQ) with
centred rows, summed over tasks; only dimensions x block numbers reach the driver. A Chebyshev polynomial of such products
damps the part of the spectrum below the block; QR and Rayleigh-Ritz turn what is left into eigenpairs, until their
residuals certify them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import store

# Fixed values of the contract's whole-number vectors.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this size of 64 * c are held at it, so that whole numbers stay exact.
LARGEST = float(1 << 50)
#: A residual is certified at this share of the largest eigenvalue, or once it stops falling below ROUNDING of it.
RESIDUAL, ROUNDING = 2e-14, 1e-11
#: Eigenvalues under this share of the largest are rounding of 0: nothing varies there, so nothing can be whitened.
NO_VARIANCE = 1e-12
MAX_ROUNDS = 100


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<bigint> of the rows of vectors(vec_id, embedding) whose vector is whole and finite.

    Vectors of another length than most rows have (of equally many, the longer) have no place in the space and go too.
    """
    value = F.col("embedding").cast("array<double>")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    cell = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(SHIFT).cast("bigint")
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("c")).filter("c is not null and size(c) > 0").filter(
        F.forall("c", finite)
    )
    width = sound.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kept = sound.filter(F.size("c") == (width["width"] if width else 0))
    return kept.select("vec_id", F.transform("c", cell).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all vectors of part(block of rows), an array of `shape`: one row per cell and task is shuffled."""
    cells = int(np.prod(shape))

    def run(batches):
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(cells)
    for row in fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row["cell"]] = row["value"]
    return out.reshape(shape)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches):
        rows, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                # A batch is at most a few thousand rows of numbers under 2**51.
                held = [x[i : i + 2048].sum(axis=0, dtype=np.int64).tolist() for i in range(0, len(x), 2048)]
                rows += len(x)
                sums = [sum(c) for c in zip(*held, *([sums] if sums else []))]
        if sums:
            amounts = pa.array([rows, *sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(amounts), dtype=np.int32)), amounts], ["cell", "value"])

    found = fit.mapInArrow(run, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    by_cell = {r["cell"]: int(r["value"]) for r in found}
    return by_cell.pop(0, 0), [by_cell[i] for i in sorted(by_cell)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that suffices, whole numbers of any size otherwise."""
    largest = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0))
    kind = np.int64 if largest < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding, however far the vectors lie from the origin."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def chebyshev(apply: Callable, block: np.ndarray, product: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """The block under a polynomial of the operator that is small on [0, cut] and 1 at `top`, by three-term recurrence.

    `product` is the operator times the block, already known, so `degree` costs degree - 1 passes.
    """
    half = cut / 2
    ratio = first = half / (half - top)
    before, now = block, (product - half * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - ratio)
        before, now = now, (apply(now) - half * now) * (2 * following / half) - ratio * following * before
        ratio = following
    return now


def eigenpairs(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator without negative ones.

    The block is twice as wide as wanted. Each round its last column is a fresh random vector, so that a component that
    the start lacks cannot stay hidden, and at least two rounds must agree. Degrees follow the gap to the spectrum below.
    """
    rng = np.random.default_rng(seed)
    width = min(dims, 2 * wanted)
    wanted = min(wanted, dims)

    def ritz(block):
        q, _ = np.linalg.qr(block)
        product = apply(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        return values, q @ turn, product @ turn

    values, block, product = ritz(rng.standard_normal((dims, width)))
    worst = float("inf")
    for turn in range(MAX_ROUNDS):
        top = values[0]
        if top <= 0:
            break
        residual = float(np.linalg.norm(product - block * values, axis=0)[:wanted].max())
        settled = residual <= RESIDUAL * top or (residual <= ROUNDING * top and residual > worst / 2)
        if width == dims or (settled and turn > 1):
            break
        worst = min(worst, residual)
        cut = max(values[-1], NO_VARIANCE * top)
        growth = lambda e: float(np.arccosh(max(2 * e / cut - 1, 1)))
        slow, fast = growth(values[wanted - 1]), growth(top)
        degree = int(np.clip(np.ceil(12 / max(slow, 1e-3)), 4, 40))
        # Further growth of the first column over the last wanted one would leave the latter to rounding.
        degree = max(2, min(degree, int(25 / max(fast - slow, 1e-3))))
        filtered = chebyshev(apply, block, product, cut, top, degree)
        filtered /= np.maximum(np.linalg.norm(filtered, axis=0), 1e-300)
        filtered[:, -1] = rng.standard_normal(dims)
        values, block, product = ritz(filtered)
    else:
        raise RuntimeError(f"eigenvectors not certified after {MAX_ROUNDS} rounds: residual {residual:.1e} of {top:.1e}")
    return values[:wanted], block[:, :wanted]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation decimal(38,0), whitened, explained array<double>, identity_error for vectors(vec_id, embedding).

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are vectors of another length
    than most rows have. The covariance is of the distinct whole-number vectors, however often each occurs. Components
    without variance cannot be whitened and are left out, so there are fewer with few distinct vectors, and no rows when
    all vectors are equal. Equal eigenvalues share a plane in which any basis is right. A null id keeps its row, repeated
    rows each have one; deviations beyond 38 digits are null. An empty table gives no rows; further columns are ignored.
    """
    schema = "vec_id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = whole_numbers(vectors)
    fit = store(rows.select("x").distinct(), "distinct-vectors")
    n, sums = totals(fit)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = len(sums)

    def apply(block: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return _summed(fit, part, block.shape) / n

    trace = float(_summed(fit, lambda x: (centred(x, n, sums) ** 2).sum(axis=0), (dims,)).sum()) / n
    values, axes = eigenpairs(apply, dims, components)
    varies = values > NO_VARIANCE * max(values[0], 0)
    axes = axes[:, varies] / np.sqrt(values[varies])
    explained = (values[varies] / trace).tolist() if trace > 0 else []
    k = len(explained)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)

    def spread(x):
        w = centred(x, n, sums) @ axes
        return w.T @ w

    # The rows' deviations sum to exactly 0, so their projections are centred.
    identity_error = float(np.abs(_summed(fit, spread, (k, k)) / n - np.eye(k)).max())

    def project(batches):
        limit = 10**38
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = deviations(_matrix(batch), n, sums)
            fits = moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * dims < 1 << 63
            squares = (moved * moved).sum(axis=1) if fits else [sum(v * v for v in row) for row in moved.tolist()]
            exact = pa.array(squares).cast(pa.decimal128(38, 0)) if fits else pa.array([s if s < limit else None for s in squares], pa.decimal128(38, 0))
            white = (moved / n).astype(np.float64) @ axes
            ends = pa.array(np.arange(0, white.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), exact, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"]
            )

    out = rows.mapInArrow(project, "vec_id bigint, deviation decimal(38,0), whitened array<double>")
    return out.select(
        "vec_id",
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir):
    """One row per vector and component."""
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.col("value").alias("whitened"),
        F.expr("explained[at]").alias("explained"),
        "identity_error",
    )
