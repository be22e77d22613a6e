import numpy as np
import pytest

from dqspark.llm.whitening import chebyshev, eigenpairs, op12_whitening, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0) for i, v in rows], SCHEMA)


def brute(x, k=16):
    """Fit list, and eigenpairs of its covariance by a dense solver."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(c) for c in zip(*fit.tolist())]
    c = fit - np.array(sums) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(c.T @ c / n)


def check(rows, vectors, k=16, tolerance=1e-8):
    """rows of the query against the dense solver; signs are free."""
    x = np.floor(64 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums, values, axes, trace = brute(x, k)
    assert len(rows) == len(vectors) * k
    white = {(r["vec_id"], r["component"]): r for r in rows}
    got = np.array([[white[i, j + 1]["whitened"] for j in range(k)] for i in range(len(vectors))])
    expected = (x - np.array(sums) / n) @ axes / np.sqrt(values)
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * signs).max() < tolerance
    for i in range(len(vectors)):
        r = white[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums))
    for j in range(k):
        assert abs(white[0, j + 1]["explained"] - values[j] / trace) < 1e-10
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-8


def query(spark, tmp_path, rows):
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return op12_whitening(spark, str(tmp_path)).collect()


def test_query_against_a_dense_solver(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in df] == list(range(len(df)))
    check(op12_whitening(spark, "/root/testdata/sf0.001").collect(), np.array([r["embedding"] for r in df]))


def test_copies_count_once_and_unsound_rows_go(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(0, [3, 2, 1.5, 1, 0.9, 0.8] + [0.5] * 18, (300, 24))
    v[100:250] = v[0]  # a hot vector
    rows = list(enumerate(v)) + [
        (900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0, 2.0]),
    ]
    check(query(spark, tmp_path, rows), v)


def test_null_ids_repeats_and_clashing_columns(spark):
    v = np.random.default_rng(2).normal(0, 1, (40, 3))
    rows = [(None, v[0]), (None, v[0]), (1, v[0]), *((i, x) for i, x in enumerate(v[1:], 2))]
    df = frame(spark, rows).selectExpr("*", "'y' as x", "'c' as c", "1 as cell", "2 as n", "3 as deviation")
    found = whiten(df).collect()
    assert len(found) == len(rows) and sum(r["vec_id"] is None for r in found) == 2
    same = [r["whitened"] for r in found if r["vec_id"] in (None, 1)]
    assert same[0] == same[1] == same[2] and len(same[0]) == 3 and found[0]["n"] == 40


def test_components_without_variance_are_left_out(spark):
    flat = [(i, [i % 5, 2.0 * (i % 5), 7.0]) for i in range(20)]
    found = whiten(frame(spark, flat)).collect()
    assert {len(r["whitened"]) for r in found} == {1} and found[0]["n"] == 5 and abs(found[0]["explained"][0] - 1) < 1e-12
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None)])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [1e12, 5.0]), (3, [0.0, 9.0])]
    found = {r["vec_id"]: r for r in whiten(frame(spark, rows)).collect()}
    held = 1 << 50
    x = [[min(held, max(-held, int(64 * float(np.float32(c))))) + 10**6 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        assert int(found[i]["deviation"]) == sum((4 * a - s) ** 2 for a, s in zip(v, sums))


@pytest.mark.parametrize("spectrum", ["flat", "steep", "low rank", "pairs"])
def test_eigenpairs(spectrum):
    rng = np.random.default_rng(11)
    d = 90
    values = {
        "flat": np.linspace(100, 60, d), "steep": 10.0 ** -np.linspace(0, 14, d),
        "low rank": np.array([5.0, 4, 3] + [0] * (d - 3)), "pairs": np.repeat(np.linspace(9, 1, d // 2), 2),
    }[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    a = (q * values) @ q.T
    passes = []

    def apply(block):
        passes.append(block.shape[1])
        return a @ block

    found, axes = eigenpairs(apply, d, 16)
    assert np.abs(found - values[:16]).max() < 1e-12 * values[0]
    assert np.abs(a @ axes - axes * found).max() < 1e-11 * values[0] and np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12
    assert len(passes) < 400


def test_chebyshev_damps_below_the_cut():
    values = np.array([10.0, 5.0, 1.0, 0.7, 0.2, 0.0])
    filtered = chebyshev(lambda b: values[:, None] * b, np.eye(6), np.diag(values), 1.0, 10.0, 8)
    gain = np.abs(np.diag(filtered))
    assert abs(gain[0] - 1) < 1e-12 and gain[1] > 100 * gain[2:].max()
