import random
import re
import zlib

import numpy as np
import pytest

from dqspark.llm.components import components
from dqspark.llm.jaccard_join import Geometry, Tree, count_vector, fold, jaccard_components, jaccard_links, shingle_sets

from .helpers import frame, near_copies, with_clashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def run(df, **options):
    return sorted((tuple(r) for r in jaccard_components(df, **options).collect()), key=repr)


@pytest.mark.parametrize("k,similar,seed", [(4, (85, 100), 3), (5, (80, 100), 4), (2, (60, 100), 5)])
def test_against_brute_force(spark, k, similar, seed):
    rows = near_copies(seed, originals=40) + [(5000, None), (None, "id of none " * 9), (5001, "id of none " * 9)]
    # Near copies under one id, and beside an id that numbers of nulls could take.
    again = rows[3][1] + " " + " ".join(f"again{i}" for i in range(60))
    rows += [(7000, again), (7000, again.replace("again3 ", "")), (None, again.replace("again9 ", "")), (-1, again.replace("again8 ", "")), (7001, again)]
    got = run(with_clashes(frame(spark, rows)).repartition(7), k=k, similar=similar)
    assert got == sorted(brute(rows, k, *similar), key=repr)


def test_on_the_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert run(df, k=4, similar=(85, 100)) == sorted(brute(rows, 4, 85, 100), key=repr)


def test_large_group_of_near_copies_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr("dqspark.llm.jaccard_join.TILE", 16)
    rng = random.Random(6)
    base = words(rng, 150)
    rows = []
    for i in range(150):
        edited = list(base)
        for _ in range(rng.randrange(8)):
            edited[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    assert run(frame(spark, rows).repartition(9), k=4, similar=(85, 100)) == sorted(brute(rows, 4, 85, 100), key=repr)


def test_empty_table_and_wordless_texts(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(2, None), (1, " "), (3, "")])) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_similar_sets_share_an_address():
    rng = np.random.default_rng(3)
    for similar in ((85, 100), (80, 100), (50, 100)):
        g = Geometry(similar)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.union1d(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and g.den * both >= g.num * (len(a) + len(b) - both):
                assert np.intersect1d(g.addresses(a), g.addresses(b)).size


def test_tree_returns_all_that_the_bound_allows():
    rng = np.random.default_rng(4)
    g = Geometry((85, 100))
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[s : s + 260], int(rng.integers(150, 250)))) for s in rng.integers(0, 2000, 2500)]
    n, vectors = np.array(list(map(len, sets))), [count_vector(s) for s in sets]
    tree = Tree(n, vectors, g)
    assert len(tree.levels) > 1
    for i in range(0, 2500, 50):
        may = lambda width: np.minimum(np.stack([fold(v, width) for v in vectors]), fold(vectors[i], width)).sum(axis=1)
        bound = np.minimum(may(tree.width), may(tree.fine.shape[1]))
        assert set(tree.search(int(n[i]), vectors[i])) == set(np.flatnonzero(bound >= g.needed(int(n[i]), n)))
        true = [j for j in range(2500) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert set(true) <= set(tree.search(int(n[i]), vectors[i]))


def test_vectors_keep_large_counts():
    from dqspark.llm.jaccard_join import coordinates, read_vector

    for n in (1, 5, 300, 70_000):
        v = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        vector = count_vector(v)
        assert vector.sum() == n and len(vector) == coordinates(n)
        assert (read_vector(vector.tobytes(), n) == vector).all()
    wide = np.array([70_000] + [0] * 15, "<u4")
    assert (read_vector(wide.tobytes(), 3) == wide).all()


def test_shingle_hashes_agree_with_words():
    texts = ["a b c d e", "A  B\tC\nD\x0bE", "b c d e", "a b c", "", "é É a b c d", "x" * 70_000 + " y z w"]
    sets = shingle_sets([t.encode() for t in texts], 4)
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    assert (sets[0] == sets[1]).all() and len(np.intersect1d(sets[0], sets[2])) == 1
    together = {}
    for t, s in zip(texts, sets):
        for h in s.tolist():
            together.setdefault(h, set()).add(t)
    assert len(together) == len(set().union(*(shingles(t, 4) for t in texts)))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5000, 5000), (5001, 5000)]
    labels = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    groups = {}
    for i, label in labels.items():
        groups.setdefault(label, set()).add(i)
    assert sorted(map(len, groups.values())) == [2, 200, 301]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hash_is_not_python_hash():
    # Values must be the same in every process.
    assert zlib.crc32(shingle_sets([b"a b c d"], 4)[0].tobytes()) == zlib.crc32(shingle_sets([b"a b c d"], 4)[0].tobytes())


def brute_links(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
    return sorted(((*x, n) for x, n in zip(brute(rows, k, num, den), links)), key=repr)


@pytest.mark.parametrize("mass", [400_000, 2000])
def test_links_against_brute_force(spark, monkeypatch, mass):
    """With a small LINK_SHINGLES the group of near copies lies in many tiles."""
    monkeypatch.setattr("dqspark.llm.jaccard_join.LINK_SHINGLES", mass)
    rng = random.Random(8)
    base = words(rng, 150)
    rows = near_copies(7, originals=25) + [(5000, None), (None, "id of none " * 9), (5001, "id of none " * 9)]
    for i in range(80):
        edited = list(base)
        for _ in range(rng.randrange(8)):
            edited[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows += [(6000 + i, " ".join(edited))] * (1 + i % 2)
    # Near copies under one id and under none link like others.
    again = " ".join(f"again{i}" for i in range(60))
    rows += [(7000, again), (7000, again + " x"), (None, again + " y"), (-1, again + " z")]
    got = jaccard_links(with_clashes(frame(spark, rows)).repartition(7), k=4, similar=(85, 100)).collect()
    expected = brute_links(rows, 4, 85, 100)
    assert sorted(map(tuple, got), key=repr) == expected
    assert sum(r[3] for r in expected) == 1912


def test_links_of_few_documents(spark):
    """Two near copies and an exact one link each other; the stranger and the empty text link nothing."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " end"), (3, base), (4, "other words stand here alone"), (5, None)]
    got = jaccard_links(frame(spark, rows).repartition(3), k=4, similar=(85, 100)).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 4, 85, 100)
    assert sorted((r[0], r[3]) for r in got) == [(1, 2), (2, 2), (3, 2), (4, 0), (5, 0)]
