import random

import numpy as np
import pytest

from dqspark.llm.jaccard_join import shingle_sets
from dqspark.llm.minhash_dedup import BAND, HALVES, bitmap, halve, may_link, minhashes, near_duplicates, table_keys

from .helpers import frame, near_copies, with_clashes, words
from .test_jaccard_join import brute


def run(df, **options):
    return sorted((tuple(r) for r in near_duplicates(df, **options).collect()), key=repr)


def expected(rows, k, num, den):
    return sorted(((*r, r[0] == r[2]) for r in brute(rows, k, num, den)), key=repr)


@pytest.mark.parametrize("k,similar,seed", [(2, (80, 100), 3), (5, (80, 100), 4), (3, (90, 100), 5)])
def test_against_brute_force(spark, k, similar, seed):
    rows = near_copies(seed, originals=40) + [(5000, None), (None, "id of none " * 9), (5001, "id of none " * 9), (None, None)]
    again = " ".join(f"again{i}" for i in range(60))
    rows += [(7000, again), (7000, again + " x"), (None, again + " y"), (-1, again + " z"), (9, "x " * 50_000)]
    assert run(with_clashes(frame(spark, rows)).repartition(7), k=k, similar=similar) == expected(rows, k, *similar)


def test_large_group_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr("dqspark.llm.minhash_dedup.TILE", 16)
    rng = random.Random(6)
    base = words(rng, 150)
    rows = []
    for i in range(150):
        edited = list(base)
        for _ in range(rng.randrange(26)):
            edited[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    assert run(frame(spark, rows).repartition(9), k=2) == expected(rows, 2, 80, 100)


def test_empty_table_and_wordless_texts(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(2, None), (1, " "), (3, "")])) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def pair_of(rng, n, similarity):
    """Two sets of about n hashes whose similarity is the next possible value from `similarity` on."""
    both = int(np.ceil(2 * n * similarity / (1 + similarity)))
    v = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
    return np.sort(v[:n]), np.sort(np.concatenate([v[: both], v[n:]]))


def test_keys_of_similar_sets_meet_as_often_as_stated():
    rng = np.random.default_rng(1)
    for similarity, at_least, at_most in ((0.8, 0.997, 1), (0.3, 0.0, 0.35), (0.1, 0.0, 0.02)):
        sets = [s for _ in range(1500) for s in pair_of(rng, 100, similarity)]
        keys = table_keys(minhashes(sets, 2 * HALVES * BAND))
        assert keys.shape == (3000, HALVES * HALVES)
        met = np.mean([bool(np.intersect1d(keys[i], keys[i + 1]).size) for i in range(0, 3000, 2)])
        assert at_least <= met <= at_most


def test_minhashes_estimate_the_similarity():
    rng = np.random.default_rng(2)
    sets = [s for _ in range(300) for s in pair_of(rng, 80, 0.7)]
    least = minhashes(sets, 96)
    assert abs((least[::2] == least[1::2]).mean() - 0.7) < 0.01


def test_bitmaps_lose_no_link_and_reject_most_others():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 300, 9000):
        for similarity in (0.8, 0.9, 1.0):
            a, b = pair_of(rng, n, similarity)
            wa, wb = bitmap(a), bitmap(b)
            size = min(len(wa), len(wb))
            assert may_link(len(a), halve(wa, size), np.array([len(b)]), halve(wb, size)[None], (80, 100)).all()
            assert may_link(len(a), halve(wa, 1), np.array([len(b)]), halve(wb, 1)[None], (80, 100)).all()
    a, b = pair_of(rng, 300, 0.7)
    assert not may_link(300, bitmap(a), np.array([300]), bitmap(b)[None], (80, 100)).any()


def test_short_texts_are_one_shingle():
    assert [len(s) for s in shingle_sets([b"one", b"one two", b"one two three"], 2)] == [1, 1, 2]
