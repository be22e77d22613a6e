import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dqspark.llm import packing
from dqspark.llm.packing import best_fit, cross, evolve, fitness, pack_documents

from .helpers import frame, near_copies, with_clashes


def check(rows, docs, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc_id, text in docs:
        ids = np.append(np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4"), 0).astype("<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            expected.append((doc_id, p, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(e[3] for e in expected), [e[3] for e in expected]


DOCS = [*near_copies(), (900, None), (901, ""), (901, ""), (None, "no id"), (902, "long text " * 9000)]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_piece_once_and_few_sequences(spark, capacity):
    rows = pack_documents(with_clashes(frame(spark, DOCS)).repartition(3), capacity).collect()
    used, total, lengths = check(rows, DOCS, capacity)
    lengths = np.array(lengths)
    plain = best_fit(lengths, np.argsort(-lengths, kind="stable"), np.zeros(len(lengths), int), [], capacity)
    assert -(-total // capacity) <= used <= fitness(lengths, plain)[0]


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 40)
    rows = pack_documents(frame(spark, DOCS), 64).collect()
    check(rows, DOCS, 64)
    assert len({r["sequence_id"] >> 32 for r in rows if r["sequence_id"] >= 0}) > 3


def test_empty_table(spark):
    assert pack_documents(frame(spark, [])).count() == 0


def test_crossover_keeps_pieces_and_capacity():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 70, 500)
    order = np.argsort(-lengths, kind="stable")
    people = [best_fit(lengths, rng.permutation(500), np.zeros(500, int), [], 100) for _ in range(2)]
    for _ in range(20):
        child = cross(lengths, order, people[0], people[1], 100, rng)
        loads = np.bincount(child, weights=lengths)
        assert child.min() == 0 and (loads > 0).all() and loads.max() <= 100
        people = [people[1], child]


def test_evolution_beats_best_fit_decreasing():
    # Triples that fill a bin exactly, which best fit decreasing misses.
    rng = np.random.default_rng(8)
    lengths = []
    for _ in range(60):
        a = rng.integers(26, 48)
        b = rng.integers(26, 74 - a) if a < 47 else 26
        lengths += [a, b, 100 - a - b]
    lengths = np.array(lengths)
    order = np.argsort(-lengths, kind="stable")
    plain = fitness(lengths, best_fit(lengths, order, np.zeros(len(lengths), int), [], 100))[0]
    best = fitness(lengths, evolve(lengths, [], 100, np.random.default_rng(1), 400, 8))[0]
    assert 60 <= best < plain
