import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dqspark.llm import simple8b

BY_WIDTH = st.integers(0, 64).flatmap(lambda bits: st.integers(0, 2**bits - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(BY_WIDTH, max_size=400))
def test_round_trip(values):
    v = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=1000))
def test_small_values_pack_many_to_a_word(values):
    v = np.array(values, np.uint64)
    words = simple8b.encode(v)
    assert (simple8b.decode(words, len(v)) == v).all() and len(words) <= len(v) / 30 + 6


def test_greedy_choice_is_the_longest_that_fits():
    assert len(simple8b.encode(np.zeros(240, np.uint64))) == 2
    assert len(simple8b.encode(np.full(16, 2**15 - 1, np.uint64))) == 4
    assert len(simple8b.encode(np.full(6, 2**16, np.uint64))) == 2
    # An escape costs two words.
    assert len(simple8b.encode(np.array([2**60, 1], np.uint64))) == 3


def test_raw_word_that_looks_like_an_escape():
    v = np.array([2**60, 2**63 + 5, 2**60 + 1, 3, 2**64 - 1], np.uint64)
    assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()
