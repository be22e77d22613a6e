"""Simple-8b: 64-bit words whose upper four bits select how many integers of which width the other sixty hold."""

from __future__ import annotations

import numpy as np

# Fixed values: (integers, bits) by selector. Selector 0, in the published code 240 zeros, is the escape here: the next
# word is one integer of more than 60 bits.
SELECTORS = (
    (1, 64),
    (120, 0),
    (60, 1),
    (30, 2),
    (20, 3),
    (15, 4),
    (12, 5),
    (10, 6),
    (8, 7),
    (7, 8),
    (6, 10),
    (5, 12),
    (4, 15),
    (3, 20),
    (2, 30),
    (1, 60),
)
_COUNT = np.array([c for c, _ in SELECTORS])
_LONGEST = int(_COUNT.max())


def encode(values: np.ndarray) -> np.ndarray:
    """Words for a block of integers; each word takes as many as fit, the last is filled with zeros."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.zeros(n + _LONGEST, np.uint64)
    padded[:n] = v
    bits = np.zeros(n + _LONGEST, np.int8)
    bits[:n] = np.frexp(v.astype(np.float64))[1]

    choice = np.zeros(n, np.int8)
    widest = bits[:n].copy()
    fits = {count: (s, width) for s, (count, width) in enumerate(SELECTORS) if s}
    narrow = int(bits[:n].min())
    for count in range(1, _LONGEST + 1):
        if count > 1:
            np.maximum(widest, bits[count - 1 : count - 1 + n], out=widest)
        if count in fits:
            s, width = fits[count]
            choice[widest <= width] = s
            if width < narrow:
                break
    step = _COUNT[choice].tolist()
    at, i = [], 0
    put = at.append
    while i < n:
        put(i)
        i += step[i]

    at = np.array(at)
    chosen = choice[at]
    # An escape takes two words.
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(len(at) + int((chosen == 0).sum()), np.uint64)
    for s in np.unique(chosen):
        here, to = at[chosen == s], place[chosen == s]
        if s == 0:
            words[to + 1] = padded[here]
            continue
        count, width = SELECTORS[s]
        packed = np.full(len(here), np.uint64(s) << np.uint64(60))
        if width:
            shifts = (np.arange(count) * width).astype(np.uint64)
            packed |= np.bitwise_or.reduce(padded[here[:, None] + np.arange(count)] << shifts, axis=1)
        words[to] = packed
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n integers of a block."""
    w = np.asarray(words, np.uint64)
    selector = (w >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(w), bool)
    if (selector == 0).any():
        # A word after an escape is a raw value, whatever its upper bits say.
        i = 0
        for e in np.flatnonzero(selector == 0).tolist():
            if e >= i:
                raw[e + 1] = True
                i = e + 2
    head = np.flatnonzero(~raw)
    chosen = selector[head]
    counts = _COUNT[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in np.unique(chosen):
        here, to = head[chosen == s], starts[chosen == s]
        count, width = SELECTORS[s]
        if s == 0:
            out[to] = w[here + 1]
        elif width:
            shifts = (np.arange(count) * width).astype(np.uint64)
            out[to[:, None] + np.arange(count)] = (w[here, None] >> shifts) & np.uint64((1 << width) - 1)
    return out[:n]
