import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dqspark.llm.divergence import Tree, source_divergence

from .helpers import DOCS, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    full = [(i, text, lang, source, 0) for i, (text, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def corpus(seed, sources=7):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ab", "cd", "É", "ñx", "語", "zz") for b in ("", "a", "bé", "Q", "𝒳")]
    rows = []
    for i in range(260):
        own = vocabulary if rng.random() < 0.5 else vocabulary[i % sources :: 3]
        text = rng.choice([" ", ", ", "\n", "9"]).join(rng.choices(own, k=rng.randrange(25)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice([f"s{i % sources}", "hot", "hot", None])))
    rows += [("once only", "xx", "a"), (None, "xx", "b"), ("", "yy", "a"), ("word " * 30_000, "en", "s1"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("seed,min_docs", [(1, 10), (2, 1), (3, 40)])
def test_against_brute_force(spark, monkeypatch, seed, min_docs):
    monkeypatch.setattr("dqspark.llm.divergence.TREE_ITEMS", 20)
    rows = corpus(seed)
    found = source_divergence(with_clashes(frame(spark, rows)).repartition(5), min_docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, min_docs)


def test_languages_without_kept_terms_have_pairs_of_zero(spark):
    rows = [("a b", "en", "x"), (None, "en", "y"), ("", None, None)]
    assert sorted(map(tuple, source_divergence(frame(spark, rows)).collect())) == [
        ("en", "x", "pair", "y", 0, 1),
        ("en", "y", "pair", "x", 0, 1),
    ]
    assert source_divergence(frame(spark, rows).limit(0)).collect() == []


def test_tree_shares_paths():
    rows = [("en", [(1, 5), (2, 7)], 3), ("en", [(1, 5), (2, 7), (4, 1)], 2), ("en", [(1, 5), (3, 7)], 1), ("en", [(1, 6), (3, 7)], 1), ("fr", [(1, 6), (3, 7)], 4)]
    langs = np.array([r[0] == "fr" for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r[1]], np.int64)
    tree = Tree(langs, np.array([len(r[1]) for r in rows]), np.array([r[2] for r in rows]), flat[:, 0], flat[:, 1], np.ones(len(flat), np.int64))
    nodes = sorted(zip(tree.lang.tolist(), tree.place.tolist(), tree.p.tolist(), tree.times.tolist(), tree.parent.tolist()))
    assert [n[:4] for n in nodes] == [
        (0, 1, 5, 6), (0, 1, 6, 1), (0, 2, 7, 5), (0, 3, 7, 1), (0, 3, 7, 1), (0, 4, 1, 2), (1, 1, 6, 4), (1, 3, 7, 4)
    ]
    # Each node meets each of its ancestors once: four at the second level, one at the third with two ancestors.
    assert sum(len(level[0]) for level in tree.pairs()) == 6
