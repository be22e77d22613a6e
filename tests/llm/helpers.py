"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Columns named like those that operators make for themselves.
CLASHING = ["pos", "line", "key", "hash", "digest", "rank", "body", "h", "words", "term", "place", "node", "start", "window_id", "text_hash"]


def frame(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=3, originals=25, copies=6):
    """Texts of many lengths with copies that differ in a few words, shared passages, and hubs linked only by chains."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = []
    for o in range(originals):
        base = words(rng, rng.choice([3, 4, 5, 8, 20, 60, 200, 900]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            edited = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            texts.append((" " if rng.random() < 0.5 else "\t").join(edited))
        if o % 4 == 0:
            at = rng.randrange(len(base))
            texts.append(" ".join(base[:at] + passage + base[at:]))
    chain = words(rng, 120)
    for i in range(12):
        texts.append(" ".join(chain))
        chain = list(chain)
        chain[i * 9] = f"c{i}"
    texts += ["", None, "   \n\t", "One", "one", "ONE two", "one two", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))
