import random
import re

from pyspark.sql import functions as F

from dqspark.llm.decontaminate import hit_words, phrase_matches, proximity_matches

from .helpers import frame, with_clashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, length=10):
    windows = set()
    for item, text in items:
        w = split(text)
        n = min(length, len(w))
        windows |= {(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1) if n}
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for phrase, item in windows:
            n = len(phrase)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == phrase:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return out


def tables():
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, 30, 60))) for i in range(8)]
    items += [(20, "short one"), (21, None), (22, "--"), (23, "the the the the the the the the the the the"), (7, "another text of item seven with ten words in it now"), (None, "an item that has no id but still has more than ten words")]
    docs = []
    for i in range(40):
        body = words(rng, rng.randrange(0, 90), 60)
        if i % 3 == 0:
            item = split(items[i % 8][1])
            at = rng.randrange(0, 20)
            body[3:3] = item[at : at + rng.choice([9, 10, 15])]
        docs.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, "a Short: ONE here and short-one"), (103, "the " * 5000), (104, items[0][1]), (104, items[0][1]), (104, "else"), (None, items[1][1]), (105, items[-1][1]), (106, "ÉCOLE " * 12)]
    return docs, items


def digest(df):
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_dc_hits", lambda h: h["items"]))))
    rows = df.select("doc_id", "_dc_n_words", hit_words(F.col("_dc_hits")).alias("n"), F.coalesce(items, F.array().cast("array<string>")).alias("i")).collect()
    return sorted(((r[0], r[1], r[2], tuple(r[3])) for r in rows), key=repr)


def test_against_brute_force(spark):
    docs, items = tables()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert digest(phrase_matches(with_clashes(frame(spark, docs)), with_clashes(benchmark))) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    docs, items = tables()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r[2] == 0 for r in digest(phrase_matches(frame(spark, docs), none)))
    assert phrase_matches(frame(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def near_brute(docs, items, length=10, slop=3, missing=1):
    """(doc_id, window, start, missing words) over every start of every window, without an index."""
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(len(w) - length + 1):
            if len(set(w[i : i + length])) >= missing + 2:
                windows.setdefault(tuple(w[i : i + length]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = split(text)
        for phrase, named in windows.items():
            # A start this far outside leaves no two words of the window in the text.
            scored = [
                (sum(t not in w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)] for j, t in enumerate(phrase)), s)
                for s in range(-length - slop, len(w) + slop)
            ]
            gone, start = min(scored)
            if gone <= missing:
                out.append((doc_id, phrase, start, gone, tuple(sorted(str(n) for n in named if n is not None))))
    return out


def near_rows(df):
    return sorted(
        (
            (r["doc_id"], tuple(n["words"]), n["start"], n["missing"], tuple(n["items"]))
            for r in df.select("doc_id", "_dc_near").collect()
            for n in r["_dc_near"]
        ),
        key=repr,
    )


def test_proximity_finds_each_kind_of_edit(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [
        (1, item),
        (2, "alpha beta gamma x delta epsilon zeta y eta theta iota kappa"),
        (3, "kappa iota alpha then much later on and far away from all of it gamma beta delta"),
        (4, "alpha beta gamma delta epsilon zeta eta theta iota"),
        (5, "so alpha beta gamma delta other zeta eta theta iota kappa"),
        (6, "alpha gamma delta epsilon zeta eta theta iota kappa"),
        (7, "alpha beta one two delta epsilon zeta eta theta iota"),
        (8, "alpha other another delta epsilon zeta eta theta iota kappa"),
    ]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = {r[0]: r[3] for r in near_rows(proximity_matches(frame(spark, docs), benchmark))}
    assert found == {1: 0, 2: 0, 4: 1, 5: 1, 6: 1}


def test_proximity_against_brute_force(spark, monkeypatch):
    # Short chunks, so that phrases lie across their ends.
    monkeypatch.setattr("dqspark.llm.decontaminate.CHUNK", 7)
    docs, items = tables()
    rng = random.Random(5)
    for i in range(30):
        item = split(items[i % 8][1])
        at = rng.randrange(0, 18)
        edited = item[at : at + rng.choice([9, 10, 12])]
        for _ in range(rng.randrange(0, 4)):
            place = rng.randrange(len(edited))
            edited[place : place + rng.choice([0, 1, 1])] = rng.choice([[], ["unseen"], words(rng, 2, 60)])
        docs.append((200 + i, " ".join(words(rng, rng.randrange(0, 12), 60) + edited + words(rng, rng.randrange(0, 12), 60))))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(near_brute(docs, items), key=repr)
    assert len({r[0] for r in expected if r[3]}) > 10
    assert near_rows(proximity_matches(with_clashes(frame(spark, docs)), with_clashes(benchmark))) == expected


def test_proximity_on_empty_tables(spark):
    docs, items = tables()
    none = spark.createDataFrame([], "item_id bigint, text string")
    bare = proximity_matches(frame(spark, docs), none)
    assert bare.count() == len(docs) and near_rows(bare) == []
    assert proximity_matches(frame(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
