import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dqspark.llm.token_files import BLOCK_IDS, ShardWriter, read_shard, token_files
from dqspark.llm.tokens import Encoder
from dqspark.runtime import scratch_path

from .helpers import frame, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The quick, brown fox's tail -- isn't it?",
    "THE END. The end! the end",
    "Ééçà J\u030c j\u030c T\u0308 ΣΑΣ İstanbul straße",
    "x<|endoftext|>y <|ENDOFTEXT|> <|",
    "a\u00a0b\u2003c\u0085d\x1ce",
    "123 4,5.6 '' 'll don't 'tis abc'",
    "日本語 テキスト emoji 😀👍🏽 e\u0301\u0323",
    "word" * 30_000,
    "tail...)( \t\n\x0b\x0c\r next",
    "=\u0338 a\u0338 \u0301 b",
]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_memo_gives_the_library_ids():
    e = Encoder(PATH)
    assert e.by_word
    assert e.encode(TEXTS) == plain(TEXTS)
    # Once more from the memo, and with other neighbours.
    assert e.encode(TEXTS[::-1]) == plain(TEXTS[::-1])


def test_other_tokenizers_take_the_plain_way():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.encode(TEXTS[:3]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in TEXTS[:3]]


def test_shard_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate([0, 1, 5, BLOCK_IDS, 3 * BLOCK_IDS + 1, 17])]
    docs.append((9, np.array([2**32 - 1, 0], "<u4")))
    with open(tmp_path / "f", "wb") as out:
        w = ShardWriter(out)
        for d in docs:
            w.add(*d)
        w.close()
    start = 0
    for (doc_id, ids), (got_id, got_start, got) in zip(docs, read_shard(str(tmp_path / "f")), strict=True):
        assert (got_id, got_start) == (doc_id, start) and (got == ids).all()
        start += len(ids)


def test_files_against_the_library(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 3)] + [(1, None), (2, ""), (4, "same"), (4, "same"), (None, "no id"), (-5, "minus")]
    df = with_clashes(frame(spark, rows)).repartition(5)
    got = token_files(df, scratch_path(spark, "t")).collect()
    ids = [np.append(np.frombuffer(b, "<u4"), 2).astype("<u4") for b in plain([t or "" for _, t in rows])]
    expected = sorted((d is not None, d or 0, d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids))
    in_order = sorted(got, key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in in_order] == [e[2:] for e in expected]
    before = 0
    for r in in_order:
        assert r["start"] == before
        before += r["n_tokens"]


def test_empty_table(spark):
    assert token_files(frame(spark, []), scratch_path(spark, "t")).count() == 0
