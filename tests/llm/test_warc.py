import gzip
import hashlib
import io

import pytest

from dqspark.llm.warc import normalise_stream, read_member, warc_round_trip
from dqspark.runtime import scratch_path

from .helpers import CLASHING

BIG = "<p>é</p>" * 300
SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/", BIG),
    (2, "http://b/", BIG),
    (3, None, BIG),
    (4, "http://c/\r\nX-Injected: 1", "small"),
    (5, "http://d/", "small"),
    (6, "http://e/", None),
    (7, "http://f/", ""),
    (8, "http://g/", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"),
    (None, "http://h/", BIG),
    (9, "http://é/", "x" * 3_000_000),
    (10, "http://i/", "y" * 1000),
    (11, "http://j/", "y" * 1000),
    (12, "http://k/", "z" * 999),
    (13, "http://l/", "z" * 999),
    (11, "http://j/", "y" * 1000),
]


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        keeper = max(same, default=None) if len(data) >= 1000 else page
        again = keeper is not None and page != keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in CLASHING])
    got = [tuple(r)[:5] for r in warc_round_trip(df.repartition(3), scratch_path(spark, "w")).collect()]
    assert sorted(got, key=repr) == sorted(brute(ROWS), key=repr)


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA), scratch_path(spark, "w")).count() == 0


def record(payload: bytes, kind="response") -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Payload-Digest: sha1:?\r\nWARC-Target-URI: u\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


PAYLOADS = [b"a", b"", b"\r\n\r\nWARC/1.0", b"q" * 2_500_000, b"end"]


@pytest.mark.parametrize("cut", [1, 2, 5], ids=["single stream", "two members", "member per record"])
def test_normaliser_takes_any_members(cut):
    raw = [record(p) for p in PAYLOADS]
    size = -(-len(raw) // cut)
    data = b"".join(gzip.compress(b"".join(raw[i : i + size])) for i in range(0, len(raw), size))
    out, places = io.BytesIO(), []
    normalise_stream(io.BytesIO(data), out, lambda at, n, h: places.append((at, n)))
    written = out.getvalue()
    assert [gzip.decompress(written[at : at + n]) for at, n in places] == raw
    assert sum(n for _, n in places) == len(written)
    assert [read_member(written[at : at + n])["payload_bytes"] for at, n in places] == list(map(len, PAYLOADS))


def test_normaliser_refuses_half_archives():
    data = gzip.compress(b"".join(record(p) for p in PAYLOADS))
    with pytest.raises(ValueError):
        normalise_stream(io.BytesIO(data[: len(data) // 2]), io.BytesIO(), lambda *a: None)
    with pytest.raises(ValueError):
        normalise_stream(io.BytesIO(gzip.compress(b"no archive\r\n\r\n")), io.BytesIO(), lambda *a: None)
    normalise_stream(io.BytesIO(b""), io.BytesIO(), lambda *a: None)
