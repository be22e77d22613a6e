"""WARC archives: write pages, split monolithic gzip streams into one member per record with an offset index, read back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import small_side, store
from dqspark.llm.files import one_task_each, read_random, read_stream, replacing
from dqspark.runtime import scratch_path

REVISIT_BYTES = 1000
LEVEL = 3
CHUNK = 1 << 20
# The tables hold no time of capture, and a repeated task must write the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def page_records(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to: what each page's record will be.

    Payloads of min_bytes or more that several pages share are stored once, by the largest page_id. Only these shared
    digests, folded per task before the shuffle, meet the pages again. A null page_id refers to any other; if all ids of
    a payload are null, all are responses, as are rows that repeat the largest id.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = rows.withColumns(
        {
            "payload_bytes": F.octet_length("html").cast("bigint"),
            "payload_digest": F.sha1("html"),
            "_same": F.sha2("html", 256),
        }
    )
    shared = store(
        keyed.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("_same")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("_same", "keeper"),
        "shared-payloads",
    )
    joined = keyed.join(small_side(shared), "_same", "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("keeper")).alias("refers_to"),
    )


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but tells its size and digest."""
    payload = page["html"].encode()
    uri = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in page["url"] or "")
    revisit = page["record_type"] == "revisit"
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    )
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: {_urn(page['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{page['payload_digest']}",
        f"X-Page-Id: {'' if page['page_id'] is None else page['page_id']}",
        f"X-Payload-Length: {page['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {_urn(page['refers_to'])}",
            f"X-Refers-To-Page: {page['refers_to']}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One monolithic archive per task: all records in a single gzip stream, as some crawlers leave them. Gives paths."""

    def write(batches):
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        path = f"{folder}/mono-{TaskContext.get().partitionId():07d}.warc.gz"
        with replacing(path) as out:
            gz = zlib.compressobj(1, zlib.DEFLATED, 31)
            while batch is not None:
                for page in _rows(batch):
                    out.write(gz.compress(record_bytes(page)))
                batch = next(batches, None)
            out.write(gz.flush())
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return store(records.mapInArrow(write, "path string"), "archives")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Row by row, so that only one page is a Python object at a time."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        yield {name: c[i].as_py() for name, c in columns.items()}


class Inflater:
    """Plain bytes of a gzip file of one or many members, a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.gz = stream, zlib.decompressobj(31)
        self.held = self.rest = b""
        self.inside = False

    def _more(self) -> bool:
        while True:
            if self.gz.eof:
                self.rest = self.gz.unused_data + self.rest
                self.gz = zlib.decompressobj(31)
                if not self.rest and not (data := self.stream.read(CHUNK)):
                    return False
                self.rest = self.rest or data
            data = self.rest or self.stream.read(CHUNK)
            self.rest = b""
            if not data:
                if self.inside:
                    raise ValueError("the gzip stream ends within a member")
                return False
            self.inside = True
            # Bounded output: what is not inflated yet waits in unconsumed_tail.
            plain = self.gz.decompress(data, CHUNK)
            # After a member's end the rest of the input is in unused_data.
            self.rest = b"" if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.inside = False
            if plain:
                self.held += plain
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed over; None at the end."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def chunks(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def normalise_stream(stream, out, note: Callable[[int, int, dict], None]) -> None:
    """Inflate once; write every record as a gzip member of its own; note(offset, length, header) each."""
    source, at = Inflater(stream), 0
    while True:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        head = head.lstrip(b"\r\n")
        header = parse_header(head)
        gz, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        size += out.write(data := gz.compress(head + b"\r\n\r\n")) or len(data)
        for part in source.chunks(int(header["content-length"]) + 4):
            size += out.write(data := gz.compress(part)) or len(data)
        size += out.write(data := gz.flush()) or len(data)
        note(at, size, header)
        at += size


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rewrite each archive beside itself as `norm-*` with a sidecar `.idx` of "offset length type record-id" lines."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = path.replace("/mono-", "/norm-")
                lines = []
                with read_stream(path) as stream, replacing(target) as out:
                    normalise_stream(
                        stream, out, lambda at, n, h: lines.append(f"{at} {n} {h.get('warc-type')} {h.get('warc-record-id')}\n")
                    )
                with replacing(f"{target}.idx") as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"path": [target]})

    spark = archives.sparkSession
    paths = sorted(r["path"] for r in archives.collect())
    return store(one_task_each(spark, [(p,) for p in paths], "path string").mapInArrow(run, "path string"), "normalised")


SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
    ]
)


def read_member(data: bytes) -> dict:
    """One record's row; size and digest of a response come from its payload."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    header = parse_header(head)
    _, _, payload = rest[: int(header["content-length"])].partition(b"\r\n\r\n")
    revisit = header["warc-type"] == "revisit"
    number = lambda key: int(header[key]) if header.get(key) else None
    return {
        "page_id": number("x-page-id"),
        "payload_bytes": number("x-payload-length") if revisit else len(payload),
        "payload_digest": header["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": header["warc-type"],
        "refers_to": number("x-refers-to-page"),
        "target_uri": header["warc-target-uri"],
    }


def read_archives(normalised: DataFrame) -> DataFrame:
    """A row per record, each fetched by its place in the sidecar index."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with read_stream(f"{path}.idx") as f:
                    places = [tuple(map(int, x.split()[:2])) for x in f.read().decode().splitlines()]
                with read_random(path) as f:
                    for i in range(0, len(places), 5000):
                        rows = [read_member(f.read_at(n, at)) for at, n in places[i : i + 5000]]
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    spark = normalised.sparkSession
    paths = sorted(r["path"] for r in normalised.collect())
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"
    return one_task_each(spark, [(p,) for p in paths], "path string").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Archive pages(page_id, url, html) under `folder`, normalise the archives, read the records back.

    Null html is an empty payload, a null url an empty target. Rows that repeat a page are records of their own. An empty
    table gives no archive and no row; further columns are ignored.
    """
    return read_archives(normalise_archives(write_archives(page_records(pages), folder)))


def op9_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_round_trip(pages, scratch_path(spark, "warc")).drop("target_uri")


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM (SELECT *, CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS keeper
      FROM pages)
"""
