"""Token-id files: documents in id order, coded in Simple-8b blocks with an offset table, written and read by tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm import simple8b
from dqspark.llm.common import documents, store, text_or_empty
from dqspark.llm.files import one_task_each, read_random, replacing
from dqspark.llm.tokens import encoder, in_chunks
from dqspark.runtime import scratch_path

TOKENIZER = "word_bpe_49k.json"
MAGIC = b"DQTOK001"
BLOCK_IDS = 65_536
SHARD = "shard int, path string, n_docs bigint, n_tokens bigint"

# File: MAGIC, blocks of words; then the tables, each block- or document-wise: byte offset and ids of each block as
# int64 pairs, document ids as int64 with a byte that marks nulls, document lengths; the counts of both tables, MAGIC.
_TAIL = struct.Struct("<qqq8s")


class ShardWriter:
    """Takes documents in order and writes one file; holds one block of ids and the tables."""

    def __init__(self, out):
        self.out = out
        self.at = out.write(MAGIC) or len(MAGIC)
        self.blocks: list[tuple[int, int]] = []
        self.doc_ids: list[int] = []
        self.null: list[bool] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            block = ids[i : min(i + BLOCK_IDS, whole)]
            data = simple8b.encode(block).astype("<u8").tobytes()
            self.blocks.append((self.at, len(block)))
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        lengths = simple8b.encode(np.array(self.lengths, np.uint64)).astype("<u8").tobytes()
        tables = [
            np.array(self.blocks, "<i8").tobytes(),
            np.array(self.doc_ids, "<i8").tobytes(),
            np.array(self.null, "u1").tobytes(),
            lengths,
        ]
        for t in tables:
            self.out.write(t)
        self.out.write(_TAIL.pack(len(self.blocks), len(self.doc_ids), self.at, MAGIC))


def read_shard(uri: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, ids of the file before it, packed ids) of each document; decodes block by block."""
    with read_random(uri) as f:
        size = f.size()
        n_blocks, n_docs, tables, magic = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        table = f.read_at(size - _TAIL.size - tables, tables)
        blocks = np.frombuffer(table, "<i8", n_blocks * 2).reshape(-1, 2)
        at = n_blocks * 16
        doc_ids = np.frombuffer(table, "<i8", n_docs, at)
        null = np.frombuffer(table, "u1", n_docs, at + 8 * n_docs)
        lengths = simple8b.decode(np.frombuffer(table, "<u8", -1, at + 9 * n_docs), n_docs).astype(np.int64)
        ends = np.append(blocks[1:, 0], tables)
        held, block, start = np.zeros(0, "<u4"), 0, 0
        for d in range(n_docs):
            while len(held) < lengths[d]:
                offset, n = blocks[block]
                words = np.frombuffer(f.read_at(int(ends[block] - offset), int(offset)), "<u8")
                held = np.concatenate([held, simple8b.decode(words, int(n)).astype("<u4")])
                block += 1
            ids, held = held[: lengths[d]], held[lengths[d] :]
            yield (None if null[d] else int(doc_ids[d])), start, ids
            start += int(lengths[d])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of each whole text and end_id; one file per range of document ids. Returns SHARD rows.

    Documents are range-partitioned and sorted by (doc_id, text hash), so files follow each other in id order and rows
    that repeat an id spread too. A file appears when complete; a repeated task writes the same bytes.
    """

    def write(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:07d}.s8b"
        first = next(batches, None)
        if first is None:
            return
        docs_done = tokens = 0
        with replacing(path) as out:
            writer = ShardWriter(out)
            while first is not None:
                ids, texts = first.column("doc_id").to_pylist(), first.column("text").to_pylist()
                for a, b in in_chunks(texts):
                    for doc_id, packed in zip(ids[a:b], enc.encode(texts[a:b])):
                        got = np.concatenate([np.frombuffer(packed, "<u4"), end])
                        writer.add(doc_id, got)
                        docs_done += 1
                        tokens += len(got)
                first = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": path, "n_docs": docs_done, "n_tokens": tokens}],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return store(ordered.select("doc_id", "text").mapInArrow(write, SHARD), "token-shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from the files alone.

    The driver adds up one count per file, which is no more than it keeps for the tasks that wrote them.
    """
    rows, before = [], 0
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        rows.append((r["path"], before))
        before += r["n_tokens"]

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                found = []
                for doc_id, start, ids in read_shard(path):
                    found.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(found) == 20_000:
                        yield _batch(found)
                        found = []
                yield _batch(found)

    return one_task_each(shards.sparkSession, rows, "path string, base bigint").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write documents(doc_id, text) as token files under `folder` and read them back.

    Null and empty texts hold the end id alone. Null ids come first. Rows that repeat an id are documents of their own,
    ordered by a hash of their text. An empty table gives no file and no row. Further columns are ignored.
    """
    shards = write_token_files(docs, folder, tokenizer or public_tokenizers.path(TOKENIZER), end_id)
    return read_token_files(shards)


def op4_token_files(spark, sf_dir):
    return token_files(documents(spark, sf_dir), scratch_path(spark, "token-files"))
