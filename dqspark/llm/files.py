"""Files that tasks write to the shared storage, whole or not at all, and lists of them as work for later tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any storage that pyarrow reaches by URI; a path without scheme is a local one."""
    if uri.startswith("/"):
        uri = f"file://{uri}"
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def replacing(uri: str) -> Iterator:
    """Output stream whose file appears under its name when complete, so lost or repeated attempts leave no half file."""
    store, path = locate(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    try:
        store.move(part, path)
    except OSError:
        # Another attempt of the same task was first; both write the same bytes.
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        store.delete_file(part)


def read_stream(uri: str):
    store, path = locate(uri)
    return store.open_input_stream(path, compression=None)


def read_random(uri: str):
    store, path = locate(uri)
    return store.open_input_file(path)


def one_task_each(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """One task per row; rows are file names and counts, one per file, hence no more than the tasks that wrote them."""
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, schema).repartition(len(rows))
