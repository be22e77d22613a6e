"""Helpers shared by the operators on training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.runtime import scratch_path

# The white space of the data contracts.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
#: Bytes of an Arrow batch to and from Python. Rows are whole texts, so the session's bound on rows alone lets batches grow.
ARROW_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast built-in, which agrees there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def pieces(batches, rows: int = 500):
    """Arrow batches in small slices, so that a task holds few texts as Python objects, however long its batches are."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds outside the heap; a session that already has a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).lower().removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the plan, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete a stored frame that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        context = stored.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(stored: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when rows and bytes of a stored frame are proven small; otherwise the join shuffles."""
    payload = sum(
        (F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in stored.schema.fields), F.lit(16)
    )
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(payload), F.lit(0))).first()
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored
