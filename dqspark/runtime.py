"""Session-level helpers: lineage cuts on shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
TASK_ROWS = 500_000
TASK_BYTES = 16_000_000


def session(app: str = "dqspark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Without it every column expression records its Python call site, which dominates plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; only a local master may fall back to a private one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dqspark-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the plan; the blocks are on reliable storage, so executor loss costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared checkpoint storage for intermediate tables and stream state."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as a table on the shared storage and read back: later steps read only the columns they use, and their
    joins know its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dealt(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Jobs that run inside shuffle the counted rows into tasks of TASK_ROWS, read files in splits of TASK_BYTES and join
    small partitions up to that size only, so that what a task holds does not grow with the table. The session's settings
    are back afterwards; more shuffle partitions than counted stay."""
    parts = "spark.sql.shuffle.partitions"
    wanted = {
        parts: max(int(spark.conf.get(parts)), 1 + rows // TASK_ROWS),
        "spark.sql.files.maxPartitionBytes": TASK_BYTES,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's intermediate tables and stream states. Call it when results that read them are written."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after rows and bytes are proven small; otherwise the join shuffles.

    Call it on materialized or cheap frames. Bytes are those of the values as text, measured only within the row bound.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    width = F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns])))
    size = df.agg(F.sum(F.coalesce(width, F.lit(0)) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
