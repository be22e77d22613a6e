"""The operators on streams: windows with watermarks, quarantine, freshness, lineage, micro-batch analysis."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from dqspark.functions.columns import minutes_between, nan_to_null, q
from dqspark.operators.contract import bad_values, flag_rows
from dqspark.operators.rule_spec import rule_columns
from dqspark.plans.analyze import Analysis
from dqspark.sources.lineage_events import event_edges, valid_event
from dqspark.types import kind_of


def _timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need."""
    return stream.withColumn("_time", q(ts).cast("timestamp")).withWatermark("_time", watermark)


def _window(interval: str) -> Column:
    return F.window("_time", interval).alias("w")


def _bounds() -> list[Column]:
    return [
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
    ]


def stream_profile(
    stream: DataFrame, ts: str, interval: str, watermark: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per window and column: row_count, null_ratio and, for numbers, mean, stddev, min, max.

    State holds one partial aggregate per open window; late rows are dropped by the engine and counted by `LateRows`.
    In update mode every window is given, the last open one too, and `newest_rows` reads the final values.
    """
    names = [c for c in (columns or stream.columns) if c != ts]
    clean = nan_to_null(stream, names)
    aggregates, entries = [F.count(F.lit(1)).alias("n")], []
    for i, name in enumerate(names):
        aggregates.append(F.count(q(name)).alias(f"k{i}"))
        numeric = kind_of(stream.schema[name].dataType) == "numeric"
        number = q(name).cast("double")
        if numeric:
            aggregates += [
                F.avg(number).alias(f"a{i}"),
                F.stddev_pop(number).alias(f"s{i}"),
                F.min(number).alias(f"l{i}"),
                F.max(number).alias(f"h{i}"),
            ]

        def value(prefix: str, numeric=numeric, i=i) -> Column:
            return F.round(F.col(f"{prefix}{i}"), 6) if numeric else F.lit(None).cast("double")

        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("n").alias("row_count"),
                F.round(1 - F.col(f"k{i}") / F.col("n"), 6).alias("null_ratio"),
                value("a").alias("mean"),
                value("s").alias("stddev"),
                value("l").alias("min"),
                value("h").alias("max"),
            )
        )
    grouped = _timed(clean, ts, watermark).groupBy(_window(interval)).agg(*aggregates)
    return grouped.select(*_bounds(), F.inline(F.array(*entries)))


class LateRows(StreamingQueryListener):
    """Counts the rows that each query drops behind its watermark, over its whole life.

    Register with `spark.streams.addListener` before the start; `of(query)` gives the count so far.
    """

    def __init__(self) -> None:
        self._dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self._dropped[key] = self._dropped.get(key, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        """Waits until the events of a finished query have arrived."""
        query._jsq.sparkSession().sparkContext().listenerBus().waitUntilEmpty(60_000)
        return self._dropped.get(str(query.id), 0)


def stream_contract(
    stream: DataFrame, contract: Mapping, ts: str, interval: str, watermark: str, references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Per window and row rule: violation counts; a rule that cannot be decided row by row is refused (see flag_rows)."""
    row_rules = contract.get("rules", [])
    flagged = flag_rows(stream, {"rules": row_rules}, references)
    names = [f"{r['type']}:{','.join(rule_columns(r))}" for r in row_rules]
    counts = [F.count_if(F.array_contains("failed_rules", n)).alias(f"c{i}") for i, n in enumerate(names)]
    grouped = _timed(flagged, ts, watermark).groupBy(_window(interval)).agg(F.count(F.lit(1)).alias("n"), *counts)
    entries = [
        F.struct(F.lit(n).alias("rule"), F.col("n").alias("row_count"), F.col(f"c{i}").alias("violations"))
        for i, n in enumerate(names)
    ]
    return grouped.select(*_bounds(), F.inline(F.array(*entries)))


#: Rules on values of several rows or of another table.
VALUE_RULES = ("uniqueness", "allowed_values", "referential_integrity")


def stream_value_rules(
    stream: DataFrame, contract: Mapping, ts: str, interval: str, watermark: str, references: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(window_start, window_end, rule, value_digest, rows, violations): the values that break a value rule in a window.

    State holds a count per open window, rule and value, so it is bounded by the watermark and a hot value is one row per
    task; reference tables are static sides. Uniqueness holds within a window: what repeats across windows is no violation.
    Values are digests, as keys are not to be shown. In update mode every window is given, the last open one too, and
    `newest_rows` over (window_start, rule, value_digest) reads the final counts. Nulls break no value rule; rows without
    time are left out. With all rows in time the counts are those of a batch check by window.
    """
    rules = {i: r for i, r in enumerate(contract.get("rules", [])) if r["type"] in VALUE_RULES}
    if not rules:
        raise ValueError("the contract has no value rule")
    windowed = _timed(nan_to_null(stream), ts, watermark).withColumn("w", F.window("_time", interval))
    names = F.create_map(*[F.lit(x) for i, r in rules.items() for x in (i, f"{r['type']}:{','.join(rule_columns(r))}")])
    return bad_values(windowed, rules, ["w"], references).select(
        *_bounds(), names[F.col("rule")].alias("rule"), F.sha2("value", 256).alias("value_digest"), F.col("freq").alias("rows"), F.col("amount").alias("violations")
    )


def value_rule_totals(found: DataFrame) -> DataFrame:
    """(window_start, rule, values, violations) of the final rows of `stream_value_rules`."""
    return found.groupBy("window_start", "rule").agg(F.count(F.lit(1)).alias("values"), F.sum("violations").alias("violations"))


def run_quarantine(
    stream: DataFrame, contract: Mapping, good_path: str, bad_path: str, checkpoint: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Rows that pass go to one table, rows that fail with their rule names to another.

    Each micro-batch overwrites its own folder, so a batch replayed after a failure is stored once.
    """
    flagged = flag_rows(stream, contract)

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two sinks, one read of the source
        good = batch.filter(F.size("failed_rules") == 0).drop("failed_rules")
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.filter(F.size("failed_rules") > 0).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        batch.unpersist()

    writer = flagged.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_freshness(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest event time per source key (update mode); state is one timestamp per key."""
    return stream.groupBy(q(key).alias("source_id")).agg(F.max(q(ts).cast("timestamp")).alias("latest"))


def freshness_status(latest: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    """(source_id, latest, lag_minutes, max_lag_minutes, late) of newest times against limits, fixed or learned."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    lag = minutes_between(now, F.col("latest"))
    return latest.join(limits, "source_id").select(
        "source_id",
        F.col("latest").cast("timestamp_ntz").alias("latest"),
        F.round(lag, 2).alias("lag_minutes"),
        "max_lag_minutes",
        (lag > F.col("max_lag_minutes")).alias("late"),
    )


def stream_lineage(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Edges of valid run events, each event (run, type) once even when it is delivered again."""
    timed = events.withColumn("_time", F.to_timestamp("eventTime")).withWatermark("_time", watermark)
    once = timed.filter(valid_event()).withColumn("_run", F.col("run.runId")).dropDuplicatesWithinWatermark(["_run", "eventType"])
    return event_edges(once)


def stream_analyze(
    stream: DataFrame,
    analyze: Callable[[DataFrame, str], Analysis],
    out: str,
    checkpoint: str,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Full analysis per micro-batch. `analyze(batch, run_id)` returns an Analysis, for instance that of `analyze_table`
    against the history read from `out`; each part is written under the batch id, so a replayed batch replaces its own."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        for name, part in analyze(batch, f"batch-{batch_id}")._asdict().items():
            if part is not None:
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The last row of each key that an update-mode drain wrote to its folders, one per batch."""
    rows = spark.read.parquet(out)
    order = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth", "batch")


def run_available_now(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain a stream into Parquet (append) or, for update and complete mode, into one folder per batch."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        writer = stream.writeStream.foreachBatch(keep)
    query = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
