"""Sources that fall silent: learned limits and alarms by timers, so a source is reported although no row of it arrives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from dqspark.functions.columns import q
from dqspark.operators.baseline import MAD_TO_SIGMA
from dqspark.runtime import broadcast_if_small

MINIMUM_GAPS = 5
MINUTE = 60_000

ALARM = "source_id string, silent_from_ms bigint, due_ms bigint, limit_minutes double"
STATE = "latest bigint, limit_ms bigint, limit_minutes double"


def learned_silence(history: DataFrame, key: str, ts: str, minimum_gaps: int = MINIMUM_GAPS) -> DataFrame:
    """(source_id, gaps, typical_minutes, limit_minutes): how long each source usually is silent, and when that is odd.

    Gaps lie between the minutes in which a source has rows, so a busy source counts as minutes and not as rows. The limit
    is the typical gap with its spread, at least twice the typical one and 15 minutes more. Sources with fewer than
    minimum_gaps gaps have no limit; rows without key or time are left out.
    """
    minutes = history.select(q(key).cast("string").alias("source_id"), F.date_trunc("minute", q(ts)).alias("minute")).dropna().distinct()
    before = F.lag("minute").over(Window.partitionBy("source_id").orderBy("minute"))
    gap = (F.unix_seconds(F.col("minute").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))) / 60
    gaps = minutes.select("source_id", gap.alias("gap")).filter("gap is not null")
    typical = gaps.groupBy("source_id").agg(F.count(F.lit(1)).alias("gaps"), F.percentile("gap", 0.5).alias("typical")).filter(F.col("gaps") >= minimum_gaps)
    spread = gaps.join(typical, "source_id").groupBy("source_id", "gaps", "typical").agg(F.percentile(F.abs(F.col("gap") - F.col("typical")), 0.5).alias("mad"))
    limit = F.greatest(F.col("typical") + 6 * MAD_TO_SIGMA * F.col("mad"), 2 * F.col("typical"), F.col("typical") + 15)
    return spread.select("source_id", "gaps", F.col("typical").alias("typical_minutes"), F.round(limit, 6).alias("limit_minutes"))


def _edges(chunks) -> tuple[list[int], tuple | None]:
    """First and last event of every minute of one source in one batch, in order: no gap longer than a minute is lost."""
    found: dict[int, list[int]] = {}
    limit = None
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        ms = np.sort(chunk["ms"].to_numpy())
        limit = (int(chunk["limit_ms"].iloc[0]), float(chunk["limit_minutes"].iloc[0]))
        minute, first = np.unique(ms // MINUTE, return_index=True)
        last = np.append(first[1:], len(ms)) - 1
        for m, a, b in zip(minute.tolist(), ms[first].tolist(), ms[last].tolist()):
            held = found.setdefault(m, [a, b])
            held[0], held[1] = min(held[0], a), max(held[1], b)
    return [t for m in sorted(found) for t in found[m]], limit


def _watch(key, chunks, state):
    source, alarms = key[0], []
    if state.hasTimedOut:
        latest, limit_ms, minutes = state.get
        # The state stays without a timer: the source is reported once and watched again when it is back.
        alarms.append((source, latest, latest + limit_ms, minutes))
        state.update((latest, 0, minutes))
    else:
        times, limit = _edges(chunks)
        latest, due_after, _ = state.get if state.exists else (None, 0, 0.0)
        limit_ms, minutes = limit
        for t in times:
            if latest is None or t > latest:
                if latest is not None and due_after and t > latest + due_after:
                    alarms.append((source, latest, latest + due_after, minutes))
                latest, due_after = t, limit_ms
        state.update((latest, due_after, minutes))
        if due_after:
            # A timer may not lie behind the watermark; one that is due already fires with the next batch.
            state.setTimeoutTimestamp(max(latest + due_after, state.getCurrentWatermarkMs() + 1))
    if alarms:
        yield pd.DataFrame(alarms, columns=["source_id", "silent_from_ms", "due_ms", "limit_minutes"])


def stream_silence(stream: DataFrame, key: str, ts: str, limits: DataFrame, watermark: str) -> DataFrame:
    """(source_id, silent_from, due, limit_minutes): one row per silence longer than the limits(source_id, limit_minutes).

    A silence ends with a later event or, if none comes, with a timer when the watermark passes the limit; so a source that
    stops is reported as long as others go on. State is one time and limit per source. Limits are read when the query
    starts, each start takes the newest. Sources without a limit, and rows without key or time, are not watched.
    """
    time = q(ts).cast("timestamp")
    timed = stream.select(q(key).cast("string").alias("source_id"), time.alias("_time")).filter("source_id is not null and _time is not null")
    known = broadcast_if_small(limits.select("source_id", "limit_minutes"))
    each = (
        timed.withWatermark("_time", watermark)
        .join(known, "source_id")
        .select("source_id", "_time", F.unix_millis("_time").alias("ms"), F.floor(F.col("limit_minutes") * MINUTE).cast("bigint").alias("limit_ms"), "limit_minutes")
    )
    alarms = each.groupBy("source_id").applyInPandasWithState(_watch, ALARM, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return alarms.select("source_id", at("silent_from_ms").alias("silent_from"), at("due_ms").alias("due"), "limit_minutes")
