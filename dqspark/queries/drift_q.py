"""Baselines, drift, history and the composed analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import baseline as B
from dqspark.operators import drift as D
from dqspark.operators.joint import multivariate_iforest, multivariate_mahalanobis
from dqspark.operators.joint_runs import joint_by_run
from dqspark.operators.profile import profile_segments, profile_table
from dqspark.plans.analyze import Options, analyze_runs
from dqspark.queries.base import (
    MONTH_CONTRACT,
    RUNS_SQL,
    SEVERITY_SQL,
    SHRUNK,
    faulted_orders,
    month_end,
    month_profiles,
    month_runs,
    month_signals,
    month_source_runs,
    profile_sql,
    query,
    run_catalogue,
    table,
    with_previous,
    with_sql,
)
from dqspark.runtime import materialize

# ------------------------------------------------------------------ drift against the month before


def drifting_orders(spark, sf):
    """Monthly orders in which each kind of drift returns every year: missing prices in February, prices in other units in
    May, somewhat higher ones in September, few customers in November."""
    month = F.month("o_orderdate")
    price = (
        F.when((month == 2) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(None))
        .when(month == 5, F.col("o_totalprice") * 100)
        .when(month == 9, F.col("o_totalprice") * 1.5)
        .otherwise(F.col("o_totalprice"))
    )
    customer = F.when(month == 11, F.col("o_custkey") % 5).otherwise(F.col("o_custkey"))
    orders = table(spark, sf, "orders")
    return orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), price.alias("o_totalprice"), customer.alias("o_custkey"))


_DRIFT_CHAIN = f"""
WITH f AS MATERIALIZED (
  SELECT strftime(o_orderdate, '%Y-%m') AS run_id,
    CASE WHEN month(o_orderdate) = 2 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL
         WHEN month(o_orderdate) = 5 THEN o_totalprice * 100 WHEN month(o_orderdate) = 9 THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN month(o_orderdate) = 11 THEN o_custkey % 5 ELSE o_custkey END AS o_custkey
  FROM orders),
p AS MATERIALIZED ({profile_sql('f', [("o_totalprice", "numeric"), ("o_custkey", "numeric")])}),
months AS MATERIALIZED (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS base_run FROM (SELECT DISTINCT run_id FROM f)),
pair AS MATERIALIZED (
  SELECT c.run_id, c."column", c.mean, b.mean AS b_mean, c.row_count AS n, b.row_count AS b_n, c.null_ratio - b.null_ratio AS gap,
    c.distinct_ratio AS dr, b.distinct_ratio AS b_dr, (c.mean - b.mean) / CASE WHEN b.stddev > 1e-9 THEN b.stddev END AS z,
    c.row_count * (1 - c.null_ratio) AS n_c, b.row_count * (1 - b.null_ratio) AS n_b,
    abs(c.mean - b.mean) / greatest(abs(b.mean), b.stddev, 1e-9) AS shift,
    sqrt(b.stddev * b.stddev / nullif(b.row_count * (1 - b.null_ratio), 0) + c.stddev * c.stddev / nullif(c.row_count * (1 - c.null_ratio), 0)) AS se
  FROM p c JOIN months m USING (run_id) JOIN p b ON b.run_id = m.base_run AND b."column" = c."column")
"""
_DRIFT_TESTS = {
    "completeness": ("completeness", "least(1.0, 0.5 + gap)", "gap > 0.05"),
    "mean_z": ("distribution", "least(1.0, (abs(z) - 3.0) / 3.0 + 0.5)", "abs(z) >= 3"),
    "mean_se": (
        "distribution",
        "least(1.0, 0.45 + shift * 0.5)",
        "NOT coalesce(abs(z) >= 3, false) AND n_b >= 30 AND n_c >= 30 AND shift >= 0.10 AND abs(CASE WHEN se > 1e-12 THEN (mean - b_mean) / se ELSE 1e6 END) >= 6",
    ),
    "cardinality": (
        "cardinality_drift",
        "least(1.0, 0.4 + abs((dr - b_dr) / b_dr) * 0.4)",
        "b_dr * b_n > 3 AND dr * n > 3 AND b_dr > 1e-9 AND abs((dr - b_dr) / b_dr) >= 0.5",
    ),
}


def _drift(spark, sf, test):
    profiles = materialize(profile_table(drifting_orders(spark, sf), ["run_id"], parts=("distinct",)))
    found = D.drift_columns(with_previous(profiles, month_runs(spark, sf)), profiles, ["run_id"], tests=(test,))
    return found.select("run_id", "type", "column", "severity", "score")


for _test, (_type, _score, _where) in _DRIFT_TESTS.items():
    query(
        f"drift_{_test}",
        f"""{_DRIFT_CHAIN} SELECT run_id, '{_type}' AS type, "column", {SEVERITY_SQL.format('raw')} AS severity, round(raw::DECIMAL(28,10), 4)::DOUBLE AS score
            FROM (SELECT *, {_score} AS raw FROM pair WHERE {_where})""",
    )(lambda spark, sf, t=_test: _drift(spark, sf, t))


@query(
    "drift_volume",
    with_sql(
        f"""SELECT run_id, b_row_count AS baseline_row_count, row_count AS current_row_count, round(rel::DECIMAL(28,10), 4)::DOUBLE AS relative_change,
            {SEVERITY_SQL.format('raw')} AS severity, round(raw::DECIMAL(28,10), 4)::DOUBLE AS score FROM volume"""
    ),
)
def volume(spark, sf):
    counts = faulted_orders(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count"))
    counts = materialize(counts)
    base = with_previous(counts, month_runs(spark, sf))
    found = D.drift_volume(base, counts, ["run_id"])
    return found.select(
        "run_id",
        *[F.element_at("evidence", k).cast("bigint").alias(k) for k in ("baseline_row_count", "current_row_count")],
        F.element_at("evidence", "relative_change").cast("double").alias("relative_change"),
        "severity",
        "score",
    )


@query(
    "detect",
    with_sql(
        f"""SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord, type, "column") - 1 AS seq, type, "column",
             {SEVERITY_SQL.format('raw')} AS severity, round(raw::DECIMAL(28,10), 4)::DOUBLE AS score, source FROM (
             SELECT run_id, ord, rule_type AS type, "column", raw, 'contract' AS source FROM rule_v
             UNION ALL SELECT run_id, ord, type, "column", raw, 'baseline' FROM drift
             UNION ALL SELECT run_id, ord, type, "column", raw, 'baseline' FROM volume)"""
    ),
)
def detect(spark, sf):
    profiles = materialize(month_profiles(spark, sf))
    base = with_previous(profiles, month_runs(spark, sf))
    found = D.detect(
        faulted_orders(spark, sf),
        {"rules": MONTH_CONTRACT["rules"]},
        base,
        as_of=month_end(),
        current_profiles=profiles,
        runs=["run_id"],
    )
    return found.select("run_id", "seq", "type", "column", "severity", "score", "source")


# ------------------------------------------------------------------ segments

SEGMENT_COLUMNS = [("o_custkey", "numeric"), ("o_totalprice", "numeric")]
SEGMENT_SQL = f"""
seg_rows AS (SELECT run_id, '["' || o_orderpriority || '"]' AS segment, o_custkey, o_totalprice FROM faulted),
sp AS ({profile_sql('seg_rows', SEGMENT_COLUMNS, 'run_id, segment')}),
seg_n AS (SELECT run_id, segment, count(*) AS n FROM seg_rows GROUP BY 1, 2),
seg_prev AS (SELECT m.run_id, s.segment, s.n FROM months m JOIN seg_n s ON s.run_id = m.base_run),
seg_pair AS (
  SELECT c.*, b.row_count AS b_n, b.null_ratio AS b_null, b.distinct_ratio AS b_dr, b.mean AS b_mean, b.stddev AS b_sd,
    (c.mean - b.mean) / CASE WHEN b.stddev > 1e-9 THEN b.stddev END AS z,
    c.row_count * (1 - c.null_ratio) AS n_c, b.row_count * (1 - b.null_ratio) AS n_b,
    sqrt(b.stddev ** 2 / nullif(b.row_count * (1 - b.null_ratio), 0) + c.stddev ** 2 / nullif(c.row_count * (1 - c.null_ratio), 0)) AS se,
    abs(c.mean - b.mean) / greatest(abs(b.mean), b.stddev, 1e-9) AS shift,
    (c.distinct_ratio - b.distinct_ratio) / CASE WHEN b.distinct_ratio > 1e-9 THEN b.distinct_ratio END AS rel
  FROM sp c JOIN months m USING (run_id) JOIN sp b ON b.run_id = m.base_run AND b."column" = c."column" AND b.segment = c.segment),
seg_drift AS (
  SELECT p.run_id, p.segment, 'segment_missing' AS type, NULL::VARCHAR AS "column", 0.8 AS raw
  FROM seg_prev p LEFT JOIN seg_n c USING (run_id, segment) WHERE c.n IS NULL
  UNION ALL SELECT run_id, segment, 'volume', NULL, least(1.0, abs(c.n - p.n) / p.n)
  FROM seg_prev p JOIN seg_n c USING (run_id, segment) WHERE abs(c.n - p.n) / p.n >= 0.3
  UNION ALL SELECT run_id, segment, 'completeness', "column", least(1.0, 0.5 + null_ratio - b_null) FROM seg_pair WHERE null_ratio - b_null > 0.05
  UNION ALL SELECT run_id, segment, 'distribution', "column", least(1.0, (abs(z) - 3.0) / 3.0 + 0.5) FROM seg_pair WHERE abs(z) >= 3
  UNION ALL SELECT run_id, segment, 'distribution', "column", least(1.0, 0.45 + shift * 0.5) FROM seg_pair
    WHERE NOT coalesce(abs(z) >= 3, false) AND n_b >= 30 AND n_c >= 30 AND shift >= 0.10
      AND abs(CASE WHEN se > 1e-12 THEN (mean - b_mean) / se ELSE 1e6 END) >= 6
  UNION ALL SELECT run_id, segment, 'cardinality_drift', "column", least(1.0, 0.4 + abs(rel) * 0.4) FROM seg_pair
    WHERE b_dr * b_n > 3 AND distinct_ratio * row_count > 3 AND abs(rel) >= 0.5)
"""


@query(
    "drift_segments",
    with_sql(
        f"""SELECT run_id, segment, type, "column", CASE WHEN type = 'segment_missing' THEN 'high' ELSE {SEVERITY_SQL.format('raw')} END AS severity,
            round(raw::DECIMAL(28,10), 4)::DOUBLE::DOUBLE AS score FROM seg_drift""",
        SEGMENT_SQL,
    ),
)
def segments(spark, sf):
    rows = faulted_orders(spark, sf).select("run_id", "o_orderpriority", "o_custkey", "o_totalprice")
    current = materialize(profile_segments(rows, ["o_orderpriority"], ["run_id"], parts=("distinct",)))
    previous = with_previous(current, month_runs(spark, sf))
    return D.drift_segments(previous, current, ["run_id"]).select("run_id", "segment", "type", "column", "severity", "score")


@query(
    "empty_dataset",
    f"""WITH m AS (SELECT strftime(g, '%Y-%m') AS run_id FROM (
          SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP FROM orders),
                                        (SELECT date_trunc('month', max(o_orderdate))::TIMESTAMP FROM orders), INTERVAL 1 MONTH)) AS g)),
        c AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS n FROM orders
              WHERE NOT strftime(o_orderdate, '%Y-%m') IN ('{SHRUNK}', '2000-09') GROUP BY 1)
        SELECT run_id, 'empty_dataset' AS type, 'high' AS severity, 0.8::DOUBLE AS score FROM m LEFT JOIN c USING (run_id) WHERE n IS NULL""",
)
def empty(spark, sf):
    """Expected monthly loads without a single row; two months are withheld."""
    dates = table(spark, sf, "orders").select("o_orderdate")
    span = dates.agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    counts = (
        dates.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(~F.col("run_id").isin(SHRUNK, "2000-09"))
    )
    every = months.select(F.date_format("m", "yyyy-MM").alias("run_id")).join(counts, "run_id", "left")
    return D.empty_dataset(every.withColumn("row_count", F.coalesce("row_count", F.lit(0))), ["run_id"]).select(
        "run_id", "type", "severity", "score"
    )


# ------------------------------------------------------------------ baseline choice


def priority_runs(spark, sf):
    """One source per order priority, one run per month of it; every source has faulty and failed runs."""
    return (
        faulted_orders(spark, sf)
        .groupBy("o_orderpriority", "run_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.max("o_totalprice").alias("top"))
        .select(
            F.col("o_orderpriority").alias("job_id"),
            F.concat_ws("/", "o_orderpriority", "run_id").alias("run_id"),
            month_end().alias("run_ts"),
            F.when(F.col("run_id") >= "2001-07", "failed").otherwise("success").alias("status"),
            F.when(F.col("run_id").startswith("2001-06"), "F09").alias("fault_id"),
            "row_count",
            "top",
        )
    )


PRIORITY_SQL = """
jr AS (SELECT o_orderpriority AS job_id, o_orderpriority || '/' || run_id AS run_id, count(*) AS row_count, max(o_totalprice) AS top,
         CASE WHEN run_id >= '2001-07' THEN 'failed' ELSE 'success' END AS status, CASE WHEN run_id LIKE '2001-06%' THEN 'F09' END AS fault_id,
         run_id AS month FROM faulted GROUP BY o_orderpriority, run_id),
clean AS (SELECT * FROM jr WHERE status = 'success' AND fault_id IS NULL AND NOT (top > 480000)),
newest AS (SELECT job_id, max(month) AS month FROM clean GROUP BY job_id)
"""


@query(
    "latest_clean_baseline",
    with_sql(
        """SELECT n.job_id, c.run_id, c.row_count AS baseline_row_count, 'o_totalprice' AS "column",
             (SELECT round(round(avg(o_totalprice), 6)::DECIMAL(28,6), 3)::DOUBLE FROM faulted f WHERE f.o_orderpriority = n.job_id AND f.run_id = n.month) AS mean
           FROM newest n JOIN clean c ON c.job_id = n.job_id AND c.month = n.month""",
        PRIORITY_SQL,
    ),
)
def latest_clean(spark, sf):
    runs = materialize(priority_runs(spark, sf))
    signals = runs.filter("top > 480000").select("run_id")
    rows = faulted_orders(spark, sf).select(F.concat_ws("/", "o_orderpriority", "run_id").alias("run_id"), "o_totalprice")
    profiles = profile_table(rows, ["run_id"], parts=())
    found = B.latest_clean_baseline(runs, signals, profiles)
    return found.select("job_id", "run_id", "baseline_row_count", "column", F.round("mean", 3).alias("mean"))


def hourly_runs(spark, sf):
    """Hourly event runs; an hour whose largest value is extreme is rejected."""
    return (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run_ts"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.max("value").alias("top"))
        .select(
            F.lit("events").alias("source_id"),
            F.date_format("run_ts", "yyyy-MM-dd HH").alias("run_id"),
            "run_ts",
            F.lit("v1").alias("config_hash"),
            F.when(F.col("top") > 400, "rejected").otherwise("accepted").alias("quality"),
            "total_rows",
        )
    )


def hourly_profiles(spark, sf):
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("run_id"), "value", "user_id")
    return profile_table(rows, ["run_id"], parts=("distinct",))


HOURLY_SQL = f"""
er AS (SELECT strftime(ts, '%Y-%m-%d %H') AS run_id, date_trunc('hour', ts) AS run_ts, "value", user_id FROM events),
hr AS (SELECT run_id, run_ts, count(*) AS total_rows, CASE WHEN max("value") > 400 THEN 'rejected' ELSE 'accepted' END AS quality
       FROM er GROUP BY 1, 2),
hp AS ({profile_sql('er', [('"value"', 'numeric'), ('user_id', 'numeric')]).replace(chr(39) + '"value"' + chr(39), chr(39) + 'value' + chr(39))}),
pairs AS (SELECT t.run_id, b.run_id AS base_run, b.total_rows AS base_rows,
            row_number() OVER (PARTITION BY t.run_id ORDER BY b.run_ts DESC) AS k
          FROM hr t JOIN hr b ON b.quality = 'accepted' AND b.run_ts < t.run_ts
            AND isodow(b.run_ts) = isodow(t.run_ts) AND hour(b.run_ts) = hour(t.run_ts)),
st AS (SELECT t.run_id, count(p.base_run) AS base_runs, max(CASE WHEN p.k = 1 THEN p.base_run END) AS newest_base,
         floor(median(p.base_rows))::BIGINT AS row_count
       FROM hr t LEFT JOIN pairs p ON p.run_id = t.run_id AND p.k <= 12 GROUP BY t.run_id)
"""


@query(
    "choose_baseline",
    f"""WITH {HOURLY_SQL}
        SELECT run_id, base_runs, CASE WHEN base_runs = 0 THEN 'cold_start' WHEN base_runs < 3 THEN 'insufficient_history' ELSE 'ready' END AS state,
          CASE WHEN base_runs >= 3 THEN newest_base END AS newest_base, CASE WHEN base_runs >= 3 THEN row_count END AS row_count FROM st""",
)
def seasonal_states(spark, sf):
    runs = materialize(hourly_runs(spark, sf))
    states, _ = B.choose_baseline(runs, hourly_profiles(spark, sf), runs, seasonal=True)
    return states.select("run_id", "base_runs", "state", "newest_base", "row_count")


@query(
    "choose_baseline_profiles",
    f"""WITH {HOURLY_SQL}
        SELECT p.run_id, h."column", round(2 * median(h.mean), 6) AS twice_mean, round(median(h.null_ratio), 4) AS null_ratio,
               round(2 * median(h."max"), 6) AS twice_max
        FROM pairs p JOIN st USING (run_id) JOIN hp h ON h.run_id = p.base_run
        WHERE p.k <= 12 AND st.base_runs >= 3 GROUP BY 1, 2""",
)
def seasonal_profiles(spark, sf):
    runs = materialize(hourly_runs(spark, sf))
    _, base = B.choose_baseline(runs, materialize(hourly_profiles(spark, sf)), runs, seasonal=True)
    return base.select(
        "run_id",
        "column",
        F.round(2 * F.col("mean"), 6).alias("twice_mean"),
        F.round("null_ratio", 4).alias("null_ratio"),
        F.round(2 * F.col("max"), 6).alias("twice_max"),
    )


@query(
    "choose_baseline_plain",
    with_sql(
        """SELECT t.run_id, CASE WHEN max(b.run_id) IS NULL THEN 'cold_start' ELSE 'ready' END AS state, max(b.run_id) AS newest_base
           FROM runs t LEFT JOIN runs b ON b.quality = 'accepted' AND b.config_hash = t.config_hash AND b.run_ts < t.run_ts GROUP BY t.run_id""",
        RUNS_SQL,
    ),
)
def plain_states(spark, sf):
    runs = materialize(month_source_runs(spark, sf))
    states, _ = B.choose_baseline(runs, month_profiles(spark, sf), runs)
    return states.select("run_id", "state", "newest_base")


# ------------------------------------------------------------------ history

HISTORY_SQL = """
metric AS (
  SELECT run_id, 'volume' AS kind, NULL::VARCHAR AS "column", total_rows::DOUBLE AS "value" FROM runs
  UNION ALL SELECT run_id, 'distribution', "column", mean FROM p WHERE mean IS NOT NULL
  UNION ALL SELECT run_id, 'completeness', "column", null_ratio FROM p),
hist AS (
  SELECT t.run_id, b.run_id AS base_run, row_number() OVER (PARTITION BY t.run_id ORDER BY b.run_ts DESC) AS k
  FROM runs t JOIN runs b ON b.quality = 'accepted' AND b.config_hash = t.config_hash AND b.run_ts < t.run_ts),
past AS (SELECT h.run_id, m.kind, m."column", m."value" FROM hist h JOIN metric m ON m.run_id = h.base_run WHERE h.k <= 30),
center AS (SELECT run_id, kind, "column", median("value") AS center, count(*) AS n FROM past GROUP BY ALL),
spread AS (SELECT c.*, (SELECT median(abs(q."value" - c.center)) FROM past q WHERE q.run_id = c.run_id AND q.kind = c.kind
             AND q."column" IS NOT DISTINCT FROM c."column") AS mad FROM center c WHERE n >= 8),
judged AS (SELECT m.*, s.center, s.n, (m."value" - s.center) / greatest(1.4826 * s.mad, 0.02 * abs(s.center), 1e-9) AS z
           FROM metric m JOIN spread s ON s.run_id = m.run_id AND s.kind = m.kind AND s."column" IS NOT DISTINCT FROM m."column"),
history AS (
  SELECT run_id, kind AS type, "column", n, center, z, least(1.0, 0.58 + least(abs(z), 30.0) / 75.0) AS raw FROM judged
  WHERE abs(z) >= 6 AND CASE WHEN kind = 'completeness' THEN "value" - center >= 0.02 AND z >= 0
                             ELSE abs("value" - center) / greatest(abs(center), 1e-9) >= 0.05 END)
"""


@query(
    "history_anomalies",
    with_sql(
        f"""SELECT h.run_id, h.type, h."column", h.n AS history_runs, round(round(h.center::DECIMAL(28,10), 6), 3)::DOUBLE AS typical, {SEVERITY_SQL.format('h.raw')} AS severity,
             round(h.raw::DECIMAL(28,10), 4)::DOUBLE::DOUBLE AS score
           FROM history h LEFT JOIN (SELECT DISTINCT run_id, type, "column" FROM sig) s
             ON s.run_id = h.run_id AND s.type = h.type AND s."column" IS NOT DISTINCT FROM h."column" WHERE s.run_id IS NULL""",
        RUNS_SQL + "," + HISTORY_SQL,
    ),
)
def history(spark, sf):
    runs = materialize(month_source_runs(spark, sf))
    profiles = materialize(month_profiles(spark, sf))
    found = B.history_anomalies(runs, profiles, existing=month_signals(spark, sf))
    return found.select(
        "run_id",
        "type",
        "column",
        F.element_at("evidence", "history_runs").cast("bigint").alias("history_runs"),
        F.round(F.element_at("evidence", "typical").cast("double"), 3).alias("typical"),
        "severity",
        "score",
    )


STALE_SQL = """
lag AS (SELECT r.run_id, r.config_hash, p."column", date_diff('microsecond', p.max_ts, r.run_ts) / 6e7 AS lag
        FROM runs r JOIN p USING (run_id) WHERE p."column" = 'o_orderdate'),
lag_past AS (SELECT h.run_id, l."column", l.lag FROM hist h JOIN lag l ON l.run_id = h.base_run WHERE h.k <= 30),
lag_c AS (SELECT run_id, "column", median(lag) AS typical, count(*) AS n FROM lag_past GROUP BY ALL),
lag_s AS (SELECT c.*, (SELECT median(abs(q.lag - c.typical)) FROM lag_past q WHERE q.run_id = c.run_id) AS mad FROM lag_c c WHERE n >= 5),
lag_t AS (SELECT l.run_id, l."column", l.lag, s.typical, s.n,
            greatest(s.typical + 6 * 1.4826 * s.mad, 2 * s.typical, s.typical + 15) AS threshold
          FROM lag l JOIN lag_s s USING (run_id, "column")),
stale AS (SELECT *, least(1.0, 0.5 + least(lag / threshold - 1, 1.0) * 0.4) AS raw FROM lag_t WHERE lag > threshold)
"""


@query(
    "learned_staleness",
    with_sql(
        f"""SELECT run_id, "column", round(lag::DECIMAL(28,6), 1)::DOUBLE AS lag_minutes, round(typical::DECIMAL(28,6), 1)::DOUBLE AS typical_lag_minutes, round(threshold::DECIMAL(28,6), 1)::DOUBLE AS threshold_minutes,
             {SEVERITY_SQL.format('raw')} AS severity, round(raw::DECIMAL(28,10), 4)::DOUBLE::DOUBLE AS score FROM stale""",
        ",".join([RUNS_SQL, HISTORY_SQL, STALE_SQL]),
    ),
)
def staleness(spark, sf):
    found = B.learned_staleness(
        materialize(month_source_runs(spark, sf)), materialize(month_profiles(spark, sf)), ["o_orderdate"]
    )
    return found.select(
        "run_id",
        "column",
        *[F.element_at("evidence", k).cast("double").alias(k) for k in ("lag_minutes", "typical_lag_minutes", "threshold_minutes")],
        "severity",
        "score",
    )


# ------------------------------------------------------------------ joint drift


def fees(spark, sf, broken: bool):
    """Price and a fee of a tenth of it; in the broken copy returned lines carry the fee of a mirrored price."""
    price = F.col("l_extendedprice")
    fee = 0.1 * price + 1000 * F.col("l_tax")
    if broken:
        fee = F.when(F.col("l_returnflag") == "R", 0.1 * (105_000 - price) + 1000 * F.col("l_tax")).otherwise(fee)
    return table(spark, sf, "lineitem").select(price.alias("price"), fee.alias("fee"))


JOINT_SQL = """
r AS (SELECT l_extendedprice AS price, 0.1 * l_extendedprice + 1000 * l_tax AS fee,
        CASE WHEN l_returnflag = 'R' THEN 0.1 * (105000 - l_extendedprice) + 1000 * l_tax
             ELSE 0.1 * l_extendedprice + 1000 * l_tax END AS now FROM lineitem),
m AS (SELECT avg(price) AS mx, avg(fee) AS my, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS sx,
        quantile_cont(fee, 0.75) - quantile_cont(fee, 0.25) AS sy, var_samp(price) AS vx, var_samp(fee) AS vy, covar_samp(price, fee) AS cxy FROM r),
c AS (SELECT *, vx / (sx * sx) AS a0, vy / (sy * sy) AS d0, cxy / (sx * sy) AS b FROM m),
i AS (SELECT *, a0 + 1e-3 * (a0 + d0) / 2 AS a, d0 + 1e-3 * (a0 + d0) / 2 AS d FROM c),
inv AS (SELECT *, d / (a * d - b * b) AS ia, -b / (a * d - b * b) AS ib, a / (a * d - b * b) AS id FROM i),
dist AS (SELECT ia * ((price - mx) / sx) ** 2 + 2 * ib * ((price - mx) / sx) * ((fee - my) / sy) + id * ((fee - my) / sy) ** 2 AS ref,
           ia * ((price - mx) / sx) ** 2 + 2 * ib * ((price - mx) / sx) * ((now - my) / sy) + id * ((now - my) / sy) ** 2 AS cur FROM r, inv),
flag AS (SELECT count(*) AS n, count(*) FILTER (WHERE cur > t.q) AS hits FROM dist, (SELECT quantile_cont(ref, 0.99) AS q FROM dist) t)
"""


@query(
    "multivariate_mahalanobis",
    f"""WITH {JOINT_SQL} SELECT 'multivariate_drift' AS type, n AS "rows", hits AS flagged_rows, round((hits / n)::DECIMAL(28,10), 4)::DOUBLE AS outlier_rate,
        round(least(1.0, 0.5 + round((hits / n)::DECIMAL(28,10), 4)), 4)::DOUBLE AS score FROM flag""",
)
def mahalanobis(spark, sf):
    found = multivariate_mahalanobis(fees(spark, sf, False), fees(spark, sf, True), columns=["price", "fee"])
    return found.select(
        "type",
        F.element_at("evidence", "rows").cast("bigint").alias("rows"),
        F.element_at("evidence", "flagged_rows").cast("bigint").alias("flagged_rows"),
        F.element_at("evidence", "outlier_rate").cast("double").alias("outlier_rate"),
        "score",
    )


# Years of shipment as runs, each against the year before. In one year the fees of first lines belong to a mirrored price.
BROKEN_YEAR = "1996"


def yearly_fees(spark, sf):
    price, year = F.col("l_extendedprice"), F.date_format("l_shipdate", "yyyy")
    fee = F.when((year == BROKEN_YEAR) & (F.col("l_linenumber") == 1), 0.1 * (105_000 - price)).otherwise(0.1 * price) + 1000 * F.col("l_tax")
    return table(spark, sf, "lineitem").select(year.alias("run_id"), price.alias("price"), fee.alias("fee"))


def year_pairs(fees_):
    """Each year beside the one before, where that is there."""
    years = fees_.select("run_id").distinct()
    before = years.select((F.col("run_id").cast("int") + 1).cast("string").alias("run_id"), F.col("run_id").alias("base_run"))
    return years.join(before, "run_id")


YEARS_SQL = f"""
y AS (SELECT strftime(l_shipdate, '%Y') AS run_id, l_extendedprice AS price,
        CASE WHEN strftime(l_shipdate, '%Y') = '{BROKEN_YEAR}' AND l_linenumber = 1 THEN 0.1 * (105000 - l_extendedprice) ELSE 0.1 * l_extendedprice END + 1000 * l_tax AS fee
      FROM lineitem),
m AS (SELECT run_id, count(*) AS known, avg(price) AS mx, avg(fee) AS my, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS sx,
        quantile_cont(fee, 0.75) - quantile_cont(fee, 0.25) AS sy, var_samp(price) AS vx, var_samp(fee) AS vy, covar_samp(price, fee) AS cxy
      FROM y GROUP BY run_id HAVING count(*) >= 200),
c AS (SELECT *, vx / (sx * sx) AS a0, vy / (sy * sy) AS d0, cxy / (sx * sy) AS b FROM m),
i AS (SELECT *, a0 + 1e-3 * (a0 + d0) / 2 AS a, d0 + 1e-3 * (a0 + d0) / 2 AS d FROM c),
inv AS (SELECT *, d / (a * d - b * b) AS ia, -b / (a * d - b * b) AS ib, a / (a * d - b * b) AS id FROM i),
own AS (SELECT y.run_id, ia * ((price - mx) / sx) ** 2 + 2 * ib * ((price - mx) / sx) * ((fee - my) / sy) + id * ((fee - my) / sy) ** 2 AS distance
        FROM y JOIN inv ON inv.run_id = y.run_id),
lim AS (SELECT run_id, quantile_cont(distance, 0.99) AS t FROM own GROUP BY run_id),
hit AS (SELECT y.run_id, count(*) AS n,
          count(*) FILTER (WHERE ia * ((price - mx) / sx) ** 2 + 2 * ib * ((price - mx) / sx) * ((fee - my) / sy) + id * ((fee - my) / sy) ** 2 > lim.t) AS hits
        FROM y JOIN inv ON inv.run_id = (y.run_id::INT - 1)::VARCHAR JOIN lim ON lim.run_id = inv.run_id GROUP BY y.run_id HAVING count(*) >= 200),
tail AS (SELECT run_id, n, hits, round((hits / n)::DECIMAL(28,10), 4)::DOUBLE AS rate,
           (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01) + (n - k) * ln(0.99))) FROM (SELECT unnest(range(hits, n + 1)) AS k)) AS p
         FROM hit)
"""


@query(
    "joint_by_run",
    f"""WITH {YEARS_SQL} SELECT run_id, 'multivariate_drift' AS type, n AS "rows", hits AS flagged_rows, rate AS outlier_rate,
        round(least(1.0, 0.5 + rate)::DECIMAL(28,10), 4)::DOUBLE AS score, (run_id::INT - 1)::VARCHAR AS baseline_run
        FROM tail WHERE rate >= 0.03 AND p < 1e-6""",
)
def joint_runs(spark, sf):
    """Joint drift of all runs: the broken year stands out against the year before."""
    rows = yearly_fees(spark, sf)
    return _joint_rows(joint_by_run(rows, year_pairs(rows), ["price", "fee"]))


@query(
    "analyze_runs_joint",
    f"""WITH {YEARS_SQL}, fired AS (SELECT * FROM tail WHERE rate >= 0.03 AND p < 1e-6)
        SELECT run_id, 'multivariate_drift' AS type, n AS "rows", hits AS flagged_rows, rate AS outlier_rate,
        round(least(1.0, 0.5 + rate)::DECIMAL(28,10), 4)::DOUBLE AS score, (run_id::INT - 1)::VARCHAR AS baseline_run FROM fired""",
)
def analyze_joint(spark, sf):
    """The composed analysis of yearly runs with joint drift; every year is accepted and so the next one's baseline."""
    rows = materialize(yearly_fees(spark, sf))
    runs = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit("fees").alias("source_id"),
        "run_id",
        F.concat("run_id", F.lit("-12-31 00:00:00")).cast("timestamp_ntz").alias("run_ts"),
        F.lit("accepted").alias("quality"),
        F.lit("default").alias("config_hash"),
        "total_rows",
    )
    contract = {"expected_schema": {"run_id": "string", "price": "float", "fee": "float"}, "rules": []}
    found = analyze_runs(rows, contract, runs, Options(adaptive=False, parts=(), joint_drift=["price", "fee"])).signals
    return _joint_rows(found.filter("type = 'multivariate_drift'"))


def _joint_rows(signals):
    fact = lambda k, kind: F.element_at("evidence", k).cast(kind)
    return signals.select(
        "run_id",
        "type",
        fact("rows", "bigint").alias("rows"),
        fact("flagged_rows", "bigint").alias("flagged_rows"),
        fact("outlier_rate", "double").alias("outlier_rate"),
        "score",
        fact("baseline_run", "string").alias("baseline_run"),
    )


@query(
    "multivariate_iforest",
    """SELECT 'multivariate_drift' AS type, count(*) FILTER (WHERE l_tax >= 0.08) AS planted_rows, true AS planted_are_flagged
       FROM lineitem HAVING avg((l_tax >= 0.08)::INT) >= 0.03""",
)
def iforest(spark, sf):
    """The most taxed lines sit in a corner the reference never visits: the forest must flag as many rows as these and at
    most a twentieth of all rows more, and the signal must fire."""
    clean = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    odd = F.col("l_tax") >= 0.08
    now = clean.select(
        F.when(odd, 90.0).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(odd, 200_000.0).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_tax",
    )
    rows, planted = clean.agg(F.count(F.lit(1)), F.count_if(odd)).first()
    flagged = F.element_at("evidence", "flagged_rows").cast("bigint")
    return multivariate_iforest(clean, now).select(
        "type", F.lit(planted).cast("bigint").alias("planted_rows"), flagged.between(planted, planted + rows // 20).alias("planted_are_flagged")
    )


# ------------------------------------------------------------------ schema history and acceptance


@query(
    "schema_diff",
    with_sql(
        """SELECT t.run_id, k."column", CASE WHEN c.run_id IS NULL THEN 'dropped' ELSE 'added' END AS change
           FROM (SELECT DISTINCT run_id FROM catalogue) t JOIN (SELECT "column", min(run_id) AS first_run FROM catalogue GROUP BY 1) k ON TRUE
           LEFT JOIN catalogue c ON c.run_id = t.run_id AND c."column" = k."column"
           WHERE (c.run_id IS NULL AND k.first_run < t.run_id) OR (c.run_id IS NOT NULL AND k.first_run = t.run_id)"""
    ),
)
def schema_diff(spark, sf):
    columns = run_catalogue(spark, sf).withColumn("dataset", F.lit("orders"))
    return B.schema_diff(columns, month_runs(spark, sf)).select("run_id", "column", "change")


@query(
    "schema_catalog",
    with_sql(
        """SELECT "column", coalesce(max_by(type, c.run_id) FILTER (WHERE fault_id IS NULL), min_by(type, c.run_id)) AS type
           FROM catalogue c JOIN runs r ON r.run_id = c.run_id GROUP BY "column" """,
        RUNS_SQL,
    ),
)
def schema_catalog(spark, sf):
    columns = run_catalogue(spark, sf).withColumn("dataset", F.lit("orders"))
    return B.schema_catalog(columns, month_source_runs(spark, sf)).select("column", "type")


@query(
    "accept_runs",
    with_sql(
        """SELECT r.run_id, count(s.run_id) = 0 AS can_accept, count(s.run_id) = 0 AND any_value(b.state) = 'ready' AS auto_accept,
             count(s.run_id) > 0 AND coalesce(bool_and(s.source IN ('baseline', 'segment')), false)
               AND r.run_id = (SELECT max(run_id) FROM runs) AS expected_change
           FROM runs r LEFT JOIN sig s USING (run_id)
           JOIN (SELECT t.run_id, CASE WHEN max(b.run_id) IS NULL THEN 'cold_start' ELSE 'ready' END AS state
                 FROM runs t LEFT JOIN runs b ON b.quality = 'accepted' AND b.config_hash = t.config_hash AND b.run_ts < t.run_ts GROUP BY 1) b
             ON b.run_id = r.run_id
           GROUP BY r.run_id""",
        RUNS_SQL,
    ),
)
def acceptance(spark, sf):
    runs = materialize(month_source_runs(spark, sf))
    states, _ = B.choose_baseline(runs, month_profiles(spark, sf), runs)
    return B.accept_runs(runs, month_signals(spark, sf), states).select("run_id", "can_accept", "auto_accept", "expected_change")


# ------------------------------------------------------------------ everything at once

ANALYZE_COLUMNS = [("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime")]
ANALYZE_SQL = f"""
WITH base AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS run_id FROM orders),
f AS (SELECT run_id, o_custkey, o_orderdate,
        CASE WHEN run_id = '1997-03' THEN o_totalprice * 100
             WHEN run_id = '1998-05' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_totalprice END AS o_totalprice
      FROM base WHERE NOT (run_id = '{SHRUNK}' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))
      UNION ALL SELECT run_id, o_custkey, o_orderdate, o_totalprice FROM base WHERE run_id = '1999-02'),
p AS ({profile_sql('f', ANALYZE_COLUMNS)}),
counts AS (SELECT run_id, count(*) AS row_count FROM f GROUP BY run_id),
{RUNS_SQL},
prev AS (SELECT t.run_id, max(b.run_id) AS base_run FROM runs t
         JOIN runs b ON b.quality = 'accepted' AND b.config_hash = t.config_hash AND b.run_ts < t.run_ts GROUP BY t.run_id),
pair AS (
  SELECT c.*, b.row_count AS b_n, b.null_ratio AS b_null, b.distinct_ratio AS b_dr, b.mean AS b_mean, b.stddev AS b_sd,
    (c.mean - b.mean) / CASE WHEN b.stddev > 1e-9 THEN b.stddev END AS z,
    c.row_count * (1 - c.null_ratio) AS n_c, b.row_count * (1 - b.null_ratio) AS n_b,
    sqrt(b.stddev ** 2 / nullif(b.row_count * (1 - b.null_ratio), 0) + c.stddev ** 2 / nullif(c.row_count * (1 - c.null_ratio), 0)) AS se,
    abs(c.mean - b.mean) / greatest(abs(b.mean), b.stddev, 1e-9) AS shift,
    (c.distinct_ratio - b.distinct_ratio) / CASE WHEN b.distinct_ratio > 1e-9 THEN b.distinct_ratio END AS rel
  FROM p c JOIN prev m USING (run_id) JOIN p b ON b.run_id = m.base_run AND b."column" = c."column"),
{HISTORY_SQL},
{STALE_SQL},
first_signals AS (
  SELECT run_id, 'range' AS type, 'o_totalprice' AS "column", least(1.0, 0.4 + 3 * round(bad / n, 6)) AS raw, 'contract' AS source
  FROM (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 1000000) AS bad FROM f GROUP BY 1) WHERE bad > 0
  UNION ALL SELECT run_id, 'completeness', "column", least(1.0, 0.5 + null_ratio - b_null), 'baseline' FROM pair WHERE null_ratio - b_null > 0.05
  UNION ALL SELECT run_id, 'distribution', "column", least(1.0, (abs(z) - 3.0) / 3.0 + 0.5), 'baseline' FROM pair WHERE abs(z) >= 3
  UNION ALL SELECT run_id, 'distribution', "column", least(1.0, 0.45 + shift * 0.5), 'baseline' FROM pair
    WHERE NOT coalesce(abs(z) >= 3, false) AND n_b >= 30 AND n_c >= 30 AND shift >= 0.10
      AND abs(CASE WHEN se > 1e-12 THEN (mean - b_mean) / se ELSE 1e6 END) >= 6
  UNION ALL SELECT run_id, 'cardinality_drift', "column", least(1.0, 0.4 + abs(rel) * 0.4), 'baseline' FROM pair
    WHERE b_dr * b_n > 3 AND distinct_ratio * row_count > 3 AND abs(rel) >= 0.5
  UNION ALL SELECT c.run_id, 'volume', NULL, least(1.0, abs(c.row_count - b.row_count) / b.row_count), 'baseline'
  FROM counts c JOIN prev m USING (run_id) JOIN counts b ON b.run_id = m.base_run WHERE abs(c.row_count - b.row_count) / b.row_count >= 0.3),
found AS (
  SELECT * FROM first_signals
  UNION ALL SELECT h.run_id, h.type, h."column", h.raw, 'baseline' FROM history h
    LEFT JOIN (SELECT DISTINCT run_id, type, "column" FROM first_signals) s
      ON s.run_id = h.run_id AND s.type = h.type AND s."column" IS NOT DISTINCT FROM h."column" WHERE s.run_id IS NULL
  UNION ALL SELECT run_id, 'staleness', "column", raw, 'baseline' FROM stale)
"""


@query(
    "analyze_table",
    ANALYZE_SQL
    + f""" SELECT run_id, type, "column", {SEVERITY_SQL.format('raw')} AS severity, round(raw::DECIMAL(28,10), 4)::DOUBLE::DOUBLE AS score, source FROM found""",
)
def analyze(spark, sf):
    """Every monthly run analysed in one job: contract, drift against its own baseline, volume, history, staleness."""
    rows = faulted_orders(spark, sf).select("run_id", "o_custkey", "o_totalprice", "o_orderdate")
    contract = {"rules": [{"type": "range", "column": "o_totalprice", "min": 0, "max": 1_000_000}]}
    options = Options(learned_freshness=["o_orderdate"], parts=("distinct",))
    signals = analyze_runs(rows, contract, month_source_runs(spark, sf), options, as_of=month_end()).signals
    return signals.select("run_id", "type", "column", "severity", "score", "source")


@query(
    "analyze_table_summary",
    ANALYZE_SQL
    + f""", scored AS (SELECT run_id, source, round(raw::DECIMAL(28,10), 4)::DOUBLE AS score FROM found),
    rated AS (SELECT r.run_id, count(s.run_id) AS signal_count,
      CASE WHEN count(s.run_id) = 0 THEN 0.0 ELSE
        round(least(1.0, CASE WHEN bool_or(s.source = 'contract') THEN 0.35 / 0.60 ELSE 0 END + 0.25 / 0.60 * max(s.score))::DECIMAL(28,10), 4)::DOUBLE END AS risk
      FROM runs r LEFT JOIN scored s USING (run_id) GROUP BY r.run_id)
    SELECT j.run_id, signal_count, risk::DOUBLE AS risk, CASE WHEN signal_count > 0 THEN {SEVERITY_SQL.format('risk')} ELSE 'low' END AS severity,
      CASE WHEN base_run IS NULL THEN 'cold_start' ELSE 'ready' END AS state, base_run AS baseline_run
    FROM rated j LEFT JOIN prev USING (run_id)""",
)
def analyze_summary(spark, sf):
    """Run rows of the analysis with risk, severity and baseline state."""
    rows = faulted_orders(spark, sf).select("run_id", "o_custkey", "o_totalprice", "o_orderdate")
    contract = {"rules": [{"type": "range", "column": "o_totalprice", "min": 0, "max": 1_000_000}]}
    options = Options(learned_freshness=["o_orderdate"], parts=("distinct",), sensitive_columns=["o_custkey"])
    summary = analyze_runs(rows, contract, month_source_runs(spark, sf), options, as_of=month_end()).runs
    return summary.select("run_id", "signal_count", "risk", "severity", "state", "baseline_run")


@query(
    "analyze_segments",
    with_sql(
        """SELECT run_id, '["' || o_orderpriority || '"]' AS segment, count(*) AS row_count, round(1 - count(o_totalprice) / count(*), 6) AS null_ratio,
             round(max(o_totalprice), 2) AS "max" FROM faulted GROUP BY run_id, o_orderpriority"""
    ),
)
def analyze_segments(spark, sf):
    """Segment profiles that the analysis of all runs returns for the next one."""
    rows = faulted_orders(spark, sf).select("run_id", "o_orderpriority", "o_totalprice")
    options = Options(segment_by=["o_orderpriority"], parts=("distinct",), adaptive=False)
    segments = analyze_runs(rows, {"rules": []}, month_source_runs(spark, sf), options, as_of=month_end()).segments
    return segments.filter("column = 'o_totalprice'").select("run_id", "segment", "row_count", "null_ratio", F.round("max", 2).alias("max"))


