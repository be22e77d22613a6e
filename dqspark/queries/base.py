"""Registry of the named queries, and the inputs they derive from the given tables.

Every derived input (monthly runs, planted faults, run metadata, lineage edges) is computed by Spark from the
tables, so its size follows theirs; each has a SQL twin for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.operators.baseline import previous_run
from dqspark.operators.contract import check_contract, check_schema
from dqspark.operators.drift import drift_columns, drift_volume, run_counts, shift_baseline
from dqspark.operators.profile import profile_table
from dqspark.operators.scoring import number_signals, score_violations
from dqspark.runtime import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ monthly order runs, clean and faulted

# Planted faults, one per month, so that every detector has something to find.
SCALED = "1997-03"
NULLED = "1998-05"
DOUBLED = "1999-02"
RECODED = "2000-01"
SHRUNK = "1996-06"
SWAPPED = "1995-09"
DROPPED_COLUMN = "1997-11"
RETYPED_COLUMN = "1998-10"
ADDED_COLUMN = "1999-07"

MONTH_CONTRACT = {
    "expected_schema": {
        "o_orderkey": "integer",
        "o_custkey": "integer",
        "o_orderstatus": "string",
        "o_totalprice": "float",
        "o_orderdate": "datetime",
        "due_date": "datetime",
        "o_orderpriority": "string",
    },
    "rules": [
        {"type": "not_null", "column": "o_orderkey"},
        {"type": "not_null", "column": "o_totalprice", "max_null_ratio": 0.01},
        {"type": "range", "column": "o_totalprice", "min": 0, "max": 1_000_000},
        {"type": "uniqueness", "column": "o_orderkey"},
        {"type": "freshness", "column": "o_orderdate", "max_lag_minutes": 2880},
        {"type": "allowed_values", "column": "o_orderstatus", "values": ["F", "O", "P"]},
        {"type": "row_count", "min_rows": 10},
        {"type": "column_compare", "column": "o_orderdate", "operator": "<=", "other": "due_date"},
    ],
}


def month_end(run: str = "run_id"):
    """First instant after the run's month: the moment a monthly run is checked."""
    return F.add_months(F.to_date(F.concat(F.col(run), F.lit("-01"))), 1).cast("timestamp_ntz")


def month_start(run: str = "run_id"):
    return F.to_date(F.concat(F.col(run), F.lit("-01"))).cast("timestamp_ntz")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("run_id", F.date_format("o_orderdate", "yyyy-MM"))


def faulted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders with the planted faults; one scan, the doubled month by repeating its rows in place."""
    run = F.col("run_id")
    price = (
        F.when(run == SCALED, F.col("o_totalprice") * 100)
        .when((run == NULLED) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(None))
        .otherwise(F.col("o_totalprice"))
    )
    status = F.when((run == RECODED) & (F.col("o_orderstatus") == "P"), "X").otherwise(F.col("o_orderstatus"))
    due = F.col("o_orderdate") + F.when(run == SWAPPED, F.expr("INTERVAL '-2' DAY")).otherwise(F.expr("INTERVAL '30' DAY"))
    copies = F.array_repeat(F.lit(1), F.when(run == DOUBLED, 2).otherwise(1))
    kept = ~((run == SHRUNK) & F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    return (
        monthly_orders(spark, sf_dir)
        .filter(kept)
        .select(
            "o_orderkey",
            "o_custkey",
            status.alias("o_orderstatus"),
            price.alias("o_totalprice"),
            "o_orderdate",
            due.alias("due_date"),
            "o_orderpriority",
            "run_id",
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )


BASE_SQL = f"""
base AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS run_id FROM orders),
once AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN run_id = '{RECODED}' AND o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN run_id = '{SCALED}' THEN o_totalprice * 100
         WHEN run_id = '{NULLED}' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN run_id = '{SWAPPED}' THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate + INTERVAL 30 DAY END AS due_date,
    o_orderpriority, run_id
  FROM base
  WHERE NOT (run_id = '{SHRUNK}' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))),
faulted AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE run_id = '{DOUBLED}')
"""

CATALOGUE_COLUMNS = list(MONTH_CONTRACT["expected_schema"].items())


def run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, column, type, ordinal): the columns each monthly load delivered, with planted schema changes."""
    run = F.col("run_id")
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(i).alias("ordinal"))
        for i, (c, t) in enumerate(CATALOGUE_COLUMNS)
    ]
    entries.append(F.struct(F.lit("discount_code").alias("column"), F.lit("string").alias("type"), F.lit(7).alias("ordinal")))
    rows = monthly_orders(spark, sf_dir).select("run_id").distinct().select("run_id", F.inline(F.array(*entries)))
    retyped = F.when((run == RETYPED_COLUMN) & (F.col("column") == "o_orderstatus"), "integer").otherwise(F.col("type"))
    return rows.withColumn("type", retyped).filter(
        ~((run == DROPPED_COLUMN) & (F.col("column") == "o_custkey"))
        & ((F.col("column") != "discount_code") | (run == ADDED_COLUMN))
    )


_VALUES = ", ".join(f"('{c}', '{t}', {i})" for i, (c, t) in enumerate(CATALOGUE_COLUMNS))
CATALOGUE_SQL = f"""
expected AS (SELECT * FROM (VALUES {_VALUES}) t("column", type, ordinal)),
catalogue AS (
  SELECT run_id, "column",
    CASE WHEN run_id = '{RETYPED_COLUMN}' AND "column" = 'o_orderstatus' THEN 'integer' ELSE type END AS type, ordinal
  FROM (SELECT DISTINCT run_id FROM base) CROSS JOIN (SELECT * FROM expected UNION ALL SELECT 'discount_code', 'string', 7)
  WHERE NOT (run_id = '{DROPPED_COLUMN}' AND "column" = 'o_custkey')
    AND ("column" <> 'discount_code' OR run_id = '{ADDED_COLUMN}')),
schema_v AS (
  SELECT coalesce(c.run_id, w.run_id) AS run_id, coalesce(c."column", w."column") AS "column",
    CASE WHEN c."column" IS NULL THEN 'schema_missing_column'
         WHEN w."column" IS NULL THEN 'schema_unexpected_column'
         WHEN c.type <> w.type AND NOT (w.type = 'float' AND c.type = 'integer') THEN 'schema_type_mismatch' END AS rule_type,
    CASE WHEN c."column" IS NULL THEN w.ordinal WHEN w."column" IS NULL THEN 10000 + c.ordinal ELSE 20000 + w.ordinal END AS ord
  FROM catalogue c FULL JOIN
    (SELECT r.run_id, e.* FROM (SELECT DISTINCT run_id FROM base) r CROSS JOIN expected e) w
    ON c.run_id = w.run_id AND c."column" = w."column")
"""

PROFILE_COLUMNS = [
    ("o_orderkey", "numeric"),
    ("o_custkey", "numeric"),
    ("o_orderstatus", "categorical"),
    ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"),
    ("due_date", "datetime"),
    ("o_orderpriority", "categorical"),
]


def profile_sql(source: str, columns, keys: str = "run_id") -> str:
    """UNION ALL of one aggregate per column, the long form of `profile_table`."""
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    parts = []
    for i, (name, kind) in enumerate(columns):
        number = kind == "numeric"
        stat = lambda f: f"round({f}, 6)" if number else "NULL::DOUBLE"
        parts.append(
            f"""SELECT {lead}'{name}' AS "column", {i} AS ordinal, '{kind}' AS kind, count(*) AS row_count,
            round(1 - count({name}) / count(*), 6) AS null_ratio, round(count(DISTINCT {name}) / count(*), 6) AS distinct_ratio,
            {stat(f'avg({name}::DOUBLE)') if number else 'NULL::DOUBLE'} AS mean,
            {stat(f'stddev_pop({name}::DOUBLE)') if number else 'NULL::DOUBLE'} AS stddev,
            {stat(f'min({name} + 0.0)::DOUBLE') if number else 'NULL::DOUBLE'} AS "min",
            {stat(f'max({name} + 0.0)::DOUBLE') if number else 'NULL::DOUBLE'} AS "max",
            {f'max({name})' if kind == 'datetime' else 'NULL::TIMESTAMP'} AS max_ts
            FROM {source}{group}"""
        )
    return " UNION ALL ".join(parts)


SEVERITY_SQL = "CASE WHEN {0} >= 0.85 THEN 'critical' WHEN {0} >= 0.65 THEN 'high' WHEN {0} >= 0.40 THEN 'medium' ELSE 'low' END"

DRIFT_SQL = f"""
p AS ({profile_sql('faulted', PROFILE_COLUMNS)}),
months AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS base_run FROM (SELECT DISTINCT run_id FROM faulted)),
pair AS (
  SELECT c.*, b.row_count AS b_n, b.null_ratio AS b_null, b.distinct_ratio AS b_dr, b.mean AS b_mean, b.stddev AS b_sd,
    (c.mean - b.mean) / CASE WHEN b.stddev > 1e-9 THEN b.stddev END AS z,
    c.row_count * (1 - c.null_ratio) AS n_c, b.row_count * (1 - b.null_ratio) AS n_b
  FROM p c JOIN months m USING (run_id) JOIN p b ON b.run_id = m.base_run AND b."column" = c."column"),
pair2 AS (
  SELECT *, sqrt(b_sd * b_sd / nullif(n_b, 0) + stddev * stddev / nullif(n_c, 0)) AS se,
    abs(mean - b_mean) / greatest(abs(b_mean), b_sd, 1e-9) AS shift,
    (distinct_ratio - b_dr) / CASE WHEN b_dr > 1e-9 THEN b_dr END AS rel
  FROM pair),
drift AS (
  SELECT run_id, 1000000 + ordinal * 10 AS ord, 'completeness' AS type, "column", least(1.0, 0.5 + null_ratio - b_null) AS raw,
    'completeness' AS test FROM pair2 WHERE null_ratio - b_null > 0.05
  UNION ALL
  SELECT run_id, 1000001 + ordinal * 10, 'distribution', "column", least(1.0, (abs(z) - 3.0) / 3.0 + 0.5), 'mean_z'
  FROM pair2 WHERE abs(z) >= 3
  UNION ALL
  SELECT run_id, 1000002 + ordinal * 10, 'distribution', "column", least(1.0, 0.45 + shift * 0.5), 'mean_se'
  FROM pair2 WHERE NOT coalesce(abs(z) >= 3, false) AND n_b >= 30 AND n_c >= 30 AND shift >= 0.10
    AND abs(CASE WHEN se > 1e-12 THEN (mean - b_mean) / se ELSE 1e6 END) >= 6
  UNION ALL
  SELECT run_id, 1000003 + ordinal * 10, 'cardinality_drift', "column", least(1.0, 0.4 + abs(rel) * 0.4), 'cardinality'
  FROM pair2 WHERE b_dr * b_n > 3 AND distinct_ratio * row_count > 3 AND abs(rel) >= 0.5),
counts AS (SELECT run_id, count(*) AS row_count FROM faulted GROUP BY run_id),
volume AS (
  SELECT c.run_id, 10000000 AS ord, 'volume' AS type, NULL::VARCHAR AS "column",
    least(1.0, abs(c.row_count - b.row_count) / b.row_count) AS raw, (c.row_count - b.row_count) / b.row_count AS rel,
    b.row_count AS b_row_count, c.row_count
  FROM counts c JOIN months m USING (run_id) JOIN counts b ON b.run_id = m.base_run
  WHERE abs(c.row_count - b.row_count) / b.row_count >= 0.3)
"""

RULES_SQL = """
wide AS (
  SELECT run_id, count(*) AS n, count(*) - count(o_orderkey) AS null_key, count(*) - count(o_totalprice) AS null_price,
    count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 1000000) AS out_price,
    min(CASE WHEN o_totalprice < 0 OR o_totalprice > 1000000 THEN o_totalprice END) AS sample_price,
    count(o_orderkey) - count(DISTINCT o_orderkey) AS copies,
    date_diff('microsecond', max(o_orderdate), last_day(strptime(run_id || '-01', '%Y-%m-%d')) + INTERVAL 1 DAY) / 6e7 AS lag,
    count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) AS bad_status,
    count(DISTINCT CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN o_orderstatus END) AS bad_values,
    count(*) FILTER (WHERE NOT (o_orderdate <= due_date)) AS swapped
  FROM faulted GROUP BY run_id),
rule_v AS (
  SELECT run_id, 30000 AS ord, 'completeness' AS rule_type, 'o_orderkey' AS "column", null_key / n AS ratio, null_key AS amount,
    least(1.0, 0.5 + 2 * greatest(0, null_key / n)) AS raw FROM wide WHERE null_key > 0
  UNION ALL SELECT run_id, 30001, 'completeness', 'o_totalprice', null_price / n, null_price,
    least(1.0, 0.5 + 2 * greatest(0, round(null_price / n, 6) - 0.01)) FROM wide WHERE null_price / n > 0.01
  UNION ALL SELECT run_id, 30002, 'range', 'o_totalprice', out_price / n, out_price,
    least(1.0, 0.4 + 3 * round(out_price / n, 6)) FROM wide WHERE out_price > 0
  UNION ALL SELECT run_id, 30003, 'uniqueness', 'o_orderkey', NULL, copies, 0.9 FROM wide WHERE copies > 0
  UNION ALL SELECT run_id, 30004, 'freshness', 'o_orderdate', NULL, round(lag, 2),
    least(1.0, 0.4 + (round(lag, 2) / 2880.0 - 1) * 0.3) FROM wide WHERE lag > 2880
  UNION ALL SELECT run_id, 30005, 'semantic_drift', 'o_orderstatus', NULL, bad_status, 0.5 FROM wide WHERE bad_status > 0
  UNION ALL SELECT run_id, 30006, 'row_count', NULL, NULL, n, 0.75 FROM wide WHERE n < 10
  UNION ALL SELECT run_id, 30007, 'column_compare', 'o_orderdate', swapped / n, swapped,
    least(1.0, 0.4 + 3 * round(swapped / n, 6)) FROM wide WHERE swapped > 0)
"""

SIGNAL_SQL = f"""
all_signals AS (
  SELECT run_id, ord, rule_type AS type, "column",
    CASE rule_type WHEN 'schema_missing_column' THEN 0.95 WHEN 'schema_unexpected_column' THEN 0.5 ELSE 0.9 END AS raw,
    'contract' AS source, NULL::DOUBLE AS lag FROM schema_v WHERE rule_type IS NOT NULL
  UNION ALL SELECT run_id, ord, rule_type, "column", raw, 'contract', CASE WHEN rule_type = 'freshness' THEN amount END FROM rule_v
  UNION ALL SELECT run_id, ord, type, "column", raw, 'baseline', NULL FROM drift
  UNION ALL SELECT run_id, ord, type, "column", raw, 'baseline', NULL FROM volume),
sig AS (
  SELECT run_id, seq, run_id || ':' || seq AS signal_id, type, "column", {SEVERITY_SQL.format('raw')} AS severity,
    round(raw::DECIMAL(28,10), 4)::DOUBLE AS score, source, lag
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord, type, "column") - 1 AS seq FROM all_signals))
"""

ALL_SQL = ",".join([BASE_SQL, CATALOGUE_SQL, DRIFT_SQL, RULES_SQL, SIGNAL_SQL])


def with_sql(tail: str, extra: str = "") -> str:
    """Oracle query over the shared chain orders -> faulted runs -> signals."""
    return f"WITH {ALL_SQL}{',' + extra if extra else ''} {tail}"


def month_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, run_id, run_ts): one row per monthly run; the run is taken when its month is over."""
    runs = monthly_orders(spark, sf_dir).select("run_id").distinct()
    return runs.select(F.lit("orders").alias("dataset"), "run_id", month_end().alias("run_ts"))


def month_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(faulted_orders(spark, sf_dir), ["run_id"], parts=("distinct",))


def with_previous(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run's baseline profile: that of the month before."""
    mapping = previous_run(runs).filter("base_run is not null").select("run_id", "base_run")
    return shift_baseline(profiles, mapping)


def month_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulted = faulted_orders(spark, sf_dir)
    schema = check_schema(run_catalogue(spark, sf_dir), MONTH_CONTRACT["expected_schema"], ["run_id"])
    rules = check_contract(faulted, {"rules": MONTH_CONTRACT["rules"]}, as_of=month_end(), runs=["run_id"])
    return schema.unionByName(rules)


def month_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of all monthly runs: catalogue and contract violations, drift against the month before."""
    profiles = materialize(month_profiles(spark, sf_dir))
    base = with_previous(profiles, month_runs(spark, sf_dir))
    keys = ["run_id"]
    signals = (
        score_violations(month_violations(spark, sf_dir))
        .unionByName(drift_columns(base, profiles, keys))
        .unionByName(drift_volume(run_counts(base, keys), run_counts(profiles, keys), keys))
    )
    return number_signals(signals, keys)


def month_source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows of the monthly source: accepted unless the month carries a planted fault."""
    faulty = [SCALED, NULLED, DOUBLED, RECODED, SHRUNK, SWAPPED, DROPPED_COLUMN, RETYPED_COLUMN, ADDED_COLUMN]
    return (
        faulted_orders(spark, sf_dir)
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("total_rows"))
        .select(
            F.lit("orders").alias("dataset"),
            F.lit("orders").alias("source_id"),
            F.lit("orders_load").alias("job_id"),
            "run_id",
            month_end().alias("run_ts"),
            F.lit("success").alias("status"),
            F.when(F.col("run_id").isin(faulty), "planted").alias("fault_id"),
            F.when(F.col("run_id").isin(faulty), "rejected").otherwise("accepted").alias("quality"),
            F.when(F.substring("run_id", 1, 4) < "1999", "v1").otherwise("v2").alias("config_hash"),
            F.lit("c1").alias("contract_hash"),
            "total_rows",
            (F.col("total_rows") / 1000.0).alias("duration_s"),
        )
    )


_FAULTY = ", ".join(f"'{m}'" for m in (SCALED, NULLED, DOUBLED, RECODED, SHRUNK, SWAPPED, DROPPED_COLUMN, RETYPED_COLUMN, ADDED_COLUMN))
RUNS_SQL = f"""
runs AS (
  SELECT run_id, 'orders' AS source_id, (last_day(strptime(run_id || '-01', '%Y-%m-%d')) + INTERVAL 1 DAY)::TIMESTAMP AS run_ts,
    CASE WHEN run_id IN ({_FAULTY}) THEN 'planted' END AS fault_id,
    CASE WHEN run_id IN ({_FAULTY}) THEN 'rejected' ELSE 'accepted' END AS quality,
    CASE WHEN run_id < '1999' THEN 'v1' ELSE 'v2' END AS config_hash, row_count AS total_rows, row_count / 1000.0 AS duration_s
  FROM counts)
"""
