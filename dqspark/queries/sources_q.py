"""Scans, sinks, lineage artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.queries.base import MONTH_CONTRACT, month_profiles, month_signals, query, table, with_sql
from dqspark.runtime import scratch_path
from dqspark.sources.lineage_events import EVENT, parse_manifests, read_openlineage
from dqspark.sources.tables import (
    append_table,
    cast_to_contract,
    load_profiles,
    load_signals,
    load_snapshot,
    read_csv_typed,
    read_table,
    save_profiles,
    save_signals,
    save_snapshot,
    scan_coverage,
)

START, END = "1996-01-01", "1997-01-01"


@query(
    "scan_table",
    f"""SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '{END}'""",
)
def scan(spark, sf):
    bounds = [F.to_timestamp_ntz(F.lit(d)) for d in (START, END)]
    return read_table(
        spark, f"{sf}/orders.parquet", partition=("o_orderdate", *bounds), columns=["o_orderkey", "o_totalprice"]
    )


@query(
    "scan_ordered_budget",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1000",
)
def scan_budget(spark, sf):
    return read_table(
        spark, f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice"], order_by=["o_totalprice", "o_orderkey"], max_rows=1000
    )


@query(
    "scan_coverage",
    """SELECT 'table' AS scope, 'ordered_prefix' AS method, count(*) AS total_rows,
              least(count(*), 10000)::BIGINT AS scanned_rows, count(*) <= 10000 AS complete FROM lineitem""",
)
def coverage(spark, sf):
    return scan_coverage(table(spark, sf, "lineitem"), max_rows=10_000)


@query(
    "read_csv_typed",
    """SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum("value"), 4) AS total, strftime(max(ts), '%Y-%m-%d') AS last_note,
         'event_id bigint, event_time timestamp_ntz, event_type string, value double, note string' AS types FROM events GROUP BY event_type""",
)
def csv_typed(spark, sf):
    path = scratch_path(spark, "csv")
    events = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"), "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("note"))
    events.write.option("header", True).csv(path)
    typed = read_csv_typed(spark, path)
    return typed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_time").cast("timestamp_ntz").alias("first_ts"),
        F.max("event_time").cast("timestamp_ntz").alias("last_ts"),
        F.round(F.sum("value"), 4).alias("total"),
        F.max("note").alias("last_note"),
        F.lit(", ".join(f"{c} {t}" for c, t in typed.dtypes)).alias("types"),
    )


@query("cast_to_contract", "SELECT o_orderkey, o_orderdate FROM orders")
def cast_contract(spark, sf):
    text = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    return cast_to_contract(text, MONTH_CONTRACT)


@query(
    "save_snapshot",
    """SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS first_day, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY o_orderpriority""",
)
def snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    save_snapshot(table(spark, sf, "orders"), path, "r1")
    return (
        load_snapshot(spark, path, "r1")
        .groupBy("o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderdate").alias("first_day"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
        )
    )


@query("append_table", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def append(spark, sf):
    path = scratch_path(spark, "append")
    for _ in range(2):
        append_table(table(spark, sf, "events"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "save_profiles",
    with_sql('SELECT run_id, "column", row_count, null_ratio, round(mean::DECIMAL(28,6), 3)::DOUBLE AS mean FROM p'),
)
def profiles_saved(spark, sf):
    path = scratch_path(spark, "profiles")
    rows = month_profiles(spark, sf).withColumn("dataset", F.lit("orders"))
    for _ in range(2):
        save_profiles(rows, path)
    return load_profiles(spark, path).select("run_id", "column", "row_count", "null_ratio", F.round("mean", 3).alias("mean"))


@query("save_signals", with_sql('SELECT signal_id, type, "column", severity, score FROM sig'))
def signals_saved(spark, sf):
    path = scratch_path(spark, "signals")
    rows = month_signals(spark, sf).withColumn("dataset", F.lit("orders"))
    for _ in range(2):
        save_signals(rows, path)
    return load_signals(spark, path).select("signal_id", "type", "column", "severity", "score")


def manifests(spark, sf):
    """One manifest per part: a model that depends on its brand and on a parent the manifest does not know."""
    part = F.concat(F.lit("model.part."), F.col("p_partkey").cast("string"))
    brand = F.concat(F.lit("source.brand."), F.col("p_brand"))
    node = F.struct(
        F.col("p_name").alias("name"),
        F.lit("model").alias("resource_type"),
        F.concat(F.lit("select "), F.col("p_type")).alias("raw_code"),
        F.struct(F.array(brand, F.lit("source.unknown")).alias("nodes")).alias("depends_on"),
    )
    source = F.struct(F.col("p_brand").alias("name"), F.lit("source").alias("resource_type"))
    return table(spark, sf, "part").select(
        F.to_json(
            F.struct(
                F.struct(F.lit("https://schemas.getdbt.com/dbt/manifest/v12.json").alias("dbt_schema_version")).alias("metadata"),
                F.create_map(part, node).alias("nodes"),
                F.create_map(brand, source).alias("sources"),
            )
        ).alias("value")
    )


@query(
    "read_dbt_manifest",
    """SELECT 'source.brand.' || p_brand AS src, 'source' AS src_type, 'model.part.' || p_partkey AS dst,
              'model' AS dst_type, 'FEEDS' AS edge_type FROM part""",
)
def dbt_edges(spark, sf):
    return parse_manifests(manifests(spark, sf))[1].drop("namespace")


@query(
    "read_dbt_manifest_nodes",
    """SELECT 'model.part.' || p_partkey AS uid, p_name AS name, 'model' AS type FROM part
       UNION ALL SELECT DISTINCT 'source.brand.' || p_brand, p_brand, 'source' FROM part""",
)
def dbt_nodes(spark, sf):
    return parse_manifests(manifests(spark, sf))[0].select("uid", "name", "type").distinct()


def run_events(spark, sf):
    """One run event per order: the status job of a priority reads the customer and writes the order, with
    one column edge. Events of status P carry a type the format does not know."""
    event = F.struct(
        F.when(F.col("o_orderstatus") == "P", "BROKEN").otherwise("COMPLETE").alias("eventType"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.struct(F.col("o_orderkey").cast("string").alias("runId")).alias("run"),
        F.struct(F.col("o_orderpriority").alias("namespace"), F.col("o_orderstatus").alias("name")).alias("job"),
        F.array(F.struct(F.lit("customer").alias("namespace"), F.col("o_custkey").cast("string").alias("name"))).alias("inputs"),
        F.array(
            F.struct(
                F.lit("order").alias("namespace"),
                F.col("o_orderkey").cast("string").alias("name"),
                F.struct(
                    F.struct(
                        F.create_map(
                            F.lit("Total"),
                            F.struct(
                                F.array(
                                    F.struct(
                                        F.lit("customer").alias("namespace"),
                                        F.col("o_custkey").cast("string").alias("name"),
                                        F.lit("Balance").alias("field"),
                                    )
                                ).alias("inputFields")
                            ),
                        ).alias("fields")
                    ).alias("columnLineage")
                ).alias("facets"),
            )
        ).alias("outputs"),
    )
    text = table(spark, sf, "orders").select(F.to_json(event).alias("value"))
    return text.select(F.from_json("value", EVENT).alias("e")).select("e.*")


_JOB = "'job::' || o_orderpriority || '::' || o_orderstatus"
EVENT_EDGES_SQL = f"""
SELECT DISTINCT 'customer::' || o_custkey AS src, 'dataset' AS src_type, {_JOB} AS dst, 'job' AS dst_type, 'READS_FROM' AS edge_type
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT DISTINCT {_JOB}, 'job', 'order::' || o_orderkey, 'dataset', 'WRITES_TO' FROM orders WHERE o_orderstatus <> 'P'
"""


@query("read_openlineage", EVENT_EDGES_SQL)
def event_edges_q(spark, sf):
    return read_openlineage(run_events(spark, sf))[1]


@query(
    "read_openlineage_columns",
    """SELECT DISTINCT 'customer::' || o_custkey AS src_asset, 'balance' AS src_col, 'order::' || o_orderkey AS dst_asset,
              'total' AS dst_col FROM orders WHERE o_orderstatus <> 'P'""",
)
def event_columns_q(spark, sf):
    return read_openlineage(run_events(spark, sf))[2]


@query(
    "read_openlineage_rejects",
    "SELECT o_orderpriority AS namespace, count(*) AS rejected FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
)
def event_rejects_q(spark, sf):
    rejects = read_openlineage(run_events(spark, sf))[4]
    return rejects.groupBy(F.col("job.namespace").alias("namespace")).agg(F.count(F.lit(1)).alias("rejected"))

