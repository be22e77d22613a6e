"""Lineage artifacts as tables: transformation manifests and run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted event types and the manifest schema prefix of the public formats.
EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT", "OTHER")
MANIFEST_PREFIX = "https://schemas.getdbt.com/dbt/manifest/v"

_NODE = (
    "struct<name:string,resource_type:string,relation_name:string,raw_code:string,raw_sql:string,"
    "owner:string,depends_on:struct<nodes:array<string>>,columns:map<string,string>,config:string>"
)
MANIFEST = (
    "struct<metadata:struct<dbt_schema_version:string,generated_at:string>,"
    f"nodes:map<string,{_NODE}>,sources:map<string,{_NODE}>,exposures:map<string,{_NODE}>>"
)
RESULTS = "struct<results:array<struct<unique_id:string,status:string,execution_time:double>>>"

_DATASET = "struct<namespace:string,name:string>"
_OUTPUT = (
    "struct<namespace:string,name:string,facets:struct<columnLineage:struct<fields:map<string,"
    "struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>>"
)
EVENT = (
    "eventType string, eventTime string, run struct<runId:string>, job struct<namespace:string,name:string>, "
    f"inputs array<{_DATASET}>, outputs array<{_OUTPUT}>"
)


def read_dbt_manifest(
    spark: SparkSession, path: str, results_path: str | None = None, namespace: str = "dbt"
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, runs) of manifest files; `path` may match many projects' manifests."""
    nodes, edges = parse_manifests(spark.read.text(path, wholetext=True), namespace)
    runs = parse_run_results(spark.read.text(results_path, wholetext=True), nodes) if results_path else None
    return nodes, edges, runs


def parse_manifests(texts: DataFrame, namespace: str | Column = "dbt") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a `value` column of manifest JSON. Edges lead from parent to child and only to
    parents the manifest knows. A manifest without the public schema version is an error."""
    space = namespace if isinstance(namespace, Column) else F.lit(namespace)
    parsed = texts.select(space.alias("namespace"), F.from_json("value", MANIFEST).alias("m"))
    version = F.coalesce(F.col("m.metadata.dbt_schema_version"), F.lit(""))
    checked = parsed.withColumn(
        "m", F.when(version.startswith(MANIFEST_PREFIX), F.col("m")).otherwise(F.raise_error(F.lit("manifest schema version needed")))
    )
    merged = F.map_concat(
        *[F.coalesce(F.col(f"m.{part}"), F.from_json(F.lit("{}"), f"map<string,{_NODE}>")) for part in ("sources", "nodes", "exposures")]
    )
    node = F.col("node")
    exploded = checked.select("namespace", F.explode(merged).alias("uid", "node"))
    definition = F.to_json(
        F.struct(
            F.coalesce(node["raw_code"], node["raw_sql"], F.lit("")).alias("code"),
            node["config"].alias("config"),
            node["columns"].alias("columns"),
            node["depends_on"].alias("depends_on"),
        )
    )
    nodes = exploded.select(
        "namespace",
        "uid",
        F.coalesce(node["name"], F.col("uid")).alias("name"),
        F.coalesce(node["resource_type"], F.lit("source")).alias("type"),
        node["relation_name"].alias("relation"),
        F.array_sort(F.map_keys(F.coalesce(node["columns"], F.from_json(F.lit("{}"), "map<string,string>")))).alias("columns"),
        F.sha2(definition, 256).alias("checksum"),
    )
    children = exploded.select("namespace", F.col("uid").alias("dst"), F.explode(node["depends_on"]["nodes"]).alias("src"))
    # A node may be declared in many manifests of a namespace; one row per node keeps the joins linear.
    unique = nodes.groupBy("namespace", "uid").agg(F.min("type").alias("type"))
    known = unique.select("namespace", F.col("uid").alias("src"), F.col("type").alias("src_type"))
    kinds = unique.select("namespace", F.col("uid").alias("dst"), F.col("type").alias("dst_type"))
    edges = (
        children.distinct()
        .join(known, ["namespace", "src"])
        .join(kinds, ["namespace", "dst"])
        .select("namespace", "src", "src_type", "dst", "dst_type", F.lit("FEEDS").alias("edge_type"))
    )
    return nodes, edges


def parse_run_results(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(asset, status, execution_time, known); `known` is false for results of another project."""
    rows = texts.select(F.explode(F.from_json("value", RESULTS)["results"]).alias("r"))
    ids = nodes.select(F.col("uid").alias("asset"), F.lit(True).alias("_known")).distinct()
    return (
        rows.select(F.col("r.unique_id").alias("asset"), "r.status", "r.execution_time")
        .join(ids, "asset", "left")
        .withColumn("known", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def _key(item: Column) -> Column:
    return F.concat(item["namespace"], F.lit("::"), item["name"])


def _named(item: Column) -> Column:
    return (F.coalesce(item["namespace"], F.lit("")) != "") & (F.coalesce(item["name"], F.lit("")) != "")


def valid_event() -> Column:
    """Event type, run id, time and every job and dataset name are present."""
    fields = F.flatten(
        F.transform(
            F.coalesce(F.col("outputs"), F.array()),
            lambda o: F.flatten(
                F.transform(
                    F.coalesce(F.map_values(o["facets"]["columnLineage"]["fields"]), F.array()),
                    lambda s: F.coalesce(s["inputFields"], F.array()),
                )
            ),
        )
    )
    return (
        F.coalesce(F.col("eventType").isin(*EVENT_TYPES), F.lit(False))
        & (F.coalesce(F.col("run.runId"), F.lit("")) != "")
        & (F.coalesce(F.col("eventTime"), F.lit("")) != "")
        & _named(F.col("job"))
        & F.forall(F.coalesce(F.col("inputs"), F.array()), _named)
        & F.forall(F.coalesce(F.col("outputs"), F.array()), _named)
        & F.forall(fields, lambda f: (F.coalesce(f["field"], F.lit("")) != "") & _named(f))
    )


def event_edges(events: DataFrame) -> DataFrame:
    """(src, src_type, dst, dst_type, edge_type) of valid events, batch or stream."""
    job = F.concat(F.lit("job::"), _key(F.col("job")))
    reads = F.transform(
        F.coalesce(F.col("inputs"), F.array()),
        lambda d: F.struct(
            _key(d).alias("src"), F.lit("dataset").alias("src_type"), job.alias("dst"), F.lit("job").alias("dst_type"),
            F.lit("READS_FROM").alias("edge_type"),
        ),
    )
    writes = F.transform(
        F.coalesce(F.col("outputs"), F.array()),
        lambda d: F.struct(
            job.alias("src"), F.lit("job").alias("src_type"), _key(d).alias("dst"), F.lit("dataset").alias("dst_type"),
            F.lit("WRITES_TO").alias("edge_type"),
        ),
    )
    return events.select(F.inline(F.concat(reads, writes)))


def read_openlineage(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, column_edges, runs, rejects) of events read with the `EVENT` schema. Column edges come
    only from the columnLineage facet; nothing is derived from inputs and outputs."""
    checked = events.withColumn("_ok", valid_event())
    good = checked.filter("_ok").drop("_ok")
    rejects = checked.filter("not _ok").drop("_ok")
    edges = event_edges(good).distinct()
    nodes = (
        edges.select(F.col("src").alias("uid"), F.col("src_type").alias("type"))
        .unionByName(edges.select(F.col("dst").alias("uid"), F.col("dst_type").alias("type")))
        .unionByName(good.select(F.concat(F.lit("job::"), _key(F.col("job"))).alias("uid"), F.lit("job").alias("type")))
        .distinct()
        .withColumn("name", F.element_at(F.split("uid", "::"), -1))
    )
    fields = good.select(F.explode("outputs").alias("o")).select(
        _key(F.col("o")).alias("dst_asset"), F.explode("o.facets.columnLineage.fields").alias("dst_col", "spec")
    )
    column_edges = (
        fields.select("dst_asset", F.lower("dst_col").alias("dst_col"), F.explode("spec.inputFields").alias("f"))
        .select(_key(F.col("f")).alias("src_asset"), F.lower("f.field").alias("src_col"), "dst_asset", "dst_col")
        .distinct()
    )
    runs = good.select(
        F.concat(F.lit("job::"), _key(F.col("job"))).alias("asset"),
        F.col("run.runId").alias("run_id"),
        F.col("eventType").alias("status"),
        F.col("eventTime").alias("event_time"),
    )
    return nodes, edges, column_edges, runs, rejects
