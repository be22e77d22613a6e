"""Profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators.profile import exact_quantiles, mask_sensitive, profile_by_run, profile_segments, profile_table
from dqspark.queries.base import monthly_orders, profile_sql, query, table

ORDERS = [
    ("o_orderkey", "numeric"),
    ("o_custkey", "numeric"),
    ("o_orderstatus", "categorical"),
    ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"),
    ("o_orderpriority", "categorical"),
]
LINES = [
    ("l_orderkey", "numeric"),
    ("l_partkey", "numeric"),
    ("l_suppkey", "numeric"),
    ("l_linenumber", "numeric"),
    ("l_quantity", "numeric"),
    ("l_extendedprice", "numeric"),
    ("l_discount", "numeric"),
    ("l_tax", "numeric"),
    ("l_returnflag", "categorical"),
    ("l_linestatus", "categorical"),
    ("l_shipdate", "datetime"),
]
LINE_NUMBERS = [c for c, k in LINES if k == "numeric"]


@query(
    "profile_table",
    f'SELECT "column", ordinal, kind, row_count, null_ratio, distinct_ratio FROM ({profile_sql("lineitem", LINES, "")})',
)
def profile(spark, sf):
    found = profile_table(table(spark, sf, "lineitem"), parts=("distinct",))
    return found.select("column", "ordinal", "kind", "row_count", "null_ratio", "distinct_ratio")


@query(
    "profile_numeric_stats",
    f"""SELECT "column", round(mean::DECIMAL(28,6), 3)::DOUBLE AS mean, round(stddev::DECIMAL(28,6), 3)::DOUBLE AS stddev, "min", "max"
        FROM ({profile_sql("lineitem", LINES, "")}) WHERE kind = 'numeric'""",
)
def numeric_stats(spark, sf):
    found = profile_table(table(spark, sf, "lineitem"), parts=())
    return found.filter("kind = 'numeric'").select(
        "column", F.round("mean", 3).alias("mean"), F.round("stddev", 3).alias("stddev"), "min", "max"
    )


@query(
    "profile_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
        round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(quantile_cont({c}::DOUBLE, 0.99), 4) AS p99 FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def quantiles(spark, sf):
    found = profile_table(table(spark, sf, "lineitem"), columns=LINE_NUMBERS, parts=("quantiles",))
    return found.select("column", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


@query(
    "profile_datetime_range",
    """SELECT 'events' AS dataset, 'ts' AS "column", min(ts) AS min_ts, max(ts) AS max_ts FROM events
       UNION ALL SELECT 'orders', 'o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders
       UNION ALL SELECT 'lineitem', 'l_shipdate', min(l_shipdate), max(l_shipdate) FROM lineitem""",
)
def datetime_range(spark, sf):
    parts = [
        profile_table(table(spark, sf, name), columns=[column], parts=()).select(
            F.lit(name).alias("dataset"), "column", "min_ts", "max_ts"
        )
        for name, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _top_sql(source: str, columns) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", v AS "value", n AS "count",
            row_number() OVER (ORDER BY n DESC, v) AS "rank"
            FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in columns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE \"rank\" <= 5"


@query("profile_top_values", _top_sql("part", ["p_name", "p_brand", "p_type"]))
def top_values(spark, sf):
    found = profile_table(table(spark, sf, "part"), columns=["p_name", "p_brand", "p_type"], parts=("top",))
    return found.select("column", F.posexplode("top_values").alias("rank", "t")).select(
        "column", (F.col("rank") + 1).cast("bigint").alias("rank"), "t.value", "t.count"
    )


def _hash_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'sha256:' || sha256(string_agg(v, '|' ORDER BY rn)) AS sample_hash FROM (
            SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY {c}::VARCHAR) AS rn FROM {source} WHERE {c} IS NOT NULL
        ) WHERE rn <= 200"""
        for c in columns
    )


HASHED = ["l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("profile_sample_hash", _hash_sql("lineitem", HASHED))
def sample_hash(spark, sf):
    return profile_table(table(spark, sf, "lineitem"), columns=HASHED, parts=("hash",)).select("column", "sample_hash")


SEGMENTED = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime")]


@query(
    "profile_segments",
    f"""WITH s AS (SELECT *, '["' || o_orderpriority || '", "' || o_orderstatus || '"]' AS segment FROM orders)
        SELECT segment, "column", row_count, null_ratio, distinct_ratio, round(mean::DECIMAL(28,6), 3)::DOUBLE AS mean
        FROM ({profile_sql("s", SEGMENTED, "segment")})""",
)
def segments(spark, sf):
    found = profile_segments(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], parts=("distinct",))
    return found.select("segment", "column", "row_count", "null_ratio", "distinct_ratio", F.round("mean", 3).alias("mean"))


@query(
    "profile_by_run",
    f"""WITH m AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS run_id FROM orders),
        q AS (SELECT run_id, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95,
              quantile_cont(o_totalprice, 0.99) AS p99 FROM m GROUP BY run_id)
        SELECT run_id, "column", row_count, null_ratio, distinct_ratio, round(mean::DECIMAL(28,6), 3)::DOUBLE AS mean, round(stddev::DECIMAL(28,6), 3)::DOUBLE AS stddev,
               CASE WHEN "column" = 'o_totalprice' THEN round(p50, 4) END AS price_p50,
               CASE WHEN "column" = 'o_totalprice' THEN round(p95, 4) END AS price_p95,
               CASE WHEN "column" = 'o_totalprice' THEN round(p99, 4) END AS price_p99
        FROM ({profile_sql("m", ORDERS)}) JOIN q USING (run_id)""",
)
def by_run(spark, sf):
    found = profile_by_run(monthly_orders(spark, sf), "run_id", parts=("distinct", "quantiles"))
    price = F.col("column") == "o_totalprice"
    return found.select(
        "run_id",
        "column",
        "row_count",
        "null_ratio",
        "distinct_ratio",
        F.round("mean", 3).alias("mean"),
        F.round("stddev", 3).alias("stddev"),
        *[F.when(price, F.round(p, 4)).alias(f"price_{p}") for p in ("p50", "p95", "p99")],
    )


@query(
    "mask_sensitive",
    f"""SELECT h."column", CASE WHEN h."column" <> 'c_name' THEN h.sample_hash END AS sample_hash,
               CASE WHEN h."column" <> 'c_name' THEN t.top_value END AS top_value
        FROM ({_hash_sql("customer", ["c_name", "c_mktsegment"])}) h
        JOIN (SELECT "column", "value" AS top_value FROM ({_top_sql("customer", ["c_name", "c_mktsegment"])}) WHERE "rank" = 1) t
        USING ("column")""",
)
def masked(spark, sf):
    found = profile_table(table(spark, sf, "customer"), columns=["c_name", "c_mktsegment"], parts=("top", "hash"))
    return mask_sensitive(found, ["c_name"]).select(
        "column", "sample_hash", F.col("top_values")[0]["value"].alias("top_value")
    )


@query(
    "profile_opaque",
    """SELECT 'embedding' AS "column", 'opaque' AS kind, count(*) AS row_count,
              round(1 - count(embedding) / count(*), 6) AS null_ratio, NULL::DOUBLE AS distinct_ratio FROM embeddings
       UNION ALL SELECT 'label', 'numeric', count(*), round(1 - count(label) / count(*), 6),
              round(count(DISTINCT label) / count(*), 6) FROM embeddings""",
)
def opaque(spark, sf):
    found = profile_table(table(spark, sf, "embeddings"), columns=["embedding", "label"], parts=("distinct",))
    return found.select("column", "kind", "row_count", "null_ratio", "distinct_ratio")


@query(
    "profile_long_text",
    """SELECT "column", row_count, null_ratio, distinct_ratio FROM ("""
    + profile_sql("documents", [("text", "categorical"), ("lang", "categorical"), ("source", "categorical"), ("n_chars", "numeric")], "")
    + ")",
)
def long_text(spark, sf):
    found = profile_table(table(spark, sf, "documents"), columns=["text", "lang", "source", "n_chars"], parts=("distinct",))
    return found.select("column", "row_count", "null_ratio", "distinct_ratio")


_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "profile_approx",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, round(1 - count({c}) / count(*), 6) AS null_ratio, round(avg({c}::DOUBLE)::DECIMAL(28,8), 3)::DOUBLE AS mean,
            true AS distinct_is_close, true AS median_is_close, true AS tail_is_close FROM lineitem"""
        for c in _LINE_NUMBERS
    ),
)
def approximate(spark, sf):
    """Sketch profile of the numbers, one scan: exact counts and means, and whether the sketches stay within their error:
    a fifth of the distinct count, four thousandths of the rank around the median and the 99th percentile."""
    rows = table(spark, sf, "lineitem").select(*_LINE_NUMBERS)
    sketch = profile_table(rows, exact=False)
    around = exact_quantiles(rows, list(_LINE_NUMBERS), (0.496, 0.504, 0.986, 0.994))
    counts = profile_table(rows, parts=("distinct",)).select("column", F.col("distinct_ratio").alias("exact"))
    return sketch.join(around.select("column", "q0", "q1", "q2", "q3"), "column").join(counts, "column").select(
        "column",
        "row_count",
        "null_ratio",
        F.round("mean", 3).alias("mean"),
        (F.abs(F.col("distinct_ratio") - F.col("exact")) <= 0.2 * F.col("exact")).alias("distinct_is_close"),
        F.col("p50").between(F.col("q0") - 1e-9, F.col("q1") + 1e-9).alias("median_is_close"),
        F.col("p99").between(F.col("q2") - 1e-9, F.col("q3") + 1e-9).alias("tail_is_close"),
    )
