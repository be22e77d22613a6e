"""Contract rules, row flags and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import contract as C
from dqspark.operators.scoring import incident_risk, run_severity, score_violations
from dqspark.queries.base import (
    MONTH_CONTRACT,
    SEVERITY_SQL,
    faulted_orders,
    month_end,
    month_runs,
    month_signals,
    month_violations,
    query,
    table,
    with_sql,
)


def fact(name: str, kind: str = "double"):
    return F.element_at("evidence", name).cast(kind).alias(name)


def event_catalogue(spark, sf):
    """Columns that the JSON payload of each day really carries. Two days are planted: a renamed key and a
    value that turned into text."""
    day = F.to_date("ts")
    props = (
        F.when(day == F.lit("2024-01-10"), F.replace("props", F.lit('"k"'), F.lit('"kk"')))
        .when(day == F.lit("2024-01-20"), F.regexp_replace("props", r": (\d+)", ': "$1"'))
        .otherwise(F.col("props"))
    )
    pairs = F.from_json(props, "map<string,string>")
    quoted = props.contains(': "')
    return (
        table(spark, sf, "events")
        .select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.explode(F.map_keys(pairs)).alias("column"), quoted.alias("quoted"))
        .groupBy("run_id", "column")
        .agg(F.when(F.bool_or("quoted"), "string").otherwise("integer").alias("type"))
        .withColumn("ordinal", F.lit(0))
    )


@query(
    "check_schema",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id,
          CASE WHEN ts::DATE = DATE '2024-01-10' THEN replace(props, '"k"', '"kk"')
               WHEN ts::DATE = DATE '2024-01-20' THEN regexp_replace(props, ': (\\d+)', ': "\\1"') ELSE props END AS props FROM events),
       k AS (SELECT run_id, props, unnest(json_keys(props)) AS "column" FROM e),
       cat AS (SELECT run_id, "column", CASE WHEN bool_or(json_type(props, '$.' || "column") = 'VARCHAR') THEN 'string' ELSE 'integer' END AS type
               FROM k GROUP BY 1, 2),
       want AS (SELECT DISTINCT run_id, 'k' AS "column", 'integer' AS type FROM e)
       SELECT coalesce(c.run_id, w.run_id) AS run_id, coalesce(c."column", w."column") AS "column",
         CASE WHEN c."column" IS NULL THEN 'schema_missing_column' WHEN w."column" IS NULL THEN 'schema_unexpected_column'
              ELSE 'schema_type_mismatch' END AS rule_type,
         CASE WHEN w."column" IS NULL THEN 'medium' ELSE 'high' END AS severity
       FROM cat c FULL JOIN want w ON c.run_id = w.run_id AND c."column" = w."column"
       WHERE c."column" IS NULL OR w."column" IS NULL OR c.type <> w.type""",
)
def schema(spark, sf):
    found = C.check_schema(event_catalogue(spark, sf), {"k": "integer"}, ["run_id"])
    return found.select("run_id", "column", "rule_type", "severity")


@query(
    "rule_not_null",
    with_sql("SELECT run_id, round(ratio, 6) AS null_ratio FROM rule_v WHERE rule_type = 'completeness' AND \"column\" = 'o_totalprice'"),
)
def not_null(spark, sf):
    return C.rule_not_null(faulted_orders(spark, sf), "o_totalprice", 0.01, runs=["run_id"]).select("run_id", fact("null_ratio"))


@query(
    "rule_range",
    with_sql(
        """SELECT run_id, amount::BIGINT AS violation_count, round(ratio, 6) AS violation_ratio, sample_price AS sample_value
           FROM rule_v JOIN wide USING (run_id) WHERE rule_type = 'range'"""
    ),
)
def value_range(spark, sf):
    found = C.rule_range(faulted_orders(spark, sf), "o_totalprice", 0, 1_000_000, runs=["run_id"])
    return found.select("run_id", fact("violation_count", "bigint"), fact("violation_ratio"), fact("sample_value"))


@query(
    "rule_uniqueness",
    """SELECT 'l_orderkey,l_linenumber' AS "column", count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM lineitem""",
)
def uniqueness(spark, sf):
    found = C.rule_uniqueness(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    return found.select("column", fact("duplicate_count", "bigint"))


@query(
    "rule_freshness",
    with_sql("SELECT run_id, round(lag, 2) AS lag_minutes, 2880.0::DOUBLE AS max_lag_minutes FROM wide WHERE lag > 2880"),
)
def freshness(spark, sf):
    found = C.rule_freshness(faulted_orders(spark, sf), "o_orderdate", month_end(), 2880, runs=["run_id"])
    return found.select("run_id", fact("lag_minutes"), fact("max_lag_minutes"))


@query(
    "rule_allowed_values",
    with_sql(
        """SELECT run_id, to_json(list(DISTINCT o_orderstatus))::VARCHAR AS sample, count(*) AS violation_count
           FROM faulted WHERE o_orderstatus NOT IN ('F', 'O', 'P') GROUP BY run_id"""
    ),
)
def allowed(spark, sf):
    found = C.rule_allowed_values(faulted_orders(spark, sf), "o_orderstatus", ["F", "O", "P"], runs=["run_id"])
    return found.select("run_id", F.element_at("evidence", "sample").alias("sample"), fact("violation_count", "bigint"))


QUANTITIES = [1, 2.0, "3", 4, 5, 50]
DISCOUNTS = ["0.0", "0.01", "0.020"]
DATES = ["1995-03-02", "1996-01-01 00:00:00"]


@query(
    "bad_values",
    """SELECT 'l_quantity' AS "column", l_quantity::BIGINT::VARCHAR AS value, count(*) AS freq FROM lineitem WHERE l_quantity NOT IN (1, 2, 3, 4, 5, 50) GROUP BY 2
       UNION ALL SELECT 'l_discount', rtrim(rtrim(l_discount::DECIMAL(4,2)::VARCHAR, '0'), '.'), count(*) FROM lineitem WHERE l_discount NOT IN (0, 0.01, 0.02) GROUP BY 2
       UNION ALL SELECT 'l_shipdate', CASE WHEN l_shipdate = date_trunc('day', l_shipdate) THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END, count(*)
         FROM lineitem WHERE l_shipdate NOT IN (TIMESTAMP '1995-03-02', TIMESTAMP '1996-01-01') GROUP BY 2""",
)
def all_bad_values(spark, sf):
    """Every value outside a list, of a double column against integers, a double against decimal text, dates as text."""
    rules = {
        0: {"type": "allowed_values", "column": "l_quantity", "values": QUANTITIES},
        1: {"type": "allowed_values", "column": "l_discount", "values": DISCOUNTS},
        2: {"type": "allowed_values", "column": "l_shipdate", "values": DATES},
    }
    names = F.create_map(*[F.lit(x) for i, r in rules.items() for x in (i, r["column"])])
    return C.bad_values(table(spark, sf, "lineitem"), rules, []).select(names[F.col("rule")].alias("column"), "value", "freq")


@query(
    "rule_referential_typed",
    """SELECT count(*) AS orphan_count FROM lineitem WHERE l_discount::DECIMAL(8,4) NOT IN (SELECT l_tax::DECIMAL(8,4) FROM lineitem)""",
)
def typed_reference(spark, sf):
    """A double column against a table that holds the same numbers as DECIMAL."""
    known = table(spark, sf, "lineitem").select(F.col("l_tax").cast("decimal(8,4)").alias("k"))
    return C.rule_referential(table(spark, sf, "lineitem"), "l_discount", known).select(fact("orphan_count", "bigint"))


@query(
    "rule_row_count",
    with_sql("SELECT run_id, n AS row_count FROM wide WHERE n < 100 OR n > 250"),
)
def row_count(spark, sf):
    found = C.rule_row_count(faulted_orders(spark, sf), 100, 250, runs=["run_id"])
    return found.select("run_id", fact("row_count", "bigint"))


@query(
    "rule_column_compare",
    """SELECT count(*) FILTER (WHERE NOT (l_shipdate >= o_orderdate)) AS violation_count,
              round(count(*) FILTER (WHERE NOT (l_shipdate >= o_orderdate)) / count(*), 6) AS violation_ratio
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def column_compare(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = C.rule_column_compare(joined, "l_shipdate", ">=", "o_orderdate")
    return found.select(fact("violation_count", "bigint"), fact("violation_ratio"))


@query(
    "rule_referential",
    """WITH o AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
       SELECT count(*) AS orphan_count, (SELECT to_json(list(v ORDER BY v))::VARCHAR FROM
         (SELECT doc_id::VARCHAR AS v FROM o ORDER BY 1 LIMIT 5)) AS sample FROM o""",
)
def referential(spark, sf):
    found = C.rule_referential(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels").select("doc_id"))
    return found.select(fact("orphan_count", "bigint"), F.element_at("evidence", "sample").alias("sample"))


LINE_VIOLATIONS_SQL = """
SELECT 'lineitem' AS dataset, 'uniqueness' AS rule_type, 'l_orderkey,l_linenumber' AS "column",
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS amount FROM lineitem
UNION ALL SELECT 'lineitem', 'range', 'l_extendedprice', count(*) FILTER (WHERE l_extendedprice < 0 OR l_extendedprice > 50000) FROM lineitem
UNION ALL SELECT 'lineitem', 'column_compare', 'l_tax', count(*) FILTER (WHERE NOT (l_tax <= l_discount)) FROM lineitem
"""


def _amounts(found, dataset):
    amount = F.coalesce(
        fact("violation_count", "bigint"), fact("duplicate_count", "bigint"), fact("orphan_count", "bigint"), F.floor(fact("lag_minutes")).cast("bigint")
    )
    return found.select(F.lit(dataset).alias("dataset"), "rule_type", "column", amount.alias("amount"))


@query("check_contract", LINE_VIOLATIONS_SQL)
def whole_contract(spark, sf):
    found = C.check_contract(
        table(spark, sf, "lineitem"),
        C.builtin_contracts()["lineitem"],
        references={"orders": table(spark, sf, "orders").select("o_orderkey")},
    )
    return _amounts(found, "lineitem")


@query(
    "builtin_contracts",
    LINE_VIOLATIONS_SQL
    + """UNION ALL SELECT 'customer', 'range', 'c_acctbal', count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) FROM customer
         UNION ALL SELECT 'orders', 'freshness', 'o_orderdate',
           floor(date_diff('microsecond', max(o_orderdate), TIMESTAMP '2001-08-02 00:00:00') / 6e7)::BIGINT FROM orders""",
)
def builtin(spark, sf):
    contracts = C.builtin_contracts()
    references = {"orders": table(spark, sf, "orders").select("o_orderkey")}
    parts = [
        _amounts(C.check_contract(table(spark, sf, name), contracts[name], "2001-08-02 00:00:00", references), name)
        for name in ("lineitem", "customer", "orders")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ROW_CONTRACT = {
    "rules": [
        {"type": "range", "column": "l_extendedprice", "min": 0, "max": 50_000},
        {"type": "allowed_values", "column": "l_returnflag", "values": ["A", "N"]},
        {"type": "column_compare", "column": "l_tax", "operator": "<=", "other": "l_discount"},
        {"type": "uniqueness", "columns": ["l_orderkey", "l_linenumber"]},
    ]
}


@query(
    "flag_rows",
    """WITH f AS (SELECT concat_ws(';', CASE WHEN l_extendedprice < 0 OR l_extendedprice > 50000 THEN 'range:l_extendedprice' END,
         CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'allowed_values:l_returnflag' END,
         CASE WHEN NOT (l_tax <= l_discount) THEN 'column_compare:l_tax' END,
         CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'uniqueness:l_orderkey,l_linenumber' END) AS failed
         FROM lineitem)
       SELECT failed, count(*) AS n FROM f GROUP BY failed""",
)
def flags(spark, sf):
    flagged = C.flag_rows(table(spark, sf, "lineitem"), ROW_CONTRACT)
    return flagged.groupBy(F.concat_ws(";", "failed_rules").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "check_contract_by_run",
    with_sql(
        """SELECT run_id, rule_type, "column", CASE WHEN rule_type = 'freshness' THEN NULL ELSE amount::BIGINT END AS amount FROM rule_v"""
    ),
)
def by_run(spark, sf):
    found = C.check_contract_by_run(faulted_orders(spark, sf), {"rules": MONTH_CONTRACT["rules"]}, "run_id", month_end())
    sizes = faulted_orders(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    amount = F.coalesce(
        fact("violation_count", "bigint"),
        fact("duplicate_count", "bigint"),
        fact("row_count", "bigint"),
        F.round(fact("null_ratio") * F.col("n")).cast("bigint"),
    )
    return found.join(sizes, "run_id").select("run_id", "rule_type", "column", amount.alias("amount"))


@query(
    "score_violations",
    with_sql("""SELECT run_id, type, "column", score, severity FROM sig WHERE source = 'contract'"""),
)
def scored(spark, sf):
    return score_violations(month_violations(spark, sf)).select("run_id", "type", "column", "score", "severity")


@query(
    "severity",
    with_sql("SELECT severity, source, count(*) AS n, max(score) AS top FROM sig GROUP BY 1, 2"),
)
def severities(spark, sf):
    return month_signals(spark, sf).groupBy("severity", "source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


RISK_SQL = f"""
risk AS (
  SELECT run_id, count(s.run_id) AS signal_count,
    CASE WHEN count(s.run_id) = 0 THEN 0.0 ELSE
      round(least(1.0, CASE WHEN bool_or(source = 'contract') THEN 0.35 / 0.60 ELSE 0 END + 0.25 / 0.60 * max(score))::DECIMAL(28,10), 4)::DOUBLE END AS risk
  FROM (SELECT DISTINCT run_id FROM faulted) r LEFT JOIN sig s USING (run_id) GROUP BY run_id)
"""


@query(
    "incident_risk",
    with_sql(
        f"SELECT run_id, signal_count, risk::DOUBLE AS risk, CASE WHEN signal_count > 0 THEN {SEVERITY_SQL.format('risk')} ELSE 'low' END AS severity FROM risk",
        RISK_SQL,
    ),
)
def risk(spark, sf):
    return incident_risk(month_signals(spark, sf), ["run_id"], month_runs(spark, sf))


@query(
    "run_severity",
    with_sql(
        """SELECT run_id, CASE coalesce(max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END), 0)
             WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
           FROM (SELECT DISTINCT run_id FROM faulted) r LEFT JOIN sig USING (run_id) GROUP BY run_id"""
    ),
)
def worst(spark, sf):
    return run_severity(month_runs(spark, sf), month_signals(spark, sf))
