"""Contract drafts, data diff, repair and faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.columns import nice_bounds
from dqspark.operators import diff as X
from dqspark.operators import faults as Y
from dqspark.operators import repair as R
from dqspark.operators.contract import builtin_contracts, check_contract
from dqspark.operators.ops import detection_cases, detection_metrics
from dqspark.operators.suggest import suggest_contract
from dqspark.plans.fault_matrix import fault_cases, fault_matrix
from dqspark.queries.base import ORACLES, query, table

# ------------------------------------------------------------------ drafts

_UP = "CASE WHEN {v} = 0 THEN 0.0 ELSE round(ceil({v} / pow(10.0, floor(log10(abs({v}))) - 1)) * pow(10.0, floor(log10(abs({v}))) - 1), 6) END"
_DOWN = "CASE WHEN {v} = 0 THEN 0.0 ELSE round(floor({v} / pow(10.0, floor(log10(abs({v}))) - 1)) * pow(10.0, floor(log10(abs({v}))) - 1), 6) END"
_MARGIN = "greatest((hi - lo) * 0.5, abs(hi) * 0.1, CASE WHEN hi = lo THEN 1.0 ELSE 0.0 END)"
LOW_SQL = f"CASE WHEN lo >= 0 THEN 0.0 ELSE {_DOWN.format(v='(lo - ' + _MARGIN + ')')} END"
HIGH_SQL = _UP.format(v="(hi + " + _MARGIN + ")")


@query(
    "nice_bounds",
    f"""SELECT c_nationkey, ({LOW_SQL})::DOUBLE AS lower, ({HIGH_SQL})::DOUBLE AS upper
        FROM (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)""",
)
def nice(spark, sf):
    limits = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    lower, upper = nice_bounds(F.col("lo"), F.col("hi"))
    return limits.select("c_nationkey", lower.alias("lower"), upper.alias("upper"))


def _rules_sql(source: str, columns) -> str:
    parts = []
    for name, kind, keyed in columns:
        base = f"FROM (SELECT count(*) AS n, count({name}) AS k, count(DISTINCT {name}) AS d FROM {source})"
        limit = "CASE WHEN k = n THEN 0.0 ELSE round(least(1.0, greatest(0.01, 2 * (1 - k / n))), 4) END" if keyed else "round(least(1.0, greatest(0.01, 2 * (1 - k / n))), 4)"
        parts.append(
            f"""SELECT 'not_null' AS type, '{name}' AS "column", ({limit})::DOUBLE AS max_null_ratio, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
                NULL::VARCHAR AS "values" {base} WHERE 1 - k / n <= 0.2"""
        )
        if keyed:
            parts.append(f"SELECT 'uniqueness', '{name}', NULL, NULL, NULL, NULL {base} WHERE d = n")
        elif kind == "number":
            parts.append(
                f"""SELECT 'range', '{name}', NULL, ({LOW_SQL})::DOUBLE, ({HIGH_SQL})::DOUBLE, NULL
                    FROM (SELECT min({name}::DOUBLE) AS lo, max({name}::DOUBLE) AS hi FROM {source})"""
            )
        elif kind == "string":
            parts.append(
                f"""SELECT 'allowed_values', '{name}', NULL, NULL, NULL, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {name} AS v FROM {source} WHERE {name} IS NOT NULL))
                    {base} WHERE n >= 50 AND d BETWEEN 2 AND 12 AND d / k <= 0.2"""
            )
    return " UNION ALL ".join(parts)


SUGGESTED = [
    ("o_orderkey", "number", True),
    ("o_custkey", "number", False),
    ("o_orderstatus", "string", False),
    ("o_totalprice", "number", False),
    ("o_orderdate", "time", False),
    ("o_orderpriority", "string", False),
]


@query("suggest_contract", _rules_sql("orders", SUGGESTED))
def suggest(spark, sf):
    _, rules = suggest_contract(table(spark, sf, "orders"), key_columns=["o_orderkey"])
    return rules.select(
        "type", "column", "max_null_ratio", F.col("min").alias("low"), F.col("max").alias("high"), F.when(F.col("values").isNotNull(), F.array_join("values", ",")).alias("values")
    )


# ------------------------------------------------------------------ diff


def edited_orders(spark, sf):
    """The next version of orders: urgent orders repriced, pending ones re-prioritised, the largest prices
    deleted, small prices copied under new keys."""
    orders = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    changed = orders.filter("o_totalprice <= 490000").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(urgent, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    added = orders.filter("o_totalprice < 10000").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return changed.unionByName(added)


EDIT_SQL = """
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
        o_orderdate, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_totalprice <= 490000
      UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice < 10000),
j AS (SELECT b.o_orderkey AS bk, a.o_orderkey AS ak, b.o_totalprice AS bp, a.o_totalprice AS ap, b.o_orderpriority AS bq, a.o_orderpriority AS aq,
        (b.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND b.o_totalprice IS DISTINCT FROM a.o_totalprice)::INT AS p_changed,
        (b.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND b.o_orderpriority IS DISTINCT FROM a.o_orderpriority)::INT AS q_changed
      FROM orders b FULL JOIN a USING (o_orderkey)),
d AS (SELECT count(*) FILTER (WHERE bk IS NULL) AS added_rows, count(*) FILTER (WHERE ak IS NULL) AS removed_rows,
        count(*) FILTER (WHERE p_changed + q_changed > 0) AS changed_rows, sum(p_changed + q_changed)::BIGINT AS changed_cells, count(*) AS n FROM j)
"""


@query(
    "data_diff",
    f"""WITH {EDIT_SQL} SELECT added_rows, removed_rows, changed_rows, changed_cells, round((added_rows + removed_rows + changed_rows) / n, 6) AS change_ratio,
        FALSE AS schema_changed, (added_rows + removed_rows + changed_rows) / n <= 0.1 AS passed FROM d""",
)
def data_diff(spark, sf):
    return X.data_diff(table(spark, sf, "orders"), edited_orders(spark, sf), ["o_orderkey"], 0.1)


@query("data_diff_fingerprint", ORACLES["data_diff"])
def data_diff_fingerprint(spark, sf):
    return X.data_diff(table(spark, sf, "orders"), edited_orders(spark, sf), ["o_orderkey"], 0.1, fingerprint=True)


@query(
    "diff_by_column",
    f"""WITH {EDIT_SQL} SELECT 'o_totalprice' AS "column", sum(p_changed)::BIGINT AS changed_cells FROM j
        UNION ALL SELECT 'o_orderpriority', sum(q_changed)::BIGINT FROM j""",
)
def diff_by_column(spark, sf):
    return X.diff_by_column(table(spark, sf, "orders"), edited_orders(spark, sf), ["o_orderkey"])


@query(
    "diff_samples",
    f"""WITH {EDIT_SQL}, s AS (
          SELECT 'changed' AS change, bk AS o_orderkey, concat_ws(',', CASE WHEN p_changed = 1 THEN 'o_totalprice' END,
            CASE WHEN q_changed = 1 THEN 'o_orderpriority' END) AS columns FROM j WHERE p_changed + q_changed > 0
          UNION ALL SELECT 'added', ak, '' FROM j WHERE bk IS NULL UNION ALL SELECT 'removed', bk, '' FROM j WHERE ak IS NULL)
        SELECT change, o_orderkey, columns FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY o_orderkey) AS k FROM s) WHERE k <= 5""",
)
def diff_samples(spark, sf):
    found = X.diff_samples(table(spark, sf, "orders"), edited_orders(spark, sf), ["o_orderkey"])
    return found.select("change", "o_orderkey", F.array_join(F.transform("changes", lambda c: c["column"]), ",").alias("columns"))


@query(
    "diff_totals",
    f"""WITH {EDIT_SQL} SELECT 'o_custkey' AS "column", (SELECT sum(o_custkey) FROM orders)::DOUBLE AS before, (SELECT sum(o_custkey) FROM a)::DOUBLE AS after
        UNION ALL SELECT 'o_totalprice', (SELECT round(sum(o_totalprice), 2) FROM orders), (SELECT round(sum(o_totalprice), 2) FROM a)""",
)
def diff_totals(spark, sf):
    found = X.diff_totals(table(spark, sf, "orders"), edited_orders(spark, sf), ["o_orderkey"])
    return found.select("column", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


@query(
    "quality_gate",
    f"""WITH {EDIT_SQL}, r AS (
          SELECT 'diff' AS "check", (added_rows + removed_rows + changed_rows) / n <= 0.5 AS passed FROM d
          UNION ALL SELECT 'contract:range', FALSE FROM a HAVING count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 500000) > 0
          UNION ALL SELECT 'contract:completeness', FALSE FROM a HAVING 1 - count(o_orderpriority) / count(*) > 0.01)
        SELECT "check", passed FROM r UNION ALL SELECT 'gate', bool_and(passed) FROM r""",
)
def gate(spark, sf):
    contract = {
        "rules": [
            {"type": "range", "column": "o_totalprice", "min": 0, "max": 500_000},
            {"type": "not_null", "column": "o_orderpriority", "max_null_ratio": 0.01},
        ]
    }
    found = X.quality_gate(table(spark, sf, "orders"), edited_orders(spark, sf), contract, ["o_orderkey"], 0.5)
    name = F.when(F.col("check") == "contract", F.concat_ws(":", "check", F.substring_index("detail", ":", 1))).otherwise(F.col("check"))
    return found.select(name.alias("check"), "passed")


# ------------------------------------------------------------------ repair


def damaged_orders(spark, sf):
    """One batch (status P) was loaded a hundred times too large."""
    return Y.fault_scale(table(spark, sf, "orders"), "o_totalprice", 100.0, F.col("o_orderstatus") == "P")


PRICE_RULE = {"rules": [{"type": "range", "column": "o_totalprice", "min": 0, "max": 1_000_000}]}
KEY_RULE = {"rules": [{"type": "uniqueness", "column": "o_orderkey"}]}


@query(
    "repair_scale",
    """SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 100 * 0.01 ELSE o_totalprice END), 2) AS total
       FROM orders GROUP BY 1""",
)
def repair_scale(spark, sf):
    fixed = R.repair_scale(damaged_orders(spark, sf), "o_totalprice", 0.01, {"o_orderstatus": "P"}, max_changed_rows=10**12)
    return fixed.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("repair_deduplicate", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def repair_dedup(spark, sf):
    fixed = R.repair_deduplicate(Y.fault_duplicate(table(spark, sf, "orders")), ["o_orderkey"], max_changed_rows=10**12)
    return fixed.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "validate_repair",
    """SELECT 'scale' AS repair, TRUE AS passed, count(*) FILTER (WHERE o_orderstatus = 'P') AS changed_rows, count(*) AS before_rows,
         count(*) AS after_rows, 1::BIGINT AS before_violations, 0::BIGINT AS after_violations, TRUE AS unchanged_control_passed FROM orders
       UNION ALL SELECT 'deduplicate', TRUE, count(*), 2 * count(*), count(*), 1, 0, TRUE FROM orders
       UNION ALL SELECT 'wrong batch', FALSE, count(*) FILTER (WHERE o_orderstatus = 'O'), count(*), count(*), 1, 1, TRUE FROM orders""",
)
def validate(spark, sf):
    broken = damaged_orders(spark, sf)
    doubled = Y.fault_duplicate(table(spark, sf, "orders"))
    every = 10**12

    def scaled(status):
        where = {"o_orderstatus": status}
        fixed = R.repair_scale(broken, "o_totalprice", 0.01, where, every)
        return R.validate_repair(broken, fixed, PRICE_RULE, every, where=where)

    cases = {
        "scale": scaled("P"),
        "wrong batch": scaled("O"),
        "deduplicate": R.validate_repair(doubled, R.repair_deduplicate(doubled, ["o_orderkey"], every), KEY_RULE, every),
    }
    parts = [found.select(F.lit(name).alias("repair"), "*") for name, found in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ faults


@query(
    "fault_drop_column",
    """SELECT 'schema_missing_column' AS rule_type, 'o_custkey' AS "column", count(*) AS "rows" FROM orders GROUP BY 1, 2""",
)
def drop_column(spark, sf):
    broken = Y.fault_drop_column(table(spark, sf, "orders"), "o_custkey")
    found = check_contract(broken, {"expected_schema": builtin_contracts()["orders"]["expected_schema"], "rules": [{"type": "row_count", "max_rows": 0}]})
    rows = F.max(F.element_at("evidence", "row_count").cast("bigint"))
    return found.agg(F.max(F.when(F.col("rule_type") != "row_count", F.col("rule_type"))).alias("rule_type"), F.max("column").alias("column"), rows.alias("rows"))


@query(
    "fault_recode",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders""",
)
def recode(spark, sf):
    return Y.fault_recode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "fault_null_spike",
    """WITH k AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey || ':42'), 1, 13))::BIGINT) AS rn, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.40)::BIGINT THEN NULL ELSE o_totalprice END AS o_totalprice FROM k""",
)
def null_spike(spark, sf):
    return Y.fault_null_spike(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("fault_duplicate", "SELECT o_orderkey, 2::BIGINT AS copies FROM orders")
def duplicate(spark, sf):
    return Y.fault_duplicate(table(spark, sf, "orders")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "fault_duplicate_share",
    """SELECT 1 + (('0x' || substr(md5(o_orderkey || ':42'), 1, 13))::BIGINT < floor(0.25 * pow(16, 13))::BIGINT)::BIGINT AS copies, count(*) AS keys
       FROM orders GROUP BY 1""",
)
def duplicate_share(spark, sf):
    copies = Y.fault_duplicate(table(spark, sf, "orders"), 0.25, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))
    return copies.groupBy("copies").agg(F.count(F.lit(1)).alias("keys"))


@query("fault_scale", "SELECT o_orderkey, round(o_totalprice * 100.0, 4) AS o_totalprice FROM orders")
def scale(spark, sf):
    return Y.fault_scale(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("fault_delay", "SELECT event_id, ts - INTERVAL 3 HOUR AS ts FROM events")
def delay(spark, sf):
    return Y.fault_delay(table(spark, sf, "events").select("event_id", "ts"), "ts")


FAULT_COLUMNS = {"drop": "o_custkey", "recode": "o_orderstatus", "amount": "o_totalprice", "key": "o_orderkey", "time": "o_orderdate"}


def _fault_inputs(spark, sf):
    from datetime import timedelta

    orders = table(spark, sf, "orders")
    # The moment of the check follows the data: an hour after the newest order.
    as_of = orders.agg(F.max("o_orderdate")).first()[0] + timedelta(hours=1)
    return orders, builtin_contracts()["orders"], as_of


# The catalogue again, in SQL: faulted copies of orders, their cells, the signals of contract and drift, the root causes.
# Written out here are only the contract, the score rules and what each fault must raise.
_FAULTS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS ts, o_orderpriority AS prio FROM orders),
ranked AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(k || ':42'), 1, 13))::BIGINT) AS rn, count(*) OVER () AS n,
                  dense_rank() OVER (ORDER BY status) - 1 AS code FROM o),
copies AS (
  SELECT 'clean' AS f, k, cust, status, price, ts, prio FROM o
  UNION ALL SELECT 'F01', k, cust, status, price, ts, prio FROM o
  UNION ALL SELECT 'F02', k, cust, code::VARCHAR, price, ts, prio FROM ranked
  UNION ALL SELECT 'F03', k, cust, status, CASE WHEN rn > floor(n * 0.40) THEN price END, ts, prio FROM ranked
  UNION ALL SELECT 'F04', k, cust, status, price, ts, prio FROM o, range(2)
  UNION ALL SELECT 'F05', k, cust, status, price * 100, ts, prio FROM o
  UNION ALL SELECT 'F06', k, cust, status, price, ts - INTERVAL 3 HOUR, prio FROM o
),
cells AS (
  SELECT f, 'o_orderkey' AS c, k::VARCHAR AS v, k::DOUBLE AS x FROM copies
  UNION ALL SELECT f, 'o_custkey', cust::VARCHAR, cust::DOUBLE FROM copies WHERE f <> 'F01'
  UNION ALL SELECT f, 'o_orderstatus', status, NULL FROM copies
  UNION ALL SELECT f, 'o_totalprice', price::VARCHAR, price::DOUBLE FROM copies
  UNION ALL SELECT f, 'o_orderdate', ts::VARCHAR, NULL FROM copies
  UNION ALL SELECT f, 'o_orderpriority', prio, NULL FROM copies
),
st AS (SELECT f, c, count(*) AS n, count(v) AS filled, count(DISTINCT v) AS d, 1 - count(v) / count(*) AS nulls, avg(x) AS m, coalesce(stddev_pop(x), 0) AS sd,
              bool_and(regexp_full_match(v, '[0-9]+')) AS digits FROM cells GROUP BY 1, 2),
facts AS (SELECT f, avg((price < 0 OR price > 1000000)::INT) AS outside, avg((status NOT IN ('F', 'O', 'P'))::INT) AS unlisted,
                 date_diff('second', max(ts), (SELECT max(ts) + INTERVAL 1 HOUR FROM o)) / 60.0 AS lag FROM copies GROUP BY 1),
pairs AS (SELECT s.f, s.c, s.n, s.filled, s.d / s.n AS dr, s.d, s.nulls, s.m, b.n AS bn, b.filled AS bfilled, b.d / b.n AS bdr, b.d AS bd, b.nulls AS bnulls, b.m AS bm, b.sd AS bsd,
                 (s.m - b.m) / nullif(b.sd, 0) AS z, (s.m - b.m) / nullif(sqrt(b.sd * b.sd / b.filled + s.sd * s.sd / s.filled), 0) AS zse,
                 abs(s.m - b.m) / greatest(abs(b.m), b.sd, 1e-9) AS shift FROM st s JOIN st b ON b.f = 'clean' AND b.c = s.c),
signals AS (
  SELECT f, c, 'schema_missing_column' AS t, 0.95 AS s, 0 AS nth
  FROM (SELECT DISTINCT a.f, b.c FROM st a, st b WHERE b.f = 'clean') ANTI JOIN st USING (f, c)
  UNION ALL SELECT f, c, 'schema_type_mismatch', 0.9, 0 FROM st WHERE c IN ('o_orderstatus', 'o_orderpriority') AND digits
  UNION ALL SELECT f, c, 'completeness', least(1, 0.5 + 2 * (nulls - limit_)), 0 FROM st JOIN (VALUES ('o_orderkey', 0), ('o_totalprice', 0.01)) r(c, limit_) USING (c) WHERE nulls > limit_
  UNION ALL SELECT f, 'o_totalprice', 'range', least(1, 0.4 + 3 * outside), 0 FROM facts WHERE outside > 0
  UNION ALL SELECT f, c, 'uniqueness', 0.9, 0 FROM st WHERE c = 'o_orderkey' AND d < filled
  UNION ALL SELECT f, 'o_orderdate', 'freshness', least(1, 0.4 + 0.3 * (lag / 90 - 1)), 0 FROM facts WHERE lag > 90
  UNION ALL SELECT f, 'o_orderstatus', 'semantic_drift', 0.5, 0 FROM facts WHERE unlisted > 0
  UNION ALL SELECT f, c, 'completeness', least(1, 0.5 + nulls - bnulls), 1 FROM pairs WHERE nulls - bnulls > 0.05
  UNION ALL SELECT f, c, 'distribution', least(1, 0.5 + (abs(z) - 3) / 3), 1 FROM pairs WHERE abs(z) >= 3
  UNION ALL SELECT f, c, 'distribution', least(1, 0.45 + 0.5 * shift), 1 FROM pairs WHERE abs(z) < 3 AND bfilled >= 30 AND filled >= 30 AND abs(zse) >= 6 AND shift >= 0.1
  UNION ALL SELECT f, c, 'cardinality_drift', least(1, 0.4 + 0.4 * abs(dr / bdr - 1)), 1 FROM pairs WHERE bd > 3 AND d > 3 AND abs(dr / bdr - 1) >= 0.5
  UNION ALL SELECT f, NULL, 'volume', least(1, abs(n / bn - 1)), 1 FROM pairs WHERE c = 'o_orderkey' AND abs(n / bn - 1) >= 0.3
),
first_ AS (SELECT f, c, t, round(arg_min(s, nth), 4) AS s FROM signals GROUP BY 1, 2, 3),
by_column AS (SELECT f, c, map(list(t), list(s)) AS s, list(t) AS ts FROM first_ WHERE c IS NOT NULL GROUP BY 1, 2),
whole AS (SELECT v.f, v.s AS volume, u.s AS uniqueness FROM first_ v LEFT JOIN first_ u ON u.f = v.f AND u.t = 'uniqueness' WHERE v.t = 'volume'),
causes AS (
  SELECT f, 'schema_drop' AS rule, s['schema_missing_column'] AS conf, ['schema_missing_column'] AS cites, 1 AS place FROM by_column
  UNION ALL SELECT f, 'schema_type_change', s['schema_type_mismatch'], ['schema_type_mismatch'], 1 FROM by_column
  UNION ALL SELECT f, 'scale_error', least(0.99, greatest(s['range'], s['distribution']) + 0.05), ['range', 'distribution'], 1 FROM by_column WHERE list_has_all(ts, ['range', 'distribution'])
  UNION ALL SELECT f, 'scale_error', s['range'], ['range'], 1 FROM by_column WHERE NOT list_contains(ts, 'distribution')
  UNION ALL SELECT f, 'unexplained_distribution_shift', 0.8 * s['distribution'], ['distribution'], 1 FROM by_column WHERE NOT list_contains(ts, 'range')
  UNION ALL SELECT f, 'completeness_gap', s['completeness'], ['completeness'], 1 FROM by_column
  UNION ALL SELECT f, 'freshness_sla_breach', s['freshness'], ['freshness'], 1 FROM by_column
  UNION ALL SELECT f, 'semantic_drift', 0.75 * s['semantic_drift'], ['semantic_drift'], 1 FROM by_column WHERE NOT list_contains(ts, 'schema_type_mismatch')
  UNION ALL SELECT f, 'cardinality_drift', 0.5 * s['cardinality_drift'], ['cardinality_drift'], 1 FROM by_column
  UNION ALL SELECT f, 'duplicate_load', least(0.99, (volume + uniqueness) / 2 + 0.1), ['volume', 'uniqueness'], 0 FROM whole
  UNION ALL SELECT f, 'volume_shift', 0.7 * volume, ['volume'], 0 FROM whole WHERE uniqueness IS NULL
),
strong AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY conf DESC, place) AS rk FROM causes WHERE conf >= 0.4 QUALIFY rk <= 3),
seen AS (SELECT f, list_sort(list(DISTINCT t)) AS observed FROM signals GROUP BY 1),
cited AS (SELECT f, bool_and(len(cites) > 0 AND list_has_all(observed, cites)) AS valid FROM strong JOIN seen USING (f) GROUP BY 1),
wanted AS (SELECT * FROM (VALUES ('F01', ['schema_missing_column'], 'schema_drop', 0.85), ('F02', ['schema_type_mismatch'], 'schema_type_change', 0.85),
           ('F03', ['completeness'], 'completeness_gap', 0.85), ('F04', ['volume', 'uniqueness'], 'duplicate_load', 0.85),
           ('F05', ['range', 'distribution'], 'scale_error', 0.90), ('F06', ['freshness'], 'freshness_sla_breach', 0.60)) w(f, expected, rule_, least_)),
judged AS (
  SELECT w.f, expected, coalesce(observed, []) AS observed, [x FOR x IN list_sort(expected) IF NOT list_contains(coalesce(observed, []), x)] AS missing,
         rule_, s.rule AS top_rule, coalesce(round(s.conf, 6), 0)::DOUBLE AS top_confidence, coalesce(s.rule = rule_, false) AS rule_match,
         coalesce(s.conf, 0) >= least_ AS confidence_ok, coalesce(valid, true) AS evidence_valid
  FROM wanted w LEFT JOIN seen USING (f) LEFT JOIN strong s ON s.f = w.f AND s.rk = 1 LEFT JOIN cited ON cited.f = w.f)
"""


@query(
    "fault_matrix",
    f"""{_FAULTS} SELECT f AS fault_id, array_to_string(observed, ',') AS observed, array_to_string(missing, ',') AS missing, top_rule, top_confidence,
        len(missing) = 0 AND rule_match AND confidence_ok AND evidence_valid AS passed FROM judged""",
)
def matrix(spark, sf):
    orders, contract, as_of = _fault_inputs(spark, sf)
    found = fault_matrix(orders, contract, FAULT_COLUMNS, as_of)
    lists = [F.array_join(c + "_types", ",").alias(c) for c in ("observed", "missing")]
    return found.select("fault_id", *lists, "top_rule", "top_confidence", "passed")


@query(
    "detection_cases",
    f"""{_FAULTS} SELECT f AS run_id, array_to_string(list_sort(expected), ',') AS expected, array_to_string(observed, ',') AS observed, rule_ AS expected_rule, top_rule, top_confidence,
        rule_match, confidence_ok, evidence_valid,
        concat_ws(',', CASE WHEN len(missing) > 0 THEN 'missing_types' END, CASE WHEN NOT rule_match THEN 'rule' END, CASE WHEN NOT confidence_ok THEN 'confidence' END,
                  CASE WHEN NOT evidence_valid THEN 'evidence' END) AS failures FROM judged""",
)
def cases(spark, sf):
    orders, contract, as_of = _fault_inputs(spark, sf)
    return detection_cases(*fault_cases(orders, contract, FAULT_COLUMNS, as_of)).select(
        "run_id",
        F.array_join(F.array_sort("expected_types"), ",").alias("expected"),
        F.array_join("observed_types", ",").alias("observed"),
        *("expected_rule", "top_rule", "top_confidence", "rule_match", "confidence_ok", "evidence_valid"),
        F.array_join("failures", ",").alias("failures"),
    )


@query(
    "detection_metrics",
    f"""{_FAULTS} SELECT count(*) AS cases, round(avg((len(missing) = 0)::INT), 6) AS detection_recall, round(avg(rule_match::INT), 6) AS top1_accuracy,
        round(coalesce(avg(top_confidence) FILTER (rule_match), 0), 6) AS mean_confidence, round(avg(evidence_valid::INT), 6) AS evidence_precision FROM judged""",
)
def metrics(spark, sf):
    orders, contract, as_of = _fault_inputs(spark, sf)
    return detection_metrics(*fault_cases(orders, contract, FAULT_COLUMNS, as_of))
