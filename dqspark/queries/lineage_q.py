"""Lineage traversal and incident context over graphs derived from the trade tables.

Nodes: p:<part> -> s:<supplier> -> n:<nation> -> r:<region>; customers and orders give runs and events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.functions.columns import evidence, severity
from dqspark.operators import lineage as L
from dqspark.queries.base import SEVERITY_SQL, query, table
from dqspark.queries.drift_q import priority_runs
from dqspark.runtime import dealt, stored


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edge(src, src_type, dst, dst_type, edge_type):
    return [
        src.alias("src"),
        F.lit(src_type).alias("src_type"),
        dst.alias("dst"),
        F.lit(dst_type).alias("dst_type"),
        F.lit(edge_type).alias("edge_type"),
    ]


def place_edges(spark, sf):
    s = table(spark, sf, "supplier").select(*_edge(_node("s:", "s_suppkey"), "job", _node("n:", "s_nationkey"), "dataset", "WRITES_TO"))
    n = table(spark, sf, "nation").select(*_edge(_node("n:", "n_nationkey"), "dataset", _node("r:", "n_regionkey"), "dataset", "DERIVED_FROM"))
    return s.unionByName(n)


def trade_pairs(spark, sf):
    """The distinct pairs of a part and its supplier, by tasks dealt by the counted lines."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    with dealt(spark, lines.count()):
        return stored(lines.distinct(), "pairs")


def trade_edges(spark, sf):
    p = trade_pairs(spark, sf).select(*_edge(_node("p:", "l_partkey"), "external_asset", _node("s:", "l_suppkey"), "job", "READS_FROM"))
    return p.unionByName(place_edges(spark, sf))


def trade_ends(spark, sf, prefix: str, column: str, end: str):
    """The nodes at one end of `trade_edges`, without the pairs of parts and suppliers."""
    lines = table(spark, sf, "lineitem").select(column).distinct()
    return lines.select(_node(prefix, column).alias(end)).unionByName(place_edges(spark, sf).select(end))


EDGES_SQL = """
places AS (SELECT 's:' || s_suppkey AS src, 'job' AS src_type, 'n:' || s_nationkey AS dst, 'dataset' AS dst_type, 'WRITES_TO' AS edge_type FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'dataset', 'r:' || n_regionkey, 'dataset', 'DERIVED_FROM' FROM nation),
edges AS (SELECT DISTINCT 'p:' || l_partkey AS src, 'external_asset' AS src_type, 's:' || l_suppkey AS dst, 'job' AS dst_type, 'READS_FROM' AS edge_type
  FROM lineitem UNION ALL SELECT * FROM places)
"""


def walk_sql(starts: str, reverse: bool, hops: int = 6, edges: str = "edges") -> str:
    a, b, t = ("dst", "src", "src_type") if reverse else ("src", "dst", "dst_type")
    return f"""
walk AS (
  SELECT x AS start, x AS node, NULL::VARCHAR AS node_type, 0 AS hop, NULL::VARCHAR AS via, [x] AS path FROM ({starts}) t(x)
  UNION ALL
  SELECT w.start, e.{b}, e.{t}, w.hop + 1, e.edge_type, list_append(w.path, e.{b}) FROM walk w JOIN {edges} e ON e.{a} = w.node WHERE w.hop < {hops}),
hit AS (SELECT start, node, arg_min(node_type, (hop, path)) AS node_type, min(hop) AS hop, arg_min(via, (hop, path)) AS via,
          array_to_string(arg_min(path, (hop, path)), '>') AS path FROM walk WHERE hop > 0 AND node <> start GROUP BY start, node)
"""


def _shown(found):
    return found.select("start", "node", "node_type", "hop", "via", F.array_join("path", ">").alias("path"))


@query(
    "downstream_impact",
    f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('SELECT DISTINCT src FROM edges', False)} SELECT * FROM hit",
)
def downstream(spark, sf):
    return _shown(L.downstream_impact(trade_edges(spark, sf), trade_ends(spark, sf, "p:", "l_partkey", "src")))


@query(
    "upstream_sources",
    f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('SELECT DISTINCT dst FROM edges', True)} SELECT * FROM hit",
)
def upstream(spark, sf):
    return _shown(L.upstream_sources(trade_edges(spark, sf), trade_ends(spark, sf, "s:", "l_suppkey", "dst")))


@query(
    "reachable",
    f"WITH RECURSIVE {EDGES_SQL}, {walk_sql('SELECT DISTINCT dst FROM places', True)} SELECT start, node FROM hit",
)
def closure(spark, sf):
    return L.reachable(trade_edges(spark, sf), place_edges(spark, sf).select("dst"), reverse=True)


def column_edges(spark, sf):
    def pair(df, a, a_col, b, b_col):
        return df.select(a.alias("src_asset"), F.lit(a_col).alias("src_col"), b.alias("dst_asset"), F.lit(b_col).alias("dst_col"))

    return (
        pair(trade_pairs(spark, sf), _node("p:", "l_partkey"), "RetailPrice", _node("s:", "l_suppkey"), "AcctBal")
        .unionByName(pair(table(spark, sf, "supplier"), _node("s:", "s_suppkey"), "acctbal", _node("n:", "s_nationkey"), "Balance"))
        .unionByName(pair(table(spark, sf, "nation"), _node("n:", "n_nationkey"), "BALANCE", _node("r:", "n_regionkey"), "Balance"))
    )


COLUMN_SQL = """
ce AS (SELECT DISTINCT 'p:' || l_partkey AS sa, 'retailprice' AS sc, 's:' || l_suppkey AS da, 'acctbal' AS dc FROM lineitem
  UNION ALL SELECT 's:' || s_suppkey, 'acctbal', 'n:' || s_nationkey, 'balance' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'balance', 'r:' || n_regionkey, 'balance' FROM nation)
"""


def column_walk_sql(starts: str, reverse: bool, name: str) -> str:
    a, b = ("da", "sa") if reverse else ("sa", "da")
    ac, bc = ("dc", "sc") if reverse else ("sc", "dc")
    return f"""
w_{name} AS (SELECT x AS start_asset, y AS start_column, x AS asset, y AS "column", 0 AS hop FROM ({starts}) t(x, y)
  UNION SELECT w.start_asset, w.start_column, e.{b}, e.{bc}, w.hop + 1 FROM w_{name} w JOIN ce e ON e.{a} = w.asset AND e.{ac} = w."column" WHERE w.hop < 8),
h_{name} AS (SELECT start_asset, start_column, asset, "column", min(hop) AS hop FROM w_{name} WHERE hop > 0 GROUP BY ALL),
k_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_asset, start_column ORDER BY hop, asset, "column") AS k FROM h_{name}))
"""


_NATIONS = "SELECT DISTINCT da, 'balance' FROM ce WHERE da LIKE 'n:%'"


@query(
    "reachable_columns",
    f"WITH RECURSIVE {COLUMN_SQL}, {column_walk_sql(_NATIONS, True, 'up')} SELECT start_asset, start_column, hop, asset, \"column\" FROM k_up",
)
def columns(spark, sf):
    starts = table(spark, sf, "supplier").select(_node("n:", "s_nationkey").alias("asset"), F.lit("Balance").alias("column")).distinct()
    return L.reachable_columns(column_edges(spark, sf), starts, reverse=True)


def supplier_signals(spark, sf):
    """Suppliers in debt: a range signal on the balance (in another spelling) and one without a column."""
    s = table(spark, sf, "supplier")
    owed = F.abs(F.col("s_acctbal"))
    both = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("AcctBal").alias("column"), F.least(F.lit(1.0), owed / 10_000).alias("score")),
        F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("column"), F.lit(0.5).alias("score")),
    )
    node = _node("s:", "s_suppkey")
    return s.select(F.concat(F.lit("run/"), node).alias("run_id"), node.alias("asset"), node.alias("dataset"), F.inline(both))


@query(
    "column_impact",
    f"""WITH RECURSIVE {COLUMN_SQL}, {column_walk_sql("SELECT 's:' || s_suppkey, 'acctbal' FROM supplier", True, 'up')},
        {column_walk_sql("SELECT 's:' || s_suppkey, 'acctbal' FROM supplier", False, 'dn')}
        SELECT 'run/s:' || s_suppkey AS run_id, 'acctbal' AS "column", u.x AS upstream, d.x AS downstream FROM supplier
        LEFT JOIN (SELECT start_asset, string_agg(asset || '.' || "column", ',' ORDER BY k) AS x FROM k_up GROUP BY 1) u ON u.start_asset = 's:' || s_suppkey
        LEFT JOIN (SELECT start_asset, string_agg(asset || '.' || "column", ',' ORDER BY k) AS x FROM k_dn GROUP BY 1) d ON d.start_asset = 's:' || s_suppkey""",
)
def impact(spark, sf):
    found = L.column_impact(column_edges(spark, sf), supplier_signals(spark, sf))
    return found.select("run_id", "column", *[F.array_join(c, ",").alias(c) for c in ("upstream", "downstream")])


def node_names(spark, sf):
    return (
        table(spark, sf, "nation")
        .select(_node("n:", "n_nationkey").alias("node"), F.col("n_name").alias("name"))
        .unionByName(table(spark, sf, "region").select(_node("r:", "r_regionkey").alias("node"), F.col("r_name").alias("name")))
        .unionByName(table(spark, sf, "supplier").select(_node("s:", "s_suppkey").alias("node"), F.col("s_name").alias("name")))
    )


NAMES_SQL = """
names AS (SELECT 'n:' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region
  UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier)
"""


@query(
    "affected_assets",
    f"""WITH RECURSIVE {EDGES_SQL}, {NAMES_SQL},
        cols AS (SELECT * FROM places UNION ALL SELECT 's:' || s_suppkey || '.AcctBal', 'column', 'r:' || n_regionkey, 'dataset', 'FEEDS'
                 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        top AS (SELECT 'run/s:' || s_suppkey AS run_id, CASE WHEN least(1.0, abs(s_acctbal) / 10000) >= 0.5 THEN 's:' || s_suppkey || '.AcctBal' ELSE 's:' || s_suppkey END AS start FROM supplier),
        {walk_sql('SELECT DISTINCT start FROM top', False, edges='cols')}
        SELECT run_id, top.start, hit.node, hit.hop, coalesce(name, hit.node) AS name FROM top JOIN hit ON hit.start = top.start LEFT JOIN names n ON n.node = hit.node""",
)
def affected(spark, sf):
    """The balance column of a supplier feeds its region directly; the supplier itself feeds its nation."""
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    direct = places.select(
        *_edge(F.concat(_node("s:", "s_suppkey"), F.lit(".AcctBal")), "column", _node("r:", "n_regionkey"), "dataset", "FEEDS")
    )
    edges = place_edges(spark, sf).unionByName(direct)
    found = L.affected_assets(supplier_signals(spark, sf), edges, node_names(spark, sf))
    return found.select("run_id", "start", "node", "hop", "name")


@query(
    "lineage_report",
    f"""WITH RECURSIVE {EDGES_SQL}, {NAMES_SQL}, {walk_sql('SELECT DISTINCT dst FROM places', True)},
        {walk_sql('SELECT DISTINCT dst FROM places', False).replace('walk', 'walk2').replace('hit AS', 'hit2 AS')}
        SELECT 'upstream' AS direction, start, hop, node_type, hit.node, coalesce(name, hit.node) AS name, via FROM hit LEFT JOIN names n ON n.node = hit.node
        UNION ALL SELECT 'downstream', start, hop, node_type, hit2.node, coalesce(name, hit2.node), via FROM hit2 LEFT JOIN names n ON n.node = hit2.node""",
)
def report(spark, sf):
    edges = trade_edges(spark, sf)
    return L.lineage_report(edges, node_names(spark, sf), place_edges(spark, sf).select("dst"))


@query(
    "lineage_edges",
    f"""WITH {EDGES_SQL}, {NAMES_SQL} SELECT coalesce(a.name, src) AS source, edge_type, coalesce(b.name, dst) AS target
        FROM edges LEFT JOIN names a ON a.node = src LEFT JOIN names b ON b.node = dst""",
)
def edge_list(spark, sf):
    return L.edge_report(trade_edges(spark, sf), node_names(spark, sf))


# ------------------------------------------------------------------ ingest


def _spaced(spark, sf, solvent: bool):
    """Supplier edges in one namespace per region; the new snapshot covers two regions and solvent suppliers."""
    rows = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    if solvent:
        rows = rows.filter((F.col("s_acctbal") > 0) & F.col("r_name").isin("ASIA", "EUROPE"))
    return rows.select(
        F.col("r_name").alias("namespace"),
        *_edge(_node("s:", "s_suppkey"), "job", F.concat(_node("n:", "s_nationkey"), F.lit("@2" if solvent else "")), "dataset", "WRITES_TO"),
    )


SPACED_SQL = """
sp AS (SELECT r_name AS namespace, 's:' || s_suppkey AS src, 'n:' || s_nationkey AS dst, s_acctbal FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nw AS (SELECT namespace, src, dst || '@2' AS dst FROM sp WHERE s_acctbal > 0 AND namespace IN ('ASIA', 'EUROPE'))
"""


@query(
    "merge_lineage",
    f"""WITH {SPACED_SQL} SELECT 'replace' AS mode, namespace, src, dst FROM sp WHERE namespace NOT IN (SELECT namespace FROM nw)
        UNION ALL SELECT 'replace', * FROM nw UNION ALL SELECT 'accumulate', namespace, src, dst FROM sp UNION ALL SELECT 'accumulate', * FROM nw""",
)
def merged(spark, sf):
    old, new = _spaced(spark, sf, False), _spaced(spark, sf, True)
    parts = [
        L.merge_lineage(old, new, mode).select(F.lit(mode).alias("mode"), "namespace", "src", "dst") for mode in ("replace", "accumulate")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "changed_assets",
    """SELECT 'tpch' AS namespace, 's:' || s_suppkey AS uid, CASE WHEN s_acctbal > 9000 THEN 'removed' ELSE 'changed' END AS change
       FROM supplier WHERE s_acctbal > 9000 OR s_acctbal < 0 UNION ALL SELECT 'tpch', 'x:' || s_suppkey, 'added' FROM supplier WHERE s_acctbal < 0""",
)
def changed(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.select(F.lit("tpch").alias("namespace"), _node("s:", "s_suppkey").alias("uid"), "s_name", F.col("s_acctbal").alias("balance"))
    new = s.filter("s_acctbal <= 9000").select(
        F.lit("tpch").alias("namespace"),
        _node("s:", "s_suppkey").alias("uid"),
        "s_name",
        F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")).alias("balance"),
    )
    extra = s.filter("s_acctbal < 0").select(
        F.lit("tpch").alias("namespace"), _node("x:", "s_suppkey").alias("uid"), "s_name", F.col("s_acctbal").alias("balance")
    )
    return L.changed_assets(old, new.unionByName(extra))


# ------------------------------------------------------------------ incident context


@query(
    "change_candidates",
    """WITH e AS (SELECT o_orderkey AS event_id, o_orderdate AS created_at, 'c:' || o_custkey AS asset, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
       c AS (SELECT event_id, created_at, 'trade/' || st AS namespace, asset, CASE WHEN pr = '1-URGENT' THEN 'definition_changed' ELSE 'new_or_changed_node' END AS change, NULL::VARCHAR AS status
             FROM e WHERE pr <> '5-LOW' AND pr <> '3-MEDIUM'
             UNION ALL SELECT event_id, created_at, 'trade/' || st, asset, 'run_failed', CASE st WHEN 'F' THEN 'FAIL' ELSE 'abort' END FROM e WHERE st <> 'O' AND pr <> '5-LOW'),
       s AS (SELECT 'run/' || c_custkey AS run_id, 'c:' || c_custkey AS asset, 'self' AS relation FROM customer
             UNION ALL SELECT 'run/' || c_custkey, 'c:' || (c_custkey + 1), 'upstream' FROM customer),
       r AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, event_id, change, c.asset) AS "rank", event_id, created_at, namespace, c.asset, relation, change, status
             FROM c JOIN s ON s.asset = c.asset WHERE created_at >= TIMESTAMP '1997-01-01')
       SELECT * FROM r""",
)
def candidates(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "abort").otherwise("ok")
    asset = _node("c:", "o_custkey")
    events = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "dbt_ingested")
        .when(F.col("o_orderpriority") == "5-LOW", "source_configured")
        .otherwise("openlineage_ingested")
        .alias("kind"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("trade/"), F.col("o_orderstatus")).alias("namespace"),
        (F.col("o_orderpriority") == "3-MEDIUM").alias("initial"),
        F.array(asset).alias("changed_assets"),
        F.array(F.struct(asset.alias("asset"), status.alias("status"))).alias("runs"),
    )
    customers = table(spark, sf, "customer")
    run = F.concat(F.lit("run/"), F.col("c_custkey").cast("string")).alias("run_id")
    scope = customers.select(
        run,
        F.inline(
            F.array(
                F.struct(_node("c:", "c_custkey").alias("asset"), F.lit("self").alias("relation")),
                F.struct(F.concat(F.lit("c:"), (F.col("c_custkey") + 1).cast("string")).alias("asset"), F.lit("upstream").alias("relation")),
            )
        ),
    )
    runs = customers.select(run, F.lit("1997-01-01").cast("timestamp_ntz").alias("since"))
    return L.change_candidates(events, scope, runs).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "business_impact",
    f"""WITH s AS (SELECT 'run/s:' || s_suppkey AS run_id, s_nationkey, n_regionkey, least(1.0, abs(s_acctbal) / 10000) AS score, round(abs(s_acctbal) / 100, 2) AS lag
                   FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        x AS (SELECT *, {SEVERITY_SQL.format('score')} AS severity FROM s),
        y AS (SELECT run_id, CASE severity WHEN 'low' THEN 10 WHEN 'medium' THEN 35 WHEN 'high' THEN 60 ELSE 80 END AS a,
                least(20, 4 * (1 + s_nationkey % 3) + 4 * (1 + n_regionkey)) AS b, (lag > 60)::INT + (lag > 30)::INT AS k, CASE WHEN k > 0 THEN 5 ELSE 0 END AS c FROM x)
        SELECT run_id, a::BIGINT AS severity_points, b::BIGINT AS criticality_points, c::BIGINT AS sla_points, least(100, a + b + c)::BIGINT AS priority, 2::BIGINT AS affected_policies, k::BIGINT AS sla_breaches FROM y""",
)
def business(spark, sf):
    return L.business_impact(*_impact_inputs(spark, sf))


@query(
    "affected_policies",
    """WITH s AS (SELECT 'run/s:' || s_suppkey AS run_id, s_nationkey, n_regionkey, round(abs(s_acctbal) / 100, 2) AS lag_minutes
                  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
       a AS (SELECT run_id, 'n:' || n_nationkey AS asset, n_name AS owner, 1 + n_nationkey % 3 AS criticality, 60 AS sla, lag_minutes FROM s JOIN nation ON s_nationkey = n_nationkey
             UNION ALL SELECT run_id, 'r:' || r_regionkey, r_name, 1 + r_regionkey, 30, lag_minutes FROM s JOIN region ON s.n_regionkey = r_regionkey)
       SELECT run_id, asset, owner, criticality::BIGINT AS criticality, sla::BIGINT AS sla_minutes, lag_minutes::DOUBLE AS lag_minutes, lag_minutes > sla AS sla_broken FROM a""",
)
def affected(spark, sf):
    found = L.affected_policies(*_impact_inputs(spark, sf))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("criticality", "sla_minutes")})


def _impact_inputs(spark, sf):
    """Suppliers' runs with lags by balance; nations and regions downstream of them stand under policies."""
    s = table(spark, sf, "supplier")
    node = _node("s:", "s_suppkey")
    run = F.concat(F.lit("run/"), node).alias("run_id")
    runs = s.select(run, node.alias("asset"), severity(F.least(F.lit(1.0), F.abs("s_acctbal") / 10_000)).alias("severity"))
    signals = s.select(run, F.lit("freshness").alias("type"), evidence(lag_minutes=F.round(F.abs("s_acctbal") / 100, 2)).alias("evidence"))
    nations = table(spark, sf, "nation").select(
        _node("n:", "n_nationkey").alias("asset"),
        F.col("n_name").alias("owner"),
        (1 + F.col("n_nationkey") % 3).alias("criticality"),
        F.lit(60).alias("sla_minutes"),
    )
    regions = table(spark, sf, "region").select(
        _node("r:", "r_regionkey").alias("asset"), F.col("r_name").alias("owner"), (1 + F.col("r_regionkey")).alias("criticality"), F.lit(30).alias("sla_minutes")
    )
    reach = L.reachable(place_edges(spark, sf), s.select(node.alias("start")))
    return runs, reach, nations.unionByName(regions), signals


PAIRS = [("error", "click"), ("view", "purchase")]


@query(
    "group_incidents",
    """WITH RECURSIVE r AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS run_id, event_type AS asset, ts, "value" > 110 AS bad FROM events),
       rel AS (SELECT asset, asset AS other FROM (SELECT DISTINCT asset FROM r)
               UNION ALL SELECT * FROM (VALUES ('error', 'click'), ('click', 'error'), ('view', 'purchase'), ('purchase', 'view'))),
       src AS (SELECT rel.asset, ts, run_id FROM r JOIN rel ON rel.other = r.asset WHERE bad),
       par AS (SELECT r.run_id, CASE WHEN r.ts - s.ts <= INTERVAL 1 HOUR THEN s.run_id END AS parent FROM r ASOF LEFT JOIN src s ON s.asset = r.asset AND r.ts > s.ts),
       root AS (SELECT run_id, parent, run_id AS group_id FROM par WHERE parent IS NULL
                UNION ALL SELECT p.run_id, p.parent, g.group_id FROM par p JOIN root g ON p.parent = g.run_id)
       SELECT * FROM root""",
)
def incidents(spark, sf):
    runs = table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
        F.col("event_type").alias("asset"),
        F.col("ts").alias("run_ts"),
        F.when(F.col("value") > 110, 1).otherwise(0).alias("signal_count"),
    )
    # The connected event types, in both directions, are read off the types that occur.
    partner = F.create_map(*[F.lit(x) for a, b in PAIRS for x in (a, b, b, a)])
    relations = runs.select("asset").distinct().select("asset", F.element_at(partner, F.col("asset")).alias("other")).filter("other is not null")
    return L.group_incidents(runs, relations)


@query(
    "similar_incidents",
    """WITH s AS (SELECT o_orderkey AS k, o_orderpriority AS src, o_orderdate AS ts, o_orderstatus AS st, [x FOR x IN [
           CASE WHEN o_totalprice > 470000 THEN 'range|o_totalprice' END, CASE WHEN o_totalprice < 30000 THEN 'distribution|o_totalprice' END,
           CASE WHEN month(o_orderdate) = 12 THEN 'volume|' END, CASE WHEN o_orderstatus = 'P' AND month(o_orderdate) >= 11 THEN 'semantic_drift|o_orderstatus' END]
           IF x IS NOT NULL] AS sig FROM orders),
       i AS (SELECT * FROM s WHERE len(sig) > 0), r AS (SELECT * FROM i WHERE st <> 'O'),
       q AS (SELECT i.k, r.k AS other, len(list_intersect(i.sig, r.sig)) / len(list_distinct(list_concat(i.sig, r.sig))) AS sim, r.ts, r.st
             FROM i JOIN r ON r.src = i.src AND r.k <> i.k),
       z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sim DESC, ts DESC, lpad(other::VARCHAR, 12, '0')) AS rk FROM q WHERE sim > 0)
       SELECT lpad(k::VARCHAR, 12, '0') AS run_id, rk::INTEGER AS "rank", lpad(other::VARCHAR, 12, '0') AS similar_run, round(sim, 6) AS similarity,
              'closed as ' || st AS resolution FROM z WHERE rk <= 5""",
)
def similar(spark, sf):
    orders = table(spark, sf, "orders")
    run = F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id")
    price = F.col("o_totalprice")

    def item(when, kind, column):
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(column).cast("string").alias("column")))

    found = F.array_compact(
        F.array(
            item(price > 470_000, "range", "o_totalprice"),
            item(price < 30_000, "distribution", "o_totalprice"),
            item(F.month("o_orderdate") == 12, "volume", None),
            item((F.col("o_orderstatus") == "P") & (F.month("o_orderdate") >= 11), "semantic_drift", "o_orderstatus"),
        )
    )
    signals = orders.select(run, F.inline(found))
    runs = orders.select(run, F.col("o_orderpriority").alias("source_id"), F.lit("c1").alias("contract_hash"), F.col("o_orderdate").alias("run_ts"))
    verdict = F.when(F.col("o_orderstatus") == "O", "false_positive").otherwise("resolved")
    note = F.concat(F.lit("closed as "), "o_orderstatus").alias("note")
    feedback = orders.select(run, F.col("o_orderdate").alias("ts"), verdict.alias("verdict"), note)
    return L.similar_incidents(runs, signals, feedback)


def job_edges(spark, sf):
    jobs = table(spark, sf, "orders").select("o_orderpriority").distinct()
    dataset = F.when(F.substring("o_orderpriority", 1, 1) <= "2", "fast_orders").otherwise("slow_orders")
    return jobs.select(*_edge(F.col("o_orderpriority"), "job", dataset, "dataset", "WRITES_TO"))


@query(
    "run_lookup",
    """WITH f AS (SELECT o_orderpriority AS job, strftime(o_orderdate, '%Y-%m') AS m, max(o_totalprice) AS top FROM orders
                  WHERE NOT (strftime(o_orderdate, '%Y-%m') = '1996-06' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) GROUP BY 1, 2),
       l AS (SELECT CASE WHEN left(job, 1) <= '2' THEN 'fast_orders' ELSE 'slow_orders' END AS dataset, max_by(job || '/' || m, m || job) AS run_id FROM f GROUP BY 1)
       SELECT dataset, run_id, CASE WHEN right(run_id, 7) >= '2001-07' THEN 'failed' ELSE 'success' END AS status FROM l""",
)
def lookup(spark, sf):
    latest, _ = L.run_lookup(priority_runs(spark, sf), job_edges(spark, sf), priority_runs(spark, sf).select("run_id", F.lit(0.5).alias("score"), F.lit(0).alias("seq")))
    return latest.select("dataset", "run_id", "status")
