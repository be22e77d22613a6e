"""Lineage traversal for many start nodes at once, and the context reports built on it.

Each hop joins the frontier with the edges that leave it, drops nodes already visited and keeps one path per new
node. A hop is stored as a table on the shared storage; the loop ends when no edge leaves the frontier. A side is
broadcast only where its rows and bytes were counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import number
from dqspark.runtime import BROADCAST_ROWS, broadcast_if_small, dealt, materialize, stored

MAX_HOPS = 6
COMPACT_HOPS = 8
WALK_ROWS = 500_000
# Rows of a few short columns, which may be broadcast where a wide row may not; the bytes are counted as ever.
NARROW_ROWS = 1_000_000
KINDS = 10_000
SIMILAR = 5
SLOT_PARTS = 64

# Points of the business impact.
SEVERITY_POINTS = {"low": 10, "medium": 35, "high": 60, "critical": 80}
CRITICALITY_POINTS = 4
MAX_CRITICALITY_POINTS = 20
SLA_POINTS = 5


def _directed(edges: DataFrame, reverse: bool) -> DataFrame:
    if reverse:
        return edges.select(
            F.col("dst").alias("_from"), F.col("src").alias("_to"), F.col("src_type").alias("_type"), "edge_type"
        )
    return edges.select(
        F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("dst_type").alias("_type"), "edge_type"
    )


def _kept(edges: DataFrame, name: str = "edges") -> DataFrame:
    """The edges, stored in files small enough that walks read them in small splits."""
    with dealt(edges.sparkSession):
        return stored(edges, name)


def _among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column is one of the stored keys; all rows where the keys are too many to broadcast."""
    keys = keys.toDF("_key")
    if keys.count() > BROADCAST_ROWS and broadcast_if_small(keys, NARROW_ROWS) is keys:
        return df
    return df.join(F.broadcast(keys), F.col(column) == F.col("_key"), "left_semi")


def _numbered_kinds(edges: DataFrame) -> DataFrame | None:
    """(kind, code): the few kinds of edges, numbered in their order; None where they are many."""
    kinds = stored(edges.select("kind").distinct(), "kinds")
    if kinds.count() > KINDS:
        return None
    place = F.row_number().over(Window.orderBy("kind")) - 1  # at most KINDS rows
    return stored(kinds.select("kind", place.cast("bigint").alias("code")), "codes")


def _ranked(moving: DataFrame, rows: int) -> DataFrame:
    """(start, node, between, rank): the counted rows numbered in the order of their paths, sorted in tasks of WALK_ROWS."""
    placed = moving.select("start", "node", "between").repartitionByRange(1 + rows // WALK_ROWS, "between", "node")
    placed = stored(placed.withColumn("_part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("between", "node")) - 1
    ranked = placed.join(F.broadcast(offsets), "_part").select("start", "node", "between", (F.col("_before") + place).alias("rank"))
    return stored(ranked, "ranked")


def _known(seen: DataFrame, moving: DataFrame, step: DataFrame, few_targets: bool) -> DataFrame:
    """The pairs of a start and a node among `seen` that can be met again: both occur in this hop. The side with fewer
    rows is asked first, the other only if too many pairs are left."""
    sides = [(moving, "start", "start"), (step, "_to", "node")]
    for df, name, column in reversed(sides) if few_targets else sides:
        asked = _among(seen, column, stored(df.select(name).distinct(), name))
        if asked is seen:
            continue
        seen = stored(asked, "known")
        if seen.count() <= BROADCAST_ROWS:
            break
    return broadcast_if_small(seen)


def _walk(
    edges: DataFrame, starts: DataFrame, max_hops: int | None, paths: bool = True, enough: int | None = None
) -> DataFrame:
    """(start, node, hop), with `paths` also (node_type, via, path), for stored edges as (_from, _to, _type, edge_type).

    First visit wins; among visits of the same hop the smallest path wins. A start that has `enough` nodes
    after a whole hop is not walked further: everything beyond would be farther away. Paths are compared as numbers in
    their order where many pairs come of a frontier small enough to be numbered; so most pairs carry one number, which
    hashes, and get their path back from the frontier when they are read.
    """
    with dealt(edges.sparkSession, edges.count()):
        return _hops(edges, starts, max_hops, paths, enough)


def _hops(edges: DataFrame, starts: DataFrame, max_hops: int | None, paths: bool, enough: int | None) -> DataFrame:
    # Of parallel edges the smallest type stands; a missing node type counts only if there is no other.
    kind = F.struct("edge_type", F.col("_type").isNull().alias("untyped"), "_type")
    edges = edges.select("_from", "_to", *([kind.alias("kind")] if paths else []))
    degrees = stored(edges.groupBy("_from").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    codes = _numbered_kinds(edges) if paths else None
    if codes is not None:
        kinds = max(codes.count(), 1)
        edges = edges.join(F.broadcast(codes), "kind").select("_from", "_to", F.col("code").alias("kind"))
    start = F.col(starts.columns[0])
    begin = starts.select(start.alias("start")).distinct().withColumn("node", F.col("start"))
    # The steps between start and node are all that two paths of one pair can differ in, so only these are carried.
    nothing = F.expr("cast(array() as array<string>)").alias("between")
    frontier, visited, seen, hop = stored(begin, "begin"), None, None, 0
    read = lambda rows: rows.withColumn("between", nothing) if paths else rows
    while max_hops is None or hop < max_hops:
        if enough is not None and hop:
            done = seen.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= enough).select("start")
            frontier = frontier.join(done, "start", "left_anti")
        # Nodes of the frontier that edges leave, how often they occur and how many edges leave them.
        live = _among(frontier, "node", degrees.select("_from")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        live = stored(live.join(degrees, F.col("node") == F.col("_from")).select("node", "n", "degree"), "live")
        met, leaving, pairs = live.agg(F.sum("n"), F.sum("degree"), F.sum(F.col("n") * F.col("degree"))).first()
        if not pairs:
            break
        hop += 1
        moving = read(_among(frontier, "node", live.select("node")))
        step = _among(edges, "_from", live.select("node"))
        ranks = None
        if codes is not None and 1 < hop and met <= NARROW_ROWS and pairs > WALK_ROWS:
            moving = ranks = _ranked(moving, met)
        if not paths:
            carried = []
        elif codes is None or (hop > 1 and ranks is None):
            between = F.concat("between", F.array("node")) if hop > 1 else F.col("between")
            carried = [between.alias("carried")]
        else:
            carried = [(F.col("rank") * kinds if hop > 1 else F.lit(0)).cast("bigint").alias("carried")]
        numbers = not carried or (codes is not None and (hop == 1 or ranks is not None))
        moving = moving.select("start", F.col("node").alias("_at"), *carried)
        if leaving <= met and leaving <= (BROADCAST_ROWS if paths and codes is None else NARROW_ROWS):
            step = broadcast_if_small(stored(step, "step"), NARROW_ROWS)
        elif met < leaving and met <= (NARROW_ROWS if numbers else BROADCAST_ROWS):
            moving = broadcast_if_small(stored(moving, "moving"), NARROW_ROWS)
        known = None if seen is None else _known(seen, moving, step, few_targets=leaving <= met)
        candidates = moving.join(step, F.col("_at") == F.col("_from")).filter(~F.col("start").eqNullSafe(F.col("_to")))
        best = F.col("carried") + F.col("kind") if numbers else F.struct(F.col("carried").alias("between"), "kind")
        # Dealt by the counted pairs, so that no task sorts or hashes more of them as the graph grows.
        candidates = candidates.select("start", F.col("_to").alias("node"), *([best.alias("best")] if paths else []))
        candidates = candidates.repartition(1 + pairs // WALK_ROWS, "start", "node")
        if paths:
            candidates = candidates.groupBy("start", "node").agg(F.min("best").alias("best"))
        else:
            candidates = candidates.distinct()
        fresh = candidates if known is None else candidates.join(known, ["start", "node"], "left_anti")
        frontier = stored(fresh.withColumn("hop", F.lit(hop)), "hop")
        if not paths:
            pass
        elif ranks is not None:
            walked = broadcast_if_small(ranks.select("rank", F.concat("between", F.array("node")).alias("between")), NARROW_ROWS)
            parts = {"rank": F.expr(f"best div {kinds}"), "kind": F.col("best") % kinds}
            read = lambda rows, walked=walked, parts=parts: rows.withColumns(parts).drop("best").join(walked, "rank").drop("rank")
        elif numbers:
            read = lambda rows: rows.withColumns({"between": nothing, "kind": F.col("best")}).drop("best")
        else:
            read = lambda rows: rows.withColumns({"between": F.col("best.between"), "kind": F.col("best.kind")}).drop("best")
        visited = read(frontier) if visited is None else visited.unionByName(read(frontier))
        seen = frontier.select("start", "node") if seen is None else seen.unionByName(frontier.select("start", "node"))
        if hop % COMPACT_HOPS == 0:
            visited = stored(visited, "visited")  # deep graphs would otherwise grow one union branch per hop
            seen = visited.select("start", "node")
    if visited is None:
        none = F.lit(None).cast(edges.schema["kind"].dataType) if paths else None
        visited = read(frontier).withColumns({**({"kind": none} if paths else {}), "hop": F.lit(0)}).limit(0)
    if not paths:
        return visited.select("start", "node", "hop")
    if codes is not None:
        visited = visited.withColumnRenamed("kind", "code").join(F.broadcast(codes), "code", "left")
    return visited.select(
        "start",
        "node",
        F.col("kind._type").alias("node_type"),
        "hop",
        F.col("kind.edge_type").alias("via"),
        F.concat(F.array("start"), "between", F.array("node")).alias("path"),
    )


def downstream_impact(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Everything a broken start node touches, nearest first, with one shortest path each."""
    return _walk(_directed(_kept(edges), reverse=False), starts, max_hops)


def upstream_sources(edges: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Everything that can have broken a start node."""
    return _walk(_directed(_kept(edges), reverse=True), starts, max_hops)


def reachable(edges: DataFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """(start, node): transitive closure without a hop limit."""
    return _walk(_directed(_kept(edges), reverse), starts, None, paths=False).select("start", "node")


def _column_edges(column_edges: DataFrame, reverse: bool) -> DataFrame:
    left = F.struct(F.col("src_asset").alias("asset"), F.lower("src_col").alias("column"))
    right = F.struct(F.col("dst_asset").alias("asset"), F.lower("dst_col").alias("column"))
    if reverse:
        left, right = right, left
    return column_edges.select(
        left.alias("_from"), right.alias("_to"), F.lit("column").alias("_type"), F.lit("DERIVED_FROM").alias("edge_type")
    )


def reachable_columns(
    column_edges: DataFrame, starts: DataFrame, reverse: bool = False, limit: int | None = None
) -> DataFrame:
    """(start_asset, start_column, hop, asset, column) by breadth-first walk; only the nearest `limit` per start if given."""
    return _columns_met(_kept(column_edges, "column-edges"), starts, reverse, limit)


def _columns_met(column_edges: DataFrame, starts: DataFrame, reverse: bool, limit: int | None) -> DataFrame:
    begin = starts.select(F.struct(F.col("asset").alias("asset"), F.lower("column").alias("column")).alias("start"))
    found = _walk(_column_edges(column_edges, reverse), begin, None, paths=False, enough=limit).select(
        F.col("start.asset").alias("start_asset"),
        F.col("start.column").alias("start_column"),
        "hop",
        F.col("node.asset").alias("asset"),
        F.col("node.column").alias("column"),
    )
    if limit is None:
        return found
    window = Window.partitionBy("start_asset", "start_column").orderBy("hop", "asset", "column")
    return found.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")


def column_impact(
    column_edges: DataFrame, signals: DataFrame, limit: int | None = None, max_columns: int | None = None
) -> DataFrame:
    """(run_id, asset, column, upstream, downstream) for the signalled columns of each run that have any dependency;
    only the first `max_columns` in signal order if given. `signals` carries run_id, asset, column, seq."""
    wanted = (
        signals.filter("column is not null")
        .groupBy("run_id", "asset", F.lower("column").alias("column"))
        .agg(F.min("seq").alias("seq"))
    )
    starts = wanted.select("asset", "column").distinct()
    parts = []
    column_edges = _kept(column_edges, "column-edges")  # both directions walk them
    for name, reverse in (("upstream", True), ("downstream", False)):
        walk = _columns_met(column_edges, starts, reverse, limit)
        parts.append(
            walk.groupBy(F.col("start_asset").alias("asset"), F.col("start_column").alias("column")).agg(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("hop", F.col("asset").alias("a"), F.col("column").alias("c")))),
                    lambda x: F.concat(x["a"], F.lit("."), x["c"]),
                ).alias(name)
            )
        )
    joined = wanted.join(parts[0], ["asset", "column"], "left").join(parts[1], ["asset", "column"], "left")
    found = joined.filter("upstream is not null or downstream is not null")
    if max_columns is not None:
        window = Window.partitionBy("run_id").orderBy("seq", "column")
        found = found.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= max_columns)
    return found.select("run_id", "asset", "column", "upstream", "downstream")


def affected_assets(signals: DataFrame, edges: DataFrame, names: DataFrame | None = None, max_hops: int = MAX_HOPS) -> DataFrame:
    """Downstream of the node of each run's top signal: its column, or the dataset when the column is no node.

    `signals` carries run_id, dataset, column, score, seq. Column nodes are named dataset.column.
    """
    top = signals.groupBy("run_id", "dataset").agg(
        F.max_by("column", F.struct("score", (-F.col("seq")).alias("first"))).alias("column")
    )
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    picked = top.withColumn("node", F.concat_ws(".", "dataset", "column")).join(
        nodes.withColumn("known", F.lit(True)), "node", "left"
    )
    starts = picked.select(
        "run_id", F.when(F.col("known") & F.col("column").isNotNull(), F.col("node")).otherwise(F.col("dataset")).alias("start")
    )
    hits = downstream_impact(edges, starts.select("start"), max_hops)
    result = starts.join(hits, "start").select("run_id", "start", "node", "hop")
    if names is None:
        return result
    return result.join(names.select("node", "name"), "node", "left").withColumn(
        "name", F.coalesce("name", "node")
    )


def lineage_report(edges: DataFrame, names: DataFrame, assets: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Upstream and downstream tables of the given assets with readable names and a direction column."""
    edges = _kept(edges)  # both directions walk them
    parts = [
        _walk(_directed(edges, reverse), assets, max_hops).withColumn("direction", F.lit(direction))
        for reverse, direction in ((True, "upstream"), (False, "downstream"))
    ]
    found = parts[0].unionByName(parts[1])
    return found.join(names.select("node", "name"), "node", "left").select(
        "direction", "start", "hop", "node_type", "node", F.coalesce("name", "node").alias("name"), "via"
    )


def edge_report(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edge list with readable names on both ends."""
    left = names.select(F.col("node").alias("src"), F.col("name").alias("src_name"))
    right = names.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    return (
        edges.join(left, "src", "left")
        .join(right, "dst", "left")
        .select(F.coalesce("src_name", "src").alias("source"), "edge_type", F.coalesce("dst_name", "dst").alias("target"))
    )


def merge_lineage(old: DataFrame, new: DataFrame, mode: str = "replace") -> DataFrame:
    """Edges after an ingest. `replace` (snapshot sources): the namespaces of `new` are replaced whole;
    `accumulate` (event sources): union without copies."""
    if mode not in ("replace", "accumulate"):
        raise ValueError("mode is replace or accumulate")
    kept = old if mode == "accumulate" else old.join(new.select("namespace").distinct(), "namespace", "left_anti")
    return kept.unionByName(new).dropDuplicates()


def changed_assets(old_nodes: DataFrame, new_nodes: DataFrame, mode: str = "replace") -> DataFrame:
    """(namespace, uid, change): nodes whose definition differs. Nodes carry namespace, uid and any definition
    columns; in `accumulate` mode a node missing from the new events is still there."""
    definition = [c for c in new_nodes.columns if c not in ("namespace", "uid")]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select("namespace", "uid", F.sha2(F.to_json(F.struct(*sorted(definition))), 256).alias(name))

    touched = new_nodes.select("namespace").distinct()
    old = hashed(old_nodes, "old").join(touched, "namespace", "left_semi")
    joined = old.join(hashed(new_nodes, "new"), ["namespace", "uid"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    result = joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select("namespace", "uid", change.alias("change"))
    return result if mode == "replace" else result.filter("change <> 'removed'")


def change_candidates(events: DataFrame, scope: DataFrame, runs: DataFrame, k: int | None = None) -> DataFrame:
    """Lineage events since the last good run that touch a run's asset or its upstream, ranked per run; the newest k if given.

    `events(event_id, kind, created_at, namespace, initial, changed_assets, runs array<struct<asset,status>>)`, whose
    namespace each candidate carries, `scope(run_id, asset, relation)`, `runs(run_id, since)`.
    """
    label = F.when(F.col("kind") == "dbt_ingested", "definition_changed").otherwise("new_or_changed_node")
    ingested = events.filter(F.col("kind").isin("dbt_ingested", "openlineage_ingested"))
    definitions = ingested.filter(~F.coalesce(F.col("initial"), F.lit(False))).select(
        "event_id", "created_at", "namespace", F.explode("changed_assets").alias("asset"), label.alias("change"), F.lit(None).cast("string").alias("status")
    )
    failures = (
        ingested.select("event_id", "created_at", "namespace", F.inline("runs"))
        .filter(F.lower("status").isin("error", "fail", "abort"))
        .select("event_id", "created_at", "namespace", "asset", F.lit("run_failed").alias("change"), "status")
    )
    # With k, only the newest k changes of an asset can be among the newest k of any run, so each asset is cut to k
    # lines before it meets the runs; a busy asset with many runs never multiplies.
    order = [F.col("created_at").desc(), "event_id", "change"]
    per_asset = Window.partitionBy("asset").orderBy(*order)
    newest = definitions.unionByName(failures)
    if k is not None:
        newest = newest.withColumn("_rank", F.row_number().over(per_asset)).filter(F.col("_rank") <= k).drop("_rank")
    joined = (
        newest.join(scope, "asset").join(runs.select("run_id", "since"), "run_id").filter(F.col("created_at") >= F.col("since"))
    )
    window = Window.partitionBy("run_id").orderBy(*order, "asset")
    ranked = joined.withColumn("rank", F.row_number().over(window))
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).select(
        "run_id", "rank", "event_id", "created_at", "namespace", "asset", "relation", "change", "status"
    )


def affected_policies(runs: DataFrame, reach: DataFrame, policies: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per run and asset under a policy that the run may affect: its owner, criticality, SLA and whether it is broken.

    `runs(run_id, asset)`, `reach(start, node)` downstream closure, `policies(asset, owner, criticality, sla_minutes)`.
    The lag is the largest of the run's freshness signals, 0 without one. Potential impact, not proven corruption.
    """
    late = F.when(F.col("type").isin("freshness", "staleness"), number(F.col("evidence"), "lag_minutes"))
    lags = signals.groupBy("run_id").agg(F.coalesce(F.max(late), F.lit(0.0)).alias("lag"))
    own = runs.select("run_id", "asset")
    reached = runs.select("run_id", F.col("asset").alias("start")).join(reach, "start").select("run_id", F.col("node").alias("asset"))
    lag = F.coalesce(F.col("lag"), F.lit(0.0))
    return (
        own.unionByName(reached)
        .distinct()
        .join(policies.select("asset", "owner", "criticality", "sla_minutes"), "asset")
        .join(lags, "run_id", "left")
        .select(
            "run_id", "asset", "owner", "criticality", "sla_minutes", lag.alias("lag_minutes"), (lag > F.col("sla_minutes")).alias("sla_broken")
        )
    )


def business_impact(runs: DataFrame, reach: DataFrame, policies: DataFrame, signals: DataFrame) -> DataFrame:
    """Priority 0-100 per run: severity, criticality of what may be affected, broken SLA.

    `runs(run_id, asset, severity)`; the others are those of `affected_policies`, which names the assets.
    """
    hit = (
        affected_policies(runs, reach, policies, signals)
        .groupBy("run_id")
        .agg(
            F.sum(F.col("criticality") * CRITICALITY_POINTS).alias("criticality"),
            F.bool_or("sla_broken").alias("breached"),
            F.count_if("sla_broken").alias("breaches"),
            F.count(F.lit(1)).alias("assets"),
        )
    )
    points = F.create_map(*[F.lit(x) for pair in SEVERITY_POINTS.items() for x in pair])
    base = F.element_at(points, F.col("severity"))
    extra = F.least(F.lit(MAX_CRITICALITY_POINTS), F.coalesce(F.col("criticality"), F.lit(0)))
    sla = F.when(F.coalesce(F.col("breached"), F.lit(False)), F.lit(SLA_POINTS)).otherwise(F.lit(0))
    return runs.select("run_id", "asset", "severity").join(hit, "run_id", "left").select(
        "run_id",
        base.cast("bigint").alias("severity_points"),
        extra.cast("bigint").alias("criticality_points"),
        sla.cast("bigint").alias("sla_points"),
        F.least(F.lit(100), base + extra + sla).cast("bigint").alias("priority"),
        F.coalesce(F.col("assets"), F.lit(0)).alias("affected_policies"),
        F.coalesce(F.col("breaches"), F.lit(0)).alias("sla_breaches"),
    )


def group_incidents(runs: DataFrame, relations: DataFrame, window_seconds: int = 3600) -> DataFrame:
    """(run_id, parent, group_id): each run follows the newest earlier run with signals, at most one window
    old, on the same or a connected asset; chains end in their root.

    `runs(run_id, asset, run_ts, signal_count)`, `relations(asset, other)` in both directions.

    The parent is an as-of lookup, not a pair list: events of an asset's neighbourhood are merged into one
    time line per (asset, time slot), cut into parts, and a running maximum carries the newest run with signals. Roots are
    found by pointer jumping in log2(chain length) rounds.
    """
    own = runs.select("asset", F.col("asset").alias("other")).distinct()
    related = relations.select("asset", "other").unionByName(own).distinct()
    slot = F.floor(F.unix_micros(F.col("run_ts").cast("timestamp")) / F.lit(window_seconds * 1_000_000))
    sources = (
        runs.filter("signal_count > 0")
        .select(F.col("asset").alias("other"), "run_ts", "run_id", slot.alias("slot"))
        # One line per asset and instant is enough: the tie goes to the larger run id.
        .groupBy("other", "run_ts", "slot")
        .agg(F.max("run_id").alias("run_id"))
        .join(related, "other")
        .groupBy("asset", "run_ts", "slot")
        .agg(F.max("run_id").alias("src_run"))
        # A source serves the rest of its own slot and the next one.
        .select("asset", "run_ts", "src_run", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
        .withColumn("is_run", F.lit(0))
        .withColumn("run_id", F.lit(None).cast("string"))
    )
    asks = runs.select(
        "asset", "run_ts", F.lit(None).cast("string").alias("src_run"), slot.alias("slot"), F.lit(1).alias("is_run"), "run_id"
    )
    # A busy asset's slot is cut into parts; a source of the slot before counts for the first one. What is newest in a part
    # is carried to the later ones of its slot, of which there are SLOT_PARTS at most.
    width = F.lit(window_seconds * 1_000_000 / SLOT_PARTS)
    part = F.floor(F.unix_micros(F.col("run_ts").cast("timestamp")) / width)
    lines = sources.unionByName(asks).withColumn("part", F.greatest(part, F.col("slot") * SLOT_PARTS))
    source = F.when(F.col("is_run") == 0, F.struct("run_ts", "src_run"))
    # At equal times the asking run comes first, so it never finds itself.
    line = Window.partitionBy("asset", "slot", "part").orderBy("run_ts", F.col("is_run").desc(), "run_id")
    newest = F.last(source, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.partitionBy("asset", "slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lines.groupBy("asset", "slot", "part")
        .agg(F.max(source).alias("newest"))
        .select("asset", "slot", "part", F.max("newest").over(earlier).alias("carried"))
    )
    asked = (
        lines.withColumn("own", newest)
        .filter("is_run = 1")
        .join(carried, ["asset", "slot", "part"])
        .withColumn("found", F.coalesce("own", "carried"))
    )
    age = (
        F.unix_micros(F.col("run_ts").cast("timestamp")) - F.unix_micros(F.col("found.run_ts").cast("timestamp"))
    )
    parents = asked.select(
        "run_id", F.when(age <= window_seconds * 1_000_000, F.col("found.src_run")).alias("parent")
    )
    roots = materialize(parents.withColumn("root", F.coalesce("parent", "run_id")))
    while True:
        above = roots.select(F.col("run_id").alias("root"), F.col("root").alias("_next"))
        jumped = materialize(roots.join(above, "root", "left").select("run_id", "parent", "root", F.coalesce("_next", "root").alias("_next")))
        moved = jumped.filter("root <> _next").limit(1).count()
        roots = jumped.select("run_id", "parent", F.col("_next").alias("root"))
        if not moved:
            break
    return roots.select("run_id", "parent", F.col("root").alias("group_id"))


def similar_incidents(runs: DataFrame, signals: DataFrame, feedback: DataFrame, k: int = SIMILAR) -> DataFrame:
    """(run_id, rank, similar_run, similarity, resolution): Jaccard of (type, column) sets against resolved incidents of
    the same source and contract, best k. `resolution` is the note of the verdict; null where feedback has no `note`.

    Runs are folded into distinct signatures per source and contract first, and only distinct signatures that
    share an element meet. Copies of one signature, however many, are therefore one row in the join; the k
    newest resolved runs of each signature stand for it.
    """
    element = F.concat_ws("|", "type", F.coalesce("column", F.lit("")))
    signatures = (
        signals.select("run_id", element.alias("e"))
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_set("e")).alias("signature"))
        .join(runs.select("run_id", "source_id", "contract_hash", "run_ts"), "run_id")
    )
    note = (F.col("note") if "note" in feedback.columns else F.lit(None)).cast("string").alias("resolution")
    latest = feedback.groupBy("run_id").agg(F.max_by(F.struct("verdict", note), F.struct("ts", "verdict", note)).alias("l"))
    closed = latest.filter("l.verdict = 'resolved'").select("run_id", "l.resolution")
    resolved = signatures.join(closed, "run_id")
    group = ["source_id", "contract_hash", "signature"]
    newest = Window.partitionBy(*group).orderBy(F.col("run_ts").desc(), "run_id")
    # k + 1, because a run never counts as similar to itself.
    stored = (
        resolved.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= k + 1)
        .groupBy(*group)
        .agg(F.collect_list(F.struct("run_ts", "run_id", "resolution")).alias("stored"))
    )
    kinds = signatures.select(*group).distinct()
    left = kinds.withColumn("e", F.explode("signature"))
    right = stored.select(
        "source_id", "contract_hash", F.col("signature").alias("other"), F.explode("signature").alias("e")
    )
    shared = (
        left.join(right, ["source_id", "contract_hash", "e"])
        .groupBy(*group, "other")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    union = F.size("signature") + F.size("other") - F.col("common")
    pairs = shared.select(*group, "other", (F.col("common") / union).alias("similarity"))
    # Per signature only the best stored runs matter, so the list that is joined to the runs is short.
    stored_runs = pairs.join(stored.withColumnRenamed("signature", "other"), ["source_id", "contract_hash", "other"]).select(
        *group, "similarity", F.inline("stored").alias("old_ts", "similar_run", "resolution")
    )
    best = Window.partitionBy(*group).orderBy(F.col("similarity").desc(), F.col("old_ts").desc(), "similar_run")
    short = (
        stored_runs.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= k + 1)
        .groupBy(*group)
        .agg(F.collect_list(F.struct("_rank", "similar_run", "similarity", "resolution")).alias("best"))
    )
    others = F.slice(
        F.filter(F.sort_array("best"), lambda b: b["similar_run"] != F.col("run_id")), 1, k
    )
    return (
        signatures.join(short, group)
        .select("run_id", F.posexplode(others).alias("_pos", "b"))
        .select(
            "run_id",
            (F.col("_pos") + 1).alias("rank"),
            F.col("b.similar_run").alias("similar_run"),
            F.round("b.similarity", 6).alias("similarity"),
            F.col("b.resolution").alias("resolution"),
        )
    )


def run_lookup(runs: DataFrame, edges: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest run per dataset through WRITES_TO edges, its signals by score).

    `runs(job_id, run_id, run_ts, status)`; edges lead from job to dataset.
    """
    newest = runs.groupBy("job_id").agg(
        F.max_by(F.struct("run_id", "run_ts", "status"), F.struct("run_ts", "run_id")).alias("r")
    )
    written = edges.filter("edge_type = 'WRITES_TO'").select(F.col("src").alias("job_id"), F.col("dst").alias("dataset"))
    latest = (
        written.join(newest, "job_id")
        .groupBy("dataset")
        .agg(F.max_by(F.struct("r.*"), F.struct("r.run_ts", "r.run_id")).alias("r"))
        .select("dataset", "r.*")
    )
    return latest, latest.select("dataset", "run_id").join(signals, "run_id").orderBy("dataset", F.col("score").desc(), "seq")
