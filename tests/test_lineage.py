import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqspark import runtime
from dqspark.operators import lineage as L
from dqspark.queries import QUERIES
from dqspark.queries import lineage_q as Q

EDGE = "src string, src_type string, dst string, dst_type string, edge_type string"


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, "dataset", b, "dataset", "FEEDS") for a, b in pairs], EDGE)


def starts(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "start string")


def hops(df):
    return {(r["start"], r["node"]): (r["hop"], ">".join(r["path"])) for r in df.collect()}


def test_shortest_path_wins_and_cycles_end(spark):
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"))
    assert hops(L.downstream_impact(edges, starts(spark, "a"))) == {
        ("a", "b"): (1, "a>b"),
        ("a", "c"): (1, "a>c"),
        ("a", "d"): (2, "a>c>d"),
    }
    assert set(hops(L.upstream_sources(edges, starts(spark, "d")))) == {("d", "c"), ("d", "a"), ("d", "b")}


def test_hop_limit_and_many_starts(spark):
    chain = edges_of(spark, *[(f"n{i}", f"n{i + 1}") for i in range(9)])
    found = hops(L.downstream_impact(chain, starts(spark, "n0", "n7")))
    assert max(h for (s, _), (h, _) in found.items() if s == "n0") == 6
    assert {n for s, n in found if s == "n7"} == {"n8", "n9"}
    assert L.reachable(chain, starts(spark, "n0")).count() == 9
    assert L.reachable(chain, starts(spark, "n9"), reverse=True).count() == 9
    assert L.downstream_impact(chain, starts(spark, "n9")).count() == 0


def test_columns_ignore_case_and_stop_at_the_limit(spark):
    rows = [("a", "X", "b", "y"), ("b", "Y", "c", "Z")] + [("c", "z", "d", f"k{i:02d}") for i in range(20)] + [("d", "k00", "e", "q")]
    edges = spark.createDataFrame(rows, "src_asset string, src_col string, dst_asset string, dst_col string")
    begin = spark.createDataFrame([("a", "x")], "asset string, column string")
    found = [(r["hop"], r["asset"], r["column"]) for r in L.reachable_columns(edges, begin, limit=4).orderBy("hop", "asset", "column").collect()]
    assert found == [(1, "b", "y"), (2, "c", "z"), (3, "d", "k00"), (3, "d", "k01")]
    assert L.reachable_columns(edges, begin, limit=None).count() == 23
    back = spark.createDataFrame([("c", "Z")], "asset string, column string")
    assert [(r["asset"], r["column"]) for r in L.reachable_columns(edges, back, reverse=True).orderBy("hop").collect()] == [("b", "y"), ("a", "x")]


def test_merge_and_changes(spark):
    schema = "namespace string, src string"
    old = spark.createDataFrame([("n1", "a"), ("n2", "b")], schema)
    new = spark.createDataFrame([("n1", "c"), ("n1", "c")], schema)
    assert {tuple(r) for r in L.merge_lineage(old, new).collect()} == {("n1", "c"), ("n2", "b")}
    assert L.merge_lineage(old, new, "accumulate").count() == 3
    nodes = "namespace string, uid string, checksum string"
    before = spark.createDataFrame([("n1", "a", "1"), ("n1", "b", "1"), ("n2", "z", "1")], nodes)
    after = spark.createDataFrame([("n1", "a", "2"), ("n1", "c", "1")], nodes)
    got = {(r["uid"], r["change"]) for r in L.changed_assets(before, after).collect()}
    assert got == {("a", "changed"), ("b", "removed"), ("c", "added")}
    assert ("b", "removed") not in {(r["uid"], r["change"]) for r in L.changed_assets(before, after, "accumulate").collect()}


T = datetime(2024, 1, 1)


def test_change_candidates(spark):
    rows = [
        (1, "dbt_ingested", T, True, ["a"], []),
        (2, "dbt_ingested", T + timedelta(hours=1), False, ["a", "zzz"], []),
        (3, "openlineage_ingested", T + timedelta(hours=2), False, ["up"], [("a", "FAIL"), ("a", "COMPLETE")]),
        (4, "policy_changed", T + timedelta(hours=3), False, ["a"], []),
        (5, "dbt_ingested", T - timedelta(days=9), False, ["a"], []),
    ]
    schema = "event_id int, kind string, created_at timestamp_ntz, initial boolean, changed_assets array<string>, runs array<struct<asset:string,status:string>>"
    scope = spark.createDataFrame([("r", "a", "self"), ("r", "up", "upstream")], "run_id string, asset string, relation string")
    runs = spark.createDataFrame([("r", T - timedelta(days=7))], "run_id string, since timestamp_ntz")
    events = spark.createDataFrame(rows, schema).withColumn("namespace", F.concat(F.lit("ns"), "event_id"))
    found = [(r["rank"], r["event_id"], r["namespace"], r["change"], r["relation"]) for r in L.change_candidates(events, scope, runs).orderBy("rank").collect()]
    assert found == [
        (1, 3, "ns3", "new_or_changed_node", "upstream"), (2, 3, "ns3", "run_failed", "self"), (3, 2, "ns2", "definition_changed", "self")
    ]


def test_business_impact(spark):
    runs = spark.createDataFrame([("r1", "a", "critical"), ("r2", "x", "low")], "run_id string, asset string, severity string")
    reach = spark.createDataFrame([("a", "b"), ("a", "c")], "start string, node string")
    policies = spark.createDataFrame([("a", "ann", 2, 60), ("b", "bob", 5, 30), ("c", None, 5, 600)], "asset string, owner string, criticality int, sla_minutes int")
    signals = spark.createDataFrame([("r1", "freshness", {"lag_minutes": "45"})], "run_id string, type string, evidence map<string,string>")
    got = {r["run_id"]: (r["priority"], r["criticality_points"], r["sla_points"]) for r in L.business_impact(runs, reach, policies, signals).collect()}
    assert got == {"r1": (100, 20, 5), "r2": (10, 0, 0)}
    named = L.affected_policies(runs, reach.union(reach), policies, signals).collect()
    assert {(r["run_id"], r["asset"], r["owner"], r["lag_minutes"], r["sla_broken"]) for r in named} == {
        ("r1", "a", "ann", 45.0, False), ("r1", "b", "bob", 45.0, True), ("r1", "c", None, 45.0, False)
    } and len(named) == 3


def brute_groups(rows, related, window):
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    group = {}
    for run, asset, ts, _ in ordered:
        parents = [
            o for o in ordered if o[3] > 0 and o[2] < ts and ts - o[2] <= window and (o[1] == asset or (asset, o[1]) in related)
        ]
        group[run] = group[max(parents, key=lambda o: (o[2], o[0]))[0]] if parents else run
    return group


def test_groups_match_brute_force_with_a_hot_asset(spark):
    import random

    rng = random.Random(4)
    rows = [
        (f"r{i:04d}", "hot" if i % 3 == 0 else rng.choice("abcd"), T + timedelta(seconds=rng.randrange(60 * 86_400)), rng.randrange(2))
        for i in range(600)
    ]
    related = {("hot", "a"), ("a", "hot"), ("b", "c"), ("c", "b")}
    runs = spark.createDataFrame(rows, "run_id string, asset string, run_ts timestamp_ntz, signal_count int")
    relations = spark.createDataFrame(list(related), "asset string, other string")
    for window in (3600, 40_000):
        got = {r["run_id"]: r["group_id"] for r in L.group_incidents(runs, relations, window).collect()}
        assert got == brute_groups(rows, related, timedelta(seconds=window))


def test_similar_incidents_match_brute_force(spark):
    import random

    rng = random.Random(9)
    kinds = ["range", "volume", "freshness", "completeness"]
    runs, signals, feedback, sets = [], [], [], {}
    for i in range(120):
        run = f"r{i:03d}"
        # A third of all runs carry one and the same signature.
        chosen = {"volume"} if i % 3 == 0 else set(rng.sample(kinds, rng.randrange(1, 4)))
        sets[run] = (chosen, rng.choice("st"), rng.choice("xy"), T + timedelta(minutes=i), rng.random() < 0.6)
        runs.append((run, sets[run][1], sets[run][2], sets[run][3]))
        signals += [(run, k, None if k == "volume" else "c") for k in chosen]
        feedback.append((run, T, "false_positive", "first look"))
        feedback.append((run, T + timedelta(days=1), "resolved" if sets[run][4] else "correct_cause", f"note of {run}" if i % 2 else None))
    found = L.similar_incidents(
        spark.createDataFrame(runs, "run_id string, source_id string, contract_hash string, run_ts timestamp_ntz"),
        spark.createDataFrame(signals, "run_id string, type string, column string"),
        spark.createDataFrame(feedback, "run_id string, ts timestamp_ntz, verdict string, note string"),
    )
    got = {}
    for r in found.orderBy("run_id", "rank").collect():
        assert r["resolution"] == (f"note of {r['similar_run']}" if int(r["similar_run"][1:]) % 2 else None)
        got.setdefault(r["run_id"], []).append((r["similar_run"], r["similarity"]))
    for run, (chosen, source, contract, _, _) in sets.items():
        others = [
            (len(chosen & o[0]) / len(chosen | o[0]), o[3], name)
            for name, o in sets.items()
            if name != run and o[1] == source and o[2] == contract and o[4] and chosen & o[0]
        ]
        best = sorted(others, key=lambda o: (-o[0], -o[1].timestamp()))[:5]
        assert got.get(run, []) == [(n, pytest.approx(s, abs=1e-6)) for s, _, n in best]


def test_affected_assets_prefer_the_column(spark):
    edges = spark.createDataFrame(
        [("d", "dataset", "e", "dataset", "FEEDS"), ("d.x", "column", "f", "dataset", "FEEDS")], EDGE
    )
    signals = spark.createDataFrame([("r1", "d", "x", 0.9, 0), ("r1", "d", None, 0.5, 1), ("r2", "d", "gone", 0.9, 0)], "run_id string, dataset string, column string, score double, seq int")
    names = spark.createDataFrame([("e", "E table")], "node string, name string")
    got = {(r["run_id"], r["name"]) for r in L.affected_assets(signals, edges, names).collect()}
    assert got == {("r1", "f"), ("r2", "E table")}


def test_run_lookup(spark):
    runs = spark.createDataFrame([("j1", "a", T, "success"), ("j1", "b", T + timedelta(1), "failed"), ("j2", "c", T, "success")], "job_id string, run_id string, run_ts timestamp_ntz, status string")
    edges = spark.createDataFrame([("j1", "job", "ds", "dataset", "WRITES_TO"), ("j2", "job", "ds", "dataset", "WRITES_TO"), ("j2", "job", "x", "dataset", "READS_FROM")], EDGE)
    signals = spark.createDataFrame([("b", 0.2, 0), ("b", 0.9, 1), ("a", 1.0, 0)], "run_id string, score double, seq int")
    latest, ranked = L.run_lookup(runs, edges, signals)
    assert [(r["dataset"], r["run_id"], r["status"]) for r in latest.collect()] == [("ds", "b", "failed")]
    assert [r["score"] for r in ranked.collect()] == [0.9, 0.2]


def test_edges_with_a_hub(spark):
    """A third of all edges end in one node."""
    edges = edges_of(spark, *[(f"p{i}", "hub" if i % 3 == 0 else f"s{i % 50}") for i in range(3000)], ("hub", "end"))
    found = L.upstream_sources(edges, starts(spark, "end"))
    assert found.groupBy("hop").count().orderBy("hop").collect()[1]["count"] == 1000
    assert found.filter(F.size("path") != F.col("hop") + 1).count() == 0


def brute_walk(edges, max_hops):
    """{(start, node): (hop, path, edge type, node type)} over (from, to, type, edge type)."""
    found = {}
    for start in {e[0] for e in edges}:
        layer, seen = {start: ((start,), None, None)}, {start}
        for hop in range(1, max_hops + 1):
            candidates = {}
            for a, b, kind, via in edges:
                if a in layer and b not in seen:
                    candidates.setdefault(b, []).append(((*layer[a][0], b), via, kind))
            layer = {node: min(ways) for node, ways in candidates.items()}
            seen |= set(layer)
            found |= {(start, node): (hop, *best) for node, best in layer.items()}
    return found


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_walk_in_many_small_tasks_against_brute_force(spark, monkeypatch, broadcast):
    """Cycles, loops, parallel edges and nodes met again at several hops, dealt by 50 rows, with and without broadcasts."""
    monkeypatch.setattr(L, "WALK_ROWS", 50)
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("jd"), rng.choice("RW")) for _ in range(70)]
    edges += [("n1", "n1", "j", "R"), ("n1", "n2", "d", "W"), ("n1", "n2", "d", "R"), ("n2", "n1", "j", "R")]
    rows = [(a, "x", b, kind, via) for a, b, kind, via in edges]
    frame = spark.createDataFrame(rows, "src string, src_type string, dst string, dst_type string, edge_type string")
    got = {
        (r["start"], r["node"]): (r["hop"], tuple(r["path"]), r["via"], r["node_type"])
        for r in L.downstream_impact(frame, frame.select("src"), max_hops=4).collect()
    }
    assert got == brute_walk(edges, 4)
    closure = L.reachable(frame, frame.select("src").distinct())
    assert {tuple(r) for r in closure.collect()} == set(brute_walk(edges, 40))


@pytest.mark.parametrize("narrow", [1_000_000, 0])
def test_numbered_paths_against_brute_force(spark, monkeypatch, narrow):
    """Layers with hubs, a way back and parallel edges, so that pairs meet along several paths of one length."""
    monkeypatch.setattr(L, "WALK_ROWS", 40)
    monkeypatch.setattr(L, "NARROW_ROWS", narrow)
    monkeypatch.setattr(L, "BROADCAST_ROWS", narrow)
    ranked = []
    monkeypatch.setattr(L, "_ranked", lambda moving, rows, real=L._ranked: ranked.append(rows) or real(moving, rows))
    names = [[f"{layer}{i}" for i in range(6)] for layer in "dbca"]
    edges = [(a, "job", b, "dataset", "READS_FROM") for x, y in zip(names, names[1:]) for i, a in enumerate(x) for j, b in enumerate(y) if (i + j) % 3]
    edges += [(a, "job", b, None, "WRITES_TO") for a, _, b, _, _ in edges[::4]]
    edges += [(names[-1][0], "job", names[0][0], "job", "DERIVED_FROM"), (names[0][1], None, names[0][1], None, "READS_FROM")]
    frame = spark.createDataFrame(edges, "src string, src_type string, dst string, dst_type string, edge_type string")
    found = L.downstream_impact(frame, frame.select("src").distinct(), 6)
    got = {(r["start"], r["node"]): (r["hop"], r["node_type"], r["via"], tuple(r["path"])) for r in found.collect()}
    kinds = {}
    for a, _, b, kind, via in edges:
        kinds[a, b] = min(kinds.get((a, b), ("~",)), (via, kind is None, kind or ""))
    wanted = {}
    for start in {e[0] for e in edges}:
        hop, best = 0, {start: (start,)}
        layer = dict(best)
        while layer and hop < 6:
            hop, met = hop + 1, {}
            for at, path in layer.items():
                for (a, b), (via, untyped, kind) in kinds.items():
                    if a == at and b not in best:
                        met[b] = min(met.get(b, ((("~",),))), (path + (b,), via, None if untyped else kind), key=lambda m: m[0])
            for b, (path, via, kind) in met.items():
                best[b] = path
                wanted[start, b] = (hop, kind, via, path)
            layer = {b: path for b, (path, _, _) in met.items()}
    assert got == wanted
    assert bool(ranked) == (narrow > 0)


SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("name", ["reachable", "reachable_columns"])
def test_tasks_of_a_walk_are_dealt_by_counted_rows(spark, sf, monkeypatch, name):
    """Pairs, edges and hops are stored by shuffles whose partitions follow the counted rows, from small splits."""
    met = {}

    def recorded(df, kind, real=L.stored):
        met.setdefault(kind, []).append([int(spark.conf.get(s).rstrip("b")) for s in SETTINGS])
        return real(df, kind)

    monkeypatch.setattr(L, "stored", recorded)
    monkeypatch.setattr(Q, "stored", recorded, raising=False)
    monkeypatch.setattr(runtime, "TASK_ROWS", 100, raising=False)
    before = [spark.conf.get(s, None) for s in SETTINGS]
    rows = QUERIES[name](spark, sf).count()
    lines = Q.table(spark, sf, "lineitem").count()
    assert met["pairs"] == [[1 + lines // 100, 16_000_000, 16_000_000]]
    for kind, deals in met.items():
        for parts, read, joined in deals:
            assert read == joined == 16_000_000
            assert kind in ("edges", "column-edges") or parts > 8  # the session's; edges are written without a shuffle
    assert {"begin", "degrees", "live", "hop"} <= met.keys()
    assert [spark.conf.get(s, None) for s in SETTINGS] == before
    monkeypatch.setattr(runtime, "TASK_ROWS", 500_000, raising=False)
    assert rows == QUERIES[name](spark, sf).count()


def test_settings_are_back_after_a_failure(spark):
    before = [spark.conf.get(s, None) for s in SETTINGS]
    with pytest.raises(KeyError), runtime.dealt(spark, 100_000_000):
        assert int(spark.conf.get(SETTINGS[0])) == 201
        raise KeyError
    assert [spark.conf.get(s, None) for s in SETTINGS] == before
    with runtime.dealt(spark):
        assert spark.conf.get(SETTINGS[0]) == before[0]
