from datetime import datetime, timedelta


from dqspark.runtime import scratch_path
from dqspark.streaming.silence import learned_silence, stream_silence
from dqspark.streaming.streams import run_available_now

START = datetime(2024, 1, 1)
SCHEMA = "source string, ts timestamp_ntz"


def at(*minutes):
    return [START + timedelta(minutes=m) for m in minutes]


def rows(**sources):
    return [(s, t) for s, times in sources.items() for t in times]


def drained(spark, batches, limits):
    """Alarms after each batch, all on one checkpoint."""
    path, out, state = (scratch_path(spark, n) for n in ("silence-in", "silence-out", "silence-state"))
    known = spark.createDataFrame(limits, "source_id string, limit_minutes double")
    found = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.parquet(f"{path}/batch={i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/batch=*")
        run_available_now(stream_silence(stream, "source", "ts", known, "5 minutes"), out, state)
        alarms = spark.read.schema("source_id string, silent_from timestamp_ntz, due timestamp_ntz, limit_minutes double").parquet(out).collect()
        found.append({(r["source_id"], (r["silent_from"] - START) / timedelta(minutes=1), (r["due"] - START) / timedelta(minutes=1)) for r in alarms})
    return found


def test_a_source_that_stops_is_reported_while_others_go_on(spark):
    batches = [
        rows(a=at(0, 10, 20), b=at(0, 5, 21), free=at(0)) + [(None, START), ("a", None)],
        rows(b=at(30, 45)),
        rows(b=at(60, 70)),
        rows(a=at(80, 90), b=at(80, 90)),
    ]
    first, second, third, fourth = drained(spark, batches, [("a", 30.0), ("b", 60.0)])
    assert first == second == set()
    # The watermark passed minute 50 without a row of `a`; its return is no second alarm.
    assert third == fourth == {("a", 20.0, 50.0)}


def test_a_silence_inside_a_batch_or_across_batches_counts_once(spark):
    gaps = rows(a=at(0, 1, 50, 51))
    assert drained(spark, [gaps], [("a", 20.0)])[-1] == {("a", 1.0, 21.0)}
    assert drained(spark, [gaps[:2], gaps[2:]], [("a", 20.0)])[-1] == {("a", 1.0, 21.0)}
    # Out of order within a batch, and rows behind the newest one of the state.
    assert drained(spark, [rows(a=at(30, 0, 15)), rows(a=at(28, 45))], [("a", 20.0)])[-1] == set()


def test_replayed_batches_give_the_alarms_of_one_drain(spark):
    times = {s: at(*range(0, 600, step)) for s, step in (("x", 7), ("y", 31), ("z", 90))}
    times["stopped"] = at(*range(0, 200, 9))
    every = sorted(rows(**times), key=lambda r: r[1])
    limits = [("x", 20.0), ("y", 30.0), ("z", 100.0), ("stopped", 40.0)]
    one = drained(spark, [every], limits)[-1]
    cut = [every[i : i + 60] for i in range(0, len(every), 60)]
    assert drained(spark, cut, limits)[-1] == one and ("stopped", 198.0, 238.0) in one


def test_learned_limits(spark):
    steady = rows(steady=at(*range(0, 100, 10)), short=at(0, 10, 20), jumpy=at(0, 10, 30, 60, 100, 110, 130))
    steady += [("steady", t + timedelta(seconds=20)) for _, t in steady[:10]] + [(None, START), ("steady", None)]
    found = {r["source_id"]: r for r in learned_silence(spark.createDataFrame(steady, SCHEMA), "source", "ts").collect()}
    assert set(found) == {"steady", "jumpy"}
    assert (found["steady"]["gaps"], found["steady"]["typical_minutes"], found["steady"]["limit_minutes"]) == (9, 10.0, 25.0)
    assert found["jumpy"]["typical_minutes"] == 20.0 and abs(found["jumpy"]["limit_minutes"] - (20 + 6 * 1.4826 * 10)) < 1e-6
    assert learned_silence(spark.createDataFrame([], SCHEMA), "source", "ts").count() == 0
