"""Rule statistics, scan history and the trailing-window admission."""

from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ratelimit, stats
from tidewatch.sources import tables


def walker(rows, window_us, limit):
    """Plain sequential admission: rows (event_id, client, t) in (t, id) order."""
    state, out = defaultdict(deque), {}
    for ev, client, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        q = state[client]
        while q and t - q[0] > window_us:
            q.popleft()
        ok = len(q) < limit
        if ok:
            q.append(t)
        out[ev] = ok
    return out


@pytest.mark.parametrize("window,limit", [(86400, 3), (3600, 1), (7 * 86400, 10)])
def test_admission_matches_walker(spark, sf, window, limit):
    ev = tables.read_table(spark, sf, "events")
    paths = ("click", "purchase", "view")
    got = {r.event_id: r.admitted for r in ratelimit.admit(ev, window, limit, paths, client_col="user_id",
                                                           path_col="event_type").collect()}
    rows = [(r.event_id, str(r.user_id), r.t) for r in ev.filter(F.col("event_type").isin(*paths)).select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()]
    exp = walker(rows, window * 1_000_000, limit)
    assert got == exp and (False in exp.values() or limit == 10)


def test_admission_null_client_and_exact_window(spark):
    rows = [(1, None, "view", "2024-01-01 00:00:00"), (2, None, "view", "2024-01-01 00:00:30"),
            (3, None, "view", "2024-01-01 00:01:00"), (4, None, "view", "2024-01-01 00:01:00.000001"),
            (5, "c", "other", "2024-01-01 00:00:00")]
    ev = spark.createDataFrame(rows, "event_id long, client string, path string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: (r.client, r.admitted) for r in ratelimit.admit(ev, 60, 2, ["view"]).collect()}
    # event 3 sees 1 and 2 (exactly 60 s old still counts): rejected; event 4 sees only 2 -> admitted
    assert got == {1: ("unknown", True), 2: ("unknown", True), 3: ("unknown", False), 4: ("unknown", True)}


def test_streaming_admission_equals_batch(spark, sf):
    from tidewatch.streaming.ratelimit import replay_admission
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    paths = ["click", "purchase", "view"]
    cols = {"client_col": "user_id", "path_col": "event_type"}
    batch = {r.event_id: r.admitted for r in ratelimit.admit(ev, 86400, 3, paths, **cols).collect()}
    stream = {r.event_id: r.admitted for r in replay_admission(ev, 86400, 3, paths, **cols).collect()}
    assert stream == batch


def test_stream_decides_late_events(spark):
    """Every event gets a row, however late it comes."""
    import uuid

    from tidewatch.session import checkpoint_dir
    from tidewatch.streaming.ratelimit import OUTPUT_SCHEMA, admit_stream
    root = f"{checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    schema = "event_id long, client string, path string, ts timestamp"
    for rows in ([(1, "c", "p", 1_000_000), (2, "c", "p", 1_000_010)], [(3, "c", "p", 10), (4, None, "p", 20), (5, "c", "p", 1_000_020)]):
        spark.createDataFrame(rows, "event_id long, client string, path string, s long").selectExpr(
            "event_id", "client", "path", "timestamp_seconds(s) AS ts").write.mode("append").parquet(f"{root}/in")
        q = admit_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), 60, 2, ["p"]).writeStream.format("parquet").option(
            "path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.event_id: (r.client, r.admitted) for r in spark.read.schema(OUTPUT_SCHEMA).parquet(f"{root}/out").collect()}
    # The late event 3 meets two admitted entries in the state.
    assert got == {1: ("c", True), 2: ("c", True), 3: ("c", False), 4: ("unknown", True), 5: ("c", False)}


def test_stream_state_merges_frames_and_drops_idle_clients():
    import pandas as pd

    from tidewatch.streaming.ratelimit import _step

    class State:
        def __init__(self):
            self.value, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    rng = __import__("random").Random(4)
    rows = [(i, "c", rng.randrange(10_000)) for i in range(500)]
    frames = [pd.DataFrame({"event_id": [r[0] for r in rows[k:k + 70]], "t": [r[2] for r in rows[k:k + 70]]}) for k in range(0, 500, 70)]
    state, step = State(), _step(3, 200, 60_000)
    got = pd.concat(step(("c",), iter(frames), state))
    assert dict(zip(got.event_id, got.admitted)) == walker(rows, 200, 3)
    assert state.exists and len(state.value[0]) <= 3 and state.timeout == 60_000
    state.hasTimedOut = True
    assert list(step(("c",), iter(()), state)) == [] and not state.exists


def test_clients_share_the_groups_of_a_stream(spark):
    """A group per client made the replay's time grow with the clients, a few milliseconds of a core each."""
    import uuid

    from tidewatch.session import checkpoint_dir
    from tidewatch.streaming.ratelimit import BUCKETS, OUTPUT_SCHEMA, admit_stream
    root = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}"
    rng, log, clients = __import__("random").Random(7), [], 3000
    for part in range(2):  # the second part meets the state of the first
        rows = [(part * 10_000 + i, None if i % 50 == 0 else f"c{rng.randrange(clients)}" if i % 3 else "hot", part * 5000 + rng.randrange(5000)) for i in range(9000)]
        log += rows
        spark.createDataFrame(rows, "event_id long, client string, s long").selectExpr(
            "event_id", "client", "'p' AS path", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(f"{root}/in")
        q = admit_stream(spark.readStream.schema("event_id long, client string, path string, ts timestamp").parquet(f"{root}/in"), 600, 2, ["p"]).writeStream.format(
            "parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= BUCKETS
    got = {r.event_id: (r.client, r.admitted) for r in spark.read.schema(OUTPUT_SCHEMA).parquet(f"{root}/out").collect()}
    want = walker([(i, c or "unknown", s * 1_000_000) for i, c, s in log], 600 * 1_000_000, 2)
    assert {i: ok for i, (_, ok) in got.items()} == want and {i: c for i, (c, _) in got.items()} == {i: c or "unknown" for i, c, _ in log}


def test_rule_stats_rounding_and_review(spark):
    rows = [("a", 1)] * 2 + [("a", 0)] * 1 + [("b", 0)] * 5 + [("b", 1)] * 2 + [("c", 0)]
    v = spark.createDataFrame(rows, "rule_id string, verified int")
    s = {r.rule_id: r for r in stats.rule_stats(v).collect()}
    assert (s["a"].total_validations, s["a"].dismissed_count, s["a"].dismissal_rate) == (3, 1, 0.3333)
    assert s["b"].needs_review and not s["a"].needs_review and not s["c"].needs_review
    assert s["b"].dismissal_rate == 0.7143
    assert [r.rule_id for r in stats.rule_stats(v).collect()] == ["a", "b", "c"]


def test_history(spark, sf):
    scans = stats.scans_from_events(tables.read_table(spark, sf, "events"))
    top = stats.scan_history(scans, limit=5).collect()
    assert len(top) == 5 and top == sorted(top, key=lambda r: (r.scanned_at, r.id), reverse=True)
    one = stats.scan_history(scans, "user-3", 200).collect()
    assert one and {r.repository for r in one} == {"user-3"}
    with pytest.raises(ValueError):
        stats.scan_history(scans, limit=201)
    per = stats.latest_scans_per_repo(scans, 2)
    assert per.groupBy("repository").count().filter("count > 2").count() == 0
