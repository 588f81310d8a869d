"""Trailing-window admission (W1) as a Structured Streaming query.

``applyInPandasWithState``; a client's state is the admitted
timestamps still inside the window of its latest event seen (at most ``limit`` of
them).  With ``idle_seconds`` the groups are clients, and one that has sent nothing for so long (processing time) loses its state, so
state does not grow with every client ever seen.  Without it no client's state ever goes, and the groups are ``buckets``
of clients by hash, whose state lists the clients: a group costs some milliseconds of a core in every micro-batch,
however few events it has, which clients with two or three events each would pay.  Within a micro-batch a client's events are walked in (event time, event id)
order; the frames they arrive in are sorted one by one and merged, never put together.
There is no watermark, so every event gets a row however late it comes; a late
event is judged against the admitted entries of the state as it is then (entries
later than it count as well), as the reference decides in arrival order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.ratelimit import UNKNOWN_CLIENT, micros

OUTPUT_SCHEMA = "event_id long, client string, admitted boolean"
STATE_SCHEMA = "admitted array<long>"
BUCKET_STATE_SCHEMA = "clients array<string>, counts array<int>, admitted array<long>"
OUT_ROWS = 10_000
BUCKETS = 1024  # groups of clients


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """(t, event_id) of all frames in order.  A frame is kept as two sorted arrays (16 bytes an event) and the
    frames are merged, so no frame of all a client's events is built."""
    runs = []
    for f in frames:
        t, i = f["t"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64)
        order = np.lexsort((i, t))
        runs.append((t[order], i[order]))
    yield from heapq.merge(*(zip(t, i) for t, i in runs))


def _frame(rows: list[tuple[int, bool]], client: str) -> pd.DataFrame:
    return pd.DataFrame({"event_id": [r[0] for r in rows], "client": client, "admitted": [r[1] for r in rows]})


def _step(limit: int, window_us: int, idle_ms: int | None):
    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (client,) = key
        if state.hasTimedOut:
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        out: list[tuple[int, bool]] = []
        for t, event_id in _in_order(frames):
            admitted = [a for a in admitted if t - a <= window_us]
            ok = len(admitted) < limit
            if ok:
                admitted.append(int(t))
            out.append((int(event_id), ok))
            if len(out) == OUT_ROWS:
                yield _frame(out, client)
                out = []
        state.update((admitted,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield _frame(out, client)
    return fn


def _by_client(frames: Iterator[pd.DataFrame]) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """The events of each client as one sorted run (t, event_id) per frame."""
    runs: dict[str, list] = {}
    for f in frames:
        t, i = f["t"].to_numpy(np.int64), f["event_id"].to_numpy(np.int64)
        codes, clients = pd.factorize(f["client"])
        order = np.lexsort((i, t, codes))
        ends = np.cumsum(np.bincount(codes, minlength=len(clients)))[:-1]
        for client, part in zip(clients, np.split(order, ends)):
            runs.setdefault(client, []).append((t[part], i[part]))
    return runs


def _events(run: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    t, i = run
    for k in range(0, len(t), OUT_ROWS):
        yield from zip(t[k:k + OUT_ROWS].tolist(), i[k:k + OUT_ROWS].tolist())


def _bucket_step(limit: int, window_us: int):
    def fn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        if state.exists:
            clients, counts, times = state.get
            at = 0
            for client, n in zip(clients, counts):
                held[client] = list(times[at:at + n])
                at += n
        out: list[tuple[int, str, bool]] = []
        for client, runs in _by_client(frames).items():
            admitted = held.get(client, [])
            for t, event_id in heapq.merge(*map(_events, runs)):
                admitted = [a for a in admitted if t - a <= window_us]
                ok = len(admitted) < limit
                if ok:
                    admitted.append(t)
                out.append((event_id, client, ok))
                if len(out) == OUT_ROWS:
                    yield pd.DataFrame(out, columns=["event_id", "client", "admitted"])
                    out = []
            held[client] = admitted
        state.update((list(held), [len(x) for x in held.values()], [t for x in held.values() for t in x]))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "client", "admitted"])
    return fn


def admit_stream(events: DataFrame, window_seconds: int, limit: int, counted_paths: Iterable[str],
                 client_col: str = "client", path_col: str = "path", ts_col: str = "ts",
                 id_col: str = "event_id", idle_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """W1 on a streaming DataFrame; returns a streaming (event_id, client, admitted).  A live stream passes
    its window as ``idle_seconds``; the default keeps state, since the processing time of a replay says nothing."""
    window_us = window_seconds * 1_000_000
    from tidewatch.session import ship_package
    ship_package(events.sparkSession)
    ev = (events.filter(F.col(path_col).isin(list(counted_paths)))
          .select(F.col(id_col).alias("event_id"),
                  F.coalesce(F.col(client_col).cast("string"), F.lit(UNKNOWN_CLIENT)).alias("client"),
                  micros(events, ts_col).alias("t")))
    if idle_seconds:
        return ev.groupBy("client").applyInPandasWithState(
            _step(limit, window_us, idle_seconds * 1000), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return ev.withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        _bucket_step(limit, window_us), OUTPUT_SCHEMA, BUCKET_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def replay_admission(events: DataFrame, window_seconds: int, limit: int, counted_paths: Iterable[str],
                     chunk_col: str = "ts", chunk_seconds: int = 86400 * 10, **cols) -> DataFrame:
    """W1 through Structured Streaming over an event table.

    The events are dealt into time chunks; chunk after chunk is written into the stream's
    source folder and the query runs until it has taken all there is
    (``availableNow``, same checkpoint), so the order of chunks does not rest on file
    times or names.  The driver loops over chunks, never over rows or files.
    Returns the sink as a batch DataFrame (event_id, client, admitted)."""
    import uuid

    from tidewatch.session import checkpoint_dir
    spark = events.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    chunk = F.floor(micros(events, chunk_col) / (chunk_seconds * 1_000_000)).cast("long")
    events.withColumn("_chunk", chunk).write.partitionBy("_chunk").parquet(f"{root}/staged")
    staged = spark.read.parquet(f"{root}/staged")
    for row in staged.select("_chunk").distinct().orderBy("_chunk").toLocalIterator():
        staged.filter(F.col("_chunk").eqNullSafe(row["_chunk"])).select(*events.columns).write.mode("append").parquet(f"{root}/source")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/source")
        out = admit_stream(stream, window_seconds, limit, counted_paths, **cols)
        q = (out.writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(f"{root}/out")
