"""Registered queries over event logs: rule statistics (K1, K2), scan history
(O3, O5, S13 rows) and trailing-window admission (W1, W2).  ``events`` stands
in for the verdict log (user -> repository, event type -> rule, value above
50 -> verified) and the request log (user -> client, event type -> path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import ratelimit, stats
from tidewatch.plans.registry import register
from tidewatch.sources import tables

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_TS_FMT = "%Y-%m-%d %H:%M:%S.%f"
THRESHOLD = stats.VERIFIED_VALUE_THRESHOLD

WINDOW_SECONDS = 86400          # one day: events are sparse at the minute scale
LIMIT = 3
COUNTED_PATHS = ("click", "purchase", "view")
PATHS_SQL = ", ".join(f"'{p}'" for p in COUNTED_PATHS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, "events")


@register("k1_rule_stats", f"""
WITH v AS (SELECT event_type AS rule_id, CAST(value > {THRESHOLD} AS BIGINT) AS verified FROM events),
a AS (SELECT rule_id, count(*) AS t, coalesce(sum(verified), 0) AS v FROM v GROUP BY rule_id)
SELECT rule_id, CAST(t AS BIGINT) AS total_validations, CAST(v AS BIGINT) AS verified_count,
       CAST(t - v AS BIGINT) AS dismissed_count,
       CAST(floor((20000 * (t - v) + t) / (2 * t)) AS DOUBLE) / 10000.0 AS dismissal_rate,
       t >= {stats.MIN_SAMPLE_SIZE} AND CAST(t - v AS DOUBLE) / CAST(t AS DOUBLE) > {stats.DISMISSAL_THRESHOLD} AS needs_review
FROM a""")
def k1_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rule_stats(stats.validations_from_events(_events(spark, sf_dir)))


SEV_W_SQL = ("CASE event_type WHEN 'error' THEN 10 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 5 "
             "WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 0 END")
SCANS_SQL = f"""(SELECT max(event_id) AS id, 'user-' || CAST(user_id AS VARCHAR) AS repository,
    CAST(NULL AS VARCHAR) AS branch, CAST(count(*) AS BIGINT) AS candidate_finding_count,
    CAST(count(*) FILTER (WHERE value > {THRESHOLD}) AS BIGINT) AS verified_finding_count,
    CAST(least(100, sum(CASE WHEN value > {THRESHOLD} THEN {SEV_W_SQL} ELSE 0 END)) AS INTEGER) AS risk_score,
    max(ts) AS scanned_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_date
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
SCAN_COLS_SQL = (f"id, repository, branch, candidate_finding_count, verified_finding_count, risk_score, "
                 f"strftime(scanned_at, '{DUCK_TS_FMT}') AS scanned_at, scan_date")


def _scan_out(df: DataFrame) -> DataFrame:
    return df.select("id", "repository", "branch", "candidate_finding_count", "verified_finding_count",
                     "risk_score", F.date_format("scanned_at", TS_FMT).alias("scanned_at"),
                     F.col("scan_date").cast("string").alias("scan_date"),
                     *[c for c in df.columns if c == "rank"])


@register("s13_scan_log", f"SELECT {SCAN_COLS_SQL} FROM {SCANS_SQL} s")
def s13_scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan rows (one per repository and day) as they would be appended."""
    return _scan_out(stats.scans_from_events(_events(spark, sf_dir)))


@register("o3_scan_history", f"SELECT {SCAN_COLS_SQL} FROM {SCANS_SQL} s ORDER BY scanned_at DESC, id DESC LIMIT 20")
def o3_scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_out(stats.scan_history(stats.scans_from_events(_events(spark, sf_dir))))


@register("o3_scan_history_one_repo", f"""
SELECT {SCAN_COLS_SQL} FROM {SCANS_SQL} s WHERE repository = 'user-7' ORDER BY scanned_at DESC, id DESC LIMIT 5""")
def o3_scan_history_one_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_out(stats.scan_history(stats.scans_from_events(_events(spark, sf_dir)), "user-7", 5))


@register("o5_latest_scans_per_repo", f"""
SELECT {SCAN_COLS_SQL}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY scanned_at DESC, id DESC) AS INTEGER) AS rank
FROM {SCANS_SQL} s) WHERE rank <= 3""")
def o5_latest_scans_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_out(stats.latest_scans_per_repo(stats.scans_from_events(_events(spark, sf_dir)), 3))


CLIENT_SQL = "coalesce(CAST(user_id AS VARCHAR), 'unknown')"


@register("w2_trailing_counts", f"""
SELECT event_id, {CLIENT_SQL} AS client,
       CAST(count(*) OVER (PARTITION BY {CLIENT_SQL} ORDER BY ts
            RANGE BETWEEN INTERVAL {WINDOW_SECONDS} SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_count
FROM events WHERE event_type IN ({PATHS_SQL})""")
def w2_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ratelimit.trailing_counts(_events(spark, sf_dir), WINDOW_SECONDS, client_col="user_id",
                                    path_col="event_type", counted_paths=COUNTED_PATHS)
    return out.select("event_id", "client", "trailing_count")


W_US = WINDOW_SECONDS * 1_000_000


W1_SQL = f"""
WITH RECURSIVE ev AS (
  SELECT event_id, {CLIENT_SQL} AS client, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY {CLIENT_SQL} ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ({PATHS_SQL})),
walk(client, rn, event_id, admitted, win) AS (
  SELECT client, rn, event_id, true, [t] FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.client, e.rn, e.event_id,
         len(list_filter(w.win, lambda x: e.t - x <= {W_US})) < {LIMIT},
         CASE WHEN len(list_filter(w.win, lambda x: e.t - x <= {W_US})) < {LIMIT}
              THEN list_append(list_filter(w.win, lambda x: e.t - x <= {W_US}), e.t)
              ELSE list_filter(w.win, lambda x: e.t - x <= {W_US}) END
  FROM walk w JOIN ev e ON e.client = w.client AND e.rn = w.rn + 1)
SELECT event_id, client, admitted FROM walk"""


@register("w1_admission", W1_SQL)
def w1_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratelimit.admit(_events(spark, sf_dir), WINDOW_SECONDS, LIMIT, COUNTED_PATHS,
                           client_col="user_id", path_col="event_type")


@register("w1_admission_stream", W1_SQL)
def w1_admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 as a Structured Streaming query (state per client, event-time
    timeout) over the events replayed as 10-day chunk files."""
    from tidewatch.streaming.ratelimit import replay_admission
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return replay_admission(ev, WINDOW_SECONDS, LIMIT, COUNTED_PATHS, client_col="user_id",
                            path_col="event_type")
