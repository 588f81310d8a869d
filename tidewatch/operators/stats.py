"""Rule-effectiveness statistics and scan history.

Inputs are the append-only history tables (``sources.stores``) or any table
with the same columns (the registered queries use ``events`` as a stand-in
log).  Aggregations are partial on the map side; the top-N reads are
``TakeOrderedAndProject`` (global) or a per-key ``row_number`` (per repo).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLE_SIZE = 5
DISMISSAL_THRESHOLD = 0.5
HISTORY_DEFAULT_LIMIT = 20
HISTORY_MAX_LIMIT = 200


def rule_stats(validations: DataFrame, min_sample: int = MIN_SAMPLE_SIZE,
               threshold: float = DISMISSAL_THRESHOLD) -> DataFrame:
    """K1 + K2 per rule, ordered by rule id.

    ``dismissal_rate`` is rounded half up to 4 places with integer arithmetic
    (exact on ties, where float rounding can differ in the last digit);
    ``needs_review`` uses the unrounded double rate.
    """
    agg = validations.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.coalesce(F.sum(F.col("verified").cast("long")), F.lit(0).cast("long")).alias("verified_count"))
    dismissed = F.col("total_validations") - F.col("verified_count")
    rate_num = F.floor((F.lit(20000) * dismissed + F.col("total_validations")) / (F.lit(2) * F.col("total_validations")))
    raw_rate = dismissed.cast("double") / F.col("total_validations").cast("double")
    return agg.select(
        "rule_id", "total_validations", "verified_count", dismissed.alias("dismissed_count"),
        (rate_num.cast("double") / F.lit(10000.0)).alias("dismissal_rate"),
        ((F.col("total_validations") >= min_sample) & (raw_rate > F.lit(float(threshold)))).alias("needs_review"),
    ).orderBy("rule_id")


def clamp_limit(limit: int | None) -> int:
    if limit is None:
        return HISTORY_DEFAULT_LIMIT
    if limit < 1 or limit > HISTORY_MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {HISTORY_MAX_LIMIT}")
    return limit


def scan_history(scans: DataFrame, repository: str | None = None, limit: int | None = None) -> DataFrame:
    """O3: optional repository equality (empty = all), newest first, top N.
    Ties on ``scanned_at`` break on ``id`` descending (ours; deterministic)."""
    n = clamp_limit(limit)
    out = scans.filter(F.col("repository") == F.lit(repository)) if repository else scans
    return out.orderBy(F.col("scanned_at").desc(), F.col("id").desc()).limit(n)


def latest_scans_per_repo(scans: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` scans of every repository at once."""
    w = Window.partitionBy("repository").orderBy(F.col("scanned_at").desc(), F.col("id").desc())
    return scans.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# -- stand-in logs derived from `events` --------------------------------------

VERIFIED_VALUE_THRESHOLD = 50.0
# Weight of an event type when a day of events is read as one scan (stand-in).
EVENT_SEVERITY = {"error": "high", "purchase": "medium", "signup": "medium", "view": "low", "click": "low"}


def validations_from_events(events: DataFrame, threshold: float = VERIFIED_VALUE_THRESHOLD) -> DataFrame:
    """events as a verdict log: user -> repository, event type -> rule,
    value above threshold -> verified, ts -> validated_at."""
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("repository"),
        F.col("event_type").alias("rule_id"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string")).alias("file"),
        F.lit(None).cast("string").alias("function"),
        F.lit("medium").alias("severity"),
        (F.col("value") > F.lit(threshold)).cast("int").alias("verified"),
        F.lit("medium").alias("confidence"),
        F.col("ts").cast("timestamp").alias("validated_at"))


def scans_from_events(events: DataFrame, threshold: float = VERIFIED_VALUE_THRESHOLD) -> DataFrame:
    """events as a scan log: one scan per (user, day); candidates = events,
    verified = events above the threshold, risk score from the event types."""
    sev = F.lit(None).cast("string")
    for k, v in EVENT_SEVERITY.items():
        sev = F.when(F.col("event_type") == k, F.lit(v)).otherwise(sev)
    w = (F.when(sev == "high", 10).when(sev == "medium", 5).when(sev == "low", 1).otherwise(0))
    verified = F.col("value") > F.lit(threshold)
    day = F.to_date(F.col("ts"))
    return events.groupBy("user_id", day.alias("scan_date")).agg(
        F.max("event_id").alias("id"),
        F.count(F.lit(1)).alias("candidate_finding_count"),
        F.count_if(verified).alias("verified_finding_count"),
        F.sum(F.when(verified, w).otherwise(0)).alias("raw"),
        F.max("ts").alias("scanned_at"),
    ).select(
        "id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("repository"),
        F.lit(None).cast("string").alias("branch"), "candidate_finding_count", "verified_finding_count",
        F.least(F.lit(100), F.col("raw")).cast("int").alias("risk_score"),
        F.col("scanned_at").cast("timestamp").alias("scanned_at"), "scan_date")
