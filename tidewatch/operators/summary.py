"""Summaries over findings.

All are ``groupBy`` aggregations keyed by ``repo`` (partial aggregation on the
map side, so a repository holding a third of the findings only makes its
partial counts bigger, not one task slower), left-joined from the full list of
repositories so that a clean repository still gets a row with score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import MAX_RISK_SCORE, SEVERITY_WEIGHT

BANDS = ("high", "medium", "low")


def severity_weight(sev_lower):
    w = F.lit(0)
    for name, weight in SEVERITY_WEIGHT.items():
        w = F.when(sev_lower == F.lit(name), F.lit(weight)).otherwise(w)
    return w


def severity_distribution(findings: DataFrame) -> DataFrame:
    """(repo, severity lower-cased, n); unknown severities are kept."""
    return (findings.groupBy("repo", F.lower("severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def rule_distribution(findings: DataFrame) -> DataFrame:
    """(repo, rule_id, n)."""
    return findings.groupBy("repo", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def distributions_as_maps(findings: DataFrame) -> DataFrame:
    """D1 + D2 in the reference's shape: one row per repo with two maps."""
    sev = (severity_distribution(findings).groupBy("repo")
           .agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severity_distribution")))
    rul = (rule_distribution(findings).groupBy("repo")
           .agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "n"))).alias("rule_distribution")))
    return sev.join(rul, "repo", "full")


def risk_band(score):
    """>=60 high, >=20 medium, else low."""
    return F.when(score >= 60, "high").when(score >= 20, "medium").otherwise("low")


def summarize(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """D3/D4/D7 per repository: counts by band, risk score, band.

    ``repos`` has a ``repo`` column (every scanned repository, e.g.
    ``sources.select('repo')``); it is de-duplicated here.
    """
    sev = F.lower("severity")
    per_repo = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(sev == "high").alias("high_count"),
        F.count_if(sev == "medium").alias("medium_count"),
        F.count_if(sev == "low").alias("low_count"),
        F.sum(severity_weight(sev)).cast("long").alias("raw_score"),
    )
    all_repos = repos.select("repo").distinct()
    out = all_repos.join(per_repo, "repo", "left")
    score = F.least(F.lit(MAX_RISK_SCORE).cast("long"), F.coalesce(F.col("raw_score"), F.lit(0).cast("long")))
    return out.select(
        "repo",
        F.coalesce("finding_count", F.lit(0).cast("long")).alias("finding_count"),
        F.coalesce("high_count", F.lit(0).cast("long")).alias("high_count"),
        F.coalesce("medium_count", F.lit(0).cast("long")).alias("medium_count"),
        F.coalesce("low_count", F.lit(0).cast("long")).alias("low_count"),
        score.cast("int").alias("risk_score"),
        risk_band(score).alias("risk_band"),
    )


def severity_bars(summary: DataFrame) -> DataFrame:
    """Per repo and band, percent of the largest band (at least 1), rounded
    half up in double arithmetic, zero-filled for the three bands."""
    counts = F.array(
        F.struct(F.lit("high").alias("band"), F.col("high_count").alias("n")),
        F.struct(F.lit("medium").alias("band"), F.col("medium_count").alias("n")),
        F.struct(F.lit("low").alias("band"), F.col("low_count").alias("n")),
    )
    mx = F.greatest(F.lit(1).cast("long"), "high_count", "medium_count", "low_count")
    rows = summary.select("repo", mx.alias("mx"), F.inline(counts))
    pct = F.floor(F.col("n").cast("double") / F.col("mx").cast("double") * F.lit(100.0) + F.lit(0.5))
    return rows.select("repo", "band", F.col("n").alias("count"), pct.cast("int").alias("pct"))


def verified_share(candidate_count, verified_count):
    """round(100 * verified / candidates), 0 without candidates."""
    pct = F.floor(verified_count.cast("double") / candidate_count.cast("double") * F.lit(100.0) + F.lit(0.5))
    return F.when(candidate_count > 0, pct.cast("int")).otherwise(F.lit(0))
