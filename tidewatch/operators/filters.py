"""Finding and file filters (Q1-Q9).

Every filter is a predicate or a semi join, so Catalyst can push it as far
down as the plan allows.  Findings are file-local, so path / language /
changed-file predicates may also be applied to the *sources* before fact
extraction (``plans.scan`` does that); the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import SEVERITY_GATE_RANK

SEARCH_COLUMNS = ("file", "title", "description", "snippet", "rule_id")


def _rank(sev_lower):
    r = F.lit(0)
    for name, rank in SEVERITY_GATE_RANK.items():
        r = F.when(sev_lower == F.lit(name), F.lit(rank)).otherwise(r)
    return r


def search_predicate(query: str):
    """Q5: case-insensitive substring over file, title, description, snippet,
    rule id, and the function when it is set."""
    q = F.lit(query.lower())
    cond = F.lit(False)
    for c in SEARCH_COLUMNS:
        cond = cond | F.lower(F.col(c)).contains(q)
    cond = cond | (F.col("function").isNotNull() & F.lower(F.col("function")).contains(q))
    return cond


def filter_findings(findings: DataFrame, files: DataFrame | None = None,
                    severity: Sequence[str] | None = None, languages: Sequence[str] | None = None,
                    rules: Sequence[str] | DataFrame | None = None, search: str | None = None) -> DataFrame:
    """Q7: AND of the given filters; None or empty means no filter.

    ``files`` (repo, path, language) is the unfiltered file inventory (Q4); the
    language filter (Q3) is a left-semi join to it, so a finding whose file is
    unknown is dropped, and the filter is skipped when ``files`` is None.
    ``rules`` may be a list (Q2, exact) or a one-column DataFrame of rule ids
    (left-semi join, for long lists).
    """
    out = findings
    if severity:
        out = out.filter(F.lower("severity").isin(sorted({s.lower() for s in severity})))
    if rules is not None:
        if isinstance(rules, DataFrame):
            out = out.join(rules.select(F.col(rules.columns[0]).alias("rule_id")).distinct(), "rule_id", "left_semi")
        elif len(rules) > 0:
            out = out.filter(F.col("rule_id").isin(sorted(set(rules))))
    if languages and files is not None:
        wanted = sorted({lang.lower() for lang in languages})
        keep = (files.filter(F.lower("language").isin(wanted))
                .select("repo", F.col("path").alias("file")))
        out = out.join(keep, ["repo", "file"], "left_semi")
    if search:
        out = out.filter(search_predicate(search))
    return out


def filter_files_by_language(files: DataFrame, languages: Sequence[str] | None) -> DataFrame:
    """Q6."""
    if not languages:
        return files
    return files.filter(F.lower("language").isin(sorted({lang.lower() for lang in languages})))


def filter_to_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Q8: findings whose (repo, file) is in ``changed`` (repo, path)."""
    return findings.join(changed.select("repo", F.col("path").alias("file")).distinct(), ["repo", "file"], "left_semi")


def gate(findings: DataFrame, repos: DataFrame, fail_on: str | None) -> DataFrame:
    """Q9: per repository, is any finding at or above ``fail_on``?  Unknown
    severities rank 0 (so they trip 'low'); no threshold means false."""
    all_repos = repos.select("repo").distinct()
    if not fail_on:
        return all_repos.withColumn("gate_triggered", F.lit(False))
    threshold = SEVERITY_GATE_RANK.get(fail_on.lower(), 0)
    hit = findings.groupBy("repo").agg(F.bool_or(_rank(F.lower("severity")) >= threshold).alias("hit"))
    return (all_repos.join(hit, "repo", "left")
            .select("repo", F.coalesce("hit", F.lit(False)).alias("gate_triggered")))
