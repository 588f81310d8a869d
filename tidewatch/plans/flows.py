"""The two whole flows as one call each: review (filters, verdicts, ranking,
summary, history) and continuous integration (baseline, changed files, report, gate)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewatch.operators import baseline as bl
from tidewatch.operators import filters, summary, verdicts
from tidewatch.session import materialize
from tidewatch.sources import reports, stores


@dataclass
class Review:
    candidates: DataFrame   # findings after the filters, before any verdict
    verified: DataFrame     # ranked
    dismissed: DataFrame
    summary: DataFrame      # per repository, of the verified findings only
    errors: DataFrame       # verdict documents that could not be read
    new_cache: DataFrame    # whole, lazily merged
    new_rows: DataFrame     # what this review adds to it, for ``stores.update_cache``
    warnings: list[str] = field(default_factory=list)


def review_flow(findings: DataFrame, files: DataFrame, cache: DataFrame, provider: verdicts.Provider, *,
                severity: Sequence[str] | None = None, languages: Sequence[str] | None = None,
                rules: Sequence[str] | None = None, search: str | None = None, history: str | None = None,
                branch: str | None = None, fail_fast: bool = False) -> Review:
    """Filters come before the review, so nothing that was filtered out is paid
    for.  ``files`` (repo, path, language) names the scanned repositories.
    History is appended under ``history``; a failed append is a warning, never a failed review."""
    candidates = materialize(filters.filter_findings(findings, files, severity, languages, rules, search), "review-candidates")
    res = verdicts.validate_findings(candidates, cache, provider, fail_fast=fail_fast)
    validated = materialize(res.validated, "review-validated")
    verified, dismissed = verdicts.split_verified(validated)
    repos = files.select("repo").distinct()
    out = Review(candidates, verdicts.rank_verified(verified), dismissed, summary.summarize(verified, repos), res.errors, res.new_cache, res.new_rows)
    if history is not None:
        for what, append in (("validations", lambda p: stores.record_validations(validated, p)),
                             ("scans", lambda p: stores.record_scans(stores.scan_rows(candidates, validated, repos, branch), p))):
            try:
                append(f"{history.rstrip('/')}/{what}")
            except Exception as e:
                out.warnings.append(f"history of {what} was not written: {type(e).__name__}: {str(e)[:200]}")
    return out


@dataclass
class Ci:
    findings: DataFrame   # what is new and in changed files
    report: DataFrame     # text report rows
    gate: DataFrame       # (repo, gate_triggered)
    baseline_written: bool = False


def ci_flow(findings: DataFrame, repos: DataFrame, *, baseline: DataFrame | None = None, changed: DataFrame | None = None,
            fail_on: str | None = None, write_baseline_to: str | None = None) -> Ci:
    """With ``write_baseline_to`` the findings become the baseline and the flow
    stops (clean gate); otherwise known findings and unchanged files are taken
    out, what is left is reported, and the gate is set from it."""
    if write_baseline_to is not None:
        stores.write_baseline(bl.baseline_of(findings), write_baseline_to)
        nothing = findings.limit(0)
        return Ci(nothing, reports.text_report_rows(nothing, repos), filters.gate(nothing, repos, None), True)
    left = findings if baseline is None else bl.new_findings(findings, baseline)
    left = left if changed is None else filters.filter_to_changed(left, changed)
    left = materialize(left, "ci-findings")
    return Ci(left, reports.text_report_rows(left, repos), filters.gate(left, repos, fail_on))
