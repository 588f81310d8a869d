"""Finding construction: rule metadata (F1), rule disabling (F4), snippets and
redaction (F2, F3, see operators.windows), emission order.

A *candidate* has ``repo, file, line, function, rule_id, snippet, via_param,
ord``; ``attach_metadata`` turns it into the findings table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import CROSS_FUNCTION_NOTE, RULES, rules_df

SECRET_RULE = "hardcoded-secret"
FINDING_COLUMNS = ("repo", "file", "line", "function", "rule_id", "title", "severity", "cwe",
                   "owasp", "snippet", "description", "remediation", "ord")


def parse_disabled(raw: str | Iterable[str] | None) -> list[str]:
    """Comma list (or iterable) of rule ids; trimmed, empties ignored."""
    if raw is None:
        return []
    items = raw.split(",") if isinstance(raw, str) else list(raw)
    return sorted({s.strip() for s in items if s and s.strip()})


def drop_disabled(candidates: DataFrame, disabled: str | Iterable[str] | None) -> DataFrame:
    ids = parse_disabled(disabled)
    return candidates.filter(~F.col("rule_id").isin(ids)) if ids else candidates


def attach_metadata(candidates: DataFrame, disabled: str | Iterable[str] | None = None, only_rule: str | None = None) -> DataFrame:
    """Add title, severity, CWE, OWASP, description (+ cross-function note) and
    remediation; unknown rule ids are dropped.  The dimension has 19 rows, so
    broadcasting it is bounded; candidates that are all of ``only_rule`` get its row as literals."""
    cand = drop_disabled(candidates, disabled)
    if "via_param" not in cand.columns:
        cand = cand.withColumn("via_param", F.lit(False))
    if only_rule is not None:
        r = next(r for r in RULES if r.rule_id == only_rule)
        j = cand.withColumns({c: F.lit(getattr(r, c)).cast("string") for c in ("title", "severity", "cwe", "owasp", "description", "remediation")})
    else:
        j = cand.join(F.broadcast(rules_df(cand.sparkSession)), "rule_id")
    return j.select(
        "repo", "file", F.col("line").cast("int").alias("line"), "function", "rule_id", "title", "severity", "cwe", "owasp", "snippet",
        F.when(F.col("via_param"), F.concat("description", F.lit(CROSS_FUNCTION_NOTE))).otherwise(F.col("description")).alias("description"),
        "remediation", F.col("ord").cast("long").alias("ord"),
    )


def attach_snippets(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """F2 + F3: looks up the snippet of candidates (repo, file, line, pos, rule_id) in the
    fact pass's ``windows`` (see ``operators.windows``).  Both sides are short rows, about as many as there are
    findings; no file content is read or shuffled."""
    own = F.when(F.col("rule_id") == SECRET_RULE, F.col("pos").cast("int")).otherwise(F.lit(-1))
    w = windows.select("repo", F.col("path").alias("file"), "line", F.coalesce("pos", F.lit(-1)).alias("__at"), "snippet")
    return candidates.withColumn("__at", own).join(w, ["repo", "file", "line", "__at"], "left").drop("__at")
