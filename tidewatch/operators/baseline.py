"""Finding identity and baselines.

B1 fingerprint = sha256 of ``rule_id:file:function-or-empty:snippet`` (no line,
so unrelated edits above a finding keep it stable).  A baseline is a
distributed table of fingerprints; "new findings" is a left-anti join to it,
so its size never has to fit in one task (AQE picks broadcast or sort-merge
from the runtime size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint_col():
    raw = F.concat_ws(":", F.col("rule_id"), F.col("file"), F.coalesce(F.col("function"), F.lit("")),
                      F.col("snippet"))
    return F.sha2(raw, 256)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint_col())


def baseline_of(findings: DataFrame) -> DataFrame:
    """The distinct fingerprints of a findings table."""
    return findings.select(fingerprint_col().alias("fingerprint")).distinct()


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """B2: findings whose fingerprint is not in the baseline (an empty baseline
    keeps everything, which the anti join does by itself)."""
    fp = baseline.select("fingerprint").where(F.col("fingerprint").isNotNull())
    return (with_fingerprint(findings).join(fp, "fingerprint", "left_anti").drop("fingerprint"))
