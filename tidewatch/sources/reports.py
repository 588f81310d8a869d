"""Finding reports: JSON lines (S14), text report (S15), SARIF 2.1.0.

Reports are built as rows first (one row per finding plus small per-repo
rows), so they can be checked as tables and written without collecting a
repository's findings into one row.  JSON lines and text are range-sorted, so a large
repository is several files in order; a SARIF document is one file by its format.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import RULES, SARIF_LEVEL
from tidewatch.operators.findings import FINDING_COLUMNS

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL_NAME = "tidewatch"
TOOL_VERSION = "0.1.0"


# -- S14 ----------------------------------------------------------------------

def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding (the finding fields, no internals)."""
    cols = [c for c in FINDING_COLUMNS if c not in ("repo", "ord")]
    return findings.select("repo", "file", "line", "ord",
                           F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_findings_json(findings: DataFrame, path: str) -> None:
    (findings_json(findings).repartitionByRange("repo", "file", "line", "ord").sortWithinPartitions("repo", "file", "line", "ord")
     .select("repo", "json").write.mode("overwrite").partitionBy("repo").text(path))


# -- S15 ----------------------------------------------------------------------

def text_report_rows(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """S15 as rows (repo, part, file, line, ord, text): part 0 = one line per
    finding ``file:line (function) [severity] rule — title``, part 1 = the
    footer (blank line + count) or ``No findings.`` for a clean repository."""
    func = F.when(F.col("function").isNotNull(), F.concat(F.lit(" ("), F.col("function"), F.lit(")"))).otherwise(F.lit(""))
    body = findings.select(
        "repo", F.lit(0).alias("part"), "file", "line", "ord",
        F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), func, F.lit(" ["), F.col("severity"),
                 F.lit("] "), F.col("rule_id"), F.lit(" — "), F.col("title")).alias("text"))
    counts = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    foot = (repos.select("repo").distinct().join(counts, "repo", "left")
            .select("repo", F.lit(1).alias("part"), F.lit(None).cast("string").alias("file"),
                    F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("ord"),
                    F.when(F.col("n").isNull(), F.lit("No findings."))
                    .otherwise(F.concat(F.lit("\n"), F.col("n").cast("string"), F.lit(" finding(s).")))
                    .alias("text")))
    return body.unionByName(foot)


def write_text_report(rows: DataFrame, path: str) -> None:
    (rows.repartitionByRange("repo", "part", "file", "line", "ord").sortWithinPartitions("repo", "part", "file", "line", "ord")
     .select("repo", "text").write.mode("overwrite").partitionBy("repo").text(path))


# -- S16 ----------------------------------------------------------------------

def _rule_table(spark) -> DataFrame:
    rows = []
    for r in RULES:
        cwe_no = r.cwe.split("-")[-1] if r.cwe else None
        rows.append((r.rule_id, r.title, r.description, r.remediation,
                     f"https://cwe.mitre.org/data/definitions/{cwe_no}.html" if cwe_no else "",
                     [t for t in (r.cwe, r.owasp) if t]))
    return spark.createDataFrame(rows, "rule_id string, title string, description string, remediation string, "
                                       "help_uri string, tags array<string>")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """S16 rule descriptors: one per distinct rule of a repo, with the position
    of its first finding (request order) for first-seen ordering.  An unknown
    rule id gets its id as title and empty texts.  At most 19 rows per repo."""
    first = findings.groupBy("repo", "rule_id").agg(F.min(F.struct("file", "line", "ord")).alias("first_seen"))
    meta = F.broadcast(_rule_table(findings.sparkSession))
    j = first.join(meta, "rule_id", "left")
    return j.select(
        "repo", "rule_id", F.col("first_seen.file").alias("first_file"), F.col("first_seen.line").alias("first_line"),
        F.col("first_seen.ord").alias("first_ord"),
        F.coalesce("title", "rule_id").alias("short_description"),
        F.coalesce("description", F.lit("")).alias("full_description"),
        F.coalesce("help_uri", F.lit("")).alias("help_uri"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"),
        F.col("remediation").alias("help_text"))


def sarif_level(sev):
    lvl = F.lit("warning")
    for k, v in SARIF_LEVEL.items():
        lvl = F.when(F.lower(sev) == F.lit(k), F.lit(v)).otherwise(lvl)
    return lvl


def sarif_results(findings: DataFrame) -> DataFrame:
    """S16 results: level from severity (else warning), message = explanation
    when present and non-empty else description, start line at least 1,
    logical location = function when set."""
    msg = F.col("description")
    if "explanation" in findings.columns:
        msg = F.when(F.col("explanation").isNotNull() & (F.col("explanation") != ""), F.col("explanation")).otherwise(msg)
    return findings.select(
        "repo", "file", "line", "ord", "rule_id", sarif_level(F.col("severity")).alias("level"),
        msg.alias("message"), F.greatest(F.lit(1), F.col("line")).alias("start_line"),
        F.col("function").alias("logical_name"))


def sarif_fragments(findings: DataFrame, repos: DataFrame | None = None, tool_name: str = TOOL_NAME, tool_version: str = TOOL_VERSION) -> DataFrame:
    """Rows (repo, part, file, line, ord, text) whose concatenation in key order is
    the repository's SARIF document.  Results keep request order.  ``repos`` (repo)
    names all scanned repositories: one without findings gets a document without
    results, which is what clears its old alerts."""
    listed = findings.select("repo") if repos is None else findings.select("repo").unionByName(repos.select("repo"))
    listed = listed.distinct()
    res = sarif_results(findings)
    loc = F.struct(
        F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
                 F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"),
        F.when(F.col("logical_name").isNotNull(), F.array(F.struct(F.col("logical_name").alias("name"))))
         .otherwise(F.array().cast("array<struct<name:string>>")).alias("logicalLocations"))
    result_json = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level",
                                     F.struct(F.col("message").alias("text")).alias("message"),
                                     F.array(loc).alias("locations")))
    first = res.groupBy("repo").agg(F.min(F.struct("file", "line", "ord")).alias("f"))
    body = (res.join(first, "repo")
            .select("repo", F.lit(2).alias("part"), "file", "line", "ord",
                    F.concat(F.when(F.struct("file", "line", "ord") == F.col("f"), F.lit("")).otherwise(F.lit(",")),
                             result_json).alias("text")))
    rules = sarif_rules(findings)
    rule_json = F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"),
        F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.col("help_uri").alias("helpUri"),
        F.struct(F.filter(F.split("tags", ","), lambda t: t != "").alias("tags")).alias("properties"),
        F.when(F.col("help_text").isNotNull(), F.struct(F.col("help_text").alias("text"))).alias("help")))
    by_repo = (rules.groupBy("repo").agg(F.sort_array(F.collect_list(
        F.struct("first_file", "first_line", "first_ord", rule_json.alias("j")))).alias("rs")))
    head_rules = (listed.join(by_repo, "repo", "left")
        .select("repo", F.lit(1).alias("part"), F.lit(None).cast("string").alias("file"),
                F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("ord"),
                F.concat(F.lit('{"$schema":' + json.dumps(SARIF_SCHEMA_URI) + ',"version":"' + SARIF_VERSION +
                               '","runs":[{"tool":{"driver":{"name":' + json.dumps(tool_name) + ',"version":' +
                               json.dumps(tool_version) + ',"rules":['),
                         F.coalesce(F.array_join(F.transform("rs", lambda x: x["j"]), ","), F.lit("")),
                         F.lit(']}},"results":[')).alias("text")))
    tail = (listed.select(
        "repo", F.lit(3).alias("part"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("long").alias("ord"), F.lit("]}]}").alias("text")))
    return head_rules.unionByName(body).unionByName(tail)


def sarif_documents(findings: DataFrame, repos: DataFrame | None = None, **kw) -> DataFrame:
    """(repo, document): the fragments of each repository joined to its one SARIF text."""
    parts = F.sort_array(F.collect_list(F.struct("part", "file", "line", "ord", "text")))
    return sarif_fragments(findings, repos, **kw).groupBy("repo").agg(parts.alias("p")).select(
        "repo", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("document"))


def write_sarif(findings: DataFrame, path: str, **kw) -> None:
    """One SARIF document per repository under ``path/repo=<repo>/``."""
    (sarif_fragments(findings, **kw).repartition("repo")
     .sortWithinPartitions("repo", "part", "file", "line", "ord")
     .select("repo", "text").write.mode("overwrite").partitionBy("repo").text(path))
