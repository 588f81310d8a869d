"""Registered queries over the text tables: lexical findings, file facts,
summaries and filters (RL, F1-F4, P1, P9, D1-D7, Q1-Q9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import loc_from_lines, split_lines
from tidewatch.operators import filters, summary
from tidewatch.operators.lexical import scan_secrets
from tidewatch.plans.oracle import (SRC_ALL_TEXT, SRC_DOCUMENTS, lines_sql, rl_findings_sql)
from tidewatch.plans.registry import register
from tidewatch.sources import tables


def rl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(tables.documents_as_sources(spark, sf_dir))


def rl_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(tables.all_text_sources(spark, sf_dir))


register("rl_secrets_documents", rl_findings_sql(SRC_DOCUMENTS))(rl_documents)
register("rl_secrets_all_text", rl_findings_sql(SRC_ALL_TEXT))(rl_all_text)


@register("p1_loc_documents", f"""
SELECT repo, path, language, CAST(loc AS INTEGER) AS loc FROM {lines_sql(SRC_DOCUMENTS)}""")
def p1_loc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.documents_as_sources(spark, sf_dir)
    return src.select("repo", "path", "language",
                      loc_from_lines(split_lines(F.col("content"))).cast("int").alias("loc"))


@register("p9_inventory_all_text", f"""
SELECT repo, CAST(count(*) AS BIGINT) AS file_count,
       array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
       CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM {SRC_ALL_TEXT} GROUP BY repo""")
def p9_inventory_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File count and sorted distinct languages per repository."""
    src = tables.all_text_sources(spark, sf_dir)
    return src.groupBy("repo").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"),
        F.sum("bytes").cast("long").alias("total_bytes"),
    )


RL_ALL = rl_findings_sql(SRC_ALL_TEXT)


@register("d1_severity_distribution", f"""
SELECT repo, lower(severity) AS severity, CAST(count(*) AS BIGINT) AS n FROM {RL_ALL} f GROUP BY 1, 2""")
def d1_severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.severity_distribution(rl_all_text(spark, sf_dir))


@register("d2_rule_distribution", f"""
SELECT repo, rule_id, CAST(count(*) AS BIGINT) AS n FROM {RL_ALL} f GROUP BY 1, 2""")
def d2_rule_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.rule_distribution(rl_all_text(spark, sf_dir))


@register("d1_distribution_maps", f"""
WITH f AS {RL_ALL}, s AS (SELECT repo, lower(severity) AS severity, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT repo, rule_id, count(*) AS n FROM f GROUP BY 1, 2)
SELECT repo, (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM s WHERE s.repo = x.repo) AS severities,
       (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM r WHERE r.repo = x.repo) AS rules
FROM (SELECT DISTINCT repo FROM f) x""")
def d1_distribution_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repository with both maps, written as sorted text."""
    m = summary.distributions_as_maps(rl_all_text(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("repo", text("severity_distribution").alias("severities"), text("rule_distribution").alias("rules"))


SUMMARY_SQL = f"""
WITH f AS {RL_ALL},
p AS (SELECT repo, count(*) AS finding_count,
        count(*) FILTER (WHERE lower(severity) = 'high') AS high_count,
        count(*) FILTER (WHERE lower(severity) = 'medium') AS medium_count,
        count(*) FILTER (WHERE lower(severity) = 'low') AS low_count,
        sum(CASE lower(severity) WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END) AS raw
      FROM f GROUP BY repo),
r AS (SELECT DISTINCT repo FROM {SRC_ALL_TEXT}),
s AS (SELECT r.repo,
        CAST(coalesce(finding_count, 0) AS BIGINT) AS finding_count,
        CAST(coalesce(high_count, 0) AS BIGINT) AS high_count,
        CAST(coalesce(medium_count, 0) AS BIGINT) AS medium_count,
        CAST(coalesce(low_count, 0) AS BIGINT) AS low_count,
        CAST(least(100, coalesce(raw, 0)) AS INTEGER) AS risk_score
      FROM r LEFT JOIN p USING (repo))
"""


@register("d3_summary_all_text", SUMMARY_SQL + """
SELECT *, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS risk_band
FROM s""")
def d3_summary_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.all_text_sources(spark, sf_dir)
    return summary.summarize(scan_secrets(src), src)


@register("d5_severity_bars", SUMMARY_SQL + """,
b AS (SELECT repo, greatest(1, high_count, medium_count, low_count) AS mx,
        unnest(['high', 'medium', 'low']) AS band,
        unnest([high_count, medium_count, low_count]) AS n FROM s)
SELECT repo, band, n AS count,
       CAST(floor(CAST(n AS DOUBLE) / CAST(mx AS DOUBLE) * 100.0 + 0.5) AS INTEGER) AS pct FROM b""")
def d5_severity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.all_text_sources(spark, sf_dir)
    return summary.severity_bars(summary.summarize(scan_secrets(src), src))


FILTER_LANGS = ("EN", "de")
FILTER_SEVERITY = ("MEDIUM", "high")
FILTER_SEARCH = "ToKeN"


@register("q7_filtered_findings", f"""
WITH f AS {RL_ALL}, files AS {SRC_ALL_TEXT}
SELECT f.* FROM f
WHERE lower(f.severity) IN ('medium', 'high')
  AND EXISTS (SELECT 1 FROM files WHERE files.repo = f.repo AND files.path = f.file
              AND lower(files.language) IN ('en', 'de'))
  AND (contains(lower(f.file), 'token') OR contains(lower(f.title), 'token')
       OR contains(lower(f.description), 'token') OR contains(lower(f.snippet), 'token')
       OR contains(lower(f.rule_id), 'token')
       OR (f.function IS NOT NULL AND contains(lower(f.function), 'token')))""")
def q7_filtered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.all_text_sources(spark, sf_dir)
    files = src.select("repo", "path", "language")
    return filters.filter_findings(scan_secrets(src), files=files, severity=FILTER_SEVERITY,
                                   languages=FILTER_LANGS, search=FILTER_SEARCH)


@register("q9_gate_medium", f"""
WITH f AS {RL_ALL}, r AS (SELECT DISTINCT repo FROM {SRC_ALL_TEXT}),
h AS (SELECT repo, bool_or(CASE lower(severity) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END >= 1) AS hit
      FROM f GROUP BY repo)
SELECT r.repo, coalesce(h.hit, false) AS gate_triggered FROM r LEFT JOIN h USING (repo)""")
def q9_gate_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.all_text_sources(spark, sf_dir)
    return filters.gate(scan_secrets(src), src, "medium")


