"""Registered queries over a findings table: fingerprints and baselines
(B1-B3), cache keys (B4), batching (O6), prompts (V1), the verdict stage end
to end with a cache round trip (B5-B8, V3, V4), ranking (O1) and reports
(S15, S16).  Findings = lexical secret findings of ``documents``; verdicts
come from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import baseline, verdicts
from tidewatch.operators.findings import FINDING_COLUMNS
from tidewatch.operators.lexical import scan_secrets
from tidewatch.plans.oracle import RULES, SRC_DOCUMENTS, rl_findings_sql
from tidewatch.plans.providers import labels_provider
from tidewatch.plans.registry import register
from tidewatch.session import materialize
from tidewatch.sources import reports, stores, tables

FD = rl_findings_sql(SRC_DOCUMENTS)
FD_EN = rl_findings_sql(f"(SELECT * FROM {SRC_DOCUMENTS} WHERE language = 'en')")
FP_SQL = "sha256(rule_id || ':' || file || ':' || coalesce(function, '') || ':' || snippet)"
FCOLS = ", ".join(FINDING_COLUMNS)


def doc_findings(spark: SparkSession, sf_dir: str, english_only: bool = False) -> DataFrame:
    src = tables.documents_as_sources(spark, sf_dir)
    if english_only:
        src = src.filter(F.col("language") == "en")
    return scan_secrets(src)


@register("b1_fingerprints", f"SELECT repo, file, line, ord, rule_id, {FP_SQL} AS fingerprint FROM {FD} f")
def b1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.with_fingerprint(doc_findings(spark, sf_dir)).select(
        "repo", "file", "line", "ord", "rule_id", "fingerprint")


@register("b2_new_findings", f"""
WITH f AS {FD}, b AS (SELECT DISTINCT {FP_SQL} AS fp FROM {FD_EN} e)
SELECT {FCOLS} FROM f WHERE {FP_SQL} NOT IN (SELECT fp FROM b)""")
def b2_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = baseline.baseline_of(doc_findings(spark, sf_dir, english_only=True))
    return baseline.new_findings(doc_findings(spark, sf_dir), base)


@register("b3_baseline", f"SELECT DISTINCT {FP_SQL} AS fingerprint FROM {FD} f")
def b3_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.baseline_of(doc_findings(spark, sf_dir))


@register("b4_cache_keys", f"""
SELECT repo, file, line, ord, sha256('{verdicts.PROMPT_VERSION}:' || rule_id || ':' || snippet) AS cache_key FROM {FD} f""")
def b4_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).select("repo", "file", "line", "ord",
                                              verdicts.cache_key_col().alias("cache_key"))


BATCH_SQL = f"""(SELECT *, repo || '#' || CAST(position // 8 AS VARCHAR) AS batch_id,
       CAST(position % 8 AS INTEGER) AS idx
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line, ord) - 1 AS position FROM {FD} f))"""


@register("o6_batches", f"SELECT repo, file, line, ord, batch_id, idx FROM {BATCH_SQL}")
def o6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.assign_batches(doc_findings(spark, sf_dir)).select(
        "repo", "file", "line", "ord", "batch_id", "idx")


NL = "chr(10)"
LINE_SQL = ("to_json(struct_pack(n := idx, rule := rule_id, what := title, weakness := coalesce(cwe, ''), "
            "\"at\" := file || ':' || CAST(line AS VARCHAR), scope := coalesce(function, ''), why := description, code := snippet))")


def _sql_text(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


@register("v1_prompts", f"""
SELECT batch_id, repo, CAST(count(*) AS BIGINT) AS n,
       {_sql_text(verdicts.PROMPT_HEAD)} || string_agg(CAST({LINE_SQL} AS VARCHAR), {NL} ORDER BY idx) || {_sql_text(verdicts.PROMPT_TAIL)} AS prompt
FROM {BATCH_SQL} GROUP BY batch_id, repo""")
def v1_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.build_prompts(verdicts.assign_batches(doc_findings(spark, sf_dir)))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two review rounds: English documents first (empty cache), then all
    documents with the cache the first round wrote (hits + new misses).  The
    lexical findings are computed once and written; round 1 takes the English
    documents' share of them."""
    provider = labels_provider(tables.read_table(spark, sf_dir, "labels"))
    empty = spark.createDataFrame([], stores.CACHE_SCHEMA)
    findings = materialize(doc_findings(spark, sf_dir), "doc-findings")
    english = (tables.read_table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
               .select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file")))
    first = verdicts.validate_findings(findings.join(english, ["repo", "file"], "left_semi"), empty, provider)
    cache = materialize(first.new_cache, "verdict-cache")      # the cache a first review run saved
    second = verdicts.validate_findings(findings, cache, provider)
    return second.validated


LABEL_VERDICT_SQL = f"""coalesce(l.quality = 1, false) AS verified,
    CASE WHEN l.doc_id IS NULL THEN 'low' WHEN l.toxic = 1 THEN 'low' WHEN l.quality = 1 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN l.doc_id IS NULL THEN {_sql_text(verdicts.MISSING_EXPLANATION)}
         ELSE 'label quality=' || CAST(l.quality AS VARCHAR) || ', toxic=' || CAST(l.toxic AS VARCHAR) END AS explanation,
    '' AS exploit_scenario, '' AS patch_suggestion,
    CASE WHEN l.doc_id IS NULL THEN {_sql_text(verdicts.MISSING_TODO)} ELSE 'check the label' END AS things_to_verify"""
CACHE_KEY_SQL = f"sha256('{verdicts.PROMPT_VERSION}:' || rule_id || ':' || snippet)"

# Round 1 reviews the English documents and caches, per key, the verdict of the
# last finding in (repo, file, line, ord) order; round 2 reviews everything,
# taking cached verdicts for known keys.
VALIDATED_SQL = f"""(WITH r1 AS (
    SELECT * FROM (SELECT {CACHE_KEY_SQL} AS cache_key, {LABEL_VERDICT_SQL},
        row_number() OVER (PARTITION BY {CACHE_KEY_SQL} ORDER BY repo DESC, file DESC, line DESC, ord DESC) AS rk
      FROM {FD_EN} e LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = e.file) WHERE rk = 1),
  own AS (SELECT f.*, {CACHE_KEY_SQL} AS cache_key, {LABEL_VERDICT_SQL}
      FROM {FD} f LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = f.file)
  SELECT {", ".join("own." + c for c in FINDING_COLUMNS)},
    CASE WHEN r1.cache_key IS NULL THEN own.verified ELSE r1.verified END AS verified,
    CASE WHEN r1.cache_key IS NULL THEN own.confidence ELSE r1.confidence END AS confidence,
    CASE WHEN r1.cache_key IS NULL THEN own.explanation ELSE r1.explanation END AS explanation,
    '' AS exploit_scenario, '' AS patch_suggestion,
    CASE WHEN r1.cache_key IS NULL THEN own.things_to_verify ELSE r1.things_to_verify END AS things_to_verify
  FROM own LEFT JOIN r1 USING (cache_key))"""

VERDICT_OUT = ("verified", "confidence", "explanation", "exploit_scenario", "patch_suggestion")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLUMNS, *VERDICT_OUT,
                     F.array_join("things_to_verify", "\n").alias("things_to_verify"))


@register("v4_validated_findings", f"SELECT * FROM {VALIDATED_SQL}")
def v4_validated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_validated(spark, sf_dir))


@register("b8_dismissed_findings", f"SELECT * FROM {VALIDATED_SQL} WHERE NOT verified")
def b8_dismissed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(verdicts.split_verified(_validated(spark, sf_dir))[1])


@register("o1_ranked_verified", f"""
SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS severity_rank,
       CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS confidence_rank
FROM {VALIDATED_SQL} WHERE verified""")
def o1_ranked_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    ver, _ = verdicts.split_verified(_validated(spark, sf_dir))
    return verdicts.rank_verified(_flat(ver))


@register("s15_text_report", f"""
WITH f AS {FD}, r AS (SELECT DISTINCT repo FROM {SRC_DOCUMENTS}),
c AS (SELECT repo, count(*) AS n FROM f GROUP BY repo)
SELECT repo, 0 AS part, file, line, ord,
       file || ':' || CAST(line AS VARCHAR) || CASE WHEN function IS NOT NULL THEN ' (' || function || ')' ELSE '' END
       || ' [' || severity || '] ' || rule_id || ' — ' || title AS text FROM f
UNION ALL
SELECT r.repo, 1, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT),
       CASE WHEN c.n IS NULL THEN 'No findings.' ELSE chr(10) || CAST(c.n AS VARCHAR) || ' finding(s).' END
FROM r LEFT JOIN c USING (repo)""")
def s15_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_report_rows(doc_findings(spark, sf_dir), tables.documents_as_sources(spark, sf_dir))


SARIF_LEVEL_SQL = ("CASE lower(severity) WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' "
                   "WHEN 'low' THEN 'note' ELSE 'warning' END")


@register("s16_sarif_results", f"""
SELECT repo, file, line, ord, rule_id, {SARIF_LEVEL_SQL} AS level,
       CASE WHEN explanation IS NOT NULL AND explanation <> '' THEN explanation ELSE description END AS message,
       greatest(1, line) AS start_line, function AS logical_name
FROM {VALIDATED_SQL} v""")
def s16_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF results of validated findings (the explanation wins over the description)."""
    return reports.sarif_results(_validated(spark, sf_dir))


@register("s16_sarif_rules", f"""
WITH f AS {FD},
fs AS (SELECT repo, rule_id, min({{'file': file, 'line': line, 'ord': ord}}) AS s FROM f GROUP BY repo, rule_id)
SELECT fs.repo, fs.rule_id, fs.s.file AS first_file, fs.s.line AS first_line, fs.s.ord AS first_ord,
       coalesce(r.title, fs.rule_id) AS short_description, coalesce(r.description, '') AS full_description,
       CASE WHEN r.cwe IS NULL THEN '' ELSE 'https://cwe.mitre.org/data/definitions/' || split_part(r.cwe, '-', -1) || '.html' END AS help_uri,
       concat_ws(',', r.cwe, r.owasp) AS tags, r.remediation AS help_text
FROM fs LEFT JOIN {RULES} r USING (rule_id)""")
def s16_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(doc_findings(spark, sf_dir))


@register("d6_verified_share", f"""
SELECT repo, CAST(count(*) AS BIGINT) AS candidate_count, CAST(count(*) FILTER (WHERE verified) AS BIGINT) AS verified_count,
       CAST(floor(CAST(count(*) FILTER (WHERE verified) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 + 0.5) AS INTEGER) AS verified_pct
FROM {VALIDATED_SQL} v GROUP BY repo""")
def d6_verified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, verified and the rounded verified share per repository."""
    from tidewatch.operators.summary import verified_share
    v = _validated(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("candidate_count"),
                                                      F.count_if("verified").alias("verified_count"))
    return v.withColumn("verified_pct", verified_share(F.col("candidate_count"), F.col("verified_count")))


@register("q8_findings_in_changed_files", f"""
WITH f AS {FD},
b AS (SELECT repo, path, sha256(content) AS hb FROM {SRC_DOCUMENTS} d WHERE language <> 'de'),
h AS (SELECT repo, path, sha256(CASE WHEN language = 'fr' THEN content || chr(10) || '# edited' ELSE content END) AS hh
      FROM {SRC_DOCUMENTS} d WHERE repo <> 'src1'),
c AS (SELECT coalesce(b.repo, h.repo) AS repo, coalesce(b.path, h.path) AS path FROM b FULL OUTER JOIN h
      ON b.repo = h.repo AND b.path = h.path WHERE hb IS NULL OR hh IS NULL OR hb <> hh)
SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.path = f.file)""")
def q8_findings_in_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 over S17: findings whose file changed between the two snapshots."""
    from tidewatch.operators.filters import filter_to_changed
    from tidewatch.plans.q_sources import _snapshots
    from tidewatch.sources.files import changed_files
    base, head = _snapshots(spark, sf_dir)
    return filter_to_changed(doc_findings(spark, sf_dir), changed_files(base, head))
