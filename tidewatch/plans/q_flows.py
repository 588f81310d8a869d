"""Registered queries of whole flows and of write-then-read round trips:
review and CI flow, baseline, cache and history tables (S9-S13), verdict documents
that cannot be read (V3), SARIF documents (S16), UTF-8 decoding (S5), rule and language
filters (Q2, Q6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import baseline, filters, verdicts
from tidewatch.plans.flows import ci_flow, review_flow
from tidewatch.plans.oracle import SRC_DOCUMENTS
from tidewatch.plans.providers import labels_provider
from tidewatch.plans.q_code import KEPT, PY_FINDINGS_SQL, corpus_scan, ranked
from tidewatch.plans.q_findings import CACHE_KEY_SQL, FD, FD_EN, FP_SQL, LABEL_VERDICT_SQL, _sql_text, doc_findings
from tidewatch.plans.q_sources import _snapshots
from tidewatch.plans.registry import register
from tidewatch.session import checkpoint_dir
from tidewatch.sources import files, reports, stores, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _review(spark: SparkSession, sf_dir: str, history: str):
    provider = labels_provider(tables.read_table(spark, sf_dir, "labels"))
    src = tables.documents_as_sources(spark, sf_dir)
    empty = spark.createDataFrame([], stores.CACHE_SCHEMA)
    return review_flow(doc_findings(spark, sf_dir), src.select("repo", "path", "language"), empty, provider,
                       languages=["EN", "fr"], search="token", history=history)


REVIEWED_SQL = f"""(SELECT f.*, {LABEL_VERDICT_SQL} FROM {FD} f
  JOIN (SELECT doc_id AS d, lang FROM documents) k ON CAST(k.d AS VARCHAR) = f.file AND k.lang IN ('en', 'fr')
  LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = f.file
  WHERE contains(lower(f.file), 'token') OR contains(lower(f.title), 'token') OR contains(lower(f.description), 'token')
     OR contains(lower(f.snippet), 'token') OR contains(lower(f.rule_id), 'token'))"""
POINTS = "CASE lower(severity) WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END"


@register("review_flow", f"""
WITH r AS (SELECT DISTINCT repo FROM {SRC_DOCUMENTS}), v AS {REVIEWED_SQL}
SELECT r.repo AS repository, CAST(count(v.file) AS BIGINT) AS candidate_finding_count,
       CAST(count(v.file) FILTER (WHERE verified) AS BIGINT) AS verified_finding_count,
       CAST(least(100, coalesce(sum({POINTS}) FILTER (WHERE verified), 0)) AS INTEGER) AS risk_score
FROM r LEFT JOIN v ON v.repo = r.repo GROUP BY r.repo""")
def review_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan history that one review run appended (S13 round trip)."""
    root = _folder(spark, "review-history")
    _review(spark, sf_dir, root)
    out = stores.read_history(spark, f"{root}/scans", stores.SCANS_SCHEMA)
    return out.select("repository", "candidate_finding_count", "verified_finding_count", "risk_score")


@register("s12_validation_history", f"""
SELECT repo AS repository, rule_id, file, function, severity, CAST(verified AS INTEGER) AS verified, confidence FROM {REVIEWED_SQL} v""")
def s12_validation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "review-history")
    _review(spark, sf_dir, root)
    out = stores.read_history(spark, f"{root}/validations", stores.VALIDATIONS_SCHEMA)
    return out.select("repository", "rule_id", "file", "function", "severity", "verified", "confidence")


CHANGED_SQL = f"""(SELECT coalesce(b.repo, h.repo) AS repo, coalesce(b.path, h.path) AS path
  FROM (SELECT repo, path, sha256(content) AS hb FROM {SRC_DOCUMENTS} d WHERE language <> 'de') b
  FULL OUTER JOIN (SELECT repo, path, sha256(CASE WHEN language = 'fr' THEN content || chr(10) || '# edited' ELSE content END) AS hh
                   FROM {SRC_DOCUMENTS} d WHERE repo <> 'src1') h ON b.repo = h.repo AND b.path = h.path
  WHERE hb IS NULL OR hh IS NULL OR hb <> hh)"""


@register("ci_flow", f"""
WITH f AS {FD}, b AS (SELECT DISTINCT {FP_SQL} AS fp FROM {FD_EN} e), c AS {CHANGED_SQL},
k AS (SELECT f.* FROM f WHERE {FP_SQL} NOT IN (SELECT fp FROM b) AND EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.path = f.file)),
r AS (SELECT DISTINCT repo FROM {SRC_DOCUMENTS})
SELECT r.repo, CAST(count(k.file) AS BIGINT) AS n_findings,
       coalesce(bool_or(lower(k.severity) IN ('high', 'medium')), false) AS gate_triggered,
       CASE WHEN count(k.file) = 0 THEN 'No findings.' ELSE chr(10) || CAST(count(k.file) AS VARCHAR) || ' finding(s).' END AS footer
FROM r LEFT JOIN k ON k.repo = r.repo GROUP BY r.repo""")
def ci_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run writes the baseline of the English documents and stops; the
    second takes it out, keeps changed files, reports and sets the gate."""
    src = tables.documents_as_sources(spark, sf_dir)
    path = _folder(spark, "ci-baseline")
    ci_flow(doc_findings(spark, sf_dir, english_only=True), src, write_baseline_to=path)
    base, head = _snapshots(spark, sf_dir)
    run = ci_flow(doc_findings(spark, sf_dir), src, baseline=stores.load_baseline(spark, path),
                  changed=files.changed_files(base, head), fail_on="medium")
    n = run.findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n_findings"))
    footer = run.report.filter("part = 1").select("repo", F.col("text").alias("footer"))
    return run.gate.join(n, "repo", "left").join(footer, "repo").select(
        "repo", F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"), "gate_triggered", "footer")


@register("s9_baseline_roundtrip", f"SELECT DISTINCT {FP_SQL} AS fingerprint FROM {FD} f")
def s9_baseline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "baseline")
    stores.write_baseline(baseline.baseline_of(doc_findings(spark, sf_dir)), path)
    return stores.load_baseline(spark, path)


@register("s11_cache_roundtrip", f"""
SELECT cache_key, verified, confidence, explanation FROM (
  SELECT {CACHE_KEY_SQL} AS cache_key, {LABEL_VERDICT_SQL},
         row_number() OVER (PARTITION BY {CACHE_KEY_SQL} ORDER BY repo DESC, file DESC, line DESC, ord DESC) AS rk
  FROM {FD} e LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = e.file) WHERE rk = 1""")
def s11_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a review, saved and loaded again; an empty older version lies beside it."""
    root = _folder(spark, "cache")
    empty = spark.createDataFrame([], stores.CACHE_SCHEMA)
    stores.save_cache(empty, root)
    provider = labels_provider(tables.read_table(spark, sf_dir, "labels"))
    res = verdicts.validate_findings(doc_findings(spark, sf_dir), stores.load_cache(spark, root), provider)
    stores.update_cache(spark, root, res.new_rows)
    return stores.load_cache(spark, root).select("cache_key", "verified", "confidence", "explanation")


def odd_documents(prompts: DataFrame, batched: DataFrame) -> DataFrame:
    """A provider whose documents go wrong by batch number: sound, not JSON, a missing
    key, index 0 left out, index 0 twice, no document."""
    del prompts
    kind = F.col("batch_no") % 6
    item = F.struct(F.col("idx").cast("long").alias("index"), (F.col("idx") % 2 == 0).alias("verified"), F.lit("high").alias("confidence"),
                    F.concat(F.lit("n"), F.col("idx").cast("string")).alias("explanation"), F.lit("").alias("exploit_scenario"),
                    F.lit("").alias("patch_suggestion"), F.array().cast("array<string>").alias("things_to_verify"))
    per = batched.groupBy("batch_id", "batch_no").agg(F.sort_array(F.collect_list(item)).alias("r"))  # at most 8
    first = F.col("r")[0]
    again = F.struct(first["index"].alias("index"), F.lit(False).alias("verified"), F.lit("low").alias("confidence"), F.lit("second").alias("explanation"),
                     F.lit("").alias("exploit_scenario"), F.lit("").alias("patch_suggestion"), F.array().cast("array<string>").alias("things_to_verify"))
    results = (F.when(kind == 3, F.filter("r", lambda x: x["index"] != 0)).when(kind == 4, F.concat("r", F.array(again))).otherwise(F.col("r")))
    doc = F.to_json(F.struct(results.alias("results")))
    doc = F.when(kind == 1, F.lit("I cannot help with that")).when(kind == 2, F.replace(doc, F.lit('"explanation"'), F.lit('"reason"'))).otherwise(doc)
    return per.filter(kind != 5).select("batch_id", doc.alias("doc"))


@register("v3_verdict_errors", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line, ord) - 1 AS position FROM {FD} f),
b AS (SELECT *, (position // 8) % 6 AS kind, position % 8 AS idx FROM p)
SELECT repo, file, line, ord,
       CASE WHEN kind IN (1, 2, 5) OR (kind IN (3, 4) AND idx = 0) THEN false ELSE idx % 2 = 0 END AS verified,
       CASE WHEN kind IN (1, 2, 5) OR (kind IN (3, 4) AND idx = 0) THEN 'low' ELSE 'high' END AS confidence,
       CASE WHEN kind = 4 AND idx = 0 THEN 'second' WHEN kind IN (1, 2, 5) OR (kind = 3 AND idx = 0) THEN {_sql_text(verdicts.MISSING_EXPLANATION)}
            ELSE 'n' || CAST(idx AS VARCHAR) END AS explanation,
       CASE kind WHEN 1 THEN 'document is not JSON' WHEN 2 THEN 'document does not match the verdict schema' END AS error
FROM b""")
def v3_verdict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cannot be read, with dropped and repeated indexes, and none at all."""
    found = doc_findings(spark, sf_dir)
    res = verdicts.validate_findings(found, spark.createDataFrame([], stores.CACHE_SCHEMA), odd_documents)
    batch = verdicts.assign_batches(found).select("repo", "file", "line", "ord", "batch_id").join(res.errors, "batch_id", "left")
    return res.validated.join(batch, ["repo", "file", "line", "ord"]).select("repo", "file", "line", "ord", "verified", "confidence", "explanation", "error")


@register("s16_sarif_documents", f"""
WITH f AS (SELECT f.* FROM {FD} f JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.file WHERE d.lang = 'de' AND d.doc_id % 3 = 0)
SELECT r.repo, '2.1.0' AS version, CAST(count(f.file) AS INTEGER) AS n_results, CAST(count(DISTINCT f.rule_id) AS INTEGER) AS n_rules,
       count(f.file) = 0 AS clean
FROM (SELECT DISTINCT repo FROM {SRC_DOCUMENTS}) r LEFT JOIN f ON f.repo = r.repo GROUP BY r.repo""")
def s16_sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16 read back from the documents; a repository without findings has one without results."""
    src = tables.documents_as_sources(spark, sf_dir)
    found = doc_findings(spark, sf_dir)
    some = src.filter((F.col("language") == "de") & (F.col("path").cast("long") % 3 == 0)).select("repo", F.col("path").alias("file"))
    docs = reports.sarif_documents(found.join(some, ["repo", "file"], "left_semi"), src)
    results = F.get_json_object("document", "$.runs[0].results")
    return docs.select("repo", F.get_json_object("document", "$.version").alias("version"), F.json_array_length(results).alias("n_results"),
                       F.json_array_length(F.get_json_object("document", "$.runs[0].tool.driver.rules")).alias("n_rules"), (results == "[]").alias("clean"))


@register("s5_decoded_text", """
SELECT doc_id, md5(chr(65533) || text || chr(65533)) AS text_md5, CAST(length(text) + 2 AS BIGINT) AS n_chars FROM documents""")
def s5_decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 become U+FFFD, the rest is kept."""
    raw = tables.read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3"))).alias("raw"))
    text = files.decode_utf8(F.col("raw"))
    return raw.select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("text_md5"), F.char_length(text).cast("long").alias("n_chars"))


Q2_RULES = ("weak-crypto-hash", "dangerous-eval-exec", "no-such-rule")


@register("q2_findings_of_rules", f"""
SELECT * REPLACE (row_number() OVER (PARTITION BY repo, file ORDER BY ord) AS ord)
FROM {PY_FINDINGS_SQL} f WHERE rule_id IN ('weak-crypto-hash', 'dangerous-eval-exec')""")
def q2_findings_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(filters.filter_findings(corpus_scan(spark, sf_dir).findings, rules=Q2_RULES))


@register("q6_files_by_language", f"SELECT repo, path, language FROM {KEPT} k WHERE language IN ('Python', 'TypeScript')")
def q6_files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_files_by_language(corpus_scan(spark, sf_dir).files, ["python", "TYPESCRIPT"]).select("repo", "path", "language")
