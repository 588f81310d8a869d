"""Registered queries over the code corpus derived from ``documents``:
discovery (S2-S4), file facts (P1-P7, P9), cross-function seeds (T5, T6) and
the findings of all 24 detectors with taint (R1-R24, T1-T9, F1-F4, P10) for
Python and JavaScript / TypeScript, plus the summaries over them."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import facts_python as fp
from tidewatch.operators import rules_python as rp
from tidewatch.operators import summary, taint
from tidewatch.operators.findings import FINDING_COLUMNS
from tidewatch.plans import code_corpus as cc
from tidewatch.plans.oracle import NOTE, RULES, lines_sql, snippet_sql
from tidewatch.plans.registry import register
from tidewatch.plans.scan import discover, inventory_classes, inventory_functions, scan_sources
from tidewatch.session import materialize

# Scans of this process, by the session object itself: a scan dies with its session.
_CACHE: WeakKeyDictionary = WeakKeyDictionary()


def kept_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover(cc.code_corpus(spark, sf_dir).select("repo", "path", "content", "bytes"))



def corpus_scan(spark: SparkSession, sf_dir: str):
    """One scan per (session, sf_dir) within a process: the fact job is
    checkpointed, so later queries reuse it instead of re-parsing."""
    scans = _CACHE.setdefault(spark, {})
    if sf_dir not in scans:
        # The derived corpus stands in for a source table: write it once, so
        # the fact job and the snippet join both read it instead of rebuilding it.
        sources = materialize(kept_corpus(spark, sf_dir), "code-corpus")
        scans[sf_dir] = scan_sources(sources, already_discovered=True)
    return scans[sf_dir]


def ranked(findings: DataFrame) -> DataFrame:
    """``ord`` as the finding's place among its file's findings (P10)."""
    place = Window.partitionBy("repo", "file").orderBy("ord")
    return findings.withColumn("ord", F.row_number().over(place).cast("long")).select(*FINDING_COLUMNS)


KEPT = cc.kept_corpus_sql()


@register("s2_discovered_files", f"SELECT repo, path, language, bytes FROM {KEPT} k")
def s2_discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_corpus(spark, sf_dir).select("repo", "path", "language", "bytes")


@register("p1_loc_corpus", f"""
SELECT l.repo, l.path, CAST(l.loc AS INTEGER) AS loc FROM {lines_sql(KEPT)} l""")
def p1_loc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scan(spark, sf_dir).files.select("repo", "path", "loc")


@register("p2_functions", f"""
SELECT k.repo, k.path, f.name, f.start_line, f.end_line, f.args, f.is_method, f.parent_class
FROM {KEPT} k JOIN {cc.functions_values_sql()} f USING (tid)""")
def p2_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_functions(corpus_scan(spark, sf_dir).facts)


@register("p3_classes", f"""
SELECT k.repo, k.path, c.name, c.start_line, c.end_line, c.methods
FROM {KEPT} k JOIN {cc.classes_values_sql()} c USING (tid)""")
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_classes(corpus_scan(spark, sf_dir).facts)


@register("p4_parse_errors", f"""
SELECT k.repo, k.path, p.parse_error FROM {KEPT} k JOIN {cc.errors_values_sql()} p USING (tid)""")
def p4_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scan(spark, sf_dir).files.filter(F.col("parse_error").isNotNull()).select(
        "repo", "path", "parse_error")


@register("p9_inventory_corpus", f"""
WITH e AS {cc.errors_values_sql()}
SELECT repo, CAST(count(*) AS BIGINT) AS file_count,
       CAST(count(*) FILTER (WHERE tid IN (SELECT tid FROM e)) AS BIGINT) AS parse_errors,
       array_to_string(list_sort(list_distinct(list(language))), ',') AS languages
FROM {KEPT} k GROUP BY repo""")
def p9_inventory_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_scan(spark, sf_dir).files
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"),
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


@register("t5_call_taint", f"""
SELECT k.repo, k.path, c.callee, CAST(c.idx AS INTEGER) AS idx FROM {KEPT} k JOIN {cc.call_taint_values_sql()} c USING (tid)""")
def t5_call_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: (file, local callee, argument index) passed a dynamic or tainted value in pass 1."""
    facts = corpus_scan(spark, sf_dir).facts
    functions, calls, assigns = fp.functions_table(facts), fp.calls_table(facts), fp.assigns_table(facts)
    top = functions.filter(F.col("is_top_level")).select("repo", "path", F.col("local_name").alias("name"))
    tainted1 = taint.analyse(taint.definitions(assigns), rp.sink_queries(calls, top))
    local = rp.local_function_params(functions).select("repo", "path", "callee").distinct()
    return rp.call_taint(calls, tainted1).join(local, ["repo", "path", "callee"], "left_semi")


@register("t6_seeds", f"""
SELECT k.repo, k.path, s.callee, s.param FROM {KEPT} k JOIN {cc.seeds_values_sql()} s USING (tid)""")
def t6_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = corpus_scan(spark, sf_dir).facts
    functions, calls, assigns = fp.functions_table(facts), fp.calls_table(facts), fp.assigns_table(facts)
    top = functions.filter(F.col("is_top_level")).select("repo", "path", F.col("local_name").alias("name"))
    tainted1 = taint.analyse(taint.definitions(assigns), rp.sink_queries(calls, top))
    return rp.seeds(rp.call_taint(calls, tainted1), rp.local_function_params(functions))


PY_FINDINGS_SQL = f"""(WITH l AS (SELECT k.repo, k.path, k.tid, k.secret, s.lines, s.loc FROM {KEPT} k
      JOIN {lines_sql(KEPT)} s ON s.repo = k.repo AND s.path = k.path),
  j AS (SELECT l.repo, l.path AS file, e.line, e.function, e.rule_id, e.rank, e.via_param,
          replace(e.literal, '{cc.PLACEHOLDER}', l.secret) AS lit, {snippet_sql('l.lines', 'l.loc', 'e.line')} AS raw
        FROM l JOIN {cc.findings_values_sql()} e USING (tid))
  SELECT j.repo, j.file, CAST(j.line AS INTEGER) AS line, j.function, r.rule_id, r.title, r.severity, r.cwe, r.owasp,
         CASE WHEN lit IS NULL OR lit = '' THEN raw ELSE replace(raw, lit, '<redacted>') END AS snippet,
         CASE WHEN j.via_param THEN r.description || {NOTE} ELSE r.description END AS description,
         r.remediation, CAST(j.rank AS BIGINT) AS ord
  FROM j JOIN {RULES} r USING (rule_id))"""


@register("r_python_findings", f"SELECT * FROM {PY_FINDINGS_SQL} f WHERE file LIKE '%.py'")
def r_python_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the Python detectors (R1-R13) with taint."""
    return ranked(corpus_scan(spark, sf_dir).findings.filter(F.col("file").endswith(".py")))


@register("r_js_findings", f"SELECT * FROM {PY_FINDINGS_SQL} f WHERE file NOT LIKE '%.py'")
def r_js_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the JavaScript / TypeScript detectors (R14-R24) with taint."""
    return ranked(corpus_scan(spark, sf_dir).findings.filter(~F.col("file").endswith(".py")))


@register("r_code_findings", f"SELECT * FROM {PY_FINDINGS_SQL} f")
def r_code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the code scan, both languages (P10 order keys included)."""
    return ranked(corpus_scan(spark, sf_dir).findings)


@register("d3_summary_corpus", f"""
WITH f AS {PY_FINDINGS_SQL},
p AS (SELECT repo, count(*) AS finding_count,
        count(*) FILTER (WHERE lower(severity) = 'high') AS high_count,
        count(*) FILTER (WHERE lower(severity) = 'medium') AS medium_count,
        count(*) FILTER (WHERE lower(severity) = 'low') AS low_count,
        sum(CASE lower(severity) WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END) AS raw
      FROM f GROUP BY repo),
r AS (SELECT DISTINCT repo FROM {KEPT} k)
SELECT r.repo, CAST(coalesce(finding_count, 0) AS BIGINT) AS finding_count,
       CAST(coalesce(high_count, 0) AS BIGINT) AS high_count, CAST(coalesce(medium_count, 0) AS BIGINT) AS medium_count,
       CAST(coalesce(low_count, 0) AS BIGINT) AS low_count, CAST(least(100, coalesce(raw, 0)) AS INTEGER) AS risk_score,
       CASE WHEN least(100, coalesce(raw, 0)) >= 60 THEN 'high' WHEN least(100, coalesce(raw, 0)) >= 20 THEN 'medium'
            ELSE 'low' END AS risk_band
FROM r LEFT JOIN p USING (repo)""")
def d3_summary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = corpus_scan(spark, sf_dir)
    return summary.summarize(res.findings, res.files)


@register("d2_rule_distribution_corpus", f"""
SELECT repo, rule_id, CAST(count(*) AS BIGINT) AS n FROM {PY_FINDINGS_SQL} f GROUP BY repo, rule_id""")
def d2_rule_distribution_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.rule_distribution(corpus_scan(spark, sf_dir).findings)




DISABLED = ("weak-crypto-hash", "hardcoded-secret")


@register("f4_disabled_rules", f"""
SELECT * REPLACE (row_number() OVER (PARTITION BY repo, file ORDER BY ord) AS ord)
FROM {PY_FINDINGS_SQL} f WHERE rule_id NOT IN ('weak-crypto-hash', 'hardcoded-secret')""")
def f4_disabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a scan of its own with rules switched off."""
    sources = materialize(kept_corpus(spark, sf_dir), "code-corpus")
    return ranked(scan_sources(sources, disabled=",".join(DISABLED), already_discovered=True).findings)


@register("s14_findings_json", f"""
SELECT repo, file, line, ord, to_json(struct_pack(file := file, line := line, "function" := function,
  rule_id := rule_id, title := title, severity := severity, cwe := cwe, owasp := owasp, snippet := snippet,
  description := description, remediation := remediation)) AS json
FROM {PY_FINDINGS_SQL} f""")
def s14_findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources.reports import findings_json
    return findings_json(ranked(corpus_scan(spark, sf_dir).findings))
