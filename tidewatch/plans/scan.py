"""End-to-end scan plan: source table -> facts -> findings (+ file inventory).

``scan_sources`` is the library's main entry: discovery filters (S2-S4),
optional pushed-down path/language/changed-file predicates (findings are
file-local, so filtering sources first gives the same result as filtering
findings after), one Python fact job (checkpointed, so the Python work runs
once and survives lost executors), relational rules and taint, snippets and
metadata.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import facts_python as fp
from tidewatch.operators.findings import attach_metadata, attach_snippets, parse_disabled
from tidewatch.operators import rules_js as rj
from tidewatch.operators import rules_python as rp
from tidewatch.session import checkpoint_dir, materialize, materialize_parts, spread
from tidewatch.sources.files import MAX_REPO_SIZE_MB, classify, read_source_tree, repo_sizes
from tidewatch.sources.tree import list_source_tree


@dataclass
class ScanResult:
    files: DataFrame       # (repo, path, language, loc, parse_error)
    facts: DataFrame       # flat fact rows, written once, partitioned by kind
    findings: DataFrame    # findings table (FINDING_COLUMNS)


def discover(sources: DataFrame) -> DataFrame:
    """S2-S4 on any (repo, path, content[, language]) table."""
    base = sources.drop("language") if "language" in sources.columns else sources
    return classify(base)


def code_candidates(facts: DataFrame, disabled=()) -> DataFrame:
    """Candidates of all 24 detectors over Python and JS/TS facts in one
    two-pass assembly (one taint analysis for both languages)."""
    functions, calls, assigns = fp.functions_table(facts), fp.calls_table(facts), fp.assigns_table(facts)
    is_py = F.col("language") == "Python"
    py_calls, js_calls = calls.filter(is_py), calls.filter(~is_py)
    plain = (rp.assign_candidates(assigns.filter(is_py)).unionByName(rp.plain_call_candidates(py_calls))
             .unionByName(rj.plain_candidates(js_calls, assigns.filter(~is_py), fp.pairs_table(facts),
                                               fp.news_table(facts))))

    def sink():
        py_rule, py_cond = rp.taint_sink_condition()
        js_rule, js_cond = rj.taint_sink_condition()
        return (F.when(is_py, py_rule).otherwise(js_rule), F.when(is_py, py_cond).otherwise(js_cond))

    def seq_of(rule):
        s = F.lit(0)
        for r, n in list(rp.CALL_SEQ.items()) + list(rj.CALL_SEQ.items()):
            if r in rp.TAINT_RULES or r in rj.TAINT_RULES:
                s = F.when(rule == r, F.lit(n)).otherwise(s)
        return s

    return rp.assemble(functions, calls, assigns, plain, sink, seq_of, disabled)


def scan_sources(sources: DataFrame, disabled=None, languages=None, changed: DataFrame | None = None,
                 already_discovered: bool = False, strict_redaction: bool = False) -> ScanResult:
    kept = sources if already_discovered else discover(sources)
    if languages:
        kept = kept.filter(F.lower("language").isin([x.lower() for x in languages]))
    if changed is not None:
        kept = kept.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    checkpoint_dir(sources.sparkSession)
    kept = spread(kept)
    facts = materialize_parts(fp.fact_parts(kept, strict_redaction), "code-facts", partition_by="kind")
    dis = parse_disabled(disabled)
    cands = materialize(code_candidates(facts, dis), "candidates")
    # Written once: summaries, filters, reports and reviews all read this table.
    findings = materialize(attach_metadata(attach_snippets(cands, fp.windows_table(facts)), dis), "findings")
    return ScanResult(fp.files_table(facts), facts, findings)


@dataclass
class TreeScan:
    scan: ScanResult
    sizes: DataFrame       # (repo, total_bytes, size_mb, accepted): S6 over every file of the tree
    sources: DataFrame     # the code files that were scanned


def scan_tree(spark: SparkSession, root: str, repo: str | None = None, max_mb: float = MAX_REPO_SIZE_MB, **options) -> TreeScan:
    """S1 to F3 in one call: a folder of checkouts (or one checkout, with ``repo``) to findings.  Repositories
    above ``max_mb`` are listed in ``sizes`` as not accepted and none of their files is opened.  ``options`` are those of ``scan_sources``."""
    listing = list_source_tree(spark, root, repo)
    sources = read_source_tree(spark, root, repo, max_mb, listing=listing)
    return TreeScan(scan_sources(sources, already_discovered=True, **options), repo_sizes(listing, max_mb), sources)


def inventory_functions(facts: DataFrame) -> DataFrame:
    """P2 rows: module-level functions and methods of module-level classes."""
    f = fp.inventory_table(facts)
    return f.select("repo", "path", "name", "start_line", "end_line", F.array_join("params", ",").alias("args"),
                    "is_method", "parent_class")


def inventory_classes(facts: DataFrame) -> DataFrame:
    """P3 rows."""
    return fp.classes_table(facts).select("repo", "path", "name", "start_line", "end_line",
                                          F.array_join("methods", ",").alias("methods"))
