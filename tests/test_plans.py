"""Physical-plan properties the scale design relies on."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from source_tables import source_df
from tidewatch.operators import summary
from tidewatch.operators.facts_python import calls_table, extract_facts
from tidewatch.operators.lexical import scan_secrets
from tidewatch.plans.templates_py import PY_TEMPLATES
from tidewatch.session import materialize
from tidewatch.sources import tables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_lexical_scan_is_one_narrow_stage(spark, sf):
    p = plan(scan_secrets(spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"),
        F.col("lang").alias("language"), F.col("text").alias("content"))))
    # One narrow stage: the 19-row rule dimension is broadcast, nothing else moves.
    assert "Exchange" not in p and "Join" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p   # pruned columns


def test_filters_and_columns_reach_the_scan(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    p = plan(ev.filter(F.col("event_type") == "click").select("event_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_fact_tables_are_partition_pruned(spark):
    facts = materialize(extract_facts(source_df(spark, {"a.py": PY_TEMPLATES[0]})), "plan-facts", partition_by="kind")
    p = plan(calls_table(facts))
    assert "PartitionFilters: [isnotnull(kind" in p and "(kind" in p and "= call)" in p


def test_summary_aggregates_partially_before_the_shuffle(spark, sf):
    src = tables.documents_as_sources(spark, sf)
    p = plan(summary.summarize(scan_secrets(src), src))
    assert "partial_count" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_cartesian_or_nested_loop_joins_in_registered_plans(spark, sf):
    import __spark_entry__ as entry
    qs = entry.queries()
    for name in ("d3_summary_all_text", "q7_filtered_findings", "b2_new_findings", "o6_batches", "k1_rule_stats",
                 "w2_trailing_counts", "s17_changed_files", "s6_accepted_files"):
        p = plan(qs[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


MULTILINE = """const api_token: string = 'plain-secret-1', other = 1, pwd = "plain-secret-2";
function f(db, v) {
  const q = 'SELECT ' + v
  db
    // the call comes later
    .connection(() => { return 1 })
    .query(
      q)
  require('child_process')
    .spawn(v)
  const el = document
  el.body
    .innerHTML = `<p>${cp
      .exec('ls ' + v)}</p>`
  const o = cors({
    'origin':
      '*' })
  const x = new
    Function(v)
  return <p title="it's">{
    eval(
      v)}</p>
}
"""


def test_snippets_are_cut_in_the_fact_pass(spark, monkeypatch):
    from tidewatch.operators import rules_python, taint
    from tidewatch.plans import scan
    from tidewatch.session import materialize
    written = []

    def keep(df, name, partition_by=None):
        written.append((name, plan(df), materialize(df, name, partition_by)))
        return written[-1][2]

    for module in (scan, taint, rules_python, __import__("tidewatch.operators.facts_js", fromlist=["x"])):
        monkeypatch.setattr(module, "materialize", keep)
    py = "import os\nDB_PASSWORD = 'plain-secret-3'\nos.system(x)\n"
    res = scan.scan_sources(source_df(spark, {"m.jsx": MULTILINE, "m.py": py}))
    got = sorted((r.file, r.line, r.rule_id, r.snippet) for r in res.findings.collect())
    assert [(f, n, rule) for f, n, rule, _ in got] == [
        ("m.jsx", 1, "hardcoded-secret"), ("m.jsx", 1, "hardcoded-secret"), ("m.jsx", 4, "sql-injection-string-build"), ("m.jsx", 12, "xss-innerhtml-assignment"),
        ("m.jsx", 13, "command-injection-js-exec"), ("m.jsx", 16, "insecure-cors-wildcard"), ("m.jsx", 18, "dangerous-eval-exec"), ("m.jsx", 21, "dangerous-eval-exec"),
        ("m.py", 2, "hardcoded-secret"), ("m.py", 3, "command-injection-os-system")]
    text = {"m.jsx": MULTILINE.splitlines(), "m.py": py.splitlines()}
    for f, n, rule, snippet in got:
        raw = "\n".join(text[f][max(0, n - 2):n + 5])
        if rule == "hardcoded-secret":  # its own literal only
            assert snippet in [raw.replace(f"plain-secret-{i}", "<redacted>") for i in (1, 2, 3)] and snippet != raw
        else:
            assert snippet == raw
    # No text is shuffled, and what is written holds a secret only where another finding's snippet shows it.
    for name, p, df in written:
        assert not [x for x in p.splitlines() if "content" in x and ("hashpartitioning" in x or "Exchange" in x)], name
        if name not in ("findings", "code-facts"):
            assert not [r for r in df.collect() if "plain-secret" in str(r)], name
        if name == "code-facts":
            assert not [r for r in df.drop("snippet").collect() if "plain-secret" in str(r)]
    strict = scan.scan_sources(source_df(spark, {"m.jsx": MULTILINE, "m.py": py}), strict_redaction=True)
    assert "plain-secret" not in str(strict.findings.collect()) and "plain-secret" not in str(strict.facts.collect())


def test_scratch_deletes_what_a_block_wrote(spark, tmp_path):
    import os

    from tidewatch.session import checkpoint_dir, scratch
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    kept = materialize(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with scratch(spark):
        materialize(spark.range(5), "gone").write.parquet(str(tmp_path / "out"))
        assert len(os.listdir(folder)) == len(before) + 1
    assert set(os.listdir(folder)) == before and kept.count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_no_written_plan_of_a_scan_is_large(spark, monkeypatch):
    """The driver holds a plan, and all that Spark makes of it, in memory: 56 shuffles in one took more than 1.5 GB."""
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewatch.plans import scan
    shuffles, written = [], DataFrameWriter.parquet

    def keep(self, *args, **options):
        shuffles.append(plan(self._df).count("Exchange "))
        return written(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    res = scan.scan_sources(source_df(spark, {"m.jsx": MULTILINE, "m.py": "import os\nos.system(x)\n"}))
    assert res.findings.count() > 0 and max(shuffles) <= 24, shuffles


def test_parts_of_a_table_are_one_table(spark):
    from tidewatch.session import materialize_parts
    parts = [spark.range(n).selectExpr("cast(id as string) as x", f"'k{n}' as kind") for n in (0, 2, 3)]
    got = materialize_parts(parts, "parts", partition_by="kind")
    assert sorted((r.kind, r.x) for r in got.collect()) == [("k2", "0"), ("k2", "1"), ("k3", "0"), ("k3", "1"), ("k3", "2")]
    assert materialize_parts(parts[:1], "parts", partition_by="kind").count() == 0


def test_plans_of_a_scan_are_written_in_steps(spark, monkeypatch):
    """Before, parameters of functions and the findings were made by one plan each, of 14 shuffles and more."""
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewatch.plans import scan
    shuffles, written = {}, DataFrameWriter.parquet

    def keep(self, path, *args, **options):
        name = path.rstrip("/").split("/")[-1].rsplit("-", 1)[0]
        shuffles[name] = max(plan(self._df).count("Exchange "), shuffles.get(name, 0))
        return written(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    py = "def f(q):\n    db.execute(q)\n\n\ndef g(x):\n    f('a' + x)\n"
    res = scan.scan_sources(source_df(spark, {"m.jsx": MULTILINE, "m.py": py}))
    assert [(r.file, r.line) for r in res.findings.filter("rule_id = 'sql-injection-string-build'").orderBy("file").collect()] == [("m.jsx", 4), ("m.py", 2)]
    assert {"js-param-items", "local-params", "taint-params", "candidates", "findings"} <= set(shuffles)
    assert max(shuffles.values()) <= 16, shuffles


def test_the_scan_with_disabled_rules_reads_a_written_corpus(spark, monkeypatch):
    from tidewatch.plans import q_code

    class Seen(Exception):
        pass

    def scanned(sources, **options):
        raise Seen(plan(sources))

    monkeypatch.setattr(q_code, "scan_sources", scanned)
    with pytest.raises(Seen) as e:
        q_code.f4_disabled_rules(spark, "/root/testdata/sf0.001")
    assert "Join" not in str(e.value) and "Scan parquet" in str(e.value)
