"""The walk through a scope's definitions against the relational form, and what it writes."""

import random

from source_tables import source_df
from tidewatch.operators import taint
from tidewatch.plans.scan import scan_sources
from tidewatch.session import materialize

DEFS = "repo string, path string, scope_id int, var string, pos int, kind string, src string, single boolean"
ASKS = "repo string, path string, scope_id int, var string, pos int, qkind string, qvar string, qpos int, qidx int"


def relational(defs, asks, start):
    resolved = materialize(taint.resolve(defs, taint.link_queries(defs).unionByName(asks)), "resolved")
    links = taint.resolve_links(taint.link_edges(resolved))
    return taint.taint_of(taint.rooted(resolved.filter("qkind = 'sink'"), links), links.tainted(start))


def test_the_walk_gives_what_links_give(spark):
    rng, defs, asks = random.Random(3), [], []
    for path in ("a.py", "b.js", None):
        for scope in range(12):
            names = ["a", "b", "c", "d"]
            defs += [("r", path, scope, v, 0, "param", None, True) for v in names[:2]]
            for pos in range(1, rng.randrange(5, 60)):
                kind, single = rng.choice(["gen", "alias", "alias", "alias", "kill"]), rng.random() < 0.6
                single = single or kind == "kill"
                src = rng.choice(names) if kind == "alias" else None
                # Some definitions share a place, some a name too.
                for v in rng.choices(names, k=rng.choice([1, 1, 2])):
                    defs.append(("r", path, scope, v, pos, kind, src, single))
                asks += [("r", path, scope, v, pos, "sink", None, pos, k) for k, v in enumerate(rng.choices(names + ["other"], k=2))]
    d, q = materialize(spark.createDataFrame(defs, DEFS), "defs"), materialize(spark.createDataFrame(asks, ASKS), "asks")
    d, q = d.filter("path is not null"), q.filter("path is not null")
    sinks = materialize(taint.walk(d, q), "sinks")
    order = ["path", "scope_id", "var", "pos", "qidx", "tainted"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*order).collect())
    gens = d.filter("kind = 'gen'").select(*taint.DEF_KEY)
    first = rows(sinks)
    assert first == rows(relational(d, q, gens)) and {r[-1] for r in first} == {True, False}
    seeds = d.filter("kind = 'param' and (scope_id % 3 = 0 and var = 'a' or scope_id % 4 = 1 and var = 'b')").select(*taint.DEF_KEY)
    second = rows(taint.seeded(sinks, seeds))
    assert second == rows(relational(d, q, gens.unionByName(seeds))) and second != first


def test_a_long_chain_is_one_written_table(spark, monkeypatch):
    """Before, the chain's links took a written table a round, and the scan of t5_call_taint and t6_seeds did it twice."""
    from pyspark.sql.readwriter import DataFrameWriter
    names, written = [], DataFrameWriter.parquet

    def keep(self, path, *args, **options):
        names.append(path.rstrip("/").split("/tables/")[-1])
        return written(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    chain = "".join(f"    v{i} = v{i - 1}\n" for i in range(1, 400))
    py = f"def f(cur, x):\n    v0 = 'a' + x\n{chain}    cur.execute(v399)\n"
    res = scan_sources(source_df(spark, {"m.py": py}))
    assert [(r.line, r.rule_id) for r in res.findings.collect()] == [(402, "sql-injection-string-build")]
    assert len([n for n in names if n.startswith("taint-") and not n.startswith(("taint-params", "taint-candidates"))]) == 1, names


def test_a_scope_may_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n = 50
        defs = [("r", "m.py", 0, "v0", 0, "gen", None, True)] + [("r", "m.py", 0, f"v{i}", i, "alias", f"v{i - 1}", True) for i in range(1, n)]
        got = taint.walk(spark.createDataFrame(defs, DEFS), spark.createDataFrame([("r", "m.py", 0, f"v{n - 1}", n, "sink", None, n, 0)], ASKS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.pos, r.qidx, r.tainted, r.params) for r in got] == [(n, 0, True, [])]
