"""Driver contract: entry, registry, and oracle agreement on the smallest tables."""

import duckdb

import __spark_entry__ as entry

FAST = ["rl_secrets_all_text", "d3_summary_all_text", "q7_filtered_findings", "k1_rule_stats",
        "w1_admission", "s7_repo_urls", "b2_new_findings", "v4_validated_findings", "r_python_findings",
        "p2_functions", "t6_seeds"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "risk_score" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


def test_oracles_agree(spark, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "pages", "conversations", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, os_ = entry.queries(), entry.oracle_sql()
    for name in FAST:
        sdf = qs[name](spark, sf)
        cols = sorted(sdf.columns)
        got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        d = con.sql(os_[name])
        assert sorted(d.columns) == cols, name
        idx = [d.columns.index(c) for c in cols]
        exp = sorted((tuple(_norm(r[i]) for i in idx) for r in d.fetchall()), key=repr)
        assert got == exp, name


def test_workers_can_import_the_package(spark):
    import os

    import tidewatch
    from tidewatch.session import ship_package
    ship_package(spark)
    base = os.path.dirname(os.path.dirname(os.path.abspath(tidewatch.__file__)))
    assert base in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)

    def probe(batches):
        import pandas as pd

        import tidewatch as tw
        for b in batches:
            yield pd.DataFrame({"ok": [tw.__name__ == "tidewatch"] * len(b)})
    assert all(r.ok for r in spark.range(4).mapInPandas(probe, "ok boolean").collect())
