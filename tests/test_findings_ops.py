"""Lexical tier, filters, summaries, baseline, cache and verdict stage."""

import hashlib
import json

import pytest
import re

from pyspark.sql import functions as F

from tidewatch.operators import baseline, filters, summary, verdicts
from tidewatch.operators.findings import FINDING_COLUMNS, attach_metadata
from tidewatch.operators.lexical import SECRET_ASSIGN_FAST_RE, SECRET_ASSIGN_RE, scan_secrets
from tidewatch.sources import stores


def findings_df(spark, rows):
    """rows: (repo, file, line, function, rule_id, snippet) -> findings with metadata."""
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "repo string, file string, line int, function string, rule_id string, "
                               "snippet string, ord long")
    return attach_metadata(df)


def test_lexical_secrets_and_redaction(spark):
    text = ("intro\nmy_api_key = \"abcd1234\" and token='zz'\nPASSWORD = 'hunter22'; db_token = \"q1q2q3\"\n"
            "password == 'nope1234'\nſecret = 'longsecret'\nend")
    src = spark.createDataFrame([("r", "a.txt", "text", text)], "repo string, path string, language string, "
                                                                  "content string")
    rows = scan_secrets(src).orderBy("ord").collect()
    assert [(r.line, r.ord % (1 << 20)) for r in rows] == [(2, 0), (3, 0), (3, 1), (5, 0)]
    for r in rows:
        assert "abcd1234" not in r.snippet or r.line != 2
    assert "<redacted>" in rows[0].snippet and "hunter22" in rows[2].snippet   # own literal only


def test_fast_pattern_is_equivalent():
    rng = __import__("random").Random(5)
    alphabet = "ab_ tokenPASSWORDsecret=\"'x-:;1"
    fast, slow = re.compile(SECRET_ASSIGN_FAST_RE.replace("(?iu:", "(?i:")), re.compile(
        SECRET_ASSIGN_RE.replace("(?iu:", "(?i:"))
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 60)))
        assert [m.groups() for m in fast.finditer(s)] == [m.groups() for m in slow.finditer(s)], s


def test_summary_scores_and_bands(spark):
    rows = [("r1", "a.py", i, None, "sql-injection-string-build", "s") for i in range(1, 12)]
    rows += [("r2", "b.py", 1, "f", "weak-crypto-hash", "s"), ("r2", "b.py", 2, "f", "hardcoded-secret", "s")]
    f = findings_df(spark, rows)
    repos = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo string")
    s = {r.repo: r for r in summary.summarize(f, repos).collect()}
    assert (s["r1"].risk_score, s["r1"].risk_band, s["r1"].high_count) == (100, "high", 11)
    assert (s["r2"].risk_score, s["r2"].risk_band) == (6, "low")
    assert (s["r3"].risk_score, s["r3"].finding_count) == (0, 0)
    bars = {(r.repo, r.band): r.pct for r in summary.severity_bars(summary.summarize(f, repos)).collect()}
    assert bars[("r2", "low")] == 100 and bars[("r2", "medium")] == 100 and bars[("r3", "high")] == 0
    gate = {r.repo: r.gate_triggered for r in filters.gate(f, repos, "HIGH").collect()}
    assert gate == {"r1": True, "r2": False, "r3": False}
    assert not any(r.gate_triggered for r in filters.gate(f, repos, None).collect())


def test_filters(spark):
    rows = [("r", "a.py", 1, "handler", "sql-injection-string-build", "cur.execute(q)"),
            ("r", "b.js", 2, None, "weak-crypto-hash", "md5"),
            ("r", "c.py", 3, "Token_fn", "hardcoded-secret", "x")]
    f = findings_df(spark, rows)
    files = spark.createDataFrame([("r", "a.py", "Python"), ("r", "b.js", "JavaScript")],
                                  "repo string, path string, language string")
    got = lambda df: sorted(r.file for r in df.collect())
    assert got(filters.filter_findings(f, severity=["HIGH"])) == ["a.py"]
    assert got(filters.filter_findings(f, rules=["weak-crypto-hash"])) == ["b.js"]
    assert got(filters.filter_findings(f, files=files, languages=["python"])) == ["a.py"]   # c.py unknown
    assert got(filters.filter_findings(f, languages=["python"])) == ["a.py", "b.js", "c.py"]  # no lookup
    assert got(filters.filter_findings(f, search="TOKEN_FN")) == ["c.py"]
    assert got(filters.filter_findings(f, severity=[], rules=[], search="")) == ["a.py", "b.js", "c.py"]


def test_fingerprint_and_baseline(spark, tmp_path):
    f = findings_df(spark, [("r", "a.py", 1, None, "hardcoded-secret", "s1"),
                            ("r", "a.py", 9, "g", "weak-crypto-hash", "s2")])
    fp = {r.rule_id: r.fingerprint for r in baseline.with_fingerprint(f).collect()}
    assert fp["hardcoded-secret"] == hashlib.sha256(b"hardcoded-secret:a.py::s1").hexdigest()
    assert fp["weak-crypto-hash"] == hashlib.sha256(b"weak-crypto-hash:a.py:g:s2").hexdigest()
    base = baseline.baseline_of(f.filter("line = 1"))
    assert [r.rule_id for r in baseline.new_findings(f, base).collect()] == ["weak-crypto-hash"]
    empty = spark.createDataFrame([], stores.BASELINE_SCHEMA)
    assert baseline.new_findings(f, empty).count() == 2
    doc = json.loads(stores.baseline_document(baseline.baseline_of(f)).first().json)
    assert doc == {"format_version": 1, "fingerprints": sorted(fp.values())}
    path = str(tmp_path / "b.json")
    open(path, "w").write(json.dumps({"format_version": 1, "fingerprints": ["x", 3, None, "y"]}))
    assert sorted(r.fingerprint for r in stores.load_baseline(spark, path).collect()) == ["x", "y"]
    for bad in ["not json", "[1, 2]", '{"fingerprints": "x"}', "{}"]:
        p = str(tmp_path / f"bad{abs(hash(bad))}.json")
        open(p, "w").write(bad)
        assert stores.load_baseline(spark, p).count() == 0
    assert stores.load_baseline(spark, str(tmp_path / "missing.json")).count() == 0
    stores.write_baseline(baseline.baseline_of(f), str(tmp_path / "tbl"))
    assert stores.load_baseline(spark, str(tmp_path / "tbl")).count() == 2


def _provider(results_by_batch):
    def provide(prompts, batched):
        docs = [(b, d) for b, d in results_by_batch.items()]
        return prompts.sparkSession.createDataFrame(docs, "batch_id string, doc string")
    return provide


def test_verdict_merge_defaults_errors_and_cache(spark, tmp_path):
    rows = [("r", f"f{i}.py", 1, None, "weak-crypto-hash", f"snip{i}") for i in range(10)]
    f = findings_df(spark, rows)
    good = {"results": [{"index": 0, "verified": True, "confidence": "high", "explanation": "e0",
                         "exploit_scenario": "x", "patch_suggestion": "p", "things_to_verify": ["t"]},
                        {"index": 1, "verified": True, "confidence": "high", "explanation": "first",
                         "exploit_scenario": "", "patch_suggestion": ""},
                        {"index": 1, "verified": False, "confidence": "low", "explanation": "last",
                         "exploit_scenario": "", "patch_suggestion": "", "things_to_verify": []}]}
    docs = {"r#0": json.dumps(good), "r#1": "not json"}
    empty = spark.createDataFrame([], stores.CACHE_SCHEMA)
    res = verdicts.validate_findings(f, empty, _provider(docs))
    v = {r.file: r for r in res.validated.collect()}
    assert len(v) == 10                                          # batch r#1 could not be read: kept, unverified
    assert (v["f9.py"].verified, v["f9.py"].explanation) == (False, verdicts.MISSING_EXPLANATION)
    with pytest.raises(verdicts.VerdictError):
        verdicts.validate_findings(f, empty, _provider(docs), fail_fast=True)
    assert (v["f0.py"].verified, v["f0.py"].confidence) == (True, "high")
    assert (v["f1.py"].explanation, v["f1.py"].things_to_verify) == ("last", [])   # duplicate index: last
    assert (v["f5.py"].verified, v["f5.py"].confidence, v["f5.py"].explanation) == \
        (False, "low", verdicts.MISSING_EXPLANATION)
    assert [r.batch_id for r in res.errors.collect()] == ["r#1"]
    prompts = {r.batch_id: r for r in res.prompts.collect()}
    assert prompts["r#0"].n == 8 and prompts["r#1"].n == 2 and '{"n":7,' in prompts["r#0"].prompt
    # second round: everything from batch r#0 is a cache hit now
    root = str(tmp_path / "cache")
    stores.save_cache(res.new_cache, root)
    cache = stores.load_cache(spark, root)
    res2 = verdicts.validate_findings(f, cache, _provider({}))
    v2 = {r.file: r for r in res2.validated.collect()}
    assert v2["f1.py"].explanation == "last" and v2["f9.py"].explanation == verdicts.MISSING_EXPLANATION
    assert stores.load_cache(spark, root, enabled=False).count() == 0


def test_cache_document_parsing(spark):
    doc = json.dumps({"k1": {"verified": True, "confidence": "high", "explanation": "e", "exploit_scenario": "",
                             "patch_suggestion": "", "things_to_verify": ["a"]},
                      "k2": {"verified": "yes", "confidence": "high"}})
    rows = {r.cache_key: r for r in stores.parse_cache_document(
        spark.createDataFrame([(doc,)], "value string")).collect()}
    assert rows["k1"].verified is True and rows["k1"].things_to_verify == ["a"]
    assert rows["k2"].verified is None            # wrongly typed -> miss at probe time
    assert FINDING_COLUMNS[0] == "repo"


def cache_df(spark, keys, seq, text):
    rows = [(k, True, "high", text, "", "", [], seq) for k in keys]
    return spark.createDataFrame(rows, stores.CACHE_SCHEMA)


def test_cache_updates_rewrite_only_the_slots_they_touch(spark, tmp_path):
    import os
    root = str(tmp_path / "cache")
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)]
    stores.save_cache(cache_df(spark, keys, 1, "old"), root)
    path = stores.update_cache(spark, root, cache_df(spark, [keys[3], "new key"], 2, "new"))
    touched = {d.split("=")[1] for d in os.listdir(path) if d.startswith("slot=")}
    want = {f"{__import__('zlib').crc32(k.encode()) % 256:02x}" for k in (keys[3], "new key")}
    assert touched == want and len(touched) == 2
    rows = {r.cache_key: r.explanation for r in stores.load_cache(spark, root).collect()}
    assert len(rows) == 2001 and {k for k, v in rows.items() if v == "new"} == {keys[3], "new key"}
    assert len(stores.load_cache(spark, root).inputFiles()) <= 256
    # An older row does not win, an unfinished version does not count.
    stores.update_cache(spark, root, cache_df(spark, [keys[3]], 1, "older"))
    cache_df(spark, keys, 9, "lost").write.parquet(f"{root}/version=999999999999999-x-part/slot=00")
    assert {r.cache_key for r in stores.load_cache(spark, root).filter("explanation = 'new'").collect()} == {keys[3], "new key"}
    assert stores.load_cache(spark, root).filter("explanation = 'lost'").count() == 0
    stores.compact_cache(spark, root)
    assert len(os.listdir(f"{root}/commits")) == 1 + sum(n.endswith(".crc") for n in os.listdir(f"{root}/commits"))
    assert {r.cache_key: r.explanation for r in stores.load_cache(spark, root).collect()} == rows
    assert stores.update_cache(spark, root, cache_df(spark, [], 1, "")) is None
    stores.save_cache(cache_df(spark, ["k"], 1, "x"), root)  # a whole version replaces what was there
    assert [r.cache_key for r in stores.load_cache(spark, root).collect()] == ["k"]


def test_request_positions_number_a_repository_in_parts(spark):
    rows = [("hot" if i % 3 else "r", f"f{i % 400:03d}.py", i, None, "weak-crypto-hash", "s") for i in range(3000)]
    f = findings_df(spark, rows).repartition(5)
    got = verdicts.request_positions(f).collect()
    for repo in ("hot", "r"):
        mine = sorted((r for r in got if r.repo == repo), key=lambda r: (r.file, r.line, r.ord))
        assert [r.position for r in mine] == list(range(len(mine)))
    # Windows hold one file, one part of a range sort, or one row per part of a repository.
    plan = verdicts.request_positions(f)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line or "file" in line or "_pn" in line for line in windows)
