"""Discovery rules, repository URLs, changed files, stores and reports."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from source_tables import source_df
from tidewatch.plans.scan import scan_sources, scan_tree
from tidewatch.plans.templates_py import PY_TEMPLATES
from tidewatch.sources import files, reports, stores
from tidewatch.sources import tree as tree_source


def test_language_and_discovery(spark):
    paths = ["a.py", "b.ts", "c.tsx", "d.js", "e.jsx", "f.PY", ".py", "g.tar.py", "node_modules/x.js",
             "src/build/y.py", "lib/app.min.js", "lib/app-min.ts", "lib/x.bundle.js", "docs/readme.md",
             "builder/z.py", "a/.git/h.py"]
    df = spark.createDataFrame([("r", p, "") for p in paths], "repo string, path string, content string")
    got = {r.path: r.language for r in files.classify(df).collect()}
    assert got == {"a.py": "Python", "b.ts": "TypeScript", "c.tsx": "TypeScript", "d.js": "JavaScript",
                   "e.jsx": "JavaScript", "g.tar.py": "Python", "builder/z.py": "Python"}


def test_read_source_tree_and_utf8(spark):
    root = tempfile.mkdtemp(prefix="tw-tree-", dir="/tmp")
    os.makedirs(os.path.join(root, "pkg", "__pycache__"))
    open(os.path.join(root, "pkg", "m.py"), "wb").write(b"x = '\xff'\nPASSWORD = 'abcdef'\n")
    open(os.path.join(root, "pkg", "__pycache__", "m.py"), "w").write("y = 1\n")
    open(os.path.join(root, "notes.txt"), "w").write("hi\n")
    src = files.read_source_tree(spark, root, repo="demo")
    rows = src.collect()
    assert [(r.path, r.language) for r in rows] == [("pkg/m.py", "Python")]
    assert "�" in rows[0].content
    res = scan_sources(src, already_discovered=True)
    assert [r.rule_id for r in res.findings.collect()] == ["hardcoded-secret"]


def test_repo_urls(spark):
    urls = ["https://github.com/o/r", " https://github.com/o/r.git/ ", "https://github.com/o/r/extra",
            "http://github.com/o/r", "https://github.com/ö_1/r-2.x", "https://github.com/o/r.git.git"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    norm, valid = files.normalize_repo_url(F.col("url"))
    got = [(r.n, r.v) for r in df.select(norm.alias("n"), valid.alias("v")).collect()]
    assert got == [("https://github.com/o/r", True), ("https://github.com/o/r", True),
                   ("https://github.com/o/r/extra", False), ("http://github.com/o/r", False),
                   ("https://github.com/ö_1/r-2.x", True), ("https://github.com/o/r.git", True)]
    keys = [r.k for r in df.select(files.history_key(F.col("url")).alias("k")).collect()]
    assert keys[1] == " https://github.com/o/r.git/ " and keys[0] == "https://github.com/o/r"


def test_changed_files(spark):
    base = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo string, path string, content string")
    head = spark.createDataFrame([("r", "a", "1"), ("r", "b", "x"), ("r", "d", "4")], "repo string, path string, content string")
    got = sorted((r.path, r.change_type) for r in files.changed_files(base, head).collect())
    assert got == [("b", "modified"), ("c", "removed"), ("d", "added")]


def test_reports(spark):
    src = source_df(spark, {"t4.py": PY_TEMPLATES[4], "t1.py": PY_TEMPLATES[1]}, "demo")
    res = scan_sources(src)
    out = tempfile.mkdtemp(prefix="tw-rep-", dir="/tmp")
    reports.write_sarif(res.findings, out + "/sarif")
    part = [f for f in os.listdir(out + "/sarif/repo=demo") if f.endswith(".txt")]
    doc = json.loads("".join(open(out + "/sarif/repo=demo/" + part[0]).read().split("\n")))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == res.findings.count()
    ordered = sorted(res.findings.collect(), key=lambda r: (r.file, r.line, r.ord))
    assert [r["ruleId"] for r in run["results"]] == [r.rule_id for r in ordered]
    first_seen = list(dict.fromkeys(r.rule_id for r in ordered))
    assert [d["id"] for d in run["tool"]["driver"]["rules"]] == first_seen
    assert {r["level"] for r in run["results"]} <= {"error", "warning", "note"}
    rows = reports.text_report_rows(res.findings, src.union(src.limit(0))).collect()
    foot = [r.text for r in rows if r.part == 1]
    assert foot == [f"\n{res.findings.count()} finding(s)."]
    empty = reports.text_report_rows(res.findings.limit(0), src).collect()
    assert [r.text for r in empty] == ["No findings."]
    reports.write_findings_json(res.findings, out + "/json")
    lines = [json.loads(x) for d in os.listdir(out + "/json/repo=demo") if d.endswith(".txt")
             for x in open(out + "/json/repo=demo/" + d)]
    assert len(lines) == res.findings.count() and set(lines[0]) >= {"file", "line", "rule_id", "snippet"}


def test_history_append(spark, sf):
    from tidewatch.operators import verdicts
    root = tempfile.mkdtemp(prefix="tw-hist-", dir="/tmp")
    src = source_df(spark, {"t0.py": PY_TEMPLATES[0]}, "demo")
    res = scan_sources(src)
    val = res.findings.withColumn("verified", F.lit(True)).withColumn("confidence", F.lit("high"))
    stores.record_validations(val, root + "/validations")
    stores.record_validations(val.limit(0), root + "/validations")
    rows = stores.scan_rows(res.findings, val, src, branch="main")
    stores.record_scans(rows, root + "/scans")
    v = stores.read_history(spark, root + "/validations", stores.VALIDATIONS_SCHEMA)
    s = stores.read_history(spark, root + "/scans", stores.SCANS_SCHEMA).collect()
    assert v.count() == 2 and v.select("validated_at").distinct().count() == 1
    assert [(r.repository, r.candidate_finding_count, r.verified_finding_count, r.risk_score) for r in s] == \
        [("demo", 2, 2, 20)]
    assert verdicts.PROMPT_VERSION


def test_tree_of_checkouts_and_clean_sarif(spark):
    root = tempfile.mkdtemp(prefix="tw-tree-", dir="/tmp")
    for repo, text in (("one", "eval(x)\n"), ("two", "y = 1\n")):
        os.makedirs(os.path.join(root, repo, "src"))
        open(os.path.join(root, repo, "src", "m.py"), "w").write(text)
    src = files.read_source_tree(spark, root)
    assert sorted((r.repo, r.path) for r in src.collect()) == [("one", "src/m.py"), ("two", "src/m.py")]
    found = scan_sources(src, already_discovered=True).findings
    docs = {r.repo: json.loads(r.document) for r in reports.sarif_documents(found, src).collect()}
    assert len(docs["one"]["runs"][0]["results"]) == 1
    assert docs["two"]["runs"][0]["results"] == [] and docs["two"]["runs"][0]["tool"]["driver"]["rules"] == []


def test_review_survives_a_failed_history(spark, monkeypatch):
    from tidewatch.plans.flows import review_flow
    from tidewatch.sources import stores
    root = tempfile.mkdtemp(prefix="tw-tree-", dir="/tmp")
    open(os.path.join(root, "m.py"), "w").write("eval(x)\n")
    res = scan_sources(files.read_source_tree(spark, root, repo="demo"), already_discovered=True)

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(stores, "record_scans", broken)
    silent = lambda prompts, batched: batched.selectExpr("batch_id", "cast(null as string) as doc").limit(0)
    out = review_flow(res.findings, res.files, spark.createDataFrame([], stores.CACHE_SCHEMA), silent, history=root + "/history")
    assert out.dismissed.count() == 1 and out.verified.count() == 0
    assert len(out.warnings) == 1 and "disk full" in out.warnings[0]
    assert stores.read_history(spark, root + "/history/validations", stores.VALIDATIONS_SCHEMA).count() == 1


def test_large_files_are_listed(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tw-tree-", dir="/tmp")
    for name, text in (("big.py", "eval(x)\n" * 20), ("big.js", "eval(x);\n" * 20), ("small.py", "eval(x)\n")):
        open(os.path.join(root, name), "w").write(text)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 100)
    src = files.read_source_tree(spark, root, repo="demo")
    assert {r.path: (r.bytes, r.content) for r in src.collect()} == {"big.py": (160, None), "big.js": (180, None), "small.py": (8, "eval(x)\n")}
    assert [r.total_bytes for r in files.repo_sizes(src).collect()] == [348]
    assert files.accepted_files(src, 300 / 1024 / 1024).count() == 0
    res = scan_sources(src, already_discovered=True)
    assert {r.path: r.parse_error for r in res.files.collect()} == {"big.py": files.TOO_LARGE, "big.js": files.TOO_LARGE, "small.py": None}
    assert [r.file for r in res.findings.collect()] == ["small.py"]


def tree(files_of):
    root = tempfile.mkdtemp(prefix="tw (tree) [x]+.", dir="/tmp")
    for name, text in files_of.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        open(os.path.join(root, name), "wb").write(text if isinstance(text, bytes) else text.encode())
    return root


def test_every_name_is_listed(spark):
    names = ["a.py", "__init__.py", "pkg/_app.tsx", "pkg/_internal/x.py", "__tests__/y.js", "pkg/b.js", ".conf/z.ts", ".eslintrc.js"]
    root = tree({**{n: "x\n" for n in names}, ".git/h.py": "1", "pkg/.venv/v.py": "1", "notes.md": "1", "a b/c%20d.py": "x\n"})
    os.symlink(os.path.join(root, "pkg"), os.path.join(root, "loop"))
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "linked.py"))
    os.symlink(os.path.join(root, "nothing"), os.path.join(root, "broken.py"))
    os.mkfifo(os.path.join(root, "pipe.py"))
    got = files.read_source_tree(spark, root, repo="demo").collect()
    assert {r.path for r in got} == {*names, "a b/c%20d.py", "linked.py"} and {r.content for r in got} == {"x\n"}
    # The same whatever the tree is dealt out in, and by its address.
    for slices in (1, 3):
        assert {r.path for r in tree_source.list_source_tree(spark, "file:" + root + "/", "demo", slices).collect()} == {
            *names, "a b/c%20d.py", "linked.py", ".git/h.py", "pkg/.venv/v.py", "notes.md"}


def test_names_that_are_no_utf8_and_files_that_vanish(spark):
    root = tree({"ok.py": "eval(x)\n", "gone.py": "eval(y)\n"})
    open(os.path.join(os.fsencode(root), b"od\xff.py"), "w").write("eval(z)\n")
    listing = tree_source.list_source_tree(spark, root, "demo")
    os.remove(os.path.join(root, "gone.py"))
    src = files.read_source_tree(spark, root, "demo", listing=listing)
    res = scan_sources(src, already_discovered=True)
    assert {r.path: r.parse_error for r in res.files.collect()} == {"ok.py": None, "gone.py": files.NOT_OPENED, "od\\xff.py": files.NOT_OPENED}
    assert [r.file for r in res.findings.collect()] == ["ok.py"]


def test_scan_of_a_folder_with_the_size_cap(spark):
    assets = {f"big/assets/{i}.bin": b"\0" * 300_000 for i in range(4)}
    root = tree({"small/m.py": "eval(x)\n", "small/.git/pack": b"1" * 1000, "big/m.py": "eval(x)\n", "loose.py": "eval(x)\n", **assets})
    got = scan_tree(spark, root, max_mb=1)
    name = root.rsplit("/", 1)[-1]
    assert {(r.repo, r.total_bytes, r.accepted) for r in got.sizes.collect()} == {("small", 1008, True), ("big", 1_200_008, False), (name, 8, True)}
    assert {(r.repo, r.file) for r in got.scan.findings.collect()} == {("small", "m.py"), (name, "loose.py")}
