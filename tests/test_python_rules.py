"""Python detectors and taint on own fixtures (the corpus templates: test_templates.py)."""

from source_tables import source_df
from tidewatch.plans.scan import scan_sources
from tidewatch.plans.templates_py import PY_TEMPLATES

VULNERABLE = {
    "sql_injection_fstring": ("def f(c, n):\n    c.execute(f'SELECT {n}')\n", "sql-injection-string-build"),
    "sql_injection_percent": ("def f(c, n):\n    c.executemany('SELECT %s' % n, [])\n", "sql-injection-string-build"),
    "shell_true": ("import subprocess\nsubprocess.check_call('ls', shell=True)\n", "command-injection-shell-true"),
    "os_system": ("import os\ndef f(x):\n    os.popen(x)\n", "command-injection-os-system"),
    "secret": ("AUTH_TOKEN = 'abcdefgh'\n", "hardcoded-secret"),
    "pickle": ("import pickle\npickle.load(fh)\n", "insecure-deserialization-pickle"),
    "yaml": ("import yaml\nyaml.load(s, Loader=yaml.Loader)\n", "insecure-deserialization-yaml"),
    "eval": ("exec(code)\n", "dangerous-eval-exec"),
    "md5": ("import hashlib\nhashlib.sha1(b'')\n", "weak-crypto-hash"),
    "debug": ("app.run(host='0', debug=True)\n", "debug-mode-enabled"),
    "tls": ("import requests\nrequests.request('GET', u, verify=False)\n", "tls-verification-disabled"),
    "open": ("def f(d, n):\n    return open(d + n)\n", "path-traversal-open"),
    "random_token": ("import random\napi_key = random.choices('ab', k=8)\n", "insecure-random-token"),
    "cookie": ("resp.set_cookie('a', 'b', secure=True)\n", "flask-cookie-missing-secure-flag"),
}

SAFE = {
    "param_sql": "def f(c, n):\n    c.execute('SELECT ?', (n,))\n",
    "shell_false": "import subprocess\nsubprocess.run(['ls'], shell=False)\n",
    "os_const": "import os\nos.system('ls')\n",
    "short_secret": "password = 'abc'\n",
    "safe_yaml": "import yaml\nyaml.load(s, Loader=yaml.SafeLoader)\nyaml.safe_load(s)\n",
    "method_eval": "obj.eval(x)\n",
    "sha256": "import hashlib\nhashlib.sha256(b'')\n",
    "debug_false": "app.run(debug=False)\n",
    "verify_true": "requests.get(u, verify=True)\n",
    "method_open": "def f(d, n):\n    return fs.open(d + n)\n",
    "secrets_module": "import secrets\ntoken = secrets.token_hex()\n",
    "cookie_ok": "resp.set_cookie('a', 'b', secure=True, httponly=True)\n",
    "killed": "def f(c, n):\n    q = 'S' + n\n    q = clean(q)\n    c.execute(q)\n",
}


def run_scan(spark, files, disabled=None):
    res = scan_sources(source_df(spark, files), disabled=disabled)
    rows = res.findings.select("file", "line", "function", "rule_id", "description", "ord", "snippet").collect()
    return rows


def test_each_rule_fires_and_safe_twins_stay_silent(spark):
    files = {f"v_{k}.py": src for k, (src, _) in VULNERABLE.items()}
    files.update({f"s_{k}.py": src for k, src in SAFE.items()})
    rows = run_scan(spark, files)
    got = {(r.file, r.rule_id) for r in rows}
    for k, (_, rule) in VULNERABLE.items():
        assert (f"v_{k}.py", rule) in got, k
    assert not [r for r in rows if r.file.startswith("s_")]
    assert len(rows) == len(VULNERABLE)


def test_disabled_rules_still_propagate_taint(spark):
    files = {"t6.py": PY_TEMPLATES[6], "t3.py": PY_TEMPLATES[3]}
    rows = run_scan(spark, files, disabled=" insecure-deserialization-pickle , ,dangerous-eval-exec")
    assert sorted((r.file, r.line, r.rule_id) for r in rows) == [
        ("t3.py", 7, "insecure-deserialization-yaml"), ("t3.py", 9, "insecure-deserialization-yaml"), ("t6.py", 2, "sql-injection-string-build")]


def test_findings_order_and_module_level_function(spark):
    rows = run_scan(spark, {"m.py": PY_TEMPLATES[23]})
    assert [r.function for r in rows] == [None, None, None]
    ordered = sorted(rows, key=lambda r: (r.file, r.line, r.ord))
    assert [r.rule_id for r in ordered] == ["insecure-deserialization-pickle", "command-injection-os-system",
                                            "hardcoded-secret"]


def test_strict_redaction_hides_neighbouring_secrets(spark):
    src = "db_password = 'hunter2hunter2'\napi_token = 'abcdefghij'\nx = 1\n"
    files = {"s.py": src}
    parity = scan_sources(source_df(spark, files)).findings.orderBy("line").collect()
    assert "abcdefghij" in parity[0].snippet and "hunter2hunter2" not in parity[0].snippet
    strict = scan_sources(source_df(spark, files), strict_redaction=True).findings.orderBy("line").collect()
    assert all("hunter2hunter2" not in r.snippet and "abcdefghij" not in r.snippet for r in strict)
    assert [r.line for r in strict] == [r.line for r in parity] == [1, 2]


def test_a_long_chain_of_double_targets_takes_few_rounds(spark, monkeypatch):
    from tidewatch.operators import taint
    written, materialize = [], taint.materialize
    monkeypatch.setattr(taint, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    steps = "".join(f"    {'a = b = c' if i % 2 else 'c = d = a'}\n" for i in range(1000))
    body = f"    a = b = 1\n    c = d = 1\n{{}}{steps}    cur.execute(d)\n    cur.execute(b)\n"
    hot = "def f(cur, v):\n" + body.format("    a = b = 'x' + v\n")
    cold = "def f(cur, v):\n" + body.format("    z = y = 'x' + v\n")
    late = "def f(cur, v):\n    a = b = 1\n    a = b = v\n    cur.execute(a)\n    a = b = 'x' + v\n    cur.execute(b)\n    p = b = a\n    p = q = 1\n    cur.execute(p)\n    cur.execute(q)\n"
    res = scan_sources(source_df(spark, {"hot.py": hot, "cold.py": cold, "late.py": late}))
    # A target of an assignment with two targets that holds no name and nothing dynamic keeps what it held.
    assert sorted((r.file, r.line) for r in res.findings.collect()) == [("hot.py", 1005), ("hot.py", 1006), ("late.py", 6), ("late.py", 9)]
    assert len(written) <= 10 and written.count("taint-new") <= 2


def test_rounds_of_a_long_chain_read_no_more_tables(spark, monkeypatch):
    """The driver held a plan of 16 scans in the fifth round, and three more in every further one."""
    from pyspark.sql.readwriter import DataFrameWriter

    from tidewatch.operators import taint
    from tidewatch.session import materialize
    scans, written = [], DataFrameWriter.parquet

    def keep(self, *args, **options):
        scans.append(self._df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
        return written(self, *args, **options)

    n = 300
    edges = materialize(spark.createDataFrame([("r", "m.py", 0, f"v{i}", i, f"v{i - 1}", i - 1) for i in range(1, n)],
                                              "repo string, path string, scope_id int, var string, pos int, t_var string, t_pos int"), "edges")
    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    links = taint.resolve_links(edges)
    assert len(scans) >= 5 and max(scans) <= 7, scans
    roots = {r.var: (r.r_var, r.r_pos) for r in links.roots.collect()}
    assert roots == {f"v{i}": ("v0", 0) for i in range(1, n)} and not links.has_multi
