"""One scan of every corpus template against the literal rows of ``plans.expected``,
and programs whose answer is known from how they were made."""

import random

import pytest

from source_tables import source_df
from tidewatch.catalog import CROSS_FUNCTION_NOTE
from tidewatch.plans.code_corpus import TEMPLATES
from tidewatch.plans.expected import EXPECTED
from tidewatch.plans.q_code import ranked
from tidewatch.plans.scan import inventory_classes, inventory_functions, scan_sources


def known_program(rng, js):
    """A straight function with its findings: the generator keeps the set of tainted names as it writes."""
    names, tainted, lines, hits = ["a", "b", "c", "d"], set(), [], []
    end = ";" if js else ""
    for _ in range(rng.randrange(4, 14)):
        v, w = rng.choice(names), rng.choice(names)
        kind = rng.choice(["make", "copy", "clean", "sink"])
        if kind == "make":
            lines.append(f"{v} = 'x' + arg{end}")
            tainted.add(v)
        elif kind == "copy":
            lines.append(f"{v} = {w}{end}")
            (tainted.add if w in tainted else tainted.discard)(v)
        elif kind == "clean":
            lines.append(f"{v} = clean({w}){end}")
            tainted.discard(v)
        else:
            lines.append(f"db.{'query' if js else 'execute'}({v}){end}")
            if v in tainted:
                hits.append(len(lines) + 1)
    body = "".join(f"  {x}\n" for x in lines)
    return (f"function f(db, arg) {{\n{body}}}\n" if js else f"def f(db, arg):\n{body}"), hits


@pytest.fixture(scope="module")
def scan(spark):
    files = {f"t{i}{e}": s.replace("{SECRET}", "0123456789abcdef") for i, (e, _, s) in enumerate(TEMPLATES)}
    rng, answers = random.Random(5), {}
    for i in range(60):
        for js in (False, True):
            path = f"known{i}.{'js' if js else 'py'}"
            files[path], answers[path] = known_program(rng, js)
    res = scan_sources(source_df(spark, files))
    return ranked(res.findings).collect(), inventory_functions(res.facts).collect(), inventory_classes(res.facts).collect(), res.files.collect(), answers, files


def test_findings(scan):
    for i, (e, _, _) in enumerate(TEMPLATES):
        got = [(r.line, r.function, r.rule_id, r.description.endswith(CROSS_FUNCTION_NOTE)) for r in sorted(scan[0], key=lambda r: r.ord) if r.file == f"t{i}{e}"]
        assert got == [x[:4] for x in EXPECTED[i].get("findings", [])], i


def test_functions_and_classes(scan):
    for i, (e, _, _) in enumerate(TEMPLATES):
        got = {(r.name, r.start_line, r.end_line, r.args, r.is_method, r.parent_class) for r in scan[1] if r.path == f"t{i}{e}"}
        assert got == {(n, a, b, ",".join(p), m, c) for n, a, b, p, m, c in EXPECTED[i].get("functions", [])}, i
        got = {(r.name, r.start_line, r.end_line, r.methods) for r in scan[2] if r.path == f"t{i}{e}"}
        assert got == {(n, a, b, ",".join(m)) for n, a, b, m in EXPECTED[i].get("classes", [])}, i


def test_parse_errors(scan):
    got = {r.path: r.parse_error for r in scan[3] if r.parse_error}
    assert got == {f"t{i}{e}": EXPECTED[i]["error"] for i, (e, _, _) in enumerate(TEMPLATES) if "error" in EXPECTED[i]}


def test_secrets_are_redacted(scan):
    secret = [r for r in scan[0] if r.rule_id == "hardcoded-secret"]
    assert secret and all("0123456789abcdef" not in r.snippet for r in secret)


def test_known_programs(scan):
    for path, lines in scan[4].items():
        assert [r.line for r in sorted(scan[0], key=lambda r: r.ord) if r.file == path] == lines, path


def test_snippets(scan):
    for r in scan[0]:
        lines = scan[5][r.file].splitlines()
        want = "\n".join(lines[max(0, r.line - 2):r.line + 5])[:600]
        if r.rule_id == "hardcoded-secret":
            assert r.snippet != want and "<redacted>" in r.snippet
        else:
            assert r.snippet == want, (r.file, r.line)
