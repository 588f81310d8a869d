"""The pass over a file's tokens inside the row against the token table, and which files take which way."""

import random

from source_tables import source_df
from test_js import FEATURES, FORMS, LITERALS, TS
from tidewatch.operators import facts_js_row as row
from tidewatch.operators.facts_js import extract_js_facts, token_table_parts
from tidewatch.operators.facts_python import flat
from tidewatch.plans.templates_js import JS_TEMPLATES
from tidewatch.plans.scan import scan_sources

KINDS = ("file", "function", "inventory", "class", "call", "assign", "pair", "new", "window")
ODD = ["", "if (x {", "\0 'a", "<<<<< not code `", ") ] } ( [ {", "a ) ( b ( ) ) c = (d) => e", "x ? (a) : b => c", "=> a", "f(", "f( // c\n", "f( /* x */ a, 'b')",
       "{ function g(a) { return 1 } }", "const token = 'abc\\ndef', pwd = \"x`\", secret = 'open\r\nlet b = 1", "new a.b(c)(d); new F(x); super.f(x); this.g(y)",
       "let a, b = 1, {c} = d; export const e = f, g = h; type T = {a: b}; declare let z", "verify(a, b, {algorithms: ['none', \"HS\", `x`], Algorithm: null})",
       "class { a = () => 1; static b() {} } class extends X { c(): T { } }", "a => b => c => { d }", "(a): T => b; async x => y; async (x) => { y }", "x.y<T>(z); m<T>() { }",
       "\\u0065val(x); cp.exec('a' + b); el.innerHTML = 1; el.innerHTML = y", "res.setHeader('Access-Control-Allow-Origin', '*')", "o = {'origin': '*', a: true, b: [1], c: {d: e}}",
       "f(a, {b: 1, c}, {...d}); g({secure: true})", "var x = Math.random(), y = Math.random; token = Math.random()", "switch (a) { case 'b': c = d\nbreak }", "for (;;) { a }"]


def files():
    rng, out = random.Random(7), {}
    whole = [t for _, t in JS_TEMPLATES] + [FEATURES, TS, *FORMS, *LITERALS, *ODD]
    for n, text in enumerate(whole):
        for e in (".js", ".ts", ".tsx"):
            out[f"w{n}{e}"] = text + "\n// the end 'of' it\n"
    bits = [x for text in whole for x in text[:3000].replace("\n", " \n ").split(" ")]
    for n in range(300):
        cut = rng.choice(whole)[:2000]
        for _ in range(rng.randrange(1, 6)):  # broken in a few places, or made of pieces
            at = rng.randrange(len(cut) + 1)
            cut = cut[:at] + rng.choice(["", " ", "\n", *rng.choices(bits, k=6), *"(){}[],;:=?.'`<>/+"]) + cut[at + rng.randrange(4):]
        out[f"x{n}{rng.choice(['.js', '.tsx'])}"] = cut if n % 3 else " ".join(rng.choices(bits, k=rng.randrange(5, 80)))
    return out


def shown(df):
    got = {}
    for r in df.collect():
        r = r.asDict(recursive=True)
        if r["kind"] in KINDS:
            if r["kind"] == "window":  # the token table's windows name no language
                r["language"] = None
            got.setdefault((r["path"], r["kind"]), []).append(repr(sorted((k, v) for k, v in r.items() if v is not None)))
    return {k: sorted(v) for k, v in got.items()}


def test_the_pass_gives_what_the_token_table_gives(spark):
    made = files()
    src = source_df(spark, made)
    for strict in (False, True):
        a = shown(extract_js_facts(src, strict))
        b = {}
        for part in token_table_parts(src, strict):
            b |= shown(flat(part))
        assert {k for _, k in a} == set(KINDS)
        wrong = [(k, made[k[0]], [x for x in a.get(k, []) if x not in b.get(k, [])], [x for x in b.get(k, []) if x not in a.get(k, [])]) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
        assert not wrong, (len(wrong), wrong[:3])


def test_long_files_take_the_token_table(spark, monkeypatch):
    text = "function f(db, v) {\n  const q = 'SELECT ' + v;\n  db.query(q);\n}\nf(a, b + 'c');\n"
    made = {"short.js": text, "long.js": text + "// x\n" * 50}
    short = scan_sources(source_df(spark, made))
    monkeypatch.setattr(row, "MAX_BYTES", 200)
    long = scan_sources(source_df(spark, made))
    rows = [sorted(tuple(r) for r in res.findings.collect()) for res in (short, long)]
    assert rows[0] == rows[1] and len(rows[0]) == 2
    assert long.facts.filter("kind = 'js-large'").count() == 1 and short.facts.filter("kind = 'js-large'").count() == 0
    assert sorted((r.path, r.loc) for r in long.files.collect()) == [("long.js", 55), ("short.js", 5)]


def test_a_scan_shuffles_no_tokens(spark, monkeypatch):
    """Before, every token of a file, comments too, went through a shuffle and two written tables."""
    from pyspark.sql.readwriter import DataFrameWriter
    names, written = [], DataFrameWriter.parquet

    def keep(self, path, *args, **options):
        names.append(path.rstrip("/").split("/")[-1].rsplit("-", 1)[0])
        return written(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", keep)
    res = scan_sources(source_df(spark, {"m.js": "cp.exec('ls ' + x);\n// a\n"}))
    assert [(r.line, r.rule_id) for r in res.findings.collect()] == [(1, "command-injection-js-exec")]
    assert "js-tokens" not in names and "js-segments" not in names and len(names) <= 16, names
