"""JavaScript / TypeScript facts from the token table, on forms that lex or nest in unusual ways."""

import pytest

from source_tables import source_df
from tidewatch.operators.facts_js import extract_js_facts
from tidewatch.operators.js_tokens import lex

FEATURES = """export function exported(a, b) { return a + b; }
export default function () { return 1; }
export const arrow = (x) => x * 2;
const single = x => x;
export class Widget {
  method() { return 1; }
  onClick = (event) => event;
  static create(opts = {}) { return new Widget(); }
}
function withDefaults(a, b = 2, ...rest) { return [a, b, ...rest]; }
function pattern({a,b}, [c]) {}
"""

TS = """export function typed(id: number, name?: string, ...more: string[]): void {}
class Box<T> { private value: T; constructor(public readonly v: T) {} get(): T { return this.v; } }
"""

# Each form holds one sink that must be seen, whatever stands around it.
FORMS = [
    "class A { #m() { return 1; } get x() { return this.#m(); } set x(v) {} static { init(); } }",
    "const o = { get a() { return 1; }, set a(v) {}, async *gen() {}, [k]: 1, 'q': 2, ...rest };",
    "a?.b(); a?.[k]; x ??= 1; y **= 2; z ||= 3;",
    "outer: for (const x of xs) { continue outer; }",
    "for await (const c of stream) {}",
    "function g({ a, b = 2 }, [c, d], ...rest) {}",
    "x = a / b / c; y = (a) / 2; const r = /ab\\/c/g.test(s); if (/x['\"]/.test(s)) {}",
    "const t = `a ${`b ${c}`} d`;",
    "enum Color { Red = 1, Green }",
    "declare module 'x' { export function f(): void; }",
    "function over(a: string): void; function over(a: any) {}",
    "@Component({ selector: 'x' }) class Cmp { @Input() name: string; constructor(@Inject(T) private t: T) {} }",
    "type K = keyof typeof obj; type F = (a: number) => void; type G = new () => X;",
    "switch (x) { case 'a': { f(); break; } default: }",
    "class B extends mixin(A, C) { constructor() { super(); super.x(); } }",
    "let x = 1\nlet y = 2\nvar z = (function(){})()",
    "const v = <div className='x'>it's {a} &amp; don't</div>;",
    "const p: Promise<Array<Map<string, number>>> = load();",
    "obj.if = 1; obj.class = 2; x = obj.new;",
    "const a = <p title=\"it's\" {...rest}>don't {`${b}'`} won't</p>;",
    "const a = <T,>(x: T) => x; const b = <T extends K>(x: T) => x; const c = a < b;",
    "const a = <>it's <br/> {/* it's */} <A.B c:d='\"' e={<i>it's</i>} /></>;",
    "const a = tag`x ${y} ' ${`${z}`}`, b = `${c}${d}`, e = `,${f},`;",
    "const a = x.map(y => <li>{y ? <b>can't</b> : 'no'}</li>); if (a < 1) { b = c > 2; }",
]


@pytest.fixture(scope="module")
def facts(spark):
    files = {"f.js": FEATURES, "t.ts": TS, "empty.js": "", "open.js": "if (x {", "nul.js": "\0 'a", "words.tsx": "<<<<< not code `"}
    files |= {f"form{i}.tsx": f"#!/bin/x\n{s}\ncp.exec('ls ' + arg{i});\n" for i, s in enumerate(FORMS)}
    return [r.asDict(recursive=True) for r in extract_js_facts(source_df(spark, files)).collect()]


def of(facts, path, kind):
    return [r for r in facts if r["path"] == path and r["kind"] == kind]


def test_inventory(facts):
    inv = sorted((r["start_line"], r["name"], r["params"], r["is_method"], r["parent_class"]) for r in of(facts, "f.js", "inventory"))
    # An anonymous default export is an expression, not a declaration: not listed.
    assert inv == [(1, "exported", ["a", "b"], False, None), (3, "arrow", ["x"], False, None), (4, "single", [], False, None),
                   (6, "method", [], True, "Widget"), (7, "onClick", ["event"], True, "Widget"), (8, "create", ["opts"], True, "Widget"),
                   (10, "withDefaults", ["a", "b", "...rest"], False, None), (11, "pattern", ["{a,b}", "[c]"], False, None)]
    assert [(r["name"], r["methods"], r["start_line"], r["end_line"]) for r in of(facts, "f.js", "class")] == [
        ("Widget", ["method", "onClick", "create"], 5, 9)]


def test_typescript(facts):
    inv = {r["name"]: r["params"] for r in of(facts, "t.ts", "inventory")}
    assert inv == {"typed": ["id", "name", "...more"], "constructor": ["v"], "get": []}


def test_every_file_is_listed(facts):
    errors = {r["path"]: r["parse_error"] for r in facts if r["kind"] == "file"}
    assert errors["empty.js"] is None and errors["open.js"] and set(errors) >= {"nul.js", "words.tsx", "f.js"}
    assert len(errors) == 6 + len(FORMS)


@pytest.mark.parametrize("i", range(len(FORMS)))
def test_no_form_hides_the_sink_after_it(facts, i):
    calls = [r for r in of(facts, f"form{i}.tsx", "call") if r["name"] == "exec"]
    assert [(c["root"], c["args"][0]["kind"], c["func_name"]) for c in calls] == [("cp", "dynamic", None)], FORMS[i]


# Regular expression literals by what stands before them, each with a sink on its line; the last ones divide.
LITERALS = [
    "const ok = us.filter(u => /^https?:\\/\\//.test(u)); cp.exec('ls ' + ok);",
    "if (x) /['\"]/.test(y); cp.exec('ls ' + x);",
    "while (f(a, (b))) /[\"({]/.exec(c); cp.exec('ls ' + x);",
    "for await (const y of x) /`/.test(y); cp.exec('ls ' + x);",
    "          /['\"(]/.test(y); cp.exec('ls ' + x);",
    "const f = (a) => { switch (a) { case /[{']/.test(a): return /* of */ /[{']/; } }; cp.exec('ls ' + x);",
    "if (x) { f(); }\n          /[{']/.test(y); cp.exec('ls ' + x);",
    "const r = (a) / 2; cp.exec('ls ' + x); s = '/';",
    "const r = a[0] / 2 / b.if(c) / x! / {} / 2; cp.exec('ls ' + x); s = '/';",
    "const v = <p>{a} / {b}<br /></p>; cp.exec('ls ' + x); s = '/';",
]


@pytest.fixture(scope="module")
def literal_facts(spark):
    files = {f"lit{i}.tsx": f"{s}\nfunction after(a) {{ return a; }}\n" for i, s in enumerate(LITERALS)}
    return [r.asDict(recursive=True) for r in extract_js_facts(source_df(spark, files)).collect()]


@pytest.mark.parametrize("i", range(len(LITERALS)))
def test_regex_literals_hide_nothing(literal_facts, i):
    path = f"lit{i}.tsx"
    assert [(c["root"], c["args"][0]["kind"]) for c in of(literal_facts, path, "call") if c["name"] == "exec" and c["root"] == "cp"] == [("cp", "dynamic")]
    assert [(r["name"], r["params"]) for r in of(literal_facts, path, "inventory") if r["name"] == "after"] == [("after", ["a"])]
    assert [r["parse_error"] for r in of(literal_facts, path, "file")] == [None]


def test_tokens_give_back_the_file():
    for s in [FEATURES, TS, *FORMS, *LITERALS, "", "'open", "`open", "`open ${", "`open ${a} b", "`a\\", "<p>open {", "<p open", "<p>}</p>}", "/* open", "/[open", "\0 'a", "\u00a0\ufeff\U0001f600 é²"]:
        for jsx in (True, False):
            assert "".join(token for token, _ in lex(s, jsx)) == s


def test_long_literals_end_where_they_end(spark):
    many = "\\x41" * 100_000
    long = {"str.js": f'"{many}"', "tick.js": f"`{many}`", "class.js": "/[" + "\\u0041-\\u0043" * 2000 + "]/", "atoms.js": "/" + "a" * 2000 + "'/"}
    files = {p: f"const s = {x}; cp.exec('ls ' + s);\nfunction after(a) {{ return a; }}\n" for p, x in long.items()}
    rows = [r.asDict(recursive=True) for r in extract_js_facts(source_df(spark, files)).collect()]
    for p in files:
        assert [(c["root"], c["args"][0]["kind"]) for c in of(rows, p, "call") if c["name"] == "exec"] == [("cp", "dynamic")], p
        assert [r["name"] for r in of(rows, p, "inventory")] == ["after"], p
        assert [r["parse_error"] for r in of(rows, p, "file")] == [None], p


def test_code_in_templates_and_elements(spark):
    files = {
        "a.js": "const x = `a ${eval(u)} b`;",
        "b.js": "return `${items.map(i => { document.body.innerHTML = i; return eval(i); })}`",
        "c.jsx": "<p>don't</p>; eval(x)",
        "d.jsx": "const v = <A b={eval(x)} password='abcdef'>it's {eval(y)}</A>;",
        "e.js": "f(`${a}`, `b`, `c${`${eval(d)}`}`, eval(e))",
        "f.ts": "const a = <Foo>eval(x); const b = `${<T>eval(y)}`;",
    }
    rows = [r.asDict(recursive=True) for r in extract_js_facts(source_df(spark, files)).collect()]
    evals = {p: sum(r["name"] == "eval" for r in of(rows, p, "call")) for p in files}
    assert evals == {"a.js": 1, "b.js": 1, "c.jsx": 1, "d.jsx": 2, "e.js": 2, "f.ts": 2}
    assert [r["target_shape"] for r in of(rows, "b.js", "assign")] == ["innerHTML"]
    assert [r["targets"] for r in of(rows, "d.jsx", "assign")] == [["v"]]
    assert [[a["kind"] for a in r["args"]] for r in of(rows, "e.js", "call") if r["name"] == "f"] == [["dynamic", "template_plain", "dynamic", "call"]]
    assert all(r["parse_error"] is None for r in rows if r["kind"] == "file")


def test_destructured_parameters_are_cut_in_place(spark):
    long = ", ".join(f"name{i} = /* x */ {i}" for i in range(40))
    many = "\n".join(f"function f{i}({{ a{i}, b: [c{i}] }}, {{ {long} }} = {{}}, [d]) {{}}" for i in range(50))
    rows = [r.asDict() for r in extract_js_facts(source_df(spark, {"m.js": many})).collect()]
    got = {r["name"]: r["params"] for r in of(rows, "m.js", "inventory")}
    cut = ("{ " + ", ".join(f"name{i} = {i}" for i in range(40)))
    assert len(got) == 50 and all(got[f"f{i}"][0] == f"{{ a{i}, b: [c{i}] }}" and got[f"f{i}"][2] == "[d]" for i in range(50))
    assert {len(p[1]) for p in got.values()} == {60} and cut.startswith("{ name0")
