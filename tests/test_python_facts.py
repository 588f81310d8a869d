"""Fact extraction (pure Python part of the fact job)."""

from tidewatch.operators.facts_python import extract

SRC = '''import os

class A:
    def m(self, x, y=1):
        return x

    class B:
        def hidden(self):
            pass


async def top(a, *rest, k=0, **kw):
    def inner(z):
        os.system(z)
    q = "x" + a
    b = c = q
    inner(q)
'''


def test_inventory_matches_module_level_rules():
    f = extract(SRC)
    assert f["parse_error"] is None and f["loc"] == 17
    inv = [(x["name"], x["is_top_level"], x["is_method"], x["parent_class"], x["params"])
           for x in f["functions"] if x["is_top_level"] or x["is_method"]]
    assert inv == [("m", False, True, "A", ["self", "x", "y"]), ("top", True, False, None, ["a"])]
    assert [(c["name"], c["methods"]) for c in f["classes"]] == [("A", ["m"])]
    hidden = [x for x in f["functions"] if x["name"] == "hidden"][0]
    assert not hidden["is_top_level"] and not hidden["is_method"]


def test_scopes_and_kinds():
    f = extract(SRC)
    funcs = {x["name"]: x["func_id"] for x in f["functions"]}
    calls = {c["name"]: c for c in f["calls"]}
    assert calls["system"]["scope_id"] == funcs["inner"] and calls["system"]["func_name"] == "inner"
    assert calls["system"]["root"] == "os" and calls["system"]["shape"] == "attr"
    assert calls["inner"]["scope_id"] == funcs["top"] and calls["inner"]["args"][0]["kind"] == "ident"
    assigns = {tuple(a["targets"]): a for a in f["assigns"]}
    assert assigns[("q",)]["value"]["kind"] == "dynamic"
    assert assigns[("b", "c")]["n_targets"] == 2 and assigns[("b", "c")]["value"]["ident"] == "q"
    # pre-order: the assignment comes before the calls it contains
    assert all(a["pos"] < c["pos"] for a in f["assigns"] for c in f["calls"] if c["line"] == a["line"])


def test_parse_errors_are_rows_not_exceptions():
    assert extract("def f(:\n  pass\n")["parse_error"].startswith("syntax error: ")
    assert extract("x = 1\0\n")["parse_error"] is not None
    assert extract("# only a comment\n") == {"loc": 1, "parse_error": None, "functions": [], "classes": [], "inventory": [],
                                             "calls": [], "assigns": []}
    assert extract("")["loc"] == 0


def test_literals_and_lone_surrogates():
    f = extract('token = "\\ud800abcd"\nf(True, 1, b"x", None)\n')
    assert f["assigns"][0]["value"]["kind"] == "str_literal"
    f["assigns"][0]["value"]["literal"].encode("utf-8")     # Arrow-safe
    kinds = [(a["kind"], a["literal"]) for a in f["calls"][0]["args"]]
    assert kinds == [("other_literal", "True"), ("other_literal", "1"), ("other_literal", "b'x'"),
                     ("other_literal", "None")]
