"""Python fact extraction (P1-P4): one ``mapInArrow`` pass over the files.

Each Python file is parsed once with the standard ``ast`` module inside the
Python worker and walked in pre-order (the order ``ast.NodeVisitor`` visits:
fields in declaration order, lists in order).  The walk emits plain facts -
file, function, class, call and assignment rows (flat, ``kind`` column);
everything else (rules, taint, snippets) is relational Spark work on those
facts.  ``pos`` is the pre-order ordinal of a node, ``scope_id`` the ``pos`` of
the innermost enclosing function (0 = module); class bodies, lambdas and
comprehensions do not open a scope.

A file that does not parse gets ``parse_error`` and empty facts; any failure
(syntax, null bytes, recursion, memory) stays inside that row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.files import not_read

ARG = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("literal", T.StringType()),
    T.StructField("ident", T.StringType()), T.StructField("attr", T.StringType())])
KWARG = T.StructType([T.StructField("key", T.StringType())] + ARG.fields)

FUNCTION = T.StructType([
    T.StructField("func_id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("scope_id", T.IntegerType()), T.StructField("is_top_level", T.BooleanType()),
    T.StructField("is_method", T.BooleanType()), T.StructField("parent_class", T.StringType()),
    T.StructField("params", T.ArrayType(T.StringType())), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("local_name", T.StringType())])
CLASS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("methods", T.ArrayType(T.StringType()))])
CALL = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("line", T.IntegerType()),
    T.StructField("scope_id", T.IntegerType()), T.StructField("func_name", T.StringType()),
    T.StructField("shape", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("root", T.StringType()), T.StructField("args", T.ArrayType(ARG)),
    T.StructField("kwargs", T.ArrayType(KWARG))])
ASSIGN = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("line", T.IntegerType()),
    T.StructField("scope_id", T.IntegerType()), T.StructField("func_name", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())), T.StructField("n_targets", T.IntegerType()),
    T.StructField("value", ARG), T.StructField("value_call_shape", T.StringType()),
    T.StructField("value_call_name", T.StringType()), T.StructField("value_call_root", T.StringType())])

_FUNC_NODES = (ast.FunctionDef, ast.AsyncFunctionDef)
# Nodes without nodes below them.
_LEAVES = frozenset((ast.Constant, *(c for base in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for c in base.__subclasses__())))


def _clean(s):
    """Strings from the AST may hold lone surrogates ("\\ud800"); Arrow needs UTF-8."""
    if s is None:
        return None
    try:
        s.encode("utf-8")
        return s
    except UnicodeEncodeError:
        return s.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def _literal_text(value) -> str:
    """repr of a literal; an integer too long to print in decimal is printed in hex."""
    try:
        return _clean(repr(value))
    except ValueError:
        return hex(value) if isinstance(value, int) else type(value).__name__


def expr_fact(node: ast.AST) -> dict:
    """Kind + payload of an expression (the vocabulary of the rules)."""
    kind, literal, ident, attr = "other", None, None, None
    if isinstance(node, ast.JoinedStr):
        kind = "dynamic"
    elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add)):
        kind = "dynamic"
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        kind = "dynamic"
    elif isinstance(node, ast.Constant):
        if isinstance(node.value, str):
            kind, literal = "str_literal", _clean(node.value)
        else:
            kind, literal = "other_literal", _literal_text(node.value)
    elif isinstance(node, ast.Name):
        kind, ident = "ident", node.id
    elif isinstance(node, ast.Attribute):
        kind, attr = "attr", node.attr
    elif isinstance(node, ast.Call):
        kind = "call"
    return {"kind": kind, "literal": literal, "ident": ident, "attr": attr}


def call_shape(call: ast.Call) -> tuple[str, str | None, str | None]:
    """(shape, called name, root name) of a call."""
    f = call.func
    if isinstance(f, ast.Name):
        shape, name = "name", f.id
    elif isinstance(f, ast.Attribute):
        shape, name = "attr", f.attr
    else:
        shape, name = "other", None
    while isinstance(f, ast.Attribute):
        f = f.value
    root = f.id if isinstance(f, ast.Name) else None
    return shape, name, root


def _end_line(node) -> int:
    end = getattr(node, "end_lineno", None)
    return end if end is not None else getattr(node, "lineno", 0)


def extract(source: str) -> dict:
    """Facts of one Python source text (pure function; unit-tested directly)."""
    loc = len(source.splitlines())
    out = {"loc": loc, "parse_error": None, "functions": [], "classes": [], "calls": [], "assigns": [],
           "inventory": []}
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        out["parse_error"] = _clean(f"syntax error: {e.msg} at line {e.lineno}")
        return out
    except Exception as e:  # one file never fails the job; the inventory counts it with its reason
        out["parse_error"] = _clean(f"could not parse: {type(e).__name__}")
        return out
    try:
        _walk(tree, out)
    except Exception as e:
        for k in ("functions", "classes", "calls", "assigns", "inventory"):
            out[k] = []
        out["parse_error"] = f"could not walk: {type(e).__name__}"
    return out


def _walk(tree: ast.Module, out: dict) -> None:
    module_classes = {}
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            module_classes[id(node)] = node
            out["classes"].append({
                "name": node.name, "start_line": node.lineno, "end_line": _end_line(node),
                "methods": [c.name for c in node.body if isinstance(c, _FUNC_NODES)]})
    method_parent = {id(c): cls.name for cls in module_classes.values() for c in cls.body
                     if isinstance(c, _FUNC_NODES)}
    top_level = {id(n) for n in tree.body if isinstance(n, _FUNC_NODES)}

    pos = 0
    # explicit stack: (node, scope_id, function name); children pushed reversed
    stack = [(tree, 0, None)]
    functions, assigns, calls = out["functions"], out["assigns"], out["calls"]
    while stack:
        node, scope, fname = stack.pop()
        me, kind = pos, type(node)
        pos += 1
        if kind is ast.Name:
            pos += 1  # its context
            continue
        if kind in _LEAVES:
            continue
        if kind is ast.Call:
            shape, name, root = call_shape(node)
            calls.append({
                "pos": me, "line": node.lineno, "scope_id": scope, "func_name": fname,
                "shape": shape, "name": name, "root": root,
                "args": [expr_fact(a) for a in node.args],
                "kwargs": [{"key": k.arg, **expr_fact(k.value)} for k in node.keywords]})
        elif kind is ast.Assign:
            v = node.value
            shape = name = root = None
            if isinstance(v, ast.Call):
                shape, name, root = call_shape(v)
            assigns.append({
                "pos": me, "line": node.lineno, "scope_id": scope, "func_name": fname,
                "targets": [t.id if isinstance(t, ast.Name) else None for t in node.targets],
                "n_targets": len(node.targets), "value": expr_fact(v),
                "value_call_shape": shape, "value_call_name": name, "value_call_root": root})
        elif kind in _FUNC_NODES:
            functions.append({
                "func_id": me, "name": node.name, "local_name": node.name, "scope_id": scope,
                "is_top_level": id(node) in top_level, "is_method": id(node) in method_parent,
                "parent_class": method_parent.get(id(node)),
                "params": [a.arg for a in node.args.args],
                "start_line": node.lineno, "end_line": _end_line(node)})
            scope, fname = me, node.name
            if id(node) in top_level or id(node) in method_parent:
                out["inventory"].append({**functions[-1]})
        children = []
        for field in kind._fields:
            value = getattr(node, field, None)
            if type(value) is list:
                children += [(c, scope, fname) for c in value if isinstance(c, ast.AST)]
            elif isinstance(value, ast.AST):
                children.append((value, scope, fname))
        children.reverse()
        stack += children


# Flat fact rows: one row per file / function / class / call / assignment,
# ``kind`` says which; written once, partitioned by kind, so every fact table
# is a partition-pruned columnar scan (no re-reading of nested arrays).
FLAT_SCHEMA = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("repo", T.StringType()),
     T.StructField("path", T.StringType()), T.StructField("language", T.StringType()),
     T.StructField("loc", T.IntegerType()), T.StructField("parse_error", T.StringType())]
    + [T.StructField(f.name, f.dataType) for f in CALL.fields]
    + [T.StructField(f.name, f.dataType) for f in ASSIGN.fields if f.name not in {x.name for x in CALL.fields}]
    + [T.StructField(f.name, f.dataType) for f in FUNCTION.fields
       if f.name not in {x.name for x in CALL.fields} | {x.name for x in ASSIGN.fields}]
    + [T.StructField("methods", T.ArrayType(T.StringType()))]
    # JS/TS-only columns (null for Python rows)
    + [T.StructField("decl", T.BooleanType()), T.StructField("target_shape", T.StringType()),
       T.StructField("value_has_math_random", T.BooleanType()), T.StructField("value_is_literal", T.BooleanType()),
       T.StructField("key", T.StringType()), T.StructField("value_kind", T.StringType()),
       T.StructField("value_literal", T.StringType()), T.StructField("value_items", T.ArrayType(T.StringType())),
       T.StructField("call_pos", T.IntegerType()), T.StructField("arg_idx", T.IntegerType()),
       T.StructField("ctor", T.StringType()), T.StructField("snippet", T.StringType())])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """``pa.array``, field by field where the values are dicts or lists of dicts."""
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([pa.array([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        ends = [0, *accumulate(map(len, values))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column([x for v in values for x in v], kind.value_type), type=kind)
    return pa.array(values, kind)


class Rows:
    """Fact rows by kind, given out as Arrow batches of one schema: only the columns that a kind has are filled."""

    def __init__(self) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema
        self.schema, self.kinds, self.n = to_arrow_schema(FLAT_SCHEMA), {}, 0

    def add(self, kind: str, repo, path, language, rows: list[dict]) -> None:
        """``rows`` of a kind have the same keys."""
        if rows:
            keys, held = self.kinds.setdefault(kind, ([], []))
            keys.append((repo, path, language, len(rows)))
            held.extend(rows)
            self.n += len(rows)

    def full(self) -> bool:
        return self.n >= FLUSH_ROWS

    def take(self) -> Iterator[pa.RecordBatch]:
        for kind, (keys, rows) in self.kinds.items():
            n = len(rows)
            spread = pa.array([at for at, key in enumerate(keys) for _ in range(key[3])], pa.int32())
            columns = []
            for f in self.schema:
                if f.name == "kind":
                    columns.append(pa.array([kind] * n, f.type))
                elif f.name in ("repo", "path", "language"):
                    at = ("repo", "path", "language").index(f.name)
                    columns.append(pa.array([k[at] for k in keys], f.type).take(spread))
                elif f.name in rows[0]:
                    columns.append(_column([r[f.name] for r in rows], f.type))
                else:
                    columns.append(pa.nulls(n, f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.kinds, self.n = {}, 0


def _flat_batches(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.operators.windows import python_snippets
        out = Rows()
        for batch in batches:
            # One file after the other: a batch of files is never held as Python objects.
            columns = [batch.column(c) for c in ("repo", "path", "language", "content", "not_read")]
            for i in range(batch.num_rows):
                repo, path, lang, content, not_read = (c[i].as_py() for c in columns)
                facts = {"loc": 0, "parse_error": not_read} if not_read else extract(content or "")
                if facts.get("calls") or facts.get("assigns"):
                    facts["windows"] = python_snippets(content or "", facts, strict)
                out.add("file", repo, path, lang, [{"loc": facts["loc"], "parse_error": facts["parse_error"]}])
                for k, kind in (("functions", "function"), ("classes", "class"), ("calls", "call"), ("assigns", "assign"),
                                ("inventory", "inventory"), ("windows", "window")):
                    out.add(kind, repo, path, lang, facts.get(k, ()))
                if out.full():
                    yield from out.take()
        yield from out.take()
    return run


FLUSH_ROWS = 20_000
CODE_LANGUAGES = ("Python", "JavaScript", "TypeScript")


def extract_python_facts(sources: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, language, content) of Python files -> flat fact rows."""
    from tidewatch.session import ship_package
    ship_package(sources.sparkSession)
    src = sources.filter(F.col("language") == "Python").select("repo", "path", "language", "content", not_read(sources).alias("not_read"))
    return src.mapInArrow(_flat_batches(strict), FLAT_SCHEMA)


def extract_facts(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Flat fact rows of all code files: Python by one pass over ``ast`` per
    file, JavaScript and TypeScript by one pass over the tokens (long files by the token table).  ``strict`` redacts every
    secret of a file in all of its snippets, not only in its own."""
    parts, later = fact_parts(sources, strict), []
    for part in parts:
        later += part(parts[-2]) if callable(part) else [part]
    return reduce(DataFrame.unionByName, later)


def flat(rows: DataFrame) -> DataFrame:
    """Rows of one kind with the columns of all."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FLAT_SCHEMA.fields])


def fact_parts(sources: DataFrame, strict: bool = False) -> list:
    """The rows of ``extract_facts`` in several frames of one schema: Python's, those of JavaScript and TypeScript, and last a
    function that gives the rest from what these have written (see ``materialize_parts``)."""
    from tidewatch.operators.facts_js import js_fact_parts
    parts = [flat(extract_python_facts(sources, strict))]
    # Reads the language column only, and only up to the first file found.
    if not sources.filter(F.col("language").isin("JavaScript", "TypeScript")).select("language").isEmpty():
        parts += js_fact_parts(sources, strict)
    return parts


# -- fact tables (partition-pruned reads of the flat facts) --------------------

def _kind(facts: DataFrame, kind: str, fields) -> DataFrame:
    return facts.filter(F.col("kind") == kind).select("repo", "path", *[f.name for f in fields])


def files_table(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "file").select("repo", "path", "language", "loc", "parse_error")


def functions_table(facts: DataFrame) -> DataFrame:
    """Every function scope (any nesting); ``is_top_level`` marks the targets of
    cross-function seeding (module-level functions)."""
    return _kind(facts, "function", FUNCTION.fields)


def inventory_table(facts: DataFrame) -> DataFrame:
    """P2 / P5-P7 rows: the functions and methods a file inventory lists."""
    return _kind(facts, "inventory", FUNCTION.fields)


def pairs_table(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "pair").select(
        "repo", "path", "pos", "line", "scope_id", "func_name", "key", "value_kind", "value_literal",
        "value_items", "call_pos", "arg_idx")


def news_table(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "new").select("repo", "path", "pos", "line", "scope_id", "func_name",
                                                       "ctor")


def windows_table(facts: DataFrame) -> DataFrame:
    """Snippets by place: one per line (``pos`` null), and a redacted one per declared secret."""
    return facts.filter(F.col("kind") == "window").select("repo", "path", "line", "pos", "snippet")


def classes_table(facts: DataFrame) -> DataFrame:
    return _kind(facts, "class", CLASS.fields)


def calls_table(facts: DataFrame) -> DataFrame:
    """Calls of files that parsed (files that fail have no call rows)."""
    return facts.filter(F.col("kind") == "call").select("repo", "path", "language", *[f.name for f in CALL.fields])


def assigns_table(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "assign").select(
        "repo", "path", "language", *[f.name for f in ASSIGN.fields], "decl", "target_shape",
        "value_has_math_random", "value_is_literal")
