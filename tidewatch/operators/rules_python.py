"""Python detectors R1-R13 as filters over the fact tables, plus the two-pass
cross-function assembly (T5-T8).

Emission order ``ord`` = pass * 2^40 + pos * 64 + rule sequence inside the
node visit, so (file, line, ord) is the reference's stable finding order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import SECRET_NAME_RE
from tidewatch.operators import taint
from tidewatch.session import checkpoint_dir, materialize

FILE = ["repo", "path"]

# Callee names used by the Python rules.
SQL_EXEC = ("execute", "executemany", "executescript")
SUBPROCESS_FUNCS = ("run", "Popen", "call", "check_call", "check_output")
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "request")
RANDOM_FUNCS = ("random", "randint", "randrange", "choice", "choices", "uniform", "getrandbits")
LITERAL_KINDS = ("str_literal", "other_literal")

# Rule sequence inside one Assign / Call visit (emission order).
ASSIGN_SEQ = {"hardcoded-secret": 0, "insecure-random-token": 1}
CALL_SEQ = {"sql-injection-string-build": 0, "command-injection-shell-true": 1,
            "command-injection-os-system": 2, "insecure-deserialization-pickle": 3,
            "insecure-deserialization-yaml": 4, "dangerous-eval-exec": 5, "weak-crypto-hash": 6,
            "debug-mode-enabled": 7, "tls-verification-disabled": 8, "path-traversal-open": 9,
            "flask-cookie-missing-secure-flag": 10}
TAINT_RULES = ("sql-injection-string-build", "path-traversal-open")
PASS_STRIDE = 1 << 40


def _kw(key: str, kind: str, literal: str):
    return F.exists("kwargs", lambda k: (k["key"] == key) & (k["kind"] == kind) & (k["literal"] == literal))


def _kw_true(key: str):
    return _kw(key, "other_literal", "True")


def _arg0():
    return F.try_element_at("args", F.lit(1))


def _not_constant(a):
    return ~a["kind"].isin(*LITERAL_KINDS)


def call_rule_conditions():
    """rule_id -> condition over a calls row that does not depend on taint."""
    name, root, shape = F.col("name"), F.col("root"), F.col("shape")
    has_args = F.size("args") > 0
    loader = F.try_element_at(F.filter("kwargs", lambda k: k["key"] == "Loader"), F.lit(1))
    return {
        "command-injection-shell-true": (root == "subprocess") & name.isin(*SUBPROCESS_FUNCS) & _kw_true("shell"),
        "command-injection-os-system": (root == "os") & name.isin("system", "popen") & has_args
                                       & _not_constant(_arg0()),
        "insecure-deserialization-pickle": (root == "pickle") & name.isin("load", "loads"),
        "insecure-deserialization-yaml": (root == "yaml") & (name == "load") & (
            loader.isNull() | ((loader["kind"] == "attr") & loader["attr"].isin("Loader", "UnsafeLoader"))),
        "dangerous-eval-exec": (shape == "name") & name.isin("eval", "exec") & has_args & _not_constant(_arg0()),
        "weak-crypto-hash": (root == "hashlib") & name.isin("md5", "sha1"),
        "debug-mode-enabled": (name == "run") & _kw_true("debug"),
        "tls-verification-disabled": name.isin(*HTTP_VERBS) & _kw("verify", "other_literal", "False"),
        "flask-cookie-missing-secure-flag": (name == "set_cookie") & ~(_kw_true("secure") & _kw_true("httponly")),
    }


def taint_sink_condition():
    """Calls whose first argument is a taint sink: (rule_id column, condition)."""
    name, shape = F.col("name"), F.col("shape")
    sql = name.isin(*SQL_EXEC) & (F.size("args") > 0)
    opn = (name == "open") & (F.size("args") > 0) & (shape == "name")
    rule = F.when(sql, F.lit("sql-injection-string-build")).when(opn, F.lit("path-traversal-open"))
    return rule, sql | opn


def _cand(df: DataFrame, rule, seq, pass_no: int) -> DataFrame:
    return df.select(
        "repo", F.col("path").alias("file"), "line", F.col("func_name").alias("function"),
        (rule if not isinstance(rule, str) else F.lit(rule)).alias("rule_id"),
        (F.lit(pass_no * PASS_STRIDE) + F.col("pos").cast("long") * 64 + seq).alias("ord"),
        F.lit(pass_no).alias("pass"),
        "pos")


def assign_candidates(assigns: DataFrame) -> DataFrame:
    """R4 (hardcoded-secret) and R12."""
    secret_target = F.exists("targets", lambda t: t.isNotNull() & t.rlike(SECRET_NAME_RE))
    v = F.col("value")
    r4 = assigns.filter((v["kind"] == "str_literal") & (F.length(v["literal"]) > 3) & secret_target)
    is_random = (((F.col("value_call_root") == "random") & F.col("value_call_name").isin(*RANDOM_FUNCS))
                 | ((F.col("value_call_shape") == "name") & F.col("value_call_name").isin(*RANDOM_FUNCS)))
    r12 = assigns.filter((v["kind"] == "call") & is_random & secret_target)
    return (_cand(r4, "hardcoded-secret", ASSIGN_SEQ["hardcoded-secret"], 1)
            .unionByName(_cand(r12, "insecure-random-token", ASSIGN_SEQ["insecure-random-token"], 1)))


def plain_call_candidates(calls: DataFrame) -> DataFrame:
    """Every call rule that does not depend on taint, in one scan of the calls
    (the matching rules of a call are collected into an array and exploded).
    Pass 1 only: pass 2 would emit the same rows, which the dedupe drops."""
    matched = F.filter(F.array(*[F.when(cond, F.lit(rule_id)) for rule_id, cond in call_rule_conditions().items()]),
                       lambda r: r.isNotNull())
    seq = F.lit(0)
    for rule_id, n in CALL_SEQ.items():
        seq = F.when(F.col("rule_id") == rule_id, F.lit(n)).otherwise(seq)
    hits = calls.select("repo", "path", "line", "func_name", "pos", F.explode(matched).alias("rule_id"))
    return _cand(hits, F.col("rule_id"), seq, 1)


def sink_queries(calls: DataFrame, local_names: DataFrame | None, sink=None) -> DataFrame:
    """Identifier arguments whose taint is needed: argument 0 of the sink
    calls (R1, R11; R14, R15, R21 for JS) and every argument of bare calls
    to a local top-level function name (T5)."""
    _, is_sink = (sink or taint_sink_condition)()
    a = calls.select(*FILE, "scope_id", "pos", "shape", "name", "args", is_sink.alias("is_sink"))
    ex = a.select(*FILE, "scope_id", "pos", "shape", "name", "is_sink", F.posexplode("args").alias("idx", "arg"))
    ex = ex.filter(F.col("arg.kind") == "ident")
    want = F.col("is_sink") & (F.col("idx") == 0)
    if local_names is not None:
        local = local_names.select(*FILE, "name").distinct().withColumn("is_local", F.lit(True))
        ex = ex.join(local, FILE + ["name"], "left")
        want = want | ((F.col("shape") == "name") & F.coalesce("is_local", F.lit(False)))
    q = ex.filter(want)
    return q.select(*FILE, "scope_id", F.col("arg.ident").alias("var"), "pos", F.lit("sink").alias("qkind"),
                    F.lit(None).cast("string").alias("qvar"), F.col("pos").alias("qpos"),
                    F.col("idx").cast("int").alias("qidx"))


def taint_candidates(calls: DataFrame, tainted_args: DataFrame, pass_no: int, sink=None, seq_of=None) -> DataFrame:
    """Taint sinks: argument 0 dynamic, or an identifier whose reaching def is tainted."""
    rule, is_sink = (sink or taint_sink_condition)()
    c = calls.filter(is_sink).withColumn("rule_id", rule)
    t0 = tainted_args.filter(F.col("qidx") == 0).select(*FILE, "pos", F.col("tainted").alias("t0"))
    j = c.join(t0, FILE + ["pos"], "left")
    a0 = _arg0()["kind"]
    fire = (a0 == "dynamic") | ((a0 == "ident") & F.coalesce("t0", F.lit(False)))
    hit = j.filter(fire)
    if seq_of is not None:
        seq = seq_of(F.col("rule_id"))
    else:
        seq = F.when(F.col("rule_id") == "sql-injection-string-build", CALL_SEQ["sql-injection-string-build"]) \
            .otherwise(CALL_SEQ["path-traversal-open"])
    return _cand(hit, F.col("rule_id"), seq, pass_no)


def local_function_params(functions: DataFrame) -> DataFrame:
    """Top-level functions (classes' methods and nested ones excluded),
    the later definition of a name wins; (repo, path, callee, idx, param)."""
    top = functions.filter(F.col("is_top_level"))
    w = Window.partitionBy(*FILE, "local_name").orderBy(F.col("func_id").desc())
    last = top.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)
    return last.select(*FILE, F.col("local_name").alias("callee"), F.posexplode("params").alias("idx", "param"))


def call_taint(calls: DataFrame, tainted_args: DataFrame) -> DataFrame:
    """T5: (repo, path, callee, idx) - bare-name calls passing a dynamic or
    tainted value at positional index idx (pass 1)."""
    c = calls.filter(F.col("shape") == "name").select(*FILE, "pos", "name", F.posexplode("args").alias("idx", "arg"))
    t = tainted_args.select(*FILE, "pos", F.col("qidx").alias("idx"), F.col("tainted"))
    j = c.join(t, FILE + ["pos", "idx"], "left")
    hit = (F.col("arg.kind") == "dynamic") | ((F.col("arg.kind") == "ident") & F.coalesce("tainted", F.lit(False)))
    return j.filter(hit).select(*FILE, F.col("name").alias("callee"), F.col("idx").cast("int").alias("idx")).distinct()


def seeds(call_taint_df: DataFrame, params: DataFrame) -> DataFrame:
    """(repo, path, callee, param) from call taint x local params."""
    return (call_taint_df.join(params, FILE + ["callee", "idx"])
            .select(*FILE, "callee", "param").distinct())


def assemble(functions: DataFrame, calls: DataFrame, assigns: DataFrame, plain: DataFrame, sink, seq_of,
             disabled=()) -> DataFrame:
    """Two passes + conditional dedupe (T5-T8), shared by Python and JS.

    ``plain`` are the pass-1 candidates of rules that do not depend on taint;
    ``sink`` / ``seq_of`` describe the language's taint sinks.  Definitions are
    walked once for both passes (see ``taint``): pass 1 taints gen
    defs, pass 2 the seeded parameter defs as well.
    Columns: repo, file, line, function, rule_id, ord, pass, pos, via_param.
    """
    # What several tables are made of is written: plans that hold it again and again make the driver run out of memory.
    params = materialize(local_function_params(functions), "local-params")
    # Placeholder defs: each function node named like a module-level function,
    # one per parameter name of that function (candidates for seeding).
    nodes = functions.select(*FILE, F.col("func_id").alias("scope_id"), F.col("name").alias("callee"))
    virtual = (nodes.join(params.select(*FILE, "callee", "param").distinct(), FILE + ["callee"])
               .select(*FILE, "scope_id", F.col("param").alias("var"), F.col("scope_id").alias("pos"),
                       F.lit("param").alias("kind"), F.lit(None).cast("string").alias("src"),
                       F.lit(True).alias("single"), "callee"))
    virtual = materialize(virtual, "taint-params")
    defs = taint.definitions(assigns).withColumn("callee", F.lit(None).cast("string")).unionByName(virtual)
    top_names = functions.filter(F.col("is_top_level")).select(*FILE, F.col("local_name").alias("name"))
    checkpoint_dir(functions.sparkSession)
    # Walked once; pass 2 only asks which parameters are seeded.
    args1 = sinks = materialize(taint.walk(defs, sink_queries(calls, top_names, sink)), "taint-sinks")
    tainted_rows = taint_candidates(calls, args1, 1, sink, seq_of)

    if disabled:
        plain, tainted_rows = (d.filter(~F.col("rule_id").isin(list(disabled))) for d in (plain, tainted_rows))
    # Written once: both the unseeded rows and the dedupe below read them.
    pass1 = materialize(plain, "plain-candidates").unionByName(materialize(tainted_rows, "taint-candidates"))
    seed_rows = materialize(seeds(call_taint(calls, args1), params), "seeds")
    seeded_files = seed_rows.select(*FILE).distinct()
    seeded = not seed_rows.isEmpty()

    if not seeded:
        return pass1.withColumn("via_param", F.lit(False))

    # Pass 2: the seeded placeholder defs are tainted too (only seeded files
    # change; only the taint rules can differ from pass 1).
    seed_defs = virtual.join(seed_rows.select(*FILE, "callee", F.col("param").alias("var")),
                             FILE + ["callee", "var"], "left_semi")
    calls2 = calls.join(seeded_files, FILE, "left_semi")
    args2 = taint.seeded(sinks.filter(F.col("qidx") == 0).join(seeded_files, FILE, "left_semi"), seed_defs)
    pass2 = taint_candidates(calls2, args2, 2, sink, seq_of)
    if disabled:
        pass2 = pass2.filter(~F.col("rule_id").isin(list(disabled)))
    pass2 = materialize(pass2, "seeded-candidates")

    flag = seeded_files.select("repo", F.col("path").alias("file"), F.lit(True).alias("seeded"))
    marked = pass1.join(flag, ["repo", "file"], "left")
    plain_rows = marked.filter(F.col("seeded").isNull()).drop("seeded")
    in_seeded = marked.filter(F.col("seeded")).drop("seeded").unionByName(pass2)
    w = Window.partitionBy("repo", "file", "rule_id", "line").orderBy("pass", "ord")
    kept = in_seeded.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1).drop("rk")
    return (plain_rows.withColumn("via_param", F.lit(False))
            .unionByName(kept.withColumn("via_param", F.col("pass") == 2)))
