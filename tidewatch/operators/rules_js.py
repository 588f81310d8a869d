"""JavaScript / TypeScript detectors R14-R24 as filters and joins over the
fact tables (calls, assigns, pairs, news); taint and the two-pass assembly
are shared with Python (``rules_python.assemble``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import SECRET_NAME_RE
from tidewatch.operators.rules_python import PASS_STRIDE

# Callee names used by the JS/TS rules.
SQL_METHOD_NAMES = ("query", "execute", "raw")
EXEC_METHOD_NAMES = ("exec", "execSync", "execFile", "execFileSync")
EXEC_CHILD_PROCESS_OBJECTS = ("child_process", "cp")
HEADER_SETTER_NAMES = ("setHeader", "header", "set")
FS_PATH_FUNCS = ("readFile", "readFileSync", "writeFile", "writeFileSync", "unlink", "unlinkSync")

# Rule sequence inside one node visit (emission order).
CALL_SEQ = {"sql-injection-string-build": 0, "command-injection-js-exec": 1, "weak-crypto-hash": 2,
            "insecure-cors-wildcard": 3, "jwt-none-algorithm": 4, "path-traversal-fs": 5,
            "cookie-missing-secure-flag": 6, "dangerous-eval-exec": 7}
DECL_SEQ = {"hardcoded-secret": 0, "insecure-random-token": 1}
TAINT_RULES = ("sql-injection-string-build", "command-injection-js-exec", "path-traversal-fs")


def _arg(i: int):
    return F.try_element_at("args", F.lit(i))


def _cand(df: DataFrame, rule, seq, pass_no: int, pos="pos") -> DataFrame:
    return df.select(
        "repo", F.col("path").alias("file"), "line", F.col("func_name").alias("function"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"),
        (F.lit(pass_no * PASS_STRIDE) + F.col(pos).cast("long") * 64 + seq).alias("ord"),
        F.lit(pass_no).alias("pass"),
        F.col(pos).alias("pos"))


def taint_sink_condition():
    member, name, n = F.col("shape") == "attr", F.col("name"), F.size("args")
    sql = member & name.isin(*SQL_METHOD_NAMES) & (n > 0)
    exe = ((member & name.isin(*EXEC_METHOD_NAMES) & F.col("root").isin(*EXEC_CHILD_PROCESS_OBJECTS))
           | ((F.col("shape") == "name") & name.isin(*EXEC_METHOD_NAMES))) & (n > 0)
    fs = member & name.isin(*FS_PATH_FUNCS) & (n > 0)
    rule = (F.when(sql, F.lit("sql-injection-string-build")).when(exe, F.lit("command-injection-js-exec"))
            .when(fs, F.lit("path-traversal-fs")))
    return rule, sql | exe | fs


def plain_candidates(calls: DataFrame, assigns: DataFrame, pairs: DataFrame, news: DataFrame) -> DataFrame:
    """Every JS/TS rule that does not depend on taint (pass 1)."""
    member, name, n = F.col("shape") == "attr", F.col("name"), F.size("args")
    a0, a1, a2 = _arg(1), _arg(2), _arg(3)
    hash_ = member & (name == "createHash") & (n > 0) & (a0["kind"] == "str_literal") & \
        F.lower(a0["literal"]).isin("md5", "sha1")
    header = member & name.isin(*HEADER_SETTER_NAMES) & (n >= 2) & (a0["kind"] == "str_literal") & \
        (F.lower(a0["literal"]) == "access-control-allow-origin") & (a1["kind"] == "str_literal") & \
        (a1["literal"] == "*")
    evl = (F.col("shape") == "name") & (name == "eval") & (n > 0) & (a0["kind"] != "str_literal")
    parts = [_cand(calls.filter(hash_), "weak-crypto-hash", CALL_SEQ["weak-crypto-hash"], 1),
             _cand(calls.filter(header), "insecure-cors-wildcard", CALL_SEQ["insecure-cors-wildcard"], 1),
             _cand(calls.filter(evl), "dangerous-eval-exec", CALL_SEQ["dangerous-eval-exec"], 1)]

    # Cookie without (secure: true and httpOnly: true) in an object third argument
    opts = (pairs.filter(F.col("arg_idx") == 2).groupBy("repo", "path", "call_pos").agg(
        F.bool_or((F.col("key") == "secure") & (F.col("value_kind") == "true")).alias("sec"),
        F.bool_or((F.col("key") == "httpOnly") & (F.col("value_kind") == "true")).alias("http")))
    cookie = calls.filter(member & (name == "cookie")).join(
        opts.withColumnRenamed("call_pos", "pos"), ["repo", "path", "pos"], "left")
    insecure = (n < 3) | (a2["kind"] != "object") | ~(F.coalesce("sec", F.lit(False)) & F.coalesce("http", F.lit(False)))
    parts.append(_cand(cookie.filter(insecure), "cookie-missing-secure-flag", CALL_SEQ["cookie-missing-secure-flag"], 1))

    # verify(...) with an options object whose algorithm(s) holds 'none' (E10); one per pair
    none_val = (((F.col("value_kind") == "str_literal") & (F.lower("value_literal") == "none"))
                | ((F.col("value_kind") == "array") & F.exists("value_items", lambda x: F.lower(x) == "none")))
    bad = pairs.filter(F.col("call_pos").isNotNull() & F.lower("key").isin("algorithm", "algorithms") & none_val)
    verify = calls.filter(member & (name == "verify")).select("repo", "path", F.col("pos").alias("call_pos"),
                                                              "line", "func_name")
    jwt = bad.select("repo", "path", "call_pos").join(verify, ["repo", "path", "call_pos"])
    parts.append(_cand(jwt, "jwt-none-algorithm", CALL_SEQ["jwt-none-algorithm"], 1, pos="call_pos"))

    # R19 (object form): any pair origin: '*'
    cors = pairs.filter((F.lower("key") == "origin") & (F.col("value_kind") == "str_literal")
                        & (F.col("value_literal") == "*"))
    parts.append(_cand(cors, "insecure-cors-wildcard", 0, 1))
    # R16 (constructor form): new Function(...)
    parts.append(_cand(news.filter(F.col("ctor") == "Function"), "dangerous-eval-exec", 0, 1))

    # R17, R23, R24 on declarators and assignments
    target = F.try_element_at("targets", F.lit(1))
    secret_name = F.col("decl") & target.isNotNull() & target.rlike(SECRET_NAME_RE)
    v = F.col("value")
    r23 = assigns.filter(secret_name & (v["kind"] == "str_literal") & (F.length(v["literal"]) > 3))
    r24 = assigns.filter(secret_name & F.col("value_has_math_random"))
    xss = assigns.filter((F.col("target_shape") == "innerHTML") & ~F.col("value_is_literal"))
    parts += [_cand(r23, "hardcoded-secret", DECL_SEQ["hardcoded-secret"], 1),
              _cand(r24, "insecure-random-token", DECL_SEQ["insecure-random-token"], 1),
              _cand(xss, "xss-innerhtml-assignment", 0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
