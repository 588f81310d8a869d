"""Rule catalogue and small fixed vocabularies.

Everything is a tiny dimension (19 rules, 3 severities), so joins to it are
broadcast joins with a proven size bound, or literal map expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    cwe: str
    owasp: str
    title: str
    description: str
    remediation: str


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for right results: the 19 rule
# ids with their severity, CWE and OWASP 2021 category (in catalogue order).
#   sql-injection-string-build        high    CWE-89   A03:2021-Injection
#   command-injection-shell-true      high    CWE-78   A03:2021-Injection
#   command-injection-os-system       high    CWE-78   A03:2021-Injection
#   hardcoded-secret                  medium  CWE-798  A07:2021-Identification and Authentication Failures
#   insecure-deserialization-pickle   high    CWE-502  A08:2021-Software and Data Integrity Failures
#   insecure-deserialization-yaml     high    CWE-502  A08:2021-Software and Data Integrity Failures
#   dangerous-eval-exec               high    CWE-95   A03:2021-Injection
#   weak-crypto-hash                  low     CWE-327  A02:2021-Cryptographic Failures
#   debug-mode-enabled                medium  CWE-489  A05:2021-Security Misconfiguration
#   tls-verification-disabled         high    CWE-295  A02:2021-Cryptographic Failures
#   command-injection-js-exec         high    CWE-78   A03:2021-Injection
#   xss-innerhtml-assignment          medium  CWE-79   A03:2021-Injection
#   insecure-cors-wildcard            medium  CWE-942  A05:2021-Security Misconfiguration
#   jwt-none-algorithm                high    CWE-347  A07:2021-Identification and Authentication Failures
#   path-traversal-open               medium  CWE-22   A01:2021-Broken Access Control
#   insecure-random-token             medium  CWE-330  A02:2021-Cryptographic Failures
#   flask-cookie-missing-secure-flag  low     CWE-614  A05:2021-Security Misconfiguration
#   path-traversal-fs                 medium  CWE-22   A01:2021-Broken Access Control
#   cookie-missing-secure-flag        low     CWE-614  A05:2021-Security Misconfiguration
# Titles, descriptions and remediation texts below are our own wording.
# ---------------------------------------------------------------------------
A01 = "A01:2021-Broken Access Control"
A02 = "A02:2021-Cryptographic Failures"
A03 = "A03:2021-Injection"
A05 = "A05:2021-Security Misconfiguration"
A07 = "A07:2021-Identification and Authentication Failures"
A08 = "A08:2021-Software and Data Integrity Failures"

RULES: tuple[Rule, ...] = (
    Rule("sql-injection-string-build", "high", "CWE-89", A03,
         "SQL text assembled from string pieces",
         "The statement handed to a database execute call is assembled with concatenation, "
         "%-formatting, .format() or an interpolated string rather than bound parameters; "
         "untrusted input inside it becomes SQL injection.",
         "Keep the SQL text constant and pass values as bound parameters of the driver."),
    Rule("command-injection-shell-true", "high", "CWE-78", A03,
         "subprocess started through a shell",
         "A subprocess function is called with shell=True, so the command line is interpreted "
         "by a shell and any untrusted piece of it can run extra commands.",
         "Drop shell=True and pass the program and its arguments as a list."),
    Rule("command-injection-os-system", "high", "CWE-78", A03,
         "os.system/os.popen fed a non-constant command",
         "os.system or os.popen receives a command that is not a constant string; the shell "
         "runs whatever the value contains.",
         "Use subprocess with an argument list and no shell, and validate inputs."),
    Rule("hardcoded-secret", "medium", "CWE-798", A07,
         "Credential written into the source",
         "A variable whose name looks like a password, key or token is set to a literal string, "
         "so the secret lives in the code and its history.",
         "Load secrets from the environment or a secret store and rotate the exposed one."),
    Rule("insecure-deserialization-pickle", "high", "CWE-502", A08,
         "pickle used to load data",
         "pickle.load/pickle.loads can execute code while rebuilding objects; loading data an "
         "attacker can influence is remote code execution.",
         "Exchange data as JSON or another inert format; never unpickle untrusted bytes."),
    Rule("insecure-deserialization-yaml", "high", "CWE-502", A08,
         "yaml.load without a safe loader",
         "yaml.load is called without a Loader or with the full/unsafe loader, which can build "
         "arbitrary Python objects from the document.",
         "Call yaml.safe_load or pass Loader=yaml.SafeLoader."),
    Rule("dangerous-eval-exec", "high", "CWE-95", A03,
         "Code evaluated from a non-constant value",
         "eval/exec (or new Function) runs a value that is not a constant string; untrusted "
         "data reaching it is code injection.",
         "Parse data with a dedicated parser (for example ast.literal_eval or JSON) instead."),
    Rule("weak-crypto-hash", "low", "CWE-327", A02,
         "MD5 or SHA-1 hashing",
         "MD5 and SHA-1 are broken for collision resistance and unsuitable for passwords, "
         "signatures or integrity checks.",
         "Use SHA-256 or better, and a slow password hash (bcrypt, scrypt, argon2) for passwords."),
    Rule("debug-mode-enabled", "medium", "CWE-489", A05,
         "Application run in debug mode",
         "run(debug=True) enables an interactive debugger and verbose errors that must not be "
         "reachable in production.",
         "Turn debug off outside development, for example from an environment setting."),
    Rule("tls-verification-disabled", "high", "CWE-295", A02,
         "HTTPS certificate checks turned off",
         "An HTTP request is made with verify=False, so any man in the middle can read and "
         "alter the traffic.",
         "Keep verification on; point verify at a CA bundle for private certificates."),
    Rule("command-injection-js-exec", "high", "CWE-78", A03,
         "child_process exec with a built command",
         "A child_process exec-family call receives a command string built from pieces or a "
         "tainted variable; the shell runs whatever it contains.",
         "Use execFile/spawn with an argument array and validate every argument."),
    Rule("xss-innerhtml-assignment", "medium", "CWE-79", A03,
         "innerHTML set from a non-literal value",
         "A value that is not a plain literal is written to innerHTML and parsed as HTML, which "
         "lets injected markup run script.",
         "Write textContent, or sanitise the HTML with a vetted library first."),
    Rule("insecure-cors-wildcard", "medium", "CWE-942", A05,
         "CORS open to every origin",
         "The allowed origin is '*', so any site can read responses from this service.",
         "List the trusted origins explicitly."),
    Rule("jwt-none-algorithm", "high", "CWE-347", A07,
         "JWT verification accepts the 'none' algorithm",
         "The token verification options allow the unsigned 'none' algorithm, so forged tokens "
         "pass verification.",
         "Pin the expected signing algorithms and never include 'none'."),
    Rule("path-traversal-open", "medium", "CWE-22", A01,
         "open() on a built path",
         "open() receives a path assembled from pieces or a tainted variable; '../' sequences "
         "in the input can escape the intended folder.",
         "Resolve the path and check it stays under an allowed base folder."),
    Rule("insecure-random-token", "medium", "CWE-330", A02,
         "Predictable randomness for a secret value",
         "A token, key or password variable is filled from a general-purpose random generator "
         "whose output can be predicted.",
         "Use a cryptographic source such as the secrets module or crypto.randomBytes."),
    Rule("flask-cookie-missing-secure-flag", "low", "CWE-614", A05,
         "Cookie set without secure and httponly",
         "set_cookie is called without both secure=True and httponly=True, so the cookie can "
         "travel over plain HTTP or be read by script.",
         "Pass secure=True and httponly=True (and a SameSite policy)."),
    Rule("path-traversal-fs", "medium", "CWE-22", A01,
         "fs call on a built path",
         "A file-system call receives a path assembled from pieces or a tainted variable; "
         "'../' sequences in the input can escape the intended folder.",
         "Resolve the path and check it stays under an allowed base folder."),
    Rule("cookie-missing-secure-flag", "low", "CWE-614", A05,
         "Cookie set without secure and httpOnly",
         "A response cookie is set without options that make both secure and httpOnly true.",
         "Pass { secure: true, httpOnly: true } (and a sameSite policy) to the cookie call."),
)

RULE_IDS = tuple(r.rule_id for r in RULES)
RULES_BY_ID = {r.rule_id: r for r in RULES}

# Appended to a description when the sink is reached only through a seeded parameter.
CROSS_FUNCTION_NOTE = (" The value reaches this sink through a parameter: a caller in the same "
                       "file passes it a dynamically built value.")

# Severity weights for the risk score, cap, ranks for gates and
# ordering, SARIF levels.
SEVERITY_WEIGHT = {"high": 10, "medium": 5, "low": 1}
MAX_RISK_SCORE = 100
SEVERITY_GATE_RANK = {"low": 0, "medium": 1, "high": 2}
SEVERITY_SORT_RANK = {"high": 0, "medium": 1, "low": 2}
CONFIDENCE_SORT_RANK = {"high": 0, "medium": 1, "low": 2}
SARIF_LEVEL = {"high": "error", "medium": "warning", "low": "note"}

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("cwe", T.StringType(), True),
    T.StructField("owasp", T.StringType(), True),
    T.StructField("description", T.StringType(), False),
    T.StructField("remediation", T.StringType(), True),
])


def rules_df(spark: SparkSession) -> DataFrame:
    """The 19-row rule dimension (a local relation, always broadcast)."""
    rows = [(r.rule_id, r.title, r.severity, r.cwe, r.owasp, r.description, r.remediation) for r in RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def sql_quote(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def rules_values_sql() -> str:
    """The same dimension as a SQL VALUES list (used by the DuckDB oracles)."""
    rows = ",\n".join(
        "(" + ", ".join(sql_quote(v) for v in (r.rule_id, r.title, r.severity, r.cwe, r.owasp,
                                                r.description, r.remediation)) + ")"
        for r in RULES)
    return (f"(SELECT * FROM (VALUES {rows}) AS t(rule_id, title, severity, cwe, owasp, "
            f"description, remediation))")
