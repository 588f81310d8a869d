"""What every template of the code corpus must give, as literal rows.

Rows were read against their template; nothing here is computed, and no oracle
runs any code of ``operators`` or ``functions`` to get them.

One entry per template, in the order of ``code_corpus.TEMPLATES``.  ``findings``
are (line, function, rule, reached through a seeded parameter, literal) in order
of emission; ``calls`` are (local function, argument place) that get a tainted value,
``seeds`` the parameters those reach; ``functions`` are (name, first line, last
line, parameters, is method, class), ``classes`` (name, first line, last line, methods).
"""

EXPECTED: tuple[dict, ...] = (
    {  # Python template 0
        "findings": [
            (6, "find_user", "sql-injection-string-build", False, None),
            (12, "find_by_id", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("find_user", 4, 7, ["conn", "name"], False, None),
            ("find_by_id", 10, 14, ["conn", "uid"], False, None),
        ],
    },
    {  # Python template 1
        "findings": [
            (6, "run_tool", "command-injection-shell-true", False, None),
            (8, "run_tool", "command-injection-os-system", False, None),
        ],
        "functions": [
            ("run_tool", 5, 10, ["arg"], False, None),
        ],
    },
    {  # Python template 2
        "findings": [
            (3, None, "hardcoded-secret", False, "{SECRET}"),
            (9, None, "hardcoded-secret", False, "{SECRET}-tail"),
            (12, "reset", "insecure-random-token", False, None),
        ],
        "functions": [
            ("reset", 11, 13, ["self"], True, "Settings"),
        ],
        "classes": [
            ("Settings", 8, 13, ["reset"]),
        ],
    },
    {  # Python template 3
        "findings": [
            (6, "load_blob", "insecure-deserialization-pickle", False, None),
            (7, "load_blob", "insecure-deserialization-yaml", False, None),
            (9, "load_blob", "insecure-deserialization-yaml", False, None),
            (10, "load_blob", "dangerous-eval-exec", False, None),
        ],
        "functions": [
            ("load_blob", 5, 12, ["data", "text", "expr"], False, None),
        ],
    },
    {  # Python template 4
        "findings": [
            (9, "digest", "weak-crypto-hash", False, None),
            (10, "digest", "weak-crypto-hash", False, None),
            (16, "fetch", "tls-verification-disabled", False, None),
            (20, "fetch", "flask-cookie-missing-secure-flag", False, None),
            (25, None, "debug-mode-enabled", False, None),
        ],
        "functions": [
            ("digest", 8, 12, ["data"], False, None),
            ("fetch", 15, 21, ["url"], False, None),
        ],
    },
    {  # Python template 5
        "findings": [
            (9, "read_report", "path-traversal-open", False, None),
            (11, "read_report", "path-traversal-open", False, None),
        ],
        "functions": [
            ("read_report", 4, 13, ["base", "name"], False, None),
        ],
    },
    {  # Python template 6
        "findings": [
            (2, "run_query", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("run_query", 1),
        ],
        "seeds": [
            ("run_query", "sql"),
        ],
        "functions": [
            ("run_query", 1, 2, ["cursor", "sql"], False, None),
            ("lookup", 5, 6, ["cursor", "name"], False, None),
            ("fixed", 9, 10, ["cursor"], False, None),
        ],
    },
    {  # Python template 7
        "findings": [
            (5, "report", "sql-injection-string-build", False, None),
            (11, "report", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("report", 1, 11, ["cursor", "day"], False, None),
        ],
    },
    {  # Python template 8
        "findings": [
            (6, "refresh", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("refresh", 1, 6, ["cursor", "table"], False, None),
        ],
    },
    {  # Python template 9
        "findings": [
            (15, "level_one", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("level_one", 1),
        ],
        "seeds": [
            ("level_one", "stmt"),
        ],
        "functions": [
            ("level_two", 1, 2, ["cur", "stmt"], False, None),
            ("level_one", 5, 6, ["cur", "stmt"], False, None),
            ("entry", 9, 10, ["cur", "user"], False, None),
            ("level_one", 14, 15, ["self", "stmt"], True, "Repo"),
        ],
        "classes": [
            ("Repo", 13, 15, ["level_one"]),
        ],
    },
    {  # Python template 10
        "findings": [
            (2, "writer", "path-traversal-open", True, None),
        ],
        "calls": [
            ("writer", 0),
            ("writer", 1),
        ],
        "seeds": [
            ("writer", "path"),
        ],
        "functions": [
            ("writer", 1, 3, ["path"], False, None),
            ("caller", 6, 8, ["a", "b"], False, None),
            ("only_kw", 11, 12, [], False, None),
        ],
    },
    {  # Python template 11
        "findings": [
            (10, "source", "weak-crypto-hash", False, None),
            (5, "sink", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("sink", 1),
        ],
        "seeds": [
            ("sink", "stmt"),
        ],
        "functions": [
            ("sink", 4, 5, ["cur", "stmt"], False, None),
            ("source", 8, 11, ["cur", "v"], False, None),
        ],
    },
    {  # Python template 12
        "findings": [
            (5, "digests", "weak-crypto-hash", False, None),
            (5, "digests", "weak-crypto-hash", False, None),
            (6, "digests", "hardcoded-secret", False, "{SECRET}"),
            (6, "digests", "hardcoded-secret", False, "{SECRET}"),
        ],
        "functions": [
            ("digests", 4, 7, [], False, None),
        ],
    },
    {  # Python template 13
        "findings": [
            (10, None, "sql-injection-string-build", False, None),
            (13, None, "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("use_module_var", 4, 5, ["cur"], False, None),
        ],
        "classes": [
            ("Holder", 8, 10, []),
        ],
    },
    {  # Python template 14
        "findings": [
            (7, "outer", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("outer", 1, 9, ["cur", "v"], False, None),
        ],
    },
    {  # Python template 15
        "findings": [
            (9, "handler", "command-injection-shell-true", False, None),
            (8, "handler", "command-injection-shell-true", False, None),
        ],
        "functions": [
            ("deco", 4, 5, ["x"], False, None),
            ("handler", 9, 10, ["cmd"], False, None),
        ],
    },
    {  # Python template 16
        "functions": [
            ("eval", 7, 8, ["self", "x"], True, "Store"),
            ("safe", 11, 18, ["cur", "conn", "name", "data"], False, None),
        ],
        "classes": [
            ("Store", 6, 8, ["eval"]),
        ],
    },
    {  # Python template 17
        "error": "syntax error: invalid syntax at line 1",
    },
    {  # Python template 18
        "findings": [
            (6, "make", "insecure-random-token", False, None),
            (7, "make", "insecure-random-token", False, None),
            (9, "make", "hardcoded-secret", False, "plain"),
        ],
        "functions": [
            ("make", 5, 10, [], False, None),
        ],
    },
    {  # Python template 19
        "functions": [
            ("fetch", 2, 3, ["self", "url", "timeout"], True, "Service"),
            ("close", 5, 6, ["self"], True, "Service"),
            ("main", 13, 16, ["argv"], False, None),
        ],
        "classes": [
            ("Service", 1, 10, ["fetch", "close"]),
        ],
    },
    {  # Python template 20
        "findings": [
            (3, "store", "sql-injection-string-build", True, None),
            (4, "store", "path-traversal-open", True, None),
        ],
        "calls": [
            ("store", 1),
        ],
        "seeds": [
            ("store", "value"),
        ],
        "functions": [
            ("store", 1, 5, ["cur", "value"], False, None),
            ("handler", 8, 9, ["cur", "req"], False, None),
        ],
    },
    {  # Python template 21
        "findings": [
            (2, "total", "sql-injection-string-build", False, None),
            (3, "total", "sql-injection-string-build", False, None),
            (11, "target", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("target", 2),
        ],
        "seeds": [
            ("target", "b"),
        ],
        "functions": [
            ("total", 1, 3, ["cur", "n"], False, None),
            ("target", 6, 7, ["cur", "a"], False, None),
            ("target", 10, 11, ["cur", "a", "b"], False, None),
            ("call_it", 14, 15, ["cur", "x"], False, None),
        ],
    },
    {  # Python template 22
        "findings": [
            (7, "clean", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("clean", 1, 7, ["cur", "v"], False, None),
        ],
    },
    {  # Python template 23
        "findings": [
            (4, None, "insecure-deserialization-pickle", False, None),
            (5, None, "command-injection-os-system", False, None),
            (6, None, "hardcoded-secret", False, "{SECRET}"),
        ],
    },
    {  # Python template 24
        "findings": [
            (4, "run", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("run", 3, 4, ["cur", "v"], False, None),
        ],
    },
    {  # Python template 25
        "findings": [
            (1003, "chain", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("chain", 1, 1003, ["cur", "v"], False, None),
        ],
    },
    {  # JS/TS template 0
        "findings": [
            (5, "listOrders", "sql-injection-string-build", False, None),
            (7, "listOrders", "sql-injection-string-build", False, None),
            (8, "listOrders", "command-injection-js-exec", False, None),
            (9, "listOrders", "path-traversal-fs", False, None),
        ],
        "functions": [
            ("listOrders", 4, 11, ["db", "user"], False, None),
        ],
    },
    {  # JS/TS template 1
        "findings": [
            (2, None, "hardcoded-secret", False, "{SECRET}"),
            (6, "render", "insecure-random-token", False, None),
            (7, "render", "weak-crypto-hash", False, None),
            (8, "render", "xss-innerhtml-assignment", False, None),
        ],
        "functions": [
            ("render", 5, 11, ["el", "html"], False, None),
        ],
    },
    {  # JS/TS template 2
        "findings": [
            (3, None, "insecure-cors-wildcard", False, None),
            (5, "<anonymous>", "insecure-cors-wildcard", False, None),
            (6, "<anonymous>", "cookie-missing-secure-flag", False, None),
            (8, "<anonymous>", "cookie-missing-secure-flag", False, None),
            (9, "<anonymous>", "jwt-none-algorithm", False, None),
            (9, "<anonymous>", "jwt-none-algorithm", False, None),
            (10, "<anonymous>", "dangerous-eval-exec", False, None),
            (12, "<anonymous>", "dangerous-eval-exec", False, None),
        ],
    },
    {  # JS/TS template 3
        "findings": [
            (2, "runSql", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("runSql", 1),
        ],
        "seeds": [
            ("runSql", "stmt"),
        ],
        "functions": [
            ("runSql", 1, 3, ["db", "stmt"], False, None),
            ("search", 5, 7, ["db", "term"], False, None),
            ("fixed", 9, 11, ["db"], False, None),
        ],
    },
    {  # JS/TS template 4
        "findings": [
            (4, "load", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("load", 1, 11, ["db", "id"], False, None),
        ],
    },
    {  # JS/TS template 5
        "findings": [
            (6, "remove", "path-traversal-fs", True, None),
        ],
        "calls": [
            ("middle", 0),
            ("remove", 0),
        ],
        "seeds": [
            ("middle", "stmt"),
            ("remove", "path"),
        ],
        "functions": [
            ("find", 2, 4, ["stmt"], True, "Repo"),
            ("remove", 5, 7, ["path"], True, "Repo"),
            ("find", 10, 12, ["stmt"], False, None),
            ("middle", 14, 16, ["stmt"], False, None),
            ("top", 18, 21, ["user"], False, None),
            ("remove", 23, 25, ["path"], False, None),
        ],
        "classes": [
            ("Repo", 1, 8, ["find", "remove"]),
        ],
    },
    {  # JS/TS template 6
        "functions": [
            ("safe", 3, 14, ["db", "re", "id", "res"], False, None),
        ],
    },
    {  # JS/TS template 7
        "findings": [
            (13, "byName", "sql-injection-string-build", False, None),
            (18, "hash", "weak-crypto-hash", False, None),
        ],
        "functions": [
            ("constructor", 9, 9, ["db"], True, "UserService"),
            ("byName", 11, 14, ["name", "limit"], True, "UserService"),
            ("hash", 17, 19, ["input"], False, None),
        ],
        "classes": [
            ("UserService", 6, 15, ["constructor", "byName"]),
        ],
    },
    {  # JS/TS template 8
        "findings": [
            (4, "<anonymous>", "command-injection-js-exec", False, None),
            (5, "<anonymous>", "command-injection-js-exec", False, None),
            (7, "<anonymous>", "path-traversal-fs", False, None),
        ],
    },
    {  # JS/TS template 9
        "error": "syntax error: brackets do not match",
    },
    {  # JS/TS template 10
        "findings": [
            (13, "caller", "weak-crypto-hash", False, None),
            (8, "send", "sql-injection-string-build", True, None),
        ],
        "calls": [
            ("send", 1),
        ],
        "seeds": [
            ("send", "stmt"),
        ],
        "functions": [
            ("send", 7, 9, ["db", "stmt"], False, None),
            ("caller", 11, 14, ["db", "v"], False, None),
        ],
    },
    {  # JS/TS template 11
        "findings": [
            (3, "module.exports.handler", "command-injection-js-exec", False, None),
            (8, None, "hardcoded-secret", False, "{SECRET}"),
            (9, None, "xss-innerhtml-assignment", False, None),
        ],
    },
    {  # JS/TS template 12
        "findings": [
            (10, "Search", "sql-injection-string-build", False, None),
            (11, "<anonymous>", "xss-innerhtml-assignment", False, None),
        ],
        "functions": [
            ("View", 3, 7, ["{ rows, html }"], False, None),
            ("Search", 9, 12, ["db", "term"], False, None),
        ],
    },
    {  # JS/TS template 13
        "findings": [
            (5, "load", "command-injection-js-exec", False, None),
            (10, "save", "path-traversal-fs", False, None),
        ],
        "functions": [
            ("load", 3, 7, ["m", "{ a, b }", "[c]", "...rest"], False, None),
            ("save", 10, 10, ["path"], True, "Box"),
        ],
        "classes": [
            ("Box", 9, 11, ["save"]),
        ],
    },
    {  # JS/TS template 14
        "calls": [
            ("run", 1),
        ],
        "seeds": [
            ("run", "stmt"),
        ],
        "functions": [
            ("run", 2, 4, ["db", "stmt"], False, None),
            ("outer", 5, 8, ["db", "v"], False, None),
            ("strip", 9, 9, [], False, None),
        ],
    },
    {  # JS/TS template 15
        "findings": [
            (4, "page", "dangerous-eval-exec", False, None),
            (6, "<anonymous>", "xss-innerhtml-assignment", False, None),
            (7, "<anonymous>", "dangerous-eval-exec", False, None),
            (9, "page", "command-injection-js-exec", False, None),
            (10, "page", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("page", 3, 12, ["db", "items", "u"], False, None),
            ("after", 14, 14, ["a"], False, None),
        ],
    },
    {  # JS/TS template 16
        "findings": [
            (4, "<anonymous>", "dangerous-eval-exec", False, None),
            (5, "<anonymous>", "dangerous-eval-exec", False, None),
            (12, "Note", "command-injection-js-exec", False, None),
            (15, "Last", "sql-injection-string-build", False, None),
        ],
        "functions": [
            ("List", 3, 9, ["{ rows, html }"], False, None),
            ("Note", 11, 13, ["{ text }"], False, None),
            ("Last", 15, 15, ["db", "v"], False, None),
        ],
    },
)
