"""DuckDB oracle SQL building blocks.

The oracles are plain SQL over the driver's views; they restate each query's
semantics independently of the Spark code so the driver can compare results.
Regex dialect notes: Spark uses java.util.regex, DuckDB uses RE2.  Patterns
here avoid back-references and use explicit ASCII classes; ``(?iu:...)`` in
Java becomes ``(?i:...)`` in RE2 (both fold case with Unicode rules).
"""

from __future__ import annotations

from tidewatch.catalog import rules_values_sql, sql_quote, CROSS_FUNCTION_NOTE
from tidewatch.operators.lexical import ORD_LINE_STRIDE, SECRET_ASSIGN_RE
from tidewatch.sources.tables import URL_HOST_RE

DUCK_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

RULES = rules_values_sql()
NOTE = sql_quote(CROSS_FUNCTION_NOTE)


def duck_re(java_pattern: str) -> str:
    """Java pattern -> RE2 pattern as a quoted SQL literal."""
    return sql_quote(java_pattern.replace("(?iu:", "(?i:").replace("(?iu)", "(?i)"))


LB = sql_quote(DUCK_LINE_BREAK)
PAT = duck_re(SECRET_ASSIGN_RE)

SRC_DOCUMENTS = """(SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, lang AS language,
        CAST(octet_length(encode(text)) AS BIGINT) AS bytes, text AS content FROM documents)"""
SRC_PAGES = f"""(SELECT regexp_extract(url, {sql_quote(URL_HOST_RE)}, 1) AS repo, CAST(page_id AS VARCHAR) AS path,
        'html' AS language, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, html AS content FROM pages)"""
SRC_CONVERSATIONS = """(SELECT CAST(conv_id AS VARCHAR) AS repo, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path,
        role AS language, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, text AS content FROM conversations)"""
SRC_ALL_TEXT = f"""(SELECT 'documents:' || repo AS repo, path, language, bytes, content FROM {SRC_DOCUMENTS}
  UNION ALL SELECT 'pages:' || repo, path, language, bytes, content FROM {SRC_PAGES}
  UNION ALL SELECT 'conversations:' || repo, path, language, bytes, content FROM {SRC_CONVERSATIONS})"""


def lines_sql(src: str) -> str:
    """(repo, path, language, lines, loc) for a source subquery."""
    return f"""(SELECT repo, path, language, lines,
        len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS loc
      FROM (SELECT repo, path, language, string_split_regex(content, {LB}) AS lines FROM {src}))"""


def snippet_sql(lines: str, loc: str, line: str) -> str:
    return (f"substring(array_to_string(list_slice({lines}, greatest(1, {line} - 1), "
            f"least({loc}, {line} + 5)), chr(10)), 1, 600)")


def rl_findings_sql(src: str) -> str:
    """Lexical hard-coded secret findings (same columns as the Spark findings)."""
    return f"""(WITH g AS {lines_sql(src)},
x AS (SELECT repo, path, lines, loc, unnest(lines) AS text, unnest(generate_series(1, len(lines))) AS line FROM g),
h AS (SELECT * FROM x WHERE regexp_matches(text, {PAT})),
m AS (SELECT repo, path, lines, loc, line,
        unnest(regexp_extract_all(text, {PAT}, 2)) AS quoted,
        unnest(generate_series(0, len(regexp_extract_all(text, {PAT}, 2)) - 1)) AS k
      FROM h),
s AS (SELECT repo, path, line, k, substring(quoted, 2, length(quoted) - 2) AS lit,
        {snippet_sql('lines', 'loc', 'line')} AS raw_snippet FROM m)
SELECT s.repo, s.path AS file, CAST(s.line AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS function,
       r.rule_id, r.title, r.severity, r.cwe, r.owasp,
       CASE WHEN lit IS NULL OR lit = '' THEN raw_snippet ELSE replace(raw_snippet, lit, '<redacted>') END AS snippet,
       r.description, r.remediation, CAST(s.line AS BIGINT) * {ORD_LINE_STRIDE} + k AS ord
FROM s JOIN {RULES} r ON r.rule_id = 'hardcoded-secret')"""
