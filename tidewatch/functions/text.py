"""Column expressions over source text: lines, line counts, snippets, redaction.

All JVM-side (split, slice, array_join, substring, replace), so they stay in
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line terminators of Python's str.splitlines()
# (\r\n, \n, \r, \v, \f, \x1c, \x1d, \x1e, \x85, U+2028, U+2029).
LINE_BREAK = "\r\n|[\n\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029]"

# Fixed value: the secret-looking name alternatives (searched anywhere in a name,
# ignoring case with Unicode case folding).
SECRET_WORDS = ("password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|"
                "private[_-]?key|token")
SECRET_NAME_RE = f"(?iu)({SECRET_WORDS})"

SNIPPET_BEFORE = 1      # lines shown above the flagged line
SNIPPET_AFTER = 5       # lines shown below it
SNIPPET_MAX_CHARS = 600
REDACTED = "<redacted>"


def split_lines(content: Column) -> Column:
    """Split on every splitlines() terminator; keeps a trailing empty piece."""
    return F.split(content, LINE_BREAK, -1)


def loc_from_lines(lines: Column) -> Column:
    """len(text.splitlines()) from the split array (drops the trailing empty piece)."""
    return F.size(lines) - F.when(F.element_at(lines, -1) == F.lit(""), 1).otherwise(0)


def snippet(lines: Column, loc: Column, line: Column) -> Column:
    """Lines max(1,l-1)..min(loc,l+5) joined by newline, cut to 600 code points."""
    start = F.greatest(F.lit(1), line - SNIPPET_BEFORE)
    end = F.least(loc, line + SNIPPET_AFTER)
    window = F.slice(lines, start, F.greatest(F.lit(0), end - start + 1))
    return F.substring(F.array_join(window, "\n"), 1, SNIPPET_MAX_CHARS)


def redact(snip: Column, literal: Column) -> Column:
    """Replace every occurrence of the literal (as text, not a pattern)."""
    return F.when(literal.isNull() | (literal == F.lit("")), snip).otherwise(
        F.replace(snip, literal, F.lit(REDACTED)))
