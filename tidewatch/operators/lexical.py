"""Lexical tier (RL): hard-coded secrets found in any text column, no parser.

A finding is every ``<name> = "<literal of 4+ characters>"`` (or single quotes)
where the name is a run of word characters containing one of the secret-looking
words.  This is the line-oriented form of the assignment rule for Python and
JS/TS and works on documents, pages, conversations or raw source files.

Plan shape: one narrow stage.  Each file row is split into lines, the matching
lines and their snippets are computed inside the row (``filter``/``transform``
over the lines array), and only the few hits are exploded.  No shuffle, no
re-join to the content; the 19-row rule dimension is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import SECRET_WORDS, redact, snippet, split_lines, loc_from_lines
from tidewatch.operators.findings import attach_metadata

NAME_CHARS = "[A-Za-z0-9_]*"
# Group 1: the name, group 2: the quoted literal.  (?iu: ...) = ignore case with
# Unicode case folding, the behaviour of a Python re.IGNORECASE str pattern.
SECRET_ASSIGN_RE = (f"({NAME_CHARS}(?iu:{SECRET_WORDS}){NAME_CHARS})[ \\t]*=[ \\t]*"
                    "(\"[^\"]{4,}\"|'[^']{4,}')")

# Same matches, faster: a leftmost match can only start where no word character
# precedes (else starting one character earlier would also match), so the
# look-behind only skips start positions that cannot be leftmost.  (RE2, used
# by the oracle, has no look-behind; the oracle keeps the plain pattern.)
SECRET_ASSIGN_FAST_RE = "(?<![A-Za-z0-9_])" + SECRET_ASSIGN_RE
# Necessary for any match: a secret word somewhere in the text.
SECRET_WORD_RE = f"(?iu)({SECRET_WORDS})"
# The same test on the lower-cased text with a case-sensitive regex (much
# faster than case folding in the regex).  It is exact because the only
# non-ASCII characters that case-fold to ASCII letters are dotted capital I,
# dotless i, long s and the Kelvin sign; a text holding one of them takes the
# case-folding regex instead.
SECRET_WORDS_LOWER_RE = "p(?:assword|asswd|wd)|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
FOLDING_CHARS = ("\u0130", "\u0131", "\u017f", "\u212a")


def may_hold_secret(content):
    """Cheap superset test of 'some line matches the assignment pattern'."""
    words = F.lower(content).rlike(SECRET_WORDS_LOWER_RE)
    has_folding = F.lit(False)
    for ch in FOLDING_CHARS:
        has_folding = has_folding | (F.instr(content, ch) > 0)
    folded = has_folding & content.rlike(SECRET_WORD_RE)
    return (F.instr(content, "=") > 0) & (words | folded)


ORD_LINE_STRIDE = 1 << 20   # ord = line * stride + match index in the line


def secret_candidates(sources: DataFrame) -> DataFrame:
    """Candidates (before rule metadata) with the literal already redacted."""
    pat = F.lit(SECRET_ASSIGN_FAST_RE)
    # Cheap document-level test first: most files never get split into lines.
    maybe = sources.filter(may_hold_secret(F.col("content")))
    base = (maybe.select("repo", "path", split_lines(F.col("content")).alias("lines"))
            .withColumn("loc", loc_from_lines(F.col("lines"))))
    hits = F.filter(
        F.transform(F.col("lines"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))),
        lambda h: (F.instr(h["text"], "=") > 0) & h["text"].rlike(SECRET_ASSIGN_FAST_RE),
    )
    hits = F.transform(hits, lambda h: F.struct(
        h["line"].alias("line"),
        F.arrays_zip(F.regexp_extract_all(h["text"], pat, 1).alias("name"),
                     F.regexp_extract_all(h["text"], pat, 2).alias("quoted")).alias("matches"),
        snippet(F.col("lines"), F.col("loc"), h["line"]).alias("snippet"),
    ))
    per_line = base.select("repo", "path", F.explode(hits).alias("h"))
    per_match = per_line.select(
        "repo", "path", F.col("h.line").alias("line"), F.col("h.snippet").alias("raw_snippet"),
        F.posexplode("h.matches").alias("k", "m"))
    quoted = F.col("m.quoted")
    literal = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return per_match.select(
        "repo",
        F.col("path").alias("file"),
        F.col("line").cast("int").alias("line"),
        F.lit(None).cast("string").alias("function"),
        F.lit("hardcoded-secret").alias("rule_id"),
        redact(F.col("raw_snippet"), literal).alias("snippet"),
        F.lit(False).alias("via_param"),
        (F.col("line").cast("long") * ORD_LINE_STRIDE + F.col("k")).alias("ord"),
    )


def scan_secrets(sources: DataFrame, disabled: str | Iterable[str] | None = None) -> DataFrame:
    """Lexical hard-coded secret findings for a source table."""
    return attach_metadata(secret_candidates(sources), disabled, only_rule="hardcoded-secret")
