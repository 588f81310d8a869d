"""Snippets cut where the text lies.

The fact pass has a file's lines at hand, so it also cuts the snippet of every line that a finding can
stand on: lines of calls, assignments, pairs and ``new`` whose names a rule reads.  Such a row is (line, pos, snippet).  ``pos`` is
set for the declaration of a secret only, whose snippet is stored redacted and whose literal is stored as
asterisks of its length.  Candidates then look their snippet up by place, and no text is shuffled.

JavaScript lines follow the chain and segment rules of ``js_tokens``, read in order instead of by window, so
every line a finding may get is among them; some are never asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import REDACTED, SECRET_WORDS, SNIPPET_AFTER, SNIPPET_BEFORE, SNIPPET_MAX_CHARS
from tidewatch.operators import rules_js as rj
from tidewatch.operators import rules_python as rp
from tidewatch.operators.js_tokens import DECLARES, FILE, GOES_ON, JSX_FILES, JS_LANGUAGES, NOT_CALLED, OPERATOR_WORDS, SEPARATORS, lex, run_length

SECRET_NAME = re.compile(SECRET_WORDS, re.IGNORECASE)
SHORT = 3  # a literal of more characters is a secret
# Python calls that a rule reads; some only with keyword arguments.
PY_CALLS = frozenset((*rp.SQL_EXEC, "system", "popen", "load", "loads", "eval", "exec", "md5", "sha1", "open", "set_cookie"))
PY_CALLS_WITH_KEYWORDS = frozenset((*rp.SUBPROCESS_FUNCS, *rp.HTTP_VERBS, "run"))
# JavaScript names that a rule reads; those of header setters only where the header is named.
JS_NAMES = frozenset((*rj.SQL_METHOD_NAMES, *rj.EXEC_METHOD_NAMES, *rj.FS_PATH_FUNCS, "createHash", "verify", "cookie", "eval", "Function", "innerHTML"))
JS_HEADER = "access-control-allow-origin"
JS_WORD = re.compile("|".join(sorted(JS_NAMES)) + f"|origin|{JS_HEADER}|{SECRET_WORDS}", re.IGNORECASE)
JS_SOURCE_LETTERS = re.compile(r"\\u")  # names may be written with escapes


class Snippets:
    """Rows of one file; the file's lines are split once."""

    def __init__(self, content: str, strict: bool):
        self.content, self.strict = content, strict
        self.lines: set[int] = set()
        self.secrets: list[tuple[int, int, str]] = []  # pos, line, literal

    def rows(self) -> Iterator[tuple[int, int | None, str]]:
        if not self.lines and not self.secrets:
            return
        text = self.content.splitlines()
        hidden = [literal for _, _, literal in self.secrets if len(literal) > SHORT] if self.strict else []

        def cut(line: int) -> str:
            out = "\n".join(text[max(0, line - 1 - SNIPPET_BEFORE):line + SNIPPET_AFTER])[:SNIPPET_MAX_CHARS]
            for literal in hidden:
                out = out.replace(literal, REDACTED)
            return out

        for line in sorted(self.lines):
            yield line, None, cut(line)
        for pos, line, literal in self.secrets:
            yield line, pos, cut(line).replace(literal, REDACTED) if literal else cut(line)


def python_secret(targets: list[str | None], value: dict) -> bool:
    return value["kind"] == "str_literal" and any(t and SECRET_NAME.search(t) for t in targets)


def python_snippets(content: str, facts: dict, strict: bool) -> list[dict]:
    """Window rows of a Python file; secret literals in ``facts`` are masked."""
    s = Snippets(content, strict)
    for c in facts["calls"]:
        if c["name"] in PY_CALLS or (c["kwargs"] and c["name"] in PY_CALLS_WITH_KEYWORDS):
            s.lines.add(c["line"])
    for a in facts["assigns"]:
        if python_secret(a["targets"], a["value"]):
            literal = a["value"]["literal"]
            s.secrets.append((a["pos"], a["line"], literal))
            a["value"]["literal"] = "*" * len(literal)
        elif any(t and SECRET_NAME.search(t) for t in a["targets"]):
            s.lines.add(a["line"])
    return [{"line": line, "pos": pos, "snippet": text} for line, pos, text in s.rows()]


class _Level:
    """What the tokens between one pair of brackets have said so far."""
    __slots__ = ("chain", "segment", "text", "kind", "before", "line", "declares", "site", "secret")

    def __init__(self) -> None:
        self.chain = self.segment = self.line = 0
        self.text = self.kind = self.before = ""
        self.declares = self.site = False
        self.secret: tuple[int, int] | None = None  # pos, line of a declared name that is to get a value


class Reader:
    """Reads the tokens of a file in order: lines for findings, declared secrets."""

    def __init__(self, names: frozenset[str], keys: frozenset[str]):
        self.names, self.keys, self.levels = names, keys, [_Level()]
        self.lines: set[int] = set()

    def read(self, token: str, kind: str, line: int, i: int) -> tuple[int, int] | None:
        """Takes the next token of code; (pos, line) of the secret whose string it is."""
        if (token in (")", "]", "}") and kind == "punct") or kind in ("tclose", "jclose"):
            if len(self.levels) > 1:
                self.levels.pop()
        at = self.levels[-1]
        word = kind == "ident"
        ended = (at.kind == "ident" and at.text not in OPERATOR_WORDS) or at.kind in ("str", "tmpl", "num", "regex", "tclose", "jclose") or at.text in (")", "]", "}")
        starts = (kind in ("ident", "str", "num") or (kind == "punct" and token in ("{", "}"))) and token not in GOES_ON
        ends = line > at.line and ended and starts
        found = None
        if kind == "punct" and token in SEPARATORS:
            at.segment = 0
            at.site = False
            if token == ";":
                at.declares = False
            if token != "=" and token != ":":
                at.secret = None
            elif token == ":" and at.secret and at.kind != "ident":
                at.secret = None
        else:
            if ends:
                at.segment, at.declares, at.secret, at.site = 0, False, None, False
            if kind == "str" and at.text == "=" and at.secret:
                found = at.secret
            if at.text == "=":
                at.secret = None
            at.segment = at.segment or line
            applied = kind == "punct" and token in ("(", "[") and ended and not ends and not (at.text in NOT_CALLED and at.before not in (".", "?."))
            if not (kind == "punct" and token in (".", "?.", ")", "]") or kind in ("tclose", "jclose") or at.text in (".", "?.") or applied):
                at.chain = line
            if word:
                if token in DECLARES:
                    at.declares = True
                secret = SECRET_NAME.search(token)
                if secret and at.declares:
                    at.secret = (i, line)
                if secret or token in self.names:
                    at.site = at.site or token in self.names
                    self.lines |= {line, at.chain, at.segment}
            if (word or kind == "str") and token.strip("'\"").lower() in self.keys:
                self.lines.add(line)
            if token == "(" and at.site:
                self.lines |= {line, at.chain}
        at.before, at.text, at.kind, at.line = at.text, token, kind, line
        if (kind == "punct" and token in ("(", "[", "{", "${")) or kind in ("topen", "jopen"):
            self.levels.append(_Level())
        return found


def string_inside(token: str) -> str:
    """A string token's text up to its first escape."""
    return re.sub(r"['\"]$", "", token[1:].split("\\", 1)[0])


def js_snippets(content: str, jsx: bool, strict: bool) -> Iterator[tuple[int, int | None, str]]:
    """Window rows (line, pos, snippet) of a JavaScript or TypeScript file."""
    if not JS_WORD.search(content) and not JS_SOURCE_LETTERS.search(content):
        return
    names = JS_NAMES | frozenset(rj.HEADER_SETTER_NAMES) if JS_HEADER in content.lower() else JS_NAMES
    reader, s, line = Reader(names, frozenset(("origin",))), Snippets(content, strict), 1
    for i, (token, kind) in enumerate(lex(content, jsx), 1):
        if kind not in ("space", "comment"):
            secret = reader.read(token, kind, line, i)
            if secret:
                s.secrets.append((*secret, string_inside(token)))
        line += token.count("\n")
    s.lines = reader.lines - {0}
    yield from s.rows()


def masked(tokens: Iterator[tuple[str, str]], content: str) -> Iterator[tuple[str, str]]:
    """Tokens with the strings of declared secrets as asterisks."""
    if not SECRET_NAME.search(content):
        yield from tokens
        return
    reader, line = Reader(frozenset(), frozenset()), 1
    for i, (token, kind) in enumerate(tokens, 1):
        out = token
        if kind not in ("space", "comment") and reader.read(token, kind, line, i):
            inside = string_inside(token)
            out = token[:1] + "*" * len(inside) + token[1 + len(inside):]
        line += token.count("\n")
        yield out, kind


def js_windows_of(content: str, tokens: list[tuple[str, str]], strict: bool) -> tuple[list[tuple[int, int | None, str]], list[tuple[str, str]]]:
    """What ``js_snippets`` and ``masked`` give for a file that is cut into tokens already, by one reading."""
    if not JS_WORD.search(content) and not JS_SOURCE_LETTERS.search(content):
        return [], tokens
    names = JS_NAMES | frozenset(rj.HEADER_SETTER_NAMES) if JS_HEADER in content.lower() else JS_NAMES
    reader, s, line = Reader(names, frozenset(("origin",))), Snippets(content, strict), 1
    i = 0
    for at, (token, kind) in enumerate(tokens):
        i += run_length(token) if kind == "run" else 1
        if kind not in ("space", "comment", "run") and (secret := reader.read(token, kind, line, i)):
            inside = string_inside(token)
            s.secrets.append((*secret, inside))
            tokens[at] = (token[:1] + "*" * len(inside) + token[1 + len(inside):], kind)
        line += token.count("\n")
    s.lines = reader.lines - {0}
    return list(s.rows()), tokens


def js_windows(sources: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, line, pos, snippet) of all JavaScript and TypeScript files; one narrow pass."""
    src = sources.filter(F.col("language").isin(*JS_LANGUAGES)).select(*FILE, F.col("content").cast("binary").alias("content"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:len(FILE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                content, path = b.column("content")[row].as_py(), b.column("path")[row].as_py()
                found = list(js_snippets((content or b"").decode("utf-8", "replace"), path.endswith(JSX_FILES), strict))
                if found:
                    keyed = [b.column(x).take(pa.array([row] * len(found), pa.int32())) for x in FILE]
                    yield pa.RecordBatch.from_arrays([*keyed, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
                                                      pa.array([f[2] for f in found], pa.string())], names=[*FILE, "line", "pos", "snippet"])

    return src.mapInArrow(run, f"{keys}, line int, pos int, snippet string")
