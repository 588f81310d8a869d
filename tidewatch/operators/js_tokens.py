"""JavaScript / TypeScript token table: lexing in one pass per file, bracket
structure as Spark windows.

A file is cut into tokens by a regular expression per mode inside the row
(``mapInArrow``); a stack of modes tells code from template text, tags and JSX text.  Whether a slash divides or starts a regular expression literal
depends on the token before it, and after ``)`` or ``}`` on what opened that
bracket.  Windows per file give lines and bracket depth; windows per
(file, depth) match brackets; windows per (file, enclosing bracket) split what
one pair of brackets holds into segments (at ``, ; = => : ?`` and line ends
that end a statement), items (at commas) and chains (``a.b(c).d``).

Nothing here can fail on a file: text that does not lex well yields
odd tokens around that spot and the other facts of the file stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import ship_package

FILE = ["repo", "path"]
JS_LANGUAGES = ("JavaScript", "TypeScript")

_TRIVIA = r"(?P<space>[ \t\n\x0b\x0c\r]++)|(?P<comment>//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)|\A#![^\n]*+)"
_TOKEN = re.compile("|".join((
    _TRIVIA,
    r'(?P<str>"(?:[^"\\\n]++|\\[\s\S])*+"?' + r"|'(?:[^'\\\n]++|\\[\s\S])*+'?)", r"(?P<tmpl>`)",
    r"(?P<ident>(?:[^\W\d]|[$#@])[\w$]*+)", r"(?P<num>[0-9][0-9A-Za-z_.]*+)",
    r"(?P<punct>=>|\?\.(?![0-9])|\.\.\.|[=!]==?|<=|>=|&&=?|\|\|=?|\?\?=?|\+\+|--|\*\*=?|[-+*/%&|^]=|<<=?|>>>?=?|[\s\S])",
)))
# Line comments after the first one, with the white space before each, but for what stands after the last.
_COMMENTS = re.compile(r"(?:[ \t\n\x0b\x0c\r]++//[^\n]*+)++(?=\n)")
_COMMENT = re.compile(r"//[^\n]*+")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+")
# Text of a template up to its end or its next substitution.
_PIECE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\\\Z)*+")
# The start of an element: a name or nothing, and no type parameters.
_ELEMENT = re.compile(r"<((?:[^\W\d]|\$)[\w$.:-]*+)?+(?=[\s/>])(?!\s*+,|\s++extends\s)")
_IN_TAG = re.compile(r"""(?P<space>[ \t\n\x0b\x0c\r]++)|(?P<comment>/\*[\s\S]*?(?:\*/|\Z))|(?P<piece>"[^"]*+"?|'[^']*+'?|[\w$.:-]++)|(?P<shut>/>)|(?P<sign>[\s\S])""")
_JSX_TEXT = re.compile(r"[^<{]++")
_END_TAG = re.compile(r"</[\s\w$.:-]*+>?")
JSX_FILES = (".js", ".jsx", ".tsx")
DECLARES = ("const", "let", "var")
BATCH = 50_000  # tokens that leave a task at a time
PIECE_MARK, MARKED = "`", ("piece", "jopen", "jclose")
SEPARATORS = (",", ";", "=", "=>", ":", "?")
# Words before a bracket that make it something else than a call.
NOT_CALLED = tuple(("if for while switch catch function return typeof await new delete void in of instanceof case do else yield throw with "
                    "async const let var import export extends").split())
# Words that cannot end an operand, or that go on with the line before.
OPERATOR_WORDS = tuple("return typeof await new delete void in of instanceof case do else yield throw as satisfies extends implements".split())
# Words whose brackets are the header of a statement; words, besides the operator words, that a literal may follow.
HEADS = frozenset(("if", "while", "for", "with"))
_BEFORE_LITERAL = frozenset(OPERATOR_WORDS) | {"default"}
# Words and signs that a block follows, and signs that end an operand or that no literal follows (``<`` and ``>`` also end JSX tags).
_BEFORE_BLOCK = frozenset(("", ")", ";", "{", "=>", "else", "do", "try", "finally"))
_NO_LITERAL = frozenset((")", "]", "++", "--", ".", "?.", "<", ">"))
GOES_ON = tuple("in of instanceof as satisfies else catch finally".split())


def _operand_end(kind: Column, text: Column) -> Column:
    word = (kind == "ident") & ~text.isin(*OPERATOR_WORDS)
    return word | kind.isin("str", "tmpl", "num", "regex", "tclose", "jclose") | text.isin(")", "]", "}")


def run_length(run: str) -> int:
    """Tokens that a ``run`` of ``lex`` stands for: white space and a comment in turn."""
    return 2 * len(_COMMENT.findall(run))


def lex(content: str, jsx: bool = True, runs: bool = False) -> Iterator[tuple[str, str]]:
    """(token, kind) of a file, white space and comments included; the tokens joined are the file.

    A stack of modes tells code from template text and, where ``jsx`` allows it, from the inside of tags and
    the text between them.  A template with substitutions is a pair of brackets (kinds ``topen`` and
    ``tclose``) around text pieces and ``${ }`` pairs, an element a pair (``jopen``, ``jclose``) around pieces,
    ``{ }`` pairs and elements; what stands in the brackets is code like any other.  With ``runs``, line comments
    after a line comment come as one token (kind ``run``) with the white space between them."""
    at, size = 0, len(content)
    kind = text = before = ""  # the last token that is no white space or comment, and the one before
    literal = True  # a regular expression literal, or an element, may follow
    parens: list[bool] = []  # open round brackets: the header of a statement
    modes: list[str] = []  # open curly brackets: "block", "value", "either", "${", "{x"; and "`", "<name", ">name"
    last, line_end = "", False  # the curly bracket closed last; a line end since the last token
    ends: dict[str, int] = {}  # place of the last end tag of a name

    def closes(name: str) -> bool:
        if name not in ends:
            ends[name] = content.rfind("</" + name)
        return ends[name] >= at

    while at < size:
        mode = modes[-1][0] if modes else ""
        if mode == "`":
            piece = _PIECE.match(content, at)[0]
            at += len(piece)
            if content.startswith("${", at):
                if piece:
                    yield piece, "piece"
                yield "${", "punct"
                modes.append("${")
                at += 2
                before, kind, text, literal, line_end = text, "punct", "${", True, False
            else:
                yield (piece + content[at:at + 1], "tclose" if at < size else "piece")
                at += 1
                modes.pop()
                before, kind, text, literal, line_end = text, "tclose", "`", False, False
            continue
        if mode in ("<", ">"):
            at, new = yield from _element(content, at, modes, closes)
            if new:  # an element ended, or code begins in a curly bracket
                before, (kind, text, literal), line_end = text, new, False
            continue
        if content[at] == "<" and literal and jsx and (m := _ELEMENT.match(content, at)):
            yield m[0], "jopen"
            at = m.end()
            modes.append("<" + (m[1] or ""))
            continue
        m = None
        if content[at] == "/" and (literal or (text == "}" and last == "either" and line_end)):
            m = _REGEX.match(content, at)
            # After a curly bracket, ends of JSX tags are no literal.
            if m and text == "}" and (content[at + 1] == ">" or "</" in m[0]):
                m = None
        new = "regex" if m else ""
        if not m:
            m = _TOKEN.match(content, at)
            new = m.lastgroup
        token, at = m[0], m.end()
        if new == "tmpl":
            token += _PIECE.match(content, at)[0]
            at += len(token) - 1
            if content.startswith("${", at):
                yield token, "topen"
                modes.append("`")
                yield "${", "punct"
                modes.append("${")
                at += 2
                before, kind, text, literal, line_end = text, "punct", "${", True, False
                continue
            token += content[at:at + 1]
            at += 1
        if new in ("space", "comment") or (new == "punct" and (token.isspace() or token == "﻿")):
            yield token, "comment" if new == "comment" else "space"
            line_end = line_end or "\n" in token
            if runs and new == "comment" and token.startswith("//") and (m := _COMMENTS.match(content, at)):
                yield m[0], "run"
                at, line_end = m.end(), True
            continue
        yield token, new
        if new == "punct":
            may = token not in _NO_LITERAL
            if token == "(":
                parens.append((text in HEADS and before not in (".", "?.")) or (text == "await" and before == "for"))
            elif token == ")":
                may = bool(parens and parens.pop())
            elif token == "{":
                modes.append(_brace(kind, text, last, modes))
            elif token == "}":
                last = modes.pop() if modes else "block"
                may = last == "block"
            elif token == "!":
                may = literal or line_end  # else a postfix: x! / 2
        else:
            may = new == "ident" and token in _BEFORE_LITERAL and text not in (".", "?.")
        before, kind, text, literal, line_end = text, new, token, may, False


def _element(content: str, at: int, modes: list[str], closes):
    """One step inside an element's tag (mode ``<name``) or the text after it (``>name``): yields tokens,
    returns the place after them and, where code goes on there, what stands before it."""
    if modes[-1][0] == ">":
        if m := _JSX_TEXT.match(content, at):
            yield m[0], "piece"
            return m.end(), None
        if m := _END_TAG.match(content, at):
            modes.pop()
            yield m[0], "jclose"
            return m.end(), ("jclose", ">", False)
    else:
        m = _IN_TAG.match(content, at)
        if m.lastgroup == "shut":
            modes.pop()
            yield m[0], "jclose"
            return m.end(), ("jclose", ">", False)
        if m.lastgroup != "sign":
            yield m[0], m.lastgroup
            return m.end(), None
        if m[0] == ">":
            if closes(modes[-1][1:]):
                modes[-1] = ">" + modes[-1][1:]
                yield ">", "piece"
                return m.end(), None
            modes.pop()  # no end tag: a type in angle brackets, or a tag that is never closed
            yield ">", "jclose"
            return m.end(), ("jclose", ">", True)
    if content[at] == "{":
        modes.append("{x")
        yield "{", "punct"
        return at + 1, ("punct", "{", True)
    if content[at] == "<" and (m := _ELEMENT.match(content, at)):
        modes.append("<" + (m[1] or ""))
        yield m[0], "jopen"
        return m.end(), None
    yield content[at], "piece"
    return at + 1, None


def _brace(kind: str, text: str, last: str, modes: list[str]) -> str:
    """What a curly bracket after this token opens; "either" where names and tags come before it."""
    if text == "}":
        return last if last in ("block", "value", "either") else "block"
    if text in _BEFORE_BLOCK:
        return "block"
    if text == ":":
        return "value" if modes and modes[-1] == "value" else "either"
    if kind == "punct" and text not in (">", "]"):
        return "value"
    return "value" if kind == "ident" and text in _BEFORE_LITERAL else "either"


def _lex_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from tidewatch.operators.windows import masked
    for b in batches:
        for row in range(b.num_rows):
            content, jsx = b.column("content")[row].as_py(), b.column("path")[row].as_py().endswith(JSX_FILES)
            rows, first = [], 1
            text = (content or b"").decode("utf-8", "replace")
            for token in masked(lex(text, jsx), text):
                rows.append(token)
                if len(rows) == BATCH:
                    yield _token_batch(b, row, first, rows)
                    rows, first = [], first + BATCH
            if rows:
                yield _token_batch(b, row, first, rows)


def _token_batch(b: pa.RecordBatch, row: int, first: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    keys = [b.column(x).take(pa.array([row] * len(rows), pa.int32())) for x in FILE]
    # Pieces and tags are marked, so that their text is never taken for a word or a sign of the code.
    text = pa.array([PIECE_MARK + t if k in MARKED else t for t, k in rows], pa.string())
    return pa.RecordBatch.from_arrays([*keys, pa.array(range(first, first + len(rows)), pa.int32()), text, pa.array([k for _, k in rows], pa.string())],
                                      names=[*FILE, "i", "text", "kind"])


def raw_tokens(sources: DataFrame) -> DataFrame:
    """repo, path, i (1-based), text, kind, line, depth, nth (number among the tokens of code), gap (white space before), white space and comments included.

    This is the only shuffle by file: the windows of ``tokens`` are partitioned by
    (repo, path) and more, which this partitioning already satisfies."""
    ship_package(sources.sparkSession)
    src = sources.filter(F.col("language").isin(*JS_LANGUAGES)).select(*FILE, F.col("content").cast("binary").alias("content"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:len(FILE)])
    t = src.mapInArrow(_lex_files, f"{keys}, i int, text string, kind string")
    opens = F.col("text").isin("(", "[", "{", "${") | F.col("kind").isin("topen", "jopen")
    closes = F.col("text").isin(")", "]", "}") | F.col("kind").isin("tclose", "jclose")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    w = Window.partitionBy(*FILE).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("kind").over(w)
    code = (~F.col("kind").isin("space", "comment")).cast("int")
    return t.withColumns({
        "line": (F.lit(1) + F.sum(newlines).over(upto) - newlines).cast("int"),
        "depth": F.sum(step).over(upto).cast("int"),
        "level": F.sum(step).over(upto).cast("int") - F.when(opens, 1).otherwise(0),
        "opens": opens, "closes": closes, "nth": F.sum(code).over(upto).cast("int"),
        "gap": F.when(F.lag("kind").over(w) == "space", F.lag("text").over(w)).otherwise(F.lit("")),
        "before_comment": (after == "comment") | ((after == "space") & (F.lead("kind", 2).over(w) == "comment"))})


def tokens(raw: DataFrame) -> DataFrame:
    """Tokens without white space and comments, with ``par`` (enclosing bracket,
    0 at module level), ``mate`` (matching bracket), neighbours and segments."""
    t = raw.filter(~F.col("kind").isin("space", "comment"))
    # Brackets at one depth: an opening bracket also stands as a mark at the depth it opens.
    t = t.withColumn("mark", F.explode(F.when(F.col("opens"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    t = t.withColumn("level", F.col("level") + F.col("mark"))
    at = Window.partitionBy(*FILE, "level")
    asc = at.orderBy("i", "mark").rowsBetween(Window.unboundedPreceding, 0)
    desc = at.orderBy(F.col("i").desc(), F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("mark") == 0
    t = (t.withColumns({
            "par": F.coalesce(F.last(F.when(F.col("mark") == 1, F.col("i")), True).over(asc), F.lit(0)),
            "opened": F.last(F.when(F.col("opens") & own, F.col("i")), True).over(asc),
            "closed": F.last(F.when(F.col("closes"), F.col("i")), True).over(desc)})
          .filter(own).withColumn("mate", F.when(F.col("opens"), F.col("closed")).when(F.col("closes"), F.col("opened")))
          .drop("mark", "opened", "closed"))
    w = Window.partitionBy(*FILE, "par").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    beside = {f"p{k}": F.lag("text", k).over(w) for k in (1, 2, 3, 4)} | {f"n{k}": F.lead("text", k).over(w) for k in (1, 2, 3)}
    t = t.withColumns(beside | {
        "pk1": F.lag("kind").over(w), "pi1": F.lag("i").over(w), "pmate": F.lag("mate").over(w), "pi4": F.lag("i", 4).over(w),
        "nk1": F.lead("kind").over(w), "pline": F.lag("line").over(w), "rn": F.row_number().over(w)})
    sep = F.col("text").isin(*SEPARATORS)
    starts = (F.col("kind").isin("ident", "str", "num", "tmpl") | F.col("text").isin("{", "}")) & ~F.col("text").isin(*GOES_ON) & (F.col("kind") != "tmpl")
    line_end = (F.col("line") > F.col("pline")) & _operand_end(F.col("pk1"), F.col("p1")) & starts
    t = t.withColumns({"sep": sep, "ends": F.coalesce(line_end, F.lit(False))})
    cut = F.col("sep") | F.col("ends")
    t = t.withColumns({
        "seg": F.sum(cut.cast("int")).over(upto), "item": F.sum((F.col("text") == ",").cast("int")).over(upto),
        "stmt": F.sum(((F.col("text") == ";") | F.col("ends")).cast("int")).over(upto),
        "k": F.col("rn") - F.coalesce(F.last(F.when(cut, F.col("rn") - F.col("ends").cast("int")), True).over(upto), F.lit(0))})
    # Chains: names, dots and the brackets applied to them.
    applied = F.col("text").isin("(", "[") & _operand_end(F.col("pk1"), F.col("p1")) & ~F.col("ends") & ~(
        F.col("p1").isin(*NOT_CALLED) & ~F.coalesce(F.col("p2").isin(".", "?."), F.lit(False)))
    goes_on = F.col("text").isin(".", "?.", ")", "]") | F.col("kind").isin("tclose", "jclose") | F.col("p1").isin(".", "?.") | applied
    head = ~F.coalesce(goes_on, F.lit(False))
    link = F.col("text").isin("(", "[").cast("int")
    t = t.withColumns({"head": head, "links": F.sum(link).over(upto) - link})
    first = lambda c: F.last(F.when(F.col("head"), F.struct(F.col(c).alias("v"))), True).over(upto)["v"]
    t = t.withColumns({"chain_text": first("text"), "chain_kind": first("kind"), "chain_line": first("line"),
                       "chain_before": first("p1"), "chain_links": F.col("links") - first("links")})
    # The last token of an expression that starts here, and the next body or semicolon.
    down = Window.partitionBy(*FILE, "par").orderBy(F.col("i").desc())
    later = down.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "stop": F.last(F.when(F.col("text").isin(",", ";") | F.col("ends"), F.col("pi1")), True).over(later),
        "last_i": F.max("i").over(Window.partitionBy(*FILE, "par")),
        "body": F.last(F.when(F.col("text").isin("{", ";"), F.struct("text", "i", "mate")), True).over(later),
        "paren": F.last(F.when(F.col("text") == "(", F.struct("i", "mate")), True).over(later),
        # A return type before an arrow: ``): T =>``.
        "typed": F.last(F.when(F.col("sep"), F.struct((F.when((F.col("text") == ":") & (F.col("p1") == ")"), F.col("pmate"))).alias("v"))), True).over(before)["v"]})
    return t.drop("rn", "links", "level", "opens", "closes")


def segments(t: DataFrame) -> DataFrame:
    """One row per segment: opener, next opener, first tokens and the kind of its expression."""
    c = ~F.col("sep")
    k = F.col("k")
    text = F.col("text")
    binary = _operand_end(F.col("pk1"), F.col("p1"))
    op = (F.col("kind") == "punct") & ~text.isin(".", "?.", "(", ")", "[", "]", "{", "}", "${")
    low = text.isin("===", "==", "!==", "!=", "<", ">", "<=", ">=", "&&", "||", "??", "&", "|", "^", "<<", ">>", ">>>") | (
        (F.col("kind") == "ident") & text.isin("instanceof", "in", "as", "satisfies", "yield"))
    add = text.isin("+", "-") & binary & (k > 1)
    at = lambda n, what: F.max(F.when(c & (k == n), F.col(what)))
    s = t.groupBy(*FILE, "par", "seg").agg(
        F.max(F.when(F.col("sep"), text).when(F.col("ends"), F.lit("\n"))).alias("opener"), F.min("item").alias("item"), F.min("stmt").alias("stmt"),
        F.count(F.when(c, 1)).alias("n"), F.min(F.when(c, F.col("i"))).alias("i"), F.min("line").alias("sep_line"), at(1, "line").alias("line"),
        *[at(j, "text").alias(f"t{j}") for j in (1, 2, 3, 4)], at(1, "kind").alias("k1"),
        F.max(F.when(c, F.struct("i", "text", "kind", "line"))).alias("end"),
        F.max(F.when(c & (F.col("kind") == "ident"), F.struct("i", "text", "line"))).alias("last_name"),
        F.max(F.when(add, F.struct("i", "text")))["text"].alias("add"), F.coalesce(F.bool_or(c & low), F.lit(False)).alias("low"),
        F.coalesce(F.bool_or(c & op), F.lit(False)).alias("op"), F.count(F.when(F.col("head") & c, 1)).alias("chains"),
        F.coalesce(F.bool_or(text == "class"), F.lit(False)).alias("has_class"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c & (k <= 16), F.struct("i", "text")))), lambda x: x["text"]), "").alias("joined"))
    w = Window.partitionBy(*FILE, "par").orderBy("seg")
    s = s.withColumn("next", F.lead("opener").over(w))
    for back, name in ((1, "b1"), (2, "b2")):
        s = s.withColumn(name, F.lag(F.struct("opener", "n", "t1", "t2", "k1", "i", "line", "joined", "last_name", "chains", "op", "end", "item")
                                     , back).over(w))
    whole = F.coalesce(F.col("next").isin(",", ";", "\n"), F.lit(True))
    inner = F.regexp_replace(F.regexp_extract("t1", r"^['\"`]([^\\]*)", 1), r"['\"`]$", "")
    plain_chain = (F.col("chains") == 1) & ~F.col("op")
    kind = (F.when(F.col("n") == 0, "none").when(~whole, "other")
            .when((F.col("n") == 1) & (F.col("k1") == "str"), "str_literal")
            .when((F.col("n") == 1) & (F.col("k1") == "tmpl"), "template_plain")
            .when((F.col("n") == 2) & (F.col("k1") == "topen"), "dynamic")
            .when((F.col("n") == 1) & ((F.col("k1") == "num") | F.col("t1").isin("true", "false", "null", "undefined")), "other_literal")
            .when((F.col("n") == 1) & (F.col("k1") == "ident"), "ident")
            .when((F.col("add") == "+") & ~F.col("low"), "dynamic")
            .when((F.col("n") == 2) & (F.col("t1") == "{"), "object").when((F.col("n") == 2) & (F.col("t1") == "["), "array")
            .when(plain_chain & (F.col("k1") == "ident") & (F.col("end.kind") == "ident") & F.col("t2").isin(".", "?."), "attr")
            .when(plain_chain & (F.col("k1") == "ident") & (F.col("end.text") == ")"), "call")
            .otherwise("other"))
    s = s.withColumn("kind", kind)
    return s.withColumn("value", F.struct(
        "kind", F.when(F.col("kind") == "str_literal", inner).when(F.col("kind") == "other_literal", F.col("t1")).alias("literal"),
        F.when(F.col("kind") == "ident", F.col("t1")).alias("ident"), F.when(F.col("kind") == "attr", F.col("end.text")).alias("attr")))
