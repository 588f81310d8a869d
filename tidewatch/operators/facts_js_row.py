"""JavaScript / TypeScript facts of one file in one pass inside the row.

The same facts as those of the token table (``js_tokens``, ``facts_js``): the windows over a file's tokens are loops
over lists here, since a file of usual size lies in the row anyway and its tokens need not be shuffled, sorted and
joined.  Files of more than ``MAX_BYTES`` are only named (kind ``large``); they go through the token
table, which Spark spills.  What a comparison with nothing says follows SQL there: it is never true.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa

from tidewatch.operators.js_tokens import DECLARES, FILE, GOES_ON, JSX_FILES, MARKED, NOT_CALLED, OPERATOR_WORDS, PIECE_MARK, SEPARATORS, lex, run_length

MAX_BYTES = 1 << 19  # fixed value: a longer file goes through the token table
_ENDS = frozenset(("str", "tmpl", "num", "regex", "tclose", "jclose"))
_SEPARATORS, _NOT_CALLED, _OPERATOR_WORDS, _GOES_ON, _DECLARES = map(frozenset, (SEPARATORS, NOT_CALLED, OPERATOR_WORDS, GOES_ON, DECLARES))
_LOW = frozenset(("===", "==", "!==", "!=", "<", ">", "<=", ">=", "&&", "||", "??", "&", "|", "^", "<<", ">>", ">>>"))
_LOW_WORDS = frozenset(("instanceof", "in", "as", "satisfies", "yield"))
_NO_OP = frozenset((".", "?.", "(", ")", "[", "]", "{", "}", "${"))
_WORDS = frozenset(("true", "false", "null", "undefined"))
_DOTS = frozenset((".", "?."))
_STARTS = frozenset(("ident", "str", "num"))
_OPENS, _CLOSES = frozenset(("(", "[", "{", "${")), frozenset((")", "]", "}"))
# As in Java, ``$`` also stands before any line end that is the last character.
_INNER = re.compile(r"^['\"`]([^\\]*)")
_QUOTE_END = re.compile(r"['\"`](?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)")
_ITEM = re.compile(r"^['\"]([^\\]*)")
_ITEM_END = re.compile(r"['\"](?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)")
_QUOTES = str.maketrans("", "", "'\"")
# Kinds of rows that are put together after the pass: functions and inventory without their parameters, parameters, and
# files that are too long for it.
OPEN, PARAM, LARGE = {"function": "js-function", "inventory": "js-inventory"}, "js-param", "js-large"
_ABSENT = {"kind": "none", "literal": None, "ident": None, "attr": None}
_NOTE = {"kind": "comment", "literal": None, "ident": None, "attr": None}


class Token:
    __slots__ = ("i", "text", "kind", "line", "depth", "nth", "gap", "noted", "par", "mate", "at", "group",
                 "end", "sep", "ends", "seg", "item", "stmt", "k", "head", "links", "first")


class Segment:
    __slots__ = ("par", "seg", "opener", "item", "stmt", "words", "n", "i", "line", "t1", "t2", "t3", "k1", "end", "last_name", "add", "low", "op",
                 "chains", "has_class", "next", "b1", "b2", "kind", "value", "place", "group")

    @property
    def joined(self) -> str:
        return "".join(x.text for x in self.words[:16])


class Function:
    __slots__ = ("par", "seg", "k", "line", "start", "own", "args_at", "stop", "form", "segment", "first", "name", "params", "end_line", "left", "bound",
                 "parent_class", "in_top_class", "is_top_level", "is_member", "local_name", "start_line")


def read_tokens(raw: list[tuple[str, str]]) -> list[Token]:
    """Tokens of code with their place, line, depth, enclosing bracket and mate (``raw`` holds white space and comments too)."""
    out: list[Token] = []
    line, depth = 1, 0
    opened: dict[int, int] = {}  # level: the bracket that opened it last
    same: dict[int, Token] = {}  # level: the last opening token on it
    waiting: dict[int, Token] = {}
    size = len(raw)
    i = 0
    for at, (text, kind) in enumerate(raw):
        i += 1
        if kind == "space" or kind == "comment":
            line += text.count("\n")
            continue
        if kind == "run":
            line += text.count("\n")
            i += run_length(text) - 1
            continue
        t = Token()
        t.i, t.kind, t.line, t.nth = i, kind, line, len(out) + 1
        t.gap = raw[at - 1][0] if at and raw[at - 1][1] == "space" else ""
        after = raw[at + 1][1] if at + 1 < size else None
        t.noted = after == "comment" or (after == "space" and at + 2 < size and raw[at + 2][1] == "comment")
        line += text.count("\n")
        if kind in MARKED:
            text = PIECE_MARK + text
        t.text, t.mate = text, None
        if text in _OPENS or kind == "topen" or kind == "jopen":
            t.par = opened.get(depth, 0)
            same[depth] = waiting[depth] = t
            depth += 1
            opened[depth] = t.i
        elif text in _CLOSES or kind == "tclose" or kind == "jclose":
            depth -= 1
            t.par = opened.get(depth, 0)
            if depth in same:
                t.mate = same[depth].i
            if depth in waiting:
                waiting.pop(depth).mate = t.i
        else:
            t.par = opened.get(depth, 0)
        t.depth = depth
        t.end = (kind == "ident" and text not in _OPERATOR_WORDS) or kind in _ENDS or text in _CLOSES
        out.append(t)
    return out


def cut_groups(tokens: list[Token]) -> dict[int, list[Token]]:
    """Tokens by enclosing bracket, with separators, segments, items, statements and chains."""
    groups: dict[int, list[Token]] = {}
    for t in tokens:
        g = groups.get(t.par)
        if g is None:
            g = groups[t.par] = []
        t.at, t.group = len(g), g
        g.append(t)
    for g in groups.values():
        seg = item = stmt = links = base = 0
        head = None
        p1 = p2 = None
        for rn, t in enumerate(g, 1):
            text, kind = t.text, t.kind
            t.sep = text in _SEPARATORS
            t.ends = bool(p1 and t.line > p1.line and p1.end and (kind in _STARTS or text == "{" or text == "}") and text not in _GOES_ON)
            if t.sep or t.ends:
                seg += 1
                base = rn - t.ends
                if text == ",":
                    item += 1
                if text == ";" or t.ends:
                    stmt += 1
            t.seg, t.item, t.stmt, t.k = seg, item, stmt, rn - base
            bracket = text == "(" or text == "["
            goes_on = text in _DOTS or text == ")" or text == "]" or kind == "tclose" or kind == "jclose" or (p1 is not None and (
                p1.text in _DOTS or (bracket and p1.end and not t.ends and not (p1.text in _NOT_CALLED and not (p2 is not None and p2.text in _DOTS)))))
            t.head, t.links = not goes_on, links
            if t.head:
                head = t
            t.first = head
            if bracket:
                links += 1
            p2, p1 = p1, t
    return groups


def back(t: Token, n: int) -> Token | None:
    return t.group[t.at - n] if t.at >= n else None


def ahead(t: Token, n: int) -> Token | None:
    return t.group[t.at + n] if t.at + n < len(t.group) else None


def text_of(t: Token | None) -> str | None:
    return t.text if t is not None else None


def cut_segments(groups: dict[int, list[Token]]) -> dict[int, list[Segment]]:
    """Segments of every bracket in order, with the kind of their expression and their neighbours."""
    out = {}
    for par, g in groups.items():
        parts: list[Segment] = []
        s = None
        for t in g:
            if s is None or t.seg != s.seg:
                s = Segment()
                s.par, s.seg, s.item, s.stmt, s.words, s.place, s.group = par, t.seg, t.item, t.stmt, [], len(parts), parts
                s.opener = t.text if t.sep else "\n" if t.ends else None
                s.add, s.low, s.op, s.chains, s.has_class, s.last_name = None, False, False, 0, False, None
                parts.append(s)
            text, kind = t.text, t.kind
            if text == "class":
                s.has_class = True
            if t.sep:
                continue
            s.words.append(t)
            if kind == "ident":
                s.last_name = t
                if text in _LOW_WORDS:
                    s.low = True
            elif kind == "punct":
                if text not in _NO_OP:
                    s.op = True
                if text in _LOW:
                    s.low = True
                elif (text == "+" or text == "-") and t.k > 1 and t.at and g[t.at - 1].end:
                    s.add = text
            if t.head:
                s.chains += 1
        for n, s in enumerate(parts):
            w = s.words
            s.n = len(w)
            s.next = parts[n + 1].opener if n + 1 < len(parts) else None
            s.b1 = parts[n - 1] if n else None
            s.b2 = parts[n - 2] if n > 1 else None
            first = w[0] if w else None
            s.i, s.line, s.t1, s.k1 = (first.i, first.line, first.text, first.kind) if first else (None, None, None, None)
            s.t2 = w[1].text if s.n > 1 else None
            s.t3 = w[2].text if s.n > 2 else None
            s.end = w[-1] if w else None
            s.kind = _kind(s)
            literal = inner(s.t1, _INNER, _QUOTE_END) if s.kind == "str_literal" else s.t1 if s.kind == "other_literal" else None
            s.value = {"kind": s.kind, "literal": literal, "ident": s.t1 if s.kind == "ident" else None, "attr": s.end.text if s.kind == "attr" else None}
        out[par] = parts
    return out


def inner(text: str, start: re.Pattern, end: re.Pattern) -> str:
    m = start.match(text)
    return end.sub("", m[1]) if m else ""


def _letter(text: str) -> bool:
    return text[:1] in ("_", "$") or unicodedata.category(text[0]).startswith("L")


def _kind(s: Segment) -> str:
    if s.n == 0:
        return "none"
    if s.next is not None and s.next not in (",", ";", "\n"):
        return "other"
    if s.n == 1:
        if s.k1 == "str":
            return "str_literal"
        if s.k1 == "tmpl":
            return "template_plain"
        if s.k1 == "num" or s.t1 in _WORDS:
            return "other_literal"
        if s.k1 == "ident":
            return "ident"
    if s.n == 2 and s.k1 == "topen":
        return "dynamic"
    if s.add == "+" and not s.low:
        return "dynamic"
    if s.n == 2 and s.t1 == "{":
        return "object"
    if s.n == 2 and s.t1 == "[":
        return "array"
    if s.chains == 1 and not s.op and s.k1 == "ident":
        if s.end.kind == "ident" and s.t2 in _DOTS:
            return "attr"
        if s.end.text == ")":
            return "call"
    return "other"


class Later:
    """For every token of a group, what comes after it next: a body or semicolon, a round bracket, and the token
    before the end of the expression.  Read once from behind, and only in groups that ask."""

    def __init__(self, group: list[Token]):
        self.body, self.paren, self.stop = ([None] * len(group) for _ in range(3))
        body = paren = stop = None
        for at in range(len(group) - 1, -1, -1):
            t = group[at]
            self.body[at], self.paren[at], self.stop[at] = body, paren, stop
            if t.text == "{" or t.text == ";":
                body = t
            elif t.text == "(":
                paren = t
            if (t.text == "," or t.text == ";" or t.ends) and at:
                stop = group[at - 1]


def class_bodies(tokens: list[Token], segments: dict[int, list[Segment]], segment_of) -> list[dict]:
    """Every ``{`` after ``class`` in one segment, with the nearest such word before it."""
    words: dict[tuple[int, int], Token] = {}
    out = []
    for t in tokens:
        if t.text == "class":
            words[t.par, t.seg] = t
        elif t.text == "{" and (word := words.get((t.par, t.seg))):
            named = ahead(word, 1)
            name = named.text if named is not None and named.kind == "ident" and named.text not in ("extends", "implements") else None
            out.append({"par": t.par, "at": t.i, "to": t.mate, "start_line": word.line, "cname": name})
    return out


def _named(s: Segment) -> str | None:
    b1, b2 = s.b1, s.b2
    if s.opener == "=":
        if b1 is None:
            return None
        if b1.opener == ":":
            return b2.last_name.text if b2 is not None and b2.chains <= 2 and b2.last_name else None
        if b1.chains == 1 and not b1.op:
            return b1.joined
        return b1.last_name.text if b1.last_name else None
    if s.opener == ":" and b1 is not None and b1.n == 1:
        return b1.t1.translate(_QUOTES)
    return None


def find_functions(tokens: list[Token], by_i: dict[int, Token], segment_of, classes: list[dict]) -> list[Function]:
    """One per function scope (see ``facts_js._functions``)."""
    from tidewatch.operators.facts_js import ANONYMOUS
    in_class = {c["at"] for c in classes}
    out: list[Function] = []
    known: dict[int, Later] = {}

    def later(t: Token) -> Later:
        if t.par not in known:
            known[t.par] = Later(t.group)
        return known[t.par]

    def add(t: Token, seg: int, k: int, line: int, start: int, own, args_at, stop, form: str) -> None:
        f = Function()
        f.par, f.seg, f.k, f.line, f.start, f.own, f.args_at, f.form = t.par, seg, k, line, start, own, args_at, form
        f.stop = start if stop is None else stop
        out.append(f)

    before: dict[int, Token] = {}  # the last separator of a group before this token
    separator = None
    for t in tokens:
        if separator is not None:
            before[separator.par] = separator
        separator = t if t.sep else None
        text = t.text
        if text == "function":
            if text_of(back(t, 1)) in _DOTS:
                continue
            own = text_of(ahead(t, 2) if text_of(ahead(t, 1)) == "*" else ahead(t, 1))
            body = later(t).body[t.at]
            if body is not None and body.text == "{" and body.mate is not None:
                paren = later(t).paren[t.at]
                add(t, t.seg, t.k, t.line, t.i, own if own != "(" else None, paren.i if paren is not None else None, body.mate, "function")
        elif text == "=>":
            p1 = back(t, 1)
            args_at = None
            # A return type: the separator before is ``:`` after ``)``.
            x = before.get(t.par)
            if x is not None and x.text == ":" and text_of(back(x, 1)) == ")":
                args_at = back(x, 1).mate
            if args_at is None and p1 is not None and p1.text == ")":
                args_at = p1.mate
            start = args_at if args_at is not None else p1.i if p1 is not None else None
            if start is None:
                continue
            if text_of(ahead(t, 1)) == "{":
                stop = ahead(t, 1).mate
            else:
                last = later(t).stop[t.at]
                stop = last.i if last is not None else t.group[-1].i
            head = by_i[start]
            add(t, head.seg, head.k, head.line, start, None, args_at, stop, "arrow")
        elif text == "(" and t.par > 0 and t.at:
            p1, p2, p3, p4 = (back(t, n) for n in (1, 2, 3, 4))
            generic = p1.text == ">" and p4 is not None and p3.text == "<" and _letter(p4.text)
            if not (p1.kind in _STARTS or generic) or p1.text in _NOT_CALLED:
                continue
            if p2 is not None and p2.text in (".", "?.", "function", "new") and p3 is not None and p3.text != "async":
                continue
            n2 = text_of(ahead(t, 2))
            if n2 != "{" and not (n2 == ":" and t.par in in_class):
                continue
            body = later(t).body[t.at]
            if (n2 == ":" and text_of(body) != "{") or (p2 is not None and p2.text in ("=", "=>", "return", "?")):
                continue
            named = p4 if generic else p1
            add(t, t.seg, t.k, t.line, named.i, named.text.translate(_QUOTES), t.i, body.mate if body is not None else None, "method")
    for f in out:
        s = f.segment = segment_of(f.par, f.seg)
        f.first = f.k == 1 or (f.k == 2 and s.t1 == "async")
        name = f.own if f.own is not None else _named(s) if f.first else None
        f.name = ANONYMOUS if name is None else name
    return out


def param_lists(functions: list[Function], groups: dict[int, list[Token]], tokens: list[Token], segment_of) -> dict[int, list[str]]:
    """Parameter names by opening bracket; a destructured one gives its source text."""
    from tidewatch.operators.facts_js import MODIFIERS, PARAM_TEXT
    out = {}
    for args_at in {f.args_at for f in functions if f.args_at is not None}:
        angle = item = 0
        items: dict[int, list] = {}
        for t in groups.get(args_at, ()):
            text = t.text
            angle += 1 if text == "<" else -1 if text == ">" else -2 if text == ">>" else 0
            if text == "," and angle <= 0:
                item += 1
            if t.sep:
                continue
            opener = segment_of(args_at, t.seg).opener
            if opener is not None and opener != ",":
                continue
            got = items.setdefault(item, [False, None, None])
            if text == "...":
                got[0] = True
            if got[1] is None and t.kind == "ident" and text not in MODIFIERS and not text.startswith("@") and angle <= 0:
                got[1] = text
            if got[2] is None and (text == "{" or text == "["):
                p1 = back(t, 1)
                if p1 is None or p1.text == "," or p1.text == "...":
                    got[2] = t
        names = []
        for n in sorted(items):
            rest, name, at = items[n]
            if at is not None and at.mate is not None:
                parts = []
                for x in tokens[at.nth - 1:at.nth - 1 + PARAM_TEXT]:
                    if x.i > at.mate:
                        break
                    parts.append((x.gap if x.i > at.i else "") + (x.text[1:] if x.kind in MARKED else x.text))
                name = "".join(parts)[:PARAM_TEXT]
            if name is not None:
                names.append(("..." if rest else "") + name)
        out[args_at] = names
    return out


def find_calls(tokens: list[Token], segments: dict[int, list[Segment]], functions: list[Function]) -> list[dict]:
    headers = {f.args_at for f in functions if f.args_at is not None}
    out = []
    for t in tokens:
        if t.text != "(" or t.ends or not t.at or t.i in headers:
            continue
        p1, p2, p3 = (back(t, n) for n in (1, 2, 3))
        member = p2 is not None and p2.text in _DOTS
        named = p1.kind == "ident" and (member or p1.text not in _NOT_CALLED)
        if not (named or p1.text == ")" or p1.text == "]" or (p1.text == ">" and p3 is not None and p3.text == "<")):
            continue
        head = t.first
        links = t.links - head.links if head is not None else None
        if head is not None and links == 0 and text_of(back(head, 1)) == "new":
            continue
        args = [s.value for s in segments.get(t.i, ()) if (s.opener is None or s.opener == ",") and s.kind != "none"]
        if t.noted:
            args.insert(0, _NOTE)
        root = head.text if named and member and links == 0 and head.kind == "ident" and head.text not in ("this", "super") else None
        out.append({"pos": t.i, "line": head.line if head is not None else None, "shape": ("attr" if member else "name") if named else "other",
                    "name": p1.text if named else None, "root": root, "args": args, "shift": int(t.noted)})
    return out


def find_assigns(tokens: list[Token], segments: dict[int, list[Segment]], functions: list[Function], classes: list[dict]) -> list[dict]:
    from tidewatch.operators.facts_js import OBJECT_BEFORE
    headers = {f.args_at for f in functions if f.args_at is not None}
    in_class = {c["at"] for c in classes}
    pattern = set()
    for t in tokens:
        if t.text == "{" and (back(t, 1).text in OBJECT_BEFORE if t.at else t.par > 0):
            pattern.add(t.i)
    out = []
    for par, parts in segments.items():
        declares: dict[int, int] = {}
        for s in parts:
            if s.t1 in _DECLARES or (s.t2 in _DECLARES and s.t1 in ("export", "declare")):
                declares[s.stmt] = s.seg
        plain = par not in headers and par not in in_class
        for n, s in enumerate(parts):
            seg = declares.get(s.stmt)
            a1 = parts[n + 1] if n + 1 < len(parts) else None
            a2 = parts[n + 2] if n + 2 < len(parts) else None
            if seg is not None:
                decl = (s.seg == seg and s.last_name is not None and s.last_name is s.end and s.end.text not in _DECLARES) or (
                    s.opener == "," and s.seg > seg and s.n == 1 and s.k1 == "ident")
                if not decl:
                    continue
            else:
                decl = False
                if not (a1 is not None and a1.opener == "=" and plain and s.n > 0 and s.t1 != "type"
                        and not (par in pattern and (s.opener is None or s.opener == ","))):
                    continue
            v = a1 if a1 is not None and a1.opener == "=" else a2 if a1 is not None and a1.opener == ":" and a2 is not None and a2.opener == "=" else None
            name = s.end.text if decl else s.t1 if s.n == 1 and s.k1 == "ident" else None
            shape = "name" if name is not None else "innerHTML" if s.chains == 1 and s.end.text == "innerHTML" and s.n > 1 else "other"
            out.append({"pos": s.end.i if decl else s.i, "line": s.end.line if decl else s.line, "targets": [name], "n_targets": 1,
                        "value": v.value if v is not None else _ABSENT, "decl": decl, "target_shape": shape,
                        "value_has_math_random": v is not None and v.t1 == "Math" and v.t2 == "." and v.t3 == "random" and v.kind in ("call", "attr"),
                        "value_is_literal": v is not None and v.kind in ("str_literal", "other_literal")})
    return out


def find_pairs(by_i: dict[int, Token], segments: dict[int, list[Segment]], groups: dict[int, list[Token]], segment_of, calls: list[dict]) -> list[dict]:
    from tidewatch.operators.facts_js import OBJECT_BEFORE
    shifts = {c["pos"]: c["shift"] for c in calls}
    out = []
    for par, parts in segments.items():
        brace = by_i.get(par)
        if brace is None or brace.text != "{" or not (back(brace, 1).text in OBJECT_BEFORE if brace.at else brace.par > 0):
            continue
        arg = brace.par in shifts and segment_of(brace.par, brace.seg).kind == "object"
        for s in parts:
            b1 = s.b1
            if s.opener != ":" or b1 is None or b1.n != 1 or b1.opener not in (None, ",", "\n"):
                continue
            key = b1.t1.translate(_QUOTES)
            items = []
            if s.kind == "array" and key.lower() in ("algorithm", "algorithms"):
                items = [inner(x.text, _ITEM, _ITEM_END) for x in groups.get(s.i, ()) if x.kind == "str"]
            out.append({"pos": b1.i, "line": b1.line, "key": key, "value_kind": s.t1 if s.kind == "other_literal" and s.t1 in _WORDS else s.kind,
                        "value_literal": s.value["literal"], "value_items": items, "call_pos": brace.par if arg else None,
                        "arg_idx": brace.item + shifts[brace.par] if arg else None})
    return out


def scopes_of(functions: list[Function], asks: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, str | None]]:
    """(scope_id, func_name) of each asked (pos, turn): the innermost function around it (see ``facts_js._scopes``)."""
    marks = [(f.start, 1, f.start, n) for n, f in enumerate(functions)] + [(f.stop, 3, -f.start, n) for n, f in enumerate(functions)]
    out, nest, last = {}, 0, {}
    for pos, turn, _, n in sorted([*marks, *((pos, turn, 0, -1) for pos, turn in set(asks))]):
        if turn == 1:
            nest += 1
            last[nest] = (functions[n].start, functions[n].name)
        elif turn == 3:
            nest -= 1
        else:
            out[pos, turn] = last[nest] if nest > 0 else (0, None)
    return out


def extract_js(content: str, jsx: bool, strict: bool = False) -> dict[str, list[dict]]:
    """Fact rows of one file by kind.  Functions leave without their parameters, which are rows of their own; both hold the
    place of the opening bracket in ``call_pos``."""
    from tidewatch.operators.facts_js import ANONYMOUS
    from tidewatch.operators.windows import js_windows_of
    windows, raw = js_windows_of(content, list(lex(content, jsx, runs=True)), strict)
    tokens = read_tokens(raw)
    groups = cut_groups(tokens)
    segments = cut_segments(groups)
    by_i = {t.i: t for t in tokens}

    def segment_of(par: int, seg: int) -> Segment:
        parts = segments[par]
        return parts[seg - parts[0].seg]

    classes = class_bodies(tokens, segments, segment_of)
    functions = find_functions(tokens, by_i, segment_of, classes)
    params = param_lists(functions, groups, tokens, segment_of)
    top_class = {c["at"]: ANONYMOUS if c["cname"] is None else c["cname"] for c in classes if c["par"] == 0}
    for f in functions:
        s = f.segment
        f.end_line = by_i[f.stop].line
        declared = f.par == 0 and f.form == "function" and f.own is not None and s.opener in (None, ";", "\n") and (
            f.k == 1 or (s.t1 in ("export", "async", "default") and f.k <= 4))
        left = s.b2 if s.b1 is not None and s.b1.opener == ":" else s.b1
        bound = f.par == 0 and f.first and s.opener == "=" and left is not None and (
            left.t1 in _DECLARES or (left.t2 in _DECLARES and left.t1 == "export") or (left.opener == "," and left.n == 1))
        field = f.first and s.opener == "="
        f.parent_class = top_class.get(f.par)
        f.is_member = f.par in top_class and (f.form == "method" or field)
        f.is_top_level = declared or bound
        named = left.last_name if left is not None else None
        f.local_name = (named.text if named is not None else None) if bound else f.name
        f.start_line = (named.line if named is not None else None) if bound or (field and f.par in top_class) else f.line
    calls = find_calls(tokens, segments, functions)
    assigns = find_assigns(tokens, segments, functions, classes)
    pairs = find_pairs(by_i, segments, groups, segment_of, calls)
    news = []
    for t in tokens:
        if t.text == "new" and t.kind == "ident":
            n1 = ahead(t, 1)
            ctor = n1.text if n1 is not None and n1.kind == "ident" and text_of(ahead(t, 2)) not in _DOTS else None
            news.append({"pos": t.i, "line": t.line, "ctor": ctor})
    scopes = scopes_of(functions, [(f.start, 0) for f in functions] + [(r["pos"], 2) for rows in (calls, assigns, pairs, news) for r in rows])
    for r in calls:
        del r["shift"]
    for rows in (calls, assigns, pairs, news):
        for r in rows:
            r["scope_id"], r["func_name"] = scopes[r["pos"], 2]
    own, inventory, methods = [], [], {}
    by_start: dict[int, list[Function]] = {}
    for f in functions:
        by_start.setdefault(f.start, []).append(f)
    for f in functions:
        scope_id, func_name = scopes[f.start, 0]
        own.append({"pos": f.start, "func_id": f.start, "name": f.name, "local_name": f.local_name, "is_top_level": f.is_top_level, "is_method": f.form == "method",
                    "start_line": f.start_line, "end_line": f.end_line, "scope_id": scope_id, "func_name": func_name, "call_pos": f.args_at})
        if f.is_member or f.is_top_level:
            inventory.append({"func_id": f.start, "name": f.name if f.is_member else f.local_name, "is_top_level": f.is_top_level, "is_method": f.is_member,
                              "parent_class": f.parent_class, "start_line": f.start_line, "end_line": f.end_line, "call_pos": f.args_at})
        if f.is_member:
            for g in by_start[f.start]:
                methods.setdefault(g.par, []).append((f.start, f.name))
    rows = [{"name": top_class[c["at"]], "start_line": c["start_line"], "end_line": by_i[c["to"]].line if c["to"] is not None else None,
             "methods": [name for _, name in sorted(methods.get(c["at"], ()))]} for c in classes if c["par"] == 0]
    open_ = bool(tokens) and (tokens[-1].depth != 0 or min(t.depth for t in tokens) < 0)
    return {"file": [{"loc": len(content.splitlines()), "parse_error": "syntax error: brackets do not match" if open_ else None}],
            OPEN["function"]: own, OPEN["inventory"]: inventory, "class": rows, "call": calls, "assign": assigns, "pair": pairs, "new": news,
            PARAM: [{"call_pos": at, "arg_idx": n, "name": name} for at, names in params.items() for n, name in enumerate(names)],
            "window": [{"line": line, "pos": pos, "snippet": text} for line, pos, text in windows]}


def js_rows(strict: bool):
    """The ``mapInArrow`` function: files to flat fact rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewatch.operators.facts_python import Rows
        rows = Rows()
        for b in batches:
            columns = [b.column(c) for c in (*FILE, "language", "content", "not_read")]
            for n in range(b.num_rows):
                repo, path, language, content, not_read = (c[n].as_py() for c in columns)
                if content is not None and len(content) > MAX_BYTES:
                    facts = {LARGE: [{}]}
                else:
                    facts = extract_js((content or b"").decode("utf-8", "replace"), path.endswith(JSX_FILES), strict)
                    facts["file"][0]["parse_error"] = not_read or facts["file"][0]["parse_error"]
                for kind, found in facts.items():
                    rows.add(kind, repo, path, language, found)
                if rows.full():
                    yield from rows.take()
        yield from rows.take()
    return run
