"""JavaScript / TypeScript facts (P5-P7, E2, E7-E13): functions, classes, calls, assignments,
object pairs and ``new`` expressions, in the same flat shape as Python's.  Files of usual size are read by one pass inside
the row (``facts_js_row``), longer ones by joins and windows over the token table of ``js_tokens``; tests hold each against the other.

``pos`` of a fact is the place of its token in the file, so facts of a file
sort in reading order and an assignment comes before the calls of its value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import loc_from_lines, split_lines
from tidewatch.operators import facts_js_row as row
from tidewatch.operators.facts_python import FLAT_SCHEMA, flat
from tidewatch.operators.js_tokens import DECLARES, FILE, JS_LANGUAGES, MARKED, NOT_CALLED, raw_tokens, segments, tokens
from tidewatch.session import materialize, ship_package
from tidewatch.sources.files import not_read

ANONYMOUS = "<anonymous>"
MODIFIERS = ("public", "private", "protected", "readonly", "static", "override", "async", "get", "set", "abstract", "declare", "accessor")
OBJECT_BEFORE = ("(", ",", "=", ":", "[", "?", "return", "default", "&&", "||", "??", "...", "in", "of")
PARAM_TEXT = 60  # fixed value: length a destructured parameter's text is cut to


def _named(s):
    """The name that ``name = <function>`` or ``key: <function>`` gives the function whose value segment is ``s``."""
    b1, b2 = F.col("b1"), F.col("b2")
    left = F.when(b1["opener"] == ":", F.when(b2["chains"] <= 2, b2["last_name"]["text"])).when(
        (b1["chains"] == 1) & ~b1["op"], b1["joined"]).otherwise(b1["last_name"]["text"])
    return F.when(F.col("opener") == "=", left).when((F.col("opener") == ":") & (b1["n"] == 1), F.translate(b1["t1"], "'\"", ""))


def _functions(t: DataFrame, s: DataFrame, class_bodies: DataFrame) -> DataFrame:
    """One row per function scope: start, stop, name, own name, paren, par, lines."""
    cols = [*FILE, "par", "seg", "k", "line"]
    word = t.filter((F.col("text") == "function") & ~F.coalesce(F.col("p1").isin(".", "?."), F.lit(False)))
    star = F.col("n1") == "*"
    own = F.when(star, F.col("n2")).otherwise(F.col("n1"))
    word = word.select(*cols, F.col("i").alias("start"), F.when(own != "(", own).alias("own"), F.col("paren.i").alias("args_at"),
                       F.col("body.mate").alias("stop"), F.lit("function").alias("form"), (F.col("body.text") == "{").alias("bodied"))
    # Signatures without a body, and headers that never close, are no functions.
    word = word.filter(F.col("bodied") & F.col("stop").isNotNull()).drop("bodied")
    arrow = t.filter(F.col("text") == "=>")
    block = F.col("n1") == "{"
    args_at = F.when(F.col("typed").isNotNull(), F.col("typed")).when(F.col("p1") == ")", F.col("pmate"))
    arrow = arrow.select(*cols, F.coalesce(args_at, F.col("pi1")).alias("start"), F.lit(None).cast("string").alias("own"), args_at.alias("args_at"),
                         F.when(block, F.col("body.mate")).otherwise(F.coalesce("stop", "last_i")).alias("stop"), F.lit("arrow").alias("form"))
    # The arrow's own place is its first token, not the ``=>``.
    heads = t.select(*FILE, F.col("i").alias("start"), F.col("seg").alias("seg0"), F.col("k").alias("k0"), F.col("line").alias("line0"))
    arrow = arrow.join(heads, [*FILE, "start"]).select(*FILE, "par", F.col("seg0").alias("seg"), F.col("k0").alias("k"), F.col("line0").alias("line"),
                                                       "start", "own", "args_at", "stop", "form")
    # ``name<T>(``: the name stands before the type argument.
    generic = F.coalesce((F.col("p1") == ">") & (F.col("p3") == "<") & F.col("p4").rlike(r"^[\p{L}_$]"), F.lit(False))
    called = t.withColumn("generic", generic).filter((F.col("text") == "(") & (F.col("par") > 0) & (F.col("pk1").isin("ident", "str", "num") | F.col("generic")) & ~F.col("p1").isin(*NOT_CALLED)
                      & ~F.coalesce(F.col("p2").isin(".", "?.", "function", "new", "*") & (F.col("p3") != "async") & (F.col("p2") != "*"), F.lit(False)))
    called = called.join(class_bodies.select(*FILE, F.col("at").alias("par"), F.lit(True).alias("in_class")), [*FILE, "par"], "left")
    method = (F.col("n2") == "{") | ((F.col("n2") == ":") & F.col("in_class") & (F.col("body.text") == "{"))
    method = called.filter(method & (F.col("p2").isNull() | ~F.col("p2").isin("=", "=>", "return", "?"))).select(
        *cols, F.when(F.col("generic"), F.col("pi4")).otherwise(F.col("pi1")).alias("start"),
        F.translate(F.when(F.col("generic"), F.col("p4")).otherwise(F.col("p1")), "'\"", "").alias("own"), F.col("i").alias("args_at"), F.col("body.mate").alias("stop"),
        F.lit("method").alias("form"))
    f = word.unionByName(arrow).unionByName(method)
    f = f.join(s.select(*FILE, "par", "seg", "opener", "b1", "b2", "t1", "t2", "t3", F.col("i").alias("seg_i")), [*FILE, "par", "seg"], "left")
    first = (F.col("k") == 1) | ((F.col("k") == 2) & (F.col("t1") == "async"))
    name = F.coalesce("own", F.when(first, _named(s)), F.lit(ANONYMOUS))
    return f.withColumn("first", first).withColumn("name", name).withColumn("stop", F.coalesce("stop", "start"))


def _scopes(asks: DataFrame, functions: DataFrame) -> DataFrame:
    """scope_id and func_name of each asked (repo, path, pos, turn, fact): the innermost function around ``pos``."""
    none = F.lit(None).cast("string")
    marks = functions.select(*FILE, F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).alias("turn"), F.lit(1).alias("step"), F.col("name").alias("named"), F.col("start").alias("of")),
        F.struct(F.col("stop").alias("pos"), F.lit(3).alias("turn"), F.lit(-1).alias("step"), none.alias("named"), F.col("start").alias("of")))).alias("m"))
    marks = marks.select(*FILE, "m.*", F.lit(None).cast("int").alias("fact"))
    # A function's own row (turn 0) lies outside it, everything else at its first place inside.
    asks = asks.select(*FILE, "pos", F.col("turn"), F.lit(0).alias("step"), none.alias("named"), F.lit(None).cast("int").alias("of"), F.col("fact")).distinct()
    e = marks.unionByName(asks)
    # Ends at one place close the inner function first.
    order = ["pos", "turn", F.when(F.col("turn") == 3, -F.col("of")).otherwise(F.col("of"))]
    w = Window.partitionBy(*FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("nest", F.sum("step").over(w) + F.when(F.col("step") == -1, 1).otherwise(0))
    inner = Window.partitionBy(*FILE, "nest").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("in", F.last(F.when(F.col("step") == 1, F.struct("of", "named")), True).over(inner))
    return e.filter((F.col("step") == 0)).select(
        *FILE, "pos", "fact", F.when(F.col("nest") > 0, F.col("in.of")).otherwise(0).alias("scope_id"), F.when(F.col("nest") > 0, F.col("in.named")).alias("func_name"))


def _params(functions: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    """(repo, path, args_at, params): parameter names in order; a destructured one gives its source text."""
    p = functions.filter(F.col("args_at").isNotNull()).select(*FILE, F.col("args_at").alias("par")).distinct()
    # Commas inside type arguments do not part parameters.
    angle = F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).when(F.col("text") == ">>", -2).otherwise(0)
    upto = Window.partitionBy(*FILE, "par").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = t.join(p, [*FILE, "par"]).withColumn("angle", F.sum(angle).over(upto))
    words = words.withColumn("item", F.sum(((F.col("text") == ",") & (F.col("angle") <= 0)).cast("int")).over(upto))
    plain = (F.col("kind") == "ident") & ~F.col("text").isin(*MODIFIERS) & ~F.col("text").startswith("@") & (F.col("angle") <= 0)
    # The first name, or a bracket standing where a name would.
    pattern = F.col("text").isin("{", "[") & (F.col("p1").isNull() | F.col("p1").isin(",", "..."))
    opener = s.select(*FILE, "par", "seg", "opener")
    items = words.filter(~F.col("sep")).join(opener, [*FILE, "par", "seg"]).filter(F.col("opener").isNull() | (F.col("opener") == ","))
    items = items.groupBy(*FILE, "par", "item").agg(
        F.coalesce(F.bool_or(F.col("text") == "..."), F.lit(False)).alias("rest"),
        F.min(F.when(plain, F.struct("i", "text")))["text"].alias("name"), F.min(F.when(pattern, F.struct("i", "mate", "nth"))).alias("at"))
    items = materialize(items, "js-param-items")
    # A pattern's text is cut to PARAM_TEXT characters, so it needs no more than its first so many tokens: they are
    # looked up by their number in the file.
    within = items.filter(F.col("at").isNotNull()).select(*FILE, "par", "item", F.col("at.i").alias("lo"), F.col("at.mate").alias("hi"), F.col("at.nth").alias("first"))
    within = within.withColumn("nth", F.explode(F.sequence(F.col("first"), F.col("first") + PARAM_TEXT - 1)))
    bare = F.when(F.col("kind").isin(*MARKED), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    text = F.concat(F.when(F.col("i") > F.col("lo"), F.col("gap")).otherwise(""), bare)
    source = within.join(t.select(*FILE, "nth", "i", "kind", "text", "gap"), [*FILE, "nth"]).filter("i <= hi").groupBy(*FILE, "par", "item").agg(
        F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", text.alias("text")))), lambda x: x["text"]), ""), 1, PARAM_TEXT).alias("source"))
    items = items.join(source, [*FILE, "par", "item"], "left")
    name = F.concat(F.when(F.col("rest"), "...").otherwise(""), F.coalesce("source", "name"))
    items = items.filter(F.coalesce("source", "name").isNotNull())
    return items.groupBy(*FILE, F.col("par").alias("args_at")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("item", name.alias("name")))), lambda x: x["name"]).alias("params"))


def _calls(t: DataFrame, s: DataFrame, functions: DataFrame) -> DataFrame:
    member = F.coalesce(F.col("p2").isin(".", "?."), F.lit(False))
    generic = (F.col("p1") == ">") & (F.col("p3") == "<")
    named = (F.col("pk1") == "ident") & (member | ~F.col("p1").isin(*NOT_CALLED))
    c = t.filter((F.col("text") == "(") & ~F.col("ends") & (named | F.col("p1").isin(")", "]") | generic))
    c = c.filter(~F.coalesce((F.col("chain_before") == "new") & (F.col("chain_links") == 0), F.lit(False)))
    headers = functions.filter(F.col("args_at").isNotNull()).select(*FILE, F.col("args_at").alias("i")).distinct()
    c = c.join(headers, [*FILE, "i"], "left_anti")
    a = s.filter(F.col("opener").isNull() | (F.col("opener") == ",")).filter((F.col("par") > 0))
    a = a.groupBy(*FILE, F.col("par").alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "value"))), lambda x: x["value"]).alias("args"))
    c = c.join(a, [*FILE, "i"], "left")
    note = F.struct(F.lit("comment").alias("kind"), *[F.lit(None).cast("string").alias(x) for x in ("literal", "ident", "attr")])
    args = F.coalesce(F.filter("args", lambda x: x["kind"] != "none"), F.array())
    args = F.when(F.col("before_comment"), F.concat(F.array(note), args)).otherwise(args)
    shape = F.when(named, F.when(member, "attr").otherwise("name")).otherwise("other")
    root = F.when(named & member & (F.col("chain_links") == 0) & (F.col("chain_kind") == "ident") & ~F.col("chain_text").isin("this", "super"), F.col("chain_text"))
    return c.select(*FILE, F.col("i").alias("pos"), F.col("chain_line").alias("line"), shape.alias("shape"), F.when(named, F.col("p1")).alias("name"),
                    root.alias("root"), args.alias("args"), F.lit(2).alias("turn"), F.lit(1).alias("fact"), F.col("before_comment").cast("int").alias("shift"))


def _assigns(t: DataFrame, s: DataFrame, functions: DataFrame, class_bodies: DataFrame) -> DataFrame:
    """Declarators and ``=`` assignments with the kind of their value."""
    w = Window.partitionBy(*FILE, "par").orderBy("seg")
    stmt = Window.partitionBy(*FILE, "par", "stmt")
    # The window over whole brackets comes first: its shuffle also serves the one over their statements.
    d = s.withColumns({f"a{k}": F.lead(F.struct("opener", "value", "next", "t1", "t2", "t3", "t4", "n", "kind", "item", "k1"), k).over(w) for k in (1, 2)})
    d = d.withColumn("declares", F.max(F.when(F.col("t1").isin(*DECLARES) | (F.col("t2").isin(*DECLARES) & F.col("t1").isin("export", "declare")), F.col("seg"))).over(stmt))
    first = F.col("seg") == F.col("declares")
    more = (F.col("opener") == ",") & (F.col("seg") > F.col("declares"))
    declared = (first & (F.col("last_name.i") == F.col("end.i")) & ~F.col("end.text").isin(*DECLARES)) | (more & (F.col("n") == 1) & (F.col("k1") == "ident"))
    typed = (F.col("a1.opener") == ":") & (F.col("a2.opener") == "=")
    value = F.when(F.col("a1.opener") == "=", F.col("a1")).when(typed, F.col("a2"))
    # What a bracket is: a function's parameters, a class body, a pattern or an object.
    in_header = functions.filter(F.col("args_at").isNotNull()).select(*FILE, F.col("args_at").alias("par"), F.lit(True).alias("header"))
    in_class = class_bodies.select(*FILE, F.col("at").alias("par"), F.lit(True).alias("in_class"))
    braces = t.filter((F.col("text") == "{")).select(*FILE, F.col("i").alias("par"), F.coalesce(F.col("p1").isin(*OBJECT_BEFORE), F.col("p1").isNull() & (F.col("par") > 0)).alias("pattern"))
    brackets = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (in_header, in_class, braces))
    d = d.join(brackets.groupBy(*FILE, "par").agg(*[F.bool_or(c).alias(c) for c in ("header", "in_class", "pattern")]), [*FILE, "par"], "left")
    assigned = (F.col("a1.opener") == "=") & F.col("declares").isNull() & F.col("header").isNull() & F.col("in_class").isNull() & ~(
        F.coalesce("pattern", F.lit(False)) & (F.col("opener").isNull() | (F.col("opener") == ","))) & (F.col("n") > 0) & (F.col("t1") != "type")
    hit = d.filter(declared | assigned).withColumn("decl", F.coalesce(declared, F.lit(False))).withColumn("v", value)
    name = F.when(F.col("decl"), F.col("end.text")).when((F.col("n") == 1) & (F.col("k1") == "ident"), F.col("t1"))
    shape = F.when(name.isNotNull(), "name").when((F.col("chains") == 1) & (F.col("end.text") == "innerHTML") & (F.col("n") > 1), "innerHTML").otherwise("other")
    absent = F.struct(F.lit("none").alias("kind"), *[F.lit(None).cast("string").alias(x) for x in ("literal", "ident", "attr")])
    whole = F.coalesce(F.col("v.value"), absent)
    literal = F.coalesce(F.col("v.kind").isin("str_literal", "other_literal"), F.lit(False))
    random = F.coalesce((F.col("v.t1") == "Math") & (F.col("v.t2") == ".") & (F.col("v.t3") == "random") & F.col("v.kind").isin("call", "attr"), F.lit(False))
    return hit.select(*FILE, F.when(F.col("decl"), F.col("end.i")).otherwise(F.col("i")).alias("pos"), F.when(F.col("decl"), F.col("end.line")).otherwise(F.col("line")).alias("line"),
                      F.array(name).alias("targets"), F.lit(1).alias("n_targets"), whole.alias("value"), "decl", shape.alias("target_shape"),
                      random.alias("value_has_math_random"), literal.alias("value_is_literal"), F.lit(2).alias("turn"), F.lit(2).alias("fact"))


def _pairs(t: DataFrame, s: DataFrame, calls: DataFrame) -> DataFrame:
    """``key: value`` of object literals, with the call they are an argument of."""
    objects = t.filter((F.col("text") == "{") & F.coalesce(F.col("p1").isin(*OBJECT_BEFORE), F.col("par") > 0)).select(
        *FILE, F.col("i").alias("par"), F.col("par").alias("outer"), F.col("item").alias("arg"), F.col("k").alias("ok"), F.col("seg").alias("oseg"))
    p = s.filter((F.col("opener") == ":") & (F.col("b1.n") == 1) & (F.col("b1.opener").isNull() | F.col("b1.opener").isin(",", "\n"))).join(objects, [*FILE, "par"])
    whole = s.filter(F.col("kind") == "object").select(*FILE, F.col("par").alias("outer"), F.col("seg").alias("oseg"), F.lit(True).alias("is_arg"))
    p = p.join(whole, [*FILE, "outer", "oseg"], "left")
    p = p.join(calls.select(*FILE, F.col("pos").alias("outer"), F.lit(True).alias("of_call"), "shift"), [*FILE, "outer"], "left")
    strings = t.filter((F.col("kind") == "str")).select(*FILE, F.col("par").alias("i"), F.col("i").alias("si"), F.regexp_replace(
        F.regexp_extract("text", r"^['\"]([^\\]*)", 1), r"['\"]$", "").alias("item_text"))
    key = F.translate(F.col("b1.t1"), "'\"", "")
    # Items are gathered only where a rule reads them.
    lists = p.filter((F.col("kind") == "array") & F.lower(key).isin("algorithm", "algorithms")).select(*FILE, "i").distinct()
    lists = lists.join(strings, [*FILE, "i"]).groupBy(*FILE, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("si", "item_text"))), lambda x: x["item_text"]).alias("value_items"))
    p = p.join(lists, [*FILE, "i"], "left")
    arg = F.col("of_call") & F.col("is_arg")
    kind = F.when((F.col("kind") == "other_literal") & F.col("t1").isin("true", "false", "null", "undefined"), F.col("t1")).otherwise(F.col("kind"))
    return p.select(*FILE, F.col("b1.i").alias("pos"), F.col("b1.line").alias("line"), key.alias("key"), kind.alias("value_kind"), F.col("value.literal").alias("value_literal"),
                    F.coalesce("value_items", F.array().cast("array<string>")).alias("value_items"), F.when(arg, F.col("outer")).alias("call_pos"),
                    F.when(arg, F.col("arg") + F.col("shift")).cast("int").alias("arg_idx"), F.lit(2).alias("turn"), F.lit(3).alias("fact"))


def extract_js_facts(sources: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, path, language, content) of JS / TS files -> flat fact rows of all kinds."""
    rows, rest = js_fact_parts(sources, strict)
    return reduce(DataFrame.unionByName, [rows, *rest(rows)])


def js_fact_parts(sources: DataFrame, strict: bool = False) -> list:
    """The rows of ``extract_js_facts``: those of one pass over the files, and a function that gives the others from
    these once they are written: functions with their parameters, and all rows of files too long for the pass."""
    ship_package(sources.sparkSession)
    js = sources.filter(F.col("language").isin(*JS_LANGUAGES)).select(
        *FILE, "language", F.col("content").cast("binary").alias("content"), not_read(sources).alias("not_read"))

    def rest(written: DataFrame) -> list[DataFrame]:
        items = written.filter(F.col("kind") == row.PARAM).groupBy(*FILE, "call_pos").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("arg_idx", "name"))), lambda x: x["name"]).alias("params"))
        items = materialize(items, "js-param-items")
        out = []
        for kind, unfinished in row.OPEN.items():
            f = written.filter(F.col("kind") == unfinished).drop("params").join(items, [*FILE, "call_pos"], "left")
            f = f.withColumns({"kind": F.lit(kind), "params": F.coalesce("params", F.array().cast("array<string>")), "call_pos": F.lit(None)})
            out.append(flat(f))
        if not written.filter(F.col("kind") == row.LARGE).isEmpty():
            out += [flat(p) for p in token_table_parts(sources.filter(F.octet_length("content") > row.MAX_BYTES), strict)]
        return out

    return [js.mapInArrow(row.js_rows(strict), FLAT_SCHEMA), rest]


def token_table_parts(sources: DataFrame, strict: bool = False) -> list[DataFrame]:
    """The facts by windows and joins over the token table, a frame per kind with that kind's columns."""
    from tidewatch.operators.windows import js_windows
    js = sources.filter(F.col("language").isin(*JS_LANGUAGES)).select(*FILE, "language", "content", not_read(sources).alias("not_read"))
    t = materialize(tokens(raw_tokens(js)), "js-tokens")
    s = materialize(segments(t), "js-segments")
    class_seg = s.filter("has_class").select(*FILE, "par", "seg")
    words = t.filter(F.col("text") == "class").select(*FILE, "par", "seg", F.col("i").alias("class_at"), F.col("line").alias("start_line"),
                                                    F.when(F.col("nk1") == "ident", F.col("n1")).alias("cname"))
    bodies = t.filter(F.col("text") == "{").select(*FILE, "par", "seg", F.col("i").alias("at"), F.col("mate").alias("to")).join(class_seg, [*FILE, "par", "seg"])
    bodies = bodies.join(words, [*FILE, "par", "seg"]).filter("at > class_at")
    last = Window.partitionBy(*FILE, "at").orderBy(F.col("class_at").desc())
    bodies = bodies.withColumn("o", F.row_number().over(last)).filter("o = 1").drop("o")
    bodies = bodies.withColumn("cname", F.when(F.col("cname").isin("extends", "implements"), None).otherwise(F.col("cname")))
    # Every table that others read is written: a plan over all of them is so large that the driver runs out of memory.
    bodies = materialize(bodies.select(*FILE, "par", "at", "to", "start_line", "cname"), "js-class-bodies")
    functions = materialize(_functions(t, s, bodies), "js-functions")
    params = materialize(_params(functions, t, s), "js-params")
    ends = t.select(*FILE, F.col("i").alias("stop"), F.col("line").alias("end_line"))
    f = functions.join(params, [*FILE, "args_at"], "left").join(ends, [*FILE, "stop"], "left")
    f = f.withColumn("params", F.coalesce("params", F.array().cast("array<string>")))

    # Module level: declarations, and declarators holding a function; members of module-level classes.
    exported = F.coalesce(F.col("t1").isin("export", "async", "default"), F.lit(False))
    declared = (F.col("par") == 0) & (F.col("form") == "function") & F.col("own").isNotNull() & (F.col("opener").isNull() | F.col("opener").isin(";", "\n")) & (
        (F.col("k") == 1) | (exported & (F.col("k") <= 4)))
    left = F.when(F.col("b1.opener") == ":", F.col("b2")).otherwise(F.col("b1"))
    bound = (F.col("par") == 0) & F.col("first") & (F.col("opener") == "=") & (
        left["t1"].isin(*DECLARES) | (left["t2"].isin(*DECLARES) & (left["t1"] == "export")) | ((left["opener"] == ",") & (left["n"] == 1)))
    top_class = bodies.filter("par = 0").select(*FILE, F.col("at").alias("par"), F.coalesce("cname", F.lit(ANONYMOUS)).alias("parent_class"), F.lit(True).alias("member"))
    f = f.join(top_class, [*FILE, "par"], "left")
    field = F.col("first") & (F.col("opener") == "=")
    member = F.coalesce(F.col("member") & ((F.col("form") == "method") | field), F.lit(False))
    f = (f.withColumn("is_top_level", F.coalesce(declared | bound, F.lit(False))).withColumn("is_method", F.col("form") == "method").withColumn("is_member", member)
          .withColumn("local_name", F.when(F.coalesce(bound, F.lit(False)), left["last_name"]["text"]).otherwise(F.col("name")))
          .withColumn("start_line", F.when(F.coalesce(bound, F.lit(False)) | (field & F.col("member")), left["last_name"]["line"]).otherwise(F.col("line"))))
    f = materialize(f.select(*FILE, F.col("start").alias("pos"), "start", "stop", "name", "local_name", "is_top_level", "is_method", "is_member", "parent_class",
                             "params", "start_line", "end_line", "args_at", F.lit(0).alias("turn"), F.lit(0).alias("fact"), "line"), "js-function-facts")
    calls = materialize(_calls(t, s, f), "js-calls")
    assigns = materialize(_assigns(t, s, f, bodies), "js-assigns")
    pairs = materialize(_pairs(t, s, calls), "js-pairs")
    news = t.filter((F.col("text") == "new") & (F.col("kind") == "ident")).select(
        *FILE, F.col("i").alias("pos"), "line", F.when((F.col("nk1") == "ident") & ~F.coalesce(F.col("n2").isin(".", "?."), F.lit(False)), F.col("n1")).alias("ctor"),
        F.lit(2).alias("turn"), F.lit(4).alias("fact"))
    # One scope lookup for the facts of all kinds.
    tag = lambda d, kind: d.withColumn("kind", F.lit(kind))
    own = f.drop("start", "stop", "args_at", "line", "is_member", "parent_class").withColumn("func_id", F.col("pos"))
    scoped = {"function": own, "call": calls.drop("shift"), "assign": assigns, "pair": pairs, "new": news}
    asks = reduce(DataFrame.unionByName, (d.select(*FILE, "pos", "turn", "fact") for d in scoped.values()))
    language = js.select(*FILE, "language")
    scopes = materialize(_scopes(asks, f).join(language, FILE), "js-scopes")
    numbers = {"function": 0, "call": 1, "assign": 2, "pair": 3, "new": 4}  # ``fact`` of a kind
    parts = [tag(d.join(scopes.filter(F.col("fact") == numbers[kind]), [*FILE, "pos", "fact"]).drop("fact", "turn"), kind) for kind, d in scoped.items()]
    inventory = f.filter(F.col("is_member") | F.col("is_top_level")).select(
        *FILE, F.col("pos").alias("func_id"), F.when(F.col("is_member"), F.col("name")).otherwise(F.col("local_name")).alias("name"), "is_top_level",
        F.col("is_member").alias("is_method"), "parent_class", "params", "start_line", "end_line")
    members = f.filter("is_member").join(functions.select(*FILE, "start", "par"), [*FILE, "start"])
    methods = members.groupBy(*FILE, F.col("par").alias("at")).agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]).alias("methods"))
    classes = bodies.filter("par = 0").join(ends.withColumnRenamed("stop", "to"), [*FILE, "to"], "left").join(methods, [*FILE, "at"], "left").select(
        *FILE, F.coalesce("cname", F.lit(ANONYMOUS)).alias("name"), "start_line", "end_line", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))
    # A file whose brackets do not close is listed with a reason; its facts stay.
    shut = t.groupBy(*FILE).agg(F.max(F.struct("i", "depth"))["depth"].alias("left_open"), F.min("depth").alias("lowest"))
    lines = split_lines(F.coalesce("content", F.lit("")))
    files = js.select(*FILE, "language", "not_read", loc_from_lines(lines).alias("loc")).join(shut, FILE, "left").select(
        *FILE, "language", "loc", F.when(F.col("not_read").isNotNull(), F.col("not_read")).when((F.col("left_open") != 0) | (F.col("lowest") < 0), "syntax error: brackets do not match").alias("parse_error"))
    parts += [tag(d.join(language, FILE), kind) for kind, d in (("inventory", inventory), ("class", classes))]
    return [*parts, tag(files, "file"), tag(js_windows(sources, strict), "window")]
