"""A code corpus derived from ``documents`` (the driver tables hold no code).

Every document becomes one source file: template ``doc_id % K`` (Python
modules from ``templates_py``, then JS/TS modules from ``templates_js``; each
one a set of detectors, look-alikes and taint cases), its secret placeholder
filled with the md5 of the text, followed by the document's *whole* text as
comment lines.  The corpus grows with
``documents``; the same expression is written in DuckDB SQL for the oracles,
and what each template must give is written out by hand in ``plans.expected``.  Every 20th document lands under ``node_modules/`` and the next
under ``build/``, which discovery must skip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import sql_quote
from tidewatch.plans.expected import EXPECTED
from tidewatch.plans.templates_js import JS_TEMPLATES
from tidewatch.plans.templates_py import PY_TEMPLATES
from tidewatch.sources import tables

# (extension, comment prefix, source) for every template id
TEMPLATES = tuple((".py", "# ", t) for t in PY_TEMPLATES) + tuple((e, "// ", t) for e, t in JS_TEMPLATES)
K = len(TEMPLATES)
N_PY = len(PY_TEMPLATES)
PLACEHOLDER = "{SECRET}"
# Characters other than \n that end a line for splitlines(); replaced by spaces
# so that every text line stays one comment line.
OTHER_BREAK_CHARS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"
DUCK_OTHER_BREAKS = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, language, bytes, content, doc_id, tid, secret) - unfiltered."""
    d = tables.read_table(spark, sf_dir, "documents")
    tid = (F.col("doc_id") % K).cast("int")
    # A fixed table with one row per template.
    rows = [(i, ext, comment, source) for i, (ext, comment, source) in enumerate(TEMPLATES)]
    shapes = spark.createDataFrame(rows, "__tid int, ext string, prefix string, template string")
    d = d.withColumn("tid", tid).join(F.broadcast(shapes), F.col("tid") == F.col("__tid"))
    tid, ext, prefix, template = F.col("tid"), F.col("ext"), F.col("prefix"), F.col("template")
    secret = F.md5(F.col("text"))
    # Character by character only where there is something to replace.
    clean = F.when(F.col("text").rlike(f"[{OTHER_BREAK_CHARS}]"), F.translate("text", OTHER_BREAK_CHARS, " " * len(OTHER_BREAK_CHARS))).otherwise(F.col("text"))
    comments = F.concat(prefix, F.replace(clean, F.lit("\n"), F.concat(F.lit("\n"), prefix)))
    content = F.concat(F.replace(template, F.lit(PLACEHOLDER), secret), F.lit("\n"), comments, F.lit("\n"))
    subdir = (F.when(F.col("doc_id") % 20 == 0, "node_modules/").when(F.col("doc_id") % 20 == 1, "build/")
              .otherwise(""))
    stem = F.when((F.col("doc_id") % 20 == 2) & (tid >= N_PY), F.lit(".min")).otherwise(F.lit(""))
    path = F.concat(F.col("lang"), F.lit("/"), subdir, F.lit("m"), F.col("doc_id").cast("string"), stem, ext)
    return d.select(F.col("source").alias("repo"), path.alias("path"), content.alias("content"), "doc_id",
                    tid.alias("tid"), secret.alias("secret")) \
        .withColumn("bytes", F.octet_length("content").cast("long"))


LANG_OF_EXT = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript"}


def corpus_sql() -> str:
    arr = "[" + ", ".join(sql_quote(t[2]) for t in TEMPLATES) + "]"
    exts = "[" + ", ".join(sql_quote(t[0]) for t in TEMPLATES) + "]"
    langs = "[" + ", ".join(sql_quote(LANG_OF_EXT[t[0]]) for t in TEMPLATES) + "]"
    tid = f"CAST(doc_id % {K} AS INTEGER)"
    pre = f"CASE WHEN {tid} < {N_PY} THEN '# ' ELSE '// ' END"
    return f"""(SELECT source AS repo,
    lang || '/' || CASE doc_id % 20 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'build/' ELSE '' END
      || 'm' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 20 = 2 AND {tid} >= {N_PY} THEN '.min' ELSE '' END
      || list_extract({exts}, {tid} + 1) AS path,
    list_extract({langs}, {tid} + 1) AS language, doc_id, {tid} AS tid, md5(text) AS secret,
    replace(list_extract({arr}, {tid} + 1), '{PLACEHOLDER}', md5(text)) || chr(10) || {pre}
      || replace(regexp_replace(text, '{DUCK_OTHER_BREAKS}', ' ', 'g'), chr(10), chr(10) || {pre}) || chr(10) AS content
  FROM documents)"""


IGNORED_SQL = "['.git', 'node_modules', 'venv', '.venv', '__pycache__', 'dist', 'build', '.next', 'site-packages', 'migrations']"


def kept_corpus_sql() -> str:
    """Discovery filters (S2-S4) in SQL over the corpus."""
    return f"""(SELECT *, CAST(strlen(content) AS BIGINT) AS bytes FROM {corpus_sql()} c
  WHERE NOT list_has_any(string_split(path, '/'), {IGNORED_SQL})
    AND NOT (contains(lower(string_split(path, '/')[-1]), '.min.js') OR contains(lower(string_split(path, '/')[-1]), '.min.ts')
             OR contains(lower(string_split(path, '/')[-1]), '-min.js') OR contains(lower(string_split(path, '/')[-1]), '-min.ts')
             OR contains(lower(string_split(path, '/')[-1]), '.bundle.js')))"""


def _v(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, int):
        return str(x)
    return sql_quote(x)


def _values(key: str, row, names: str) -> str:
    """The hand-written rows of all templates as a SQL table (tid, ...)."""
    rows = [f"({tid}, " + ", ".join(row(*r)) + ")" for tid, e in enumerate(EXPECTED) for r in e.get(key, ())]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS e(tid, {names}))"


def findings_values_sql() -> str:
    """rank: place of the finding among its file's findings."""
    rows = [f"({tid}, {n}, {line}, {_v(fn)}, {_v(rule)}, {_v(seeded)}, {_v(literal)})"
            for tid, e in enumerate(EXPECTED) for n, (line, fn, rule, seeded, literal) in enumerate(e.get("findings", ()), 1)]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS e(tid, rank, line, function, rule_id, via_param, literal))"


def seeds_values_sql() -> str:
    return _values("seeds", lambda fn, p: (_v(fn), _v(p)), "callee, param")


def call_taint_values_sql() -> str:
    return _values("calls", lambda fn, i: (_v(fn), str(i)), "callee, idx")


def functions_values_sql() -> str:
    return _values("functions", lambda n, a, b, args, m, c: (_v(n), str(a), str(b), _v(",".join(args)), _v(m), _v(c)),
                   "name, start_line, end_line, args, is_method, parent_class")


def classes_values_sql() -> str:
    return _values("classes", lambda n, a, b, ms: (_v(n), str(a), str(b), _v(",".join(ms))), "name, start_line, end_line, methods")


def errors_values_sql() -> str:
    rows = [f"({tid}, {_v(e['error'])})" for tid, e in enumerate(EXPECTED) if e.get("error")]
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(tid, parse_error))"
