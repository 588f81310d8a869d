"""Registered queries for source-level operators: repository size cap (S6),
repository URL normalising (S7, S8) and changed files between two snapshots
(S17).  Inputs: ``documents`` (repo = source) and ``pages.url``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import sql_quote
from tidewatch.plans.oracle import SRC_DOCUMENTS
from tidewatch.plans.registry import register
from tidewatch.session import checkpoint_dir
from tidewatch.sources import files, tables, tree

SIZE_CAP_MB = 0.125
ANY_HOST = r"[A-Za-z0-9.-]+"


@register("s6_repo_size_cap", f"""
SELECT repo, CAST(sum(bytes) AS BIGINT) AS total_bytes,
       CAST(sum(bytes) AS DOUBLE) / 1048576.0 AS size_mb,
       CAST(sum(bytes) AS DOUBLE) / 1048576.0 <= {SIZE_CAP_MB} AS accepted
FROM {SRC_DOCUMENTS} GROUP BY repo""")
def s6_repo_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repo_sizes(tables.documents_as_sources(spark, sf_dir), SIZE_CAP_MB)


@register("s6_accepted_files", f"""
WITH s AS (SELECT repo FROM {SRC_DOCUMENTS} GROUP BY repo HAVING CAST(sum(bytes) AS DOUBLE) / 1048576.0 <= {SIZE_CAP_MB})
SELECT d.repo, d.path, d.language, d.bytes FROM {SRC_DOCUMENTS} d WHERE d.repo IN (SELECT repo FROM s)""")
def s6_accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = tables.documents_as_sources(spark, sf_dir)
    return files.accepted_files(src, SIZE_CAP_MB).select("repo", "path", "language", "bytes")


WS = sql_quote(f"^{files.PY_SPACE}+|{files.PY_SPACE}+$")
U1 = f"regexp_replace(url, {WS}, '', 'g')"
U2 = f"regexp_replace({U1}, '/+\\z', '')"
U3 = f"regexp_replace({U2}, '\\.git\\z', '')"
VALID = sql_quote(f"^https://{ANY_HOST}/{files.URL_PART}/{files.URL_PART}/?\\z")


@register("s7_repo_urls", f"""
SELECT page_id, {U3} AS url_norm, regexp_matches({U3}, {VALID}) AS is_valid,
       regexp_replace(url, '/+\\z', '') AS history_key FROM pages""")
def s7_repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read_table(spark, sf_dir, "pages")
    norm, valid = files.normalize_repo_url(F.col("url"), ANY_HOST)
    return p.select("page_id", norm.alias("url_norm"), valid.alias("is_valid"),
                    files.history_key(F.col("url")).alias("history_key"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """base = documents except German ones; head = documents except source
    src1, with French documents edited (a line appended)."""
    d = tables.documents_as_sources(spark, sf_dir)
    base = d.filter(F.col("language") != "de")
    head = d.filter(F.col("repo") != "src1").withColumn(
        "content", F.when(F.col("language") == "fr", F.concat("content", F.lit("\n# edited")))
        .otherwise(F.col("content")))
    return base, head


@register("s17_changed_files", f"""
WITH b AS (SELECT repo, path, sha256(content) AS hb FROM {SRC_DOCUMENTS} d WHERE language <> 'de'),
h AS (SELECT repo, path, sha256(CASE WHEN language = 'fr' THEN content || chr(10) || '# edited' ELSE content END) AS hh
      FROM {SRC_DOCUMENTS} d WHERE repo <> 'src1'),
j AS (SELECT coalesce(b.repo, h.repo) AS repo, coalesce(b.path, h.path) AS path,
        CASE WHEN hb IS NULL THEN 'added' WHEN hh IS NULL THEN 'removed' WHEN hb <> hh THEN 'modified' END AS change_type
      FROM b FULL OUTER JOIN h ON b.repo = h.repo AND b.path = h.path)
SELECT * FROM j WHERE change_type IS NOT NULL""")
def s17_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _snapshots(spark, sf_dir)
    return files.changed_files(base, head)


# Names of the files of a tree: hidden files and folders, assets, ignored folders.
TREE_NAMES = ("p#/__init__.py", "_m#.tsx", ".conf/m#.ts", "__tests__/m#.js", "assets/m#.bin", "src/m#.jsx", "_internal/x#.py", "node_modules/m#.js", ".env#.js", "notes.py/m#")
TREE_CAP_MB = 0.125
_TREE_SQL = f"""(SELECT source AS repo, replace(list_extract([{", ".join(map(sql_quote, TREE_NAMES))}], CAST(doc_id % {len(TREE_NAMES)} AS INT) + 1), '#', CAST(doc_id AS VARCHAR)) AS path,
  text AS content, CAST(strlen(text) AS BIGINT) AS bytes FROM documents)"""
_SIZES_SQL = f"SELECT repo, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(bytes) AS DOUBLE) / 1048576.0 AS size_mb, CAST(sum(bytes) AS DOUBLE) / 1048576.0 <= {TREE_CAP_MB} AS accepted FROM {_TREE_SQL} GROUP BY repo"


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a file of a tree of checkouts, one folder per source, in the shared folder."""
    d = tables.read_table(spark, sf_dir, "documents")
    name = F.element_at(F.array(*[F.lit(n) for n in TREE_NAMES]), (F.col("doc_id") % len(TREE_NAMES) + 1).cast("int"))
    name = F.replace(name, F.lit("#"), F.col("doc_id").cast("string"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}"
    tree.write_tree(d.select(F.concat("source", F.lit("/"), name).alias("path"), F.col("text").alias("content")), root)
    return root


@register("s1_source_tree", f"""
SELECT repo, path, CASE regexp_extract(path, '[.][^.]+$') WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' ELSE 'TypeScript' END AS language,
       bytes, sha256(content) AS content_sha256
FROM {_TREE_SQL} WHERE regexp_matches(path, '[^/][.](py|ts|tsx|js|jsx)$') AND NOT starts_with(path, 'node_modules/')""")
def s1_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = files.read_source_tree(spark, _written_tree(spark, sf_dir))
    return src.select("repo", "path", "language", "bytes", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


@register("s6_tree_sizes", _SIZES_SQL)
def s6_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repo_sizes(tree.list_source_tree(spark, _written_tree(spark, sf_dir)), TREE_CAP_MB)


@register("s6_files_of_accepted_trees", f"""
WITH s AS ({_SIZES_SQL})
SELECT repo, path, bytes FROM {_TREE_SQL} JOIN s USING (repo)
WHERE accepted AND regexp_matches(path, '[^/][.](py|ts|tsx|js|jsx)$') AND NOT starts_with(path, 'node_modules/')""")
def s6_files_of_accepted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_source_tree(spark, _written_tree(spark, sf_dir), max_mb=TREE_CAP_MB).select("repo", "path", "bytes")
