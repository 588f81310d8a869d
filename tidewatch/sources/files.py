"""Source discovery and file-level rules.

``read_source_tree`` lists every file with the data source of ``tree``; the path
filters and the size cap run on that table of names and lengths, and only files that stay
are opened.  Any table with ``repo, path, content`` works the same way through ``classify``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tree import list_source_tree, read_contents

# Supported extensions (case-sensitive last suffix) -> language.
EXTENSION_LANGUAGE = {".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript",
                      ".js": "JavaScript", ".jsx": "JavaScript"}
# Directory names never walked into (whole path part match).
IGNORED_DIRS = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next",
                "site-packages", "migrations")
# Markers of bundled or minified files (in the lower-cased file name).
MINIFIED_MARKERS = (".min.js", ".min.ts", "-min.js", "-min.ts", ".bundle.js")

MAX_REPO_SIZE_MB = 200
# Repository URL shape: https://<host>/<owner>/<name> with an optional trailing slash.
URL_PART = r"[\p{L}\p{N}_.-]+"
# The characters Python's str.strip() removes (str.isspace).
PY_SPACE = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def suffix(path_col):
    """Last suffix of the file name as pathlib gives it: from the last dot when
    that dot is neither the first nor the last character ('' for '.py')."""
    name = F.element_at(F.split(path_col, "/"), -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def language_of(path_col):
    """Language for a supported extension, else null."""
    m = F.create_map(*[x for k, v in EXTENSION_LANGUAGE.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, suffix(path_col))


def in_ignored_dir(rel_path_col):
    """S3: any path part equals an ignored directory name."""
    return F.arrays_overlap(F.split(rel_path_col, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_minified(path_col):
    """Lower-cased file name contains a bundle/minified marker."""
    name = F.lower(F.element_at(F.split(path_col, "/"), -1))
    cond = F.lit(False)
    for m in MINIFIED_MARKERS:
        cond = cond | name.contains(m)
    return cond


def decode_utf8(binary_col):
    """UTF-8 text with invalid bytes replaced by U+FFFD."""
    return F.make_valid_utf8(binary_col.cast("string"))


def classify(files: DataFrame) -> DataFrame:
    """S2-S4 on (repo, path, ...): keep supported, non-ignored, non-minified
    files and add ``language``."""
    out = files.withColumn("language", language_of(F.col("path")))
    return out.filter(F.col("language").isNotNull() & ~in_ignored_dir(F.col("path")) & ~is_minified(F.col("path")))


# Larger files are listed and not read (a Spark cell holds less than 2 GiB); a parameter of ``read_source_tree``.
MAX_FILE_BYTES = 1 << 30
TOO_LARGE = "not read: file too large"
NOT_OPENED = "not read: file could not be opened"


def not_read(sources: DataFrame):
    """Why a file of ``sources`` was listed without its content; null where it was read."""
    if "bytes" not in sources.columns:
        return F.lit(None).cast("string")
    missing = F.col("content").isNull() & (F.col("bytes") > 0)
    return F.when(missing & (F.col("bytes") > MAX_FILE_BYTES), TOO_LARGE).when(missing, NOT_OPENED)


def read_source_tree(spark: SparkSession, root: str, repo: str | None = None, max_mb: float | None = None,
                     max_file_bytes: int | None = None, listing: DataFrame | None = None) -> DataFrame:
    """S1 + S5: the code files under ``root`` as (repo, path, language, bytes, content).

    Every name is listed (``tree.list_source_tree``, whose table may be given as ``listing``); only files that S2-S4
    keep are opened.  With ``max_mb`` the repositories whose files (all of them, whatever their kind) are larger are left out
    (S6).  Files above ``max_file_bytes`` are listed with their length and a null content; a scan gives them a ``parse_error``.
    """
    listing = list_source_tree(spark, root, repo) if listing is None else listing
    kept = classify(listing)
    if max_mb is not None:
        kept = kept.join(repo_sizes(listing, max_mb).filter("accepted").select("repo"), "repo", "left_semi")
    read = read_contents(kept, root.rstrip("/") or "/", MAX_FILE_BYTES if max_file_bytes is None else max_file_bytes)
    return read.select("repo", "path", "language", "bytes", decode_utf8(F.col("content")).alias("content"))


def repo_sizes(files: DataFrame, max_mb: float = MAX_REPO_SIZE_MB) -> DataFrame:
    """Per repo total bytes of *all* files (before S2-S4), size in MiB, and
    whether it is accepted (strictly greater than the cap is rejected)."""
    agg = files.groupBy("repo").agg(F.sum("bytes").cast("long").alias("total_bytes"))
    size_mb = F.col("total_bytes").cast("double") / F.lit(1024.0 * 1024.0)
    return agg.select("repo", "total_bytes", size_mb.alias("size_mb"),
                      (size_mb <= F.lit(float(max_mb))).alias("accepted"))


def accepted_files(files: DataFrame, max_mb: float = MAX_REPO_SIZE_MB) -> DataFrame:
    """Files of accepted repositories (left-semi join on the per-repo flag)."""
    ok = repo_sizes(files, max_mb).filter("accepted").select("repo")
    return files.join(ok, "repo", "left_semi")


def normalize_repo_url(url_col, host_re: str = r"github\.com"):
    """Trim, strip trailing '/', strip one '.git'; valid if it is
    https://<host>/<owner>/<name> (owner/name: letters, digits, '_', '.', '-')."""
    u = F.regexp_replace(url_col, f"^{PY_SPACE}+|{PY_SPACE}+$", "")
    u = F.regexp_replace(u, r"/+\z", "")
    u = F.regexp_replace(u, r"\.git\z", "")
    valid = u.rlike(f"^https://{host_re}/{URL_PART}/{URL_PART}/?\\z")
    return u, valid


def history_key(url_col):
    """The history key only strips trailing slashes (so x and x.git differ)."""
    return F.regexp_replace(url_col, r"/+\z", "")


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """Files that differ between two snapshots of (repo, path, content):
    added, removed (deleted files count as changed) or modified (content hash).
    Only (repo, path, hash) is shuffled."""
    b = base.select("repo", "path", F.sha2(F.col("content"), 256).alias("h_base"))
    h = head.select("repo", "path", F.sha2(F.col("content"), 256).alias("h_head"))
    j = b.join(h, ["repo", "path"], "full")
    kind = (F.when(F.col("h_base").isNull(), "added").when(F.col("h_head").isNull(), "removed")
            .when(F.col("h_base") != F.col("h_head"), "modified"))
    return j.select("repo", "path", kind.alias("change_type")).filter(F.col("change_type").isNotNull())
