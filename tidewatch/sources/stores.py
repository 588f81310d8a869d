"""Persistent tables: baseline (S9, S10), verdict cache (S11), verdict and scan
history (S12, S13).

All are Parquet tables in a folder the caller names (on a cluster: a shared
file system or object store).  Writers never overwrite the table they read:
the cache is stored in slots by key, every version holds the slots it changed, and readers take
each slot from the newest version that has it.
The reference's single-document JSON formats are read with Spark's variant
functions (all JVM-side) and malformed input degrades to an empty table.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASELINE_FORMAT_VERSION = 1

BASELINE_SCHEMA = T.StructType([T.StructField("fingerprint", T.StringType(), False)])

# Column names and types of the stored tables.
VERDICT_FIELDS = ("verified", "confidence", "explanation", "exploit_scenario", "patch_suggestion",
                  "things_to_verify")
CACHE_SCHEMA = T.StructType([
    T.StructField("cache_key", T.StringType(), False),
    T.StructField("verified", T.BooleanType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("explanation", T.StringType(), True),
    T.StructField("exploit_scenario", T.StringType(), True),
    T.StructField("patch_suggestion", T.StringType(), True),
    T.StructField("things_to_verify", T.ArrayType(T.StringType()), True),
    T.StructField("seq", T.LongType(), True),
])

VALIDATIONS_SCHEMA = T.StructType([
    T.StructField("call_id", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("repository", T.StringType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField("function", T.StringType(), True),
    T.StructField("severity", T.StringType(), False),
    T.StructField("verified", T.IntegerType(), False),
    T.StructField("confidence", T.StringType(), False),
    T.StructField("validated_at", T.TimestampType(), False),
    T.StructField("validated_date", T.DateType(), False),
])

SCANS_SCHEMA = T.StructType([
    T.StructField("call_id", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("repository", T.StringType(), False),
    T.StructField("branch", T.StringType(), True),
    T.StructField("candidate_finding_count", T.LongType(), False),
    T.StructField("verified_finding_count", T.LongType(), False),
    T.StructField("risk_score", T.IntegerType(), False),
    T.StructField("scanned_at", T.TimestampType(), False),
    T.StructField("scan_date", T.DateType(), False),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# -- baseline ---------------------------------------------------------------

def write_baseline(fingerprints: DataFrame, path: str) -> None:
    """Distinct fingerprints, sorted, as a Parquet table (range-partitioned
    sort, so no single task holds them all)."""
    (fingerprints.select("fingerprint").distinct().orderBy("fingerprint")
     .write.mode("overwrite").parquet(path))


def baseline_document(fingerprints: DataFrame) -> DataFrame:
    """S9, the reference's one-document JSON form (``format_version`` +
    sorted list).  This is a single row by definition of the format; use it
    for one repository's baseline, the Parquet table for corpus scale."""
    return (fingerprints.agg(F.sort_array(F.collect_set("fingerprint")).alias("fingerprints"))
            .select(F.to_json(F.struct(F.lit(BASELINE_FORMAT_VERSION).alias("format_version"),
                                       F.coalesce("fingerprints", F.array().cast("array<string>"))
                                       .alias("fingerprints"))).alias("json")))


def parse_baseline_documents(docs: DataFrame, column: str = "value") -> DataFrame:
    """JSON baseline documents -> fingerprints.  Bad JSON, a non-object
    top level or a non-list ``fingerprints`` give nothing; non-string members
    are dropped."""
    spark = docs.sparkSession
    v = docs.select(F.try_parse_json(F.col(column)).alias("v"))
    return spark.sql(
        """SELECT CAST(e.value AS STRING) AS fingerprint
           FROM {v}, LATERAL variant_explode(variant_get(v, '$.fingerprints')) AS e
           WHERE startswith(schema_of_variant(v), 'OBJECT')
             AND startswith(schema_of_variant(variant_get(v, '$.fingerprints')), 'ARRAY')
             AND schema_of_variant(e.value) = 'STRING'""", v=v).distinct()


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet baseline folder or a JSON document; missing -> empty."""
    if not _exists(spark, path):
        return _empty(spark, BASELINE_SCHEMA)
    if path.endswith(".json"):
        return parse_baseline_documents(spark.read.text(path, wholetext=True))
    return spark.read.schema(BASELINE_SCHEMA).parquet(path)


# -- verdict cache ------------------------------------------------------------

CACHE_SLOTS = 256


def cache_slot(key=None):
    """The slot a cache key is stored in."""
    key = F.col("cache_key") if key is None else key
    return F.lower(F.lpad(F.hex(F.crc32(key.cast("binary")) % CACHE_SLOTS), 2, "0"))


def _folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names in a folder that start with ``prefix``, in order; none where there is no such folder."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(hpath)) if n.startswith(prefix))


def _cache_parts(spark: SparkSession, root: str) -> dict[str, str]:
    """Slot -> the folder with its newest rows: of the newest whole version and the later partial ones."""
    committed = _folders(spark, f"{root}/commits")
    whole = max((k for k, v in enumerate(committed) if v.endswith("-whole")), default=0)
    parts: dict[str, str] = {}
    for version in committed[whole:]:
        parts |= {name.split("=", 1)[1]: f"{root}/{version}/{name}" for name in _folders(spark, f"{root}/{version}", "slot=")}
    return parts


def load_cache(spark: SparkSession, root: str, enabled: bool = True, slots: set[str] | None = None) -> DataFrame:
    """The rows stored under ``root`` (of ``slots`` only, if given); disabled/missing/corrupt -> empty."""
    paths = [p for slot, p in sorted(_cache_parts(spark, root).items()) if slots is None or slot in slots] if enabled else []
    if not paths:
        return _empty(spark, CACHE_SCHEMA)
    try:
        df = spark.read.schema(CACHE_SCHEMA).parquet(*paths)
        df.limit(1).collect()      # surface a corrupt folder here, not later
        return df
    except Exception as e:
        # Only a damaged table counts as empty; a failed read of a sound one is an error,
        # since an empty cache means paying for every review again.
        if not any(mark in str(e) for mark in ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "CORRUPTED")):
            raise
        return _empty(spark, CACHE_SCHEMA)


def _write_version(rows: DataFrame, root: str, kind: str) -> str:
    """A version counts once its name stands among the commits, which happens after the write."""
    version = f"version={int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}-{kind}"
    out = rows.select(*[f.name for f in CACHE_SCHEMA.fields], cache_slot().alias("slot"))
    # One task per slot, so that a slot is one file.
    out.repartition("slot").write.mode("error").partitionBy("slot").parquet(f"{root}/{version}")
    jvm = rows.sparkSession.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{version}")
    mark.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(mark).close()
    return f"{root}/{version}"


def save_cache(cache: DataFrame, root: str, enabled: bool = True) -> str | None:
    """Write a whole cache as a new version, which replaces what was there; returns its path."""
    return _write_version(cache, root, "whole") if enabled else None


def update_cache(spark: SparkSession, root: str, new_rows: DataFrame, enabled: bool = True) -> str | None:
    """B6 on the stored cache: only the slots that ``new_rows`` (CACHE_SCHEMA) touch are read, merged (last
    write wins) and written; the other slots stay in the versions that hold them."""
    from tidewatch.operators.verdicts import latest_cache
    if not enabled:
        return None
    slots = {r["slot"] for r in new_rows.select(cache_slot().alias("slot")).distinct().collect()}  # at most CACHE_SLOTS
    if not slots:
        return None
    names = [f.name for f in CACHE_SCHEMA.fields]
    return _write_version(latest_cache(load_cache(spark, root, slots=slots).unionByName(new_rows.select(*names))), root, "part")


def compact_cache(spark: SparkSession, root: str) -> str | None:
    """Writes the cache as one whole version and deletes the versions before it."""
    old = _folders(spark, f"{root}/commits")
    path = save_cache(load_cache(spark, root), root)
    jvm = spark.sparkContext._jvm
    for version in old:
        for name in (f"{root}/commits/{version}", f"{root}/{version}"):
            hpath = jvm.org.apache.hadoop.fs.Path(name)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return path


def parse_cache_document(docs: DataFrame, column: str = "value") -> DataFrame:
    """The reference's JSON cache object ``{key: {six fields}}`` -> cache
    rows.  Entries with a missing or wrongly typed field become all-null (a
    miss at probe time)."""
    spark = docs.sparkSession
    v = docs.select(F.try_parse_json(F.col(column)).alias("v"))
    e = spark.sql("""SELECT e.key AS cache_key, e.value AS x FROM {v}, LATERAL variant_explode(v) AS e
                     WHERE startswith(schema_of_variant(v), 'OBJECT')""", v=v)
    ok = F.lit(True)
    typed = {
        "verified": ("boolean", "BOOLEAN"),
        "confidence": ("string", "STRING"),
        "explanation": ("string", "STRING"),
        "exploit_scenario": ("string", "STRING"),
        "patch_suggestion": ("string", "STRING"),
    }
    cols = []
    for name, (sql_type, vt) in typed.items():
        ok = ok & (F.expr(f"schema_of_variant(variant_get(x, '$.{name}'))") == F.lit(vt))
        cols.append((name, F.expr(f"try_variant_get(x, '$.{name}', '{sql_type}')")))
    ttv = F.expr("try_variant_get(x, '$.things_to_verify', 'array<string>')")
    ok = ok & ttv.isNotNull()
    out = e.select("cache_key", *[F.when(ok, c).alias(n) for n, c in cols],
                   F.when(ok, ttv).alias("things_to_verify"), F.lit(0).cast("long").alias("seq"))
    return out


# -- history ------------------------------------------------------------------

def _call_id() -> str:
    return f"{int(time.time() * 1e6):017d}-{uuid.uuid4().hex[:12]}"


def validation_rows(validated: DataFrame, repository_col: str = "repo") -> DataFrame:
    """S12 rows: one per validated finding, one timestamp per call."""
    return validated.select(
        F.lit(_call_id()).alias("call_id"),
        F.monotonically_increasing_id().alias("id"),
        F.col(repository_col).alias("repository"), "rule_id", "file", "function", "severity",
        F.col("verified").cast("int").alias("verified"), "confidence",
        F.current_timestamp().alias("validated_at"), F.to_date(F.current_timestamp()).alias("validated_date"))


def record_validations(validated: DataFrame, path: str, repository_col: str = "repo") -> None:
    """Append; an empty input appends nothing.  Folders are dates; inside a call's files rows lie by
    repository, so a reader of one repository skips files and row groups by their statistics, and the
    number of files does not follow the number of repositories."""
    rows = validation_rows(validated, repository_col)
    order = ["repository", "file", "id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("validated_date").parquet(path)


def scan_rows(candidates: DataFrame, validated: DataFrame | None, repos: DataFrame,
              branch: str | None = None) -> DataFrame:
    """S13 rows: one per repository with candidate / verified counts and the
    risk score of the verified findings (of the candidates when not validated)."""
    from tidewatch.operators.summary import summarize
    cand = candidates.groupBy("repo").agg(F.count(F.lit(1)).alias("candidate_finding_count"))
    if validated is not None:
        ver = validated.filter("verified")
        verc = ver.groupBy("repo").agg(F.count(F.lit(1)).alias("verified_finding_count"))
        score = summarize(ver, repos).select("repo", "risk_score")
    else:
        verc = cand.select("repo", F.lit(0).cast("long").alias("verified_finding_count"))
        score = summarize(candidates, repos).select("repo", "risk_score")
    now = F.current_timestamp()
    return (repos.select("repo").distinct().join(cand, "repo", "left").join(verc, "repo", "left")
            .join(score, "repo", "left")
            .select(F.lit(_call_id()).alias("call_id"), F.monotonically_increasing_id().alias("id"),
                    F.col("repo").alias("repository"), F.lit(branch).cast("string").alias("branch"),
                    F.coalesce("candidate_finding_count", F.lit(0).cast("long")).alias("candidate_finding_count"),
                    F.coalesce("verified_finding_count", F.lit(0).cast("long")).alias("verified_finding_count"),
                    F.coalesce("risk_score", F.lit(0)).cast("int").alias("risk_score"),
                    now.alias("scanned_at"), F.to_date(now).alias("scan_date")))


def record_scans(rows: DataFrame, path: str) -> None:
    """Append, partitioned by date."""
    rows.write.mode("append").partitionBy("scan_date").parquet(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not _exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).parquet(path)
