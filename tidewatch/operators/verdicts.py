"""Review-verdict stage.

Flow (``validate_findings``): cache key (B4) -> cache probe (B5) -> misses
numbered in request order and cut into batches of 8 (O6) -> one prompt per
batch (V1) -> a *provider* turns prompts into verdict documents (the caller's
model, or any DataFrame function; no network code here), written once -> documents parsed
with an explicit schema (V2, V3) -> verdicts joined back by (batch, index)
with defaults for missing ones (B7) -> hits + merged, cache upsert (B6).

Scale notes: numbering uses per-file row numbers plus per-repo file offsets
(a window over one row per file, not over all findings); every group that is
collected is one batch (at most 8 rows).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.catalog import CONFIDENCE_SORT_RANK, SEVERITY_SORT_RANK
from tidewatch.session import materialize

PROMPT_VERSION = "v1"
BATCH_SIZE = 8

# Verdict given to a finding the provider returned nothing for (own wording).
MISSING_EXPLANATION = "The reviewer returned no verdict for this finding."
MISSING_TODO = "Review this finding by hand or run the review again."

VERDICT_DOC_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("index", T.LongType(), True),
        T.StructField("verified", T.BooleanType(), True),
        T.StructField("confidence", T.StringType(), True),
        T.StructField("explanation", T.StringType(), True),
        T.StructField("exploit_scenario", T.StringType(), True),
        T.StructField("patch_suggestion", T.StringType(), True),
        T.StructField("things_to_verify", T.ArrayType(T.StringType()), True),
    ])), True),
])

VERDICT_COLS = ("verified", "confidence", "explanation", "exploit_scenario", "patch_suggestion",
                "things_to_verify")


def cache_key_col(prompt_version: str = PROMPT_VERSION):
    """sha256 of ``prompt_version:rule_id:snippet`` (no file, line, function)."""
    return F.sha2(F.concat(F.lit(prompt_version + ":"), F.col("rule_id"), F.lit(":"), F.col("snippet")), 256)


def probe_cache(findings: DataFrame, cache: DataFrame, prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """Findings + cache columns + ``cache_hit`` (all six fields present).
    The cache keeps its newest row per key first (B6 semantics)."""
    c = latest_cache(cache).select("cache_key", *[F.col(v).alias("c_" + v) for v in VERDICT_COLS])
    keyed = findings.withColumn("cache_key", cache_key_col(prompt_version))
    out = keyed.join(c, "cache_key", "left")
    hit = F.lit(True)
    for v in VERDICT_COLS:
        hit = hit & F.col("c_" + v).isNotNull()
    return out.withColumn("cache_hit", hit)


def latest_cache(cache: DataFrame) -> DataFrame:
    """One row per key: the highest ``seq`` wins (last write)."""
    best = F.max_by(F.struct(*[F.col(v) for v in VERDICT_COLS]), F.col("seq"))
    return (cache.groupBy("cache_key").agg(best.alias("b"), F.max("seq").alias("seq"))
            .select("cache_key", *[F.col("b." + v).alias(v) for v in VERDICT_COLS], "seq"))


def upsert_cache(cache: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Last write wins per key.  Within one call the verdicts are recorded
    in request order, so among new rows sharing a key (same rule and snippet)
    the last one in (repo, position) order wins; new rows then carry the write
    time in microseconds as ``seq`` and win over every older row."""
    base = cache.select("cache_key", *VERDICT_COLS, F.col("seq").cast("long"))
    return latest_cache(base.unionByName(cache_rows(new_rows)))


def cache_rows(new_rows: DataFrame) -> DataFrame:
    """Cache rows of newly merged verdicts, one per key."""
    last = F.max_by(F.struct(*[F.col(v) for v in VERDICT_COLS]), F.struct("repo", "position"))
    return (new_rows.groupBy("cache_key").agg(last.alias("b"))
            .select("cache_key", *[F.col("b." + v).alias(v) for v in VERDICT_COLS],
                    F.unix_micros(F.current_timestamp()).alias("seq")))


def request_positions(findings: DataFrame, order_cols=("file", "line", "ord")) -> DataFrame:
    """O6 helper: 0-based position of each finding within its repo in request
    order, without a window over all findings, or all files, of a repo: row number within
    (repo, file) + findings in earlier files.  Files are range-sorted into parts; a
    file's offset is that of its part (one row per repo and part) plus what lies before it inside the part."""
    first, rest = order_cols[0], list(order_cols[1:])
    w_file = Window.partitionBy("repo", first).orderBy(*rest)
    numbered = findings.withColumn("_rn", F.row_number().over(w_file) - 1)
    per_file = findings.groupBy("repo", first).agg(F.count(F.lit(1)).alias("_n"))
    # Written once: the parts of a range sort are what they are only within one run.
    parts = materialize(per_file.repartitionByRange("repo", first).withColumn("_part", F.spark_partition_id()), "file-counts")
    ahead = lambda *key, by: Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("repo", "_part").agg(F.sum("_n").alias("_pn"))
    sums = sums.select("repo", "_part", F.coalesce(F.sum("_pn").over(ahead("repo", by="_part")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(ahead("repo", "_part", by=first)), F.lit(0))
    offsets = parts.withColumn("_in", inside).join(sums, ["repo", "_part"]).select(
        F.col("repo").alias("_repo"), F.col(first).alias("_first"), (F.col("_before") + F.col("_in")).cast("long").alias("_off"))
    same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col(first).eqNullSafe(F.col("_first"))
    return numbered.join(offsets, same).withColumn("position", F.col("_off") + F.col("_rn")).drop("_rn", "_off", "_repo", "_first")


def assign_batches(misses: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches of ``batch_size`` per repository in request order;
    ``batch_id`` is unique across repos, ``idx`` is the position in the batch."""
    pos = request_positions(misses)
    b = F.floor(F.col("position") / batch_size).cast("long")
    return (pos.withColumn("batch_no", b)
            .withColumn("idx", (F.col("position") - F.col("batch_no") * batch_size).cast("int"))
            .withColumn("batch_id", F.concat_ws("#", F.col("repo"), F.col("batch_no").cast("string"))))


# V1: own prompt form.  A finding is one JSON line, so no text of a finding can be taken for a label.
PROMPT_HEAD = ("You get candidate security findings, one JSON object per line. Judge each from its code alone: "
               "is it a real weakness?\n")
PROMPT_TAIL = ("\nReply with one JSON document {\"results\": [...]}, one entry per line above, with the keys " +
               ", ".join(("index", *VERDICT_COLS)) + "; index is the line's n.")


def finding_line(idx):
    """V1: one finding as a JSON object."""
    c = F.col
    return F.to_json(F.struct(
        idx.alias("n"), c("rule_id").alias("rule"), c("title").alias("what"), F.coalesce(c("cwe"), F.lit("")).alias("weakness"),
        F.concat(c("file"), F.lit(":"), c("line").cast("string")).alias("at"), F.coalesce(c("function"), F.lit("")).alias("scope"),
        c("description").alias("why"), c("snippet").alias("code")))


def build_prompts(batched: DataFrame) -> DataFrame:
    """V1: (batch_id, repo, n, prompt) - the group is one batch (<= 8 rows)."""
    lines = batched.select("batch_id", "repo", "idx", finding_line(F.col("idx")).alias("line"))
    agg = lines.groupBy("batch_id", "repo").agg(
        F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("parts"), F.count(F.lit(1)).alias("n"))
    return agg.select("batch_id", "repo", "n", F.concat(
        F.lit(PROMPT_HEAD), F.array_join(F.transform("parts", lambda p: p["line"]), "\n"),
        F.lit(PROMPT_TAIL)).alias("prompt"))


def parse_verdicts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V3: verdict documents (batch_id, doc) -> (verdict rows, error rows).

    A document that is not JSON, lacks ``results``, or has an element missing
    a required field (``things_to_verify`` may be missing -> empty list) makes
    an error row for its batch.  A repeated index keeps the last element.
    """
    parsed = docs.select("batch_id", F.from_json("doc", VERDICT_DOC_SCHEMA).alias("p"),
                         F.try_parse_json("doc").isNotNull().alias("is_json"))
    # Every element needs index and the five scalar fields, typed as the schema says.
    elems_ok = F.forall("p.results", lambda r: r["index"].isNotNull() & r["verified"].isNotNull()
                        & r["confidence"].isNotNull() & r["explanation"].isNotNull()
                        & r["exploit_scenario"].isNotNull() & r["patch_suggestion"].isNotNull())
    ok = F.coalesce(F.col("p.results").isNotNull() & elems_ok, F.lit(False))
    good = parsed.filter(ok)
    errors = parsed.filter(~ok).select(
        "batch_id", F.when(~F.col("is_json"), F.lit("document is not JSON"))
        .otherwise(F.lit("document does not match the verdict schema")).alias("error")).distinct()
    rows = good.select("batch_id", F.posexplode("p.results").alias("pos", "r"))
    last = F.max_by(F.col("r"), F.col("pos"))
    verdicts = (rows.groupBy("batch_id", F.col("r.index").alias("idx")).agg(last.alias("r"))
                .select("batch_id", F.col("idx").cast("int").alias("idx"),
                        *[F.col("r." + c).alias(c) for c in VERDICT_COLS[:-1]],
                        F.coalesce(F.col("r.things_to_verify"), F.array().cast("array<string>"))
                        .alias("things_to_verify")))
    return verdicts, errors


def merge_verdicts(batched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts joined back by (batch_id, idx); a finding without one gets
    unverified / low / fixed text."""
    v = verdicts.select("batch_id", "idx", *[F.col(c).alias("v_" + c) for c in VERDICT_COLS])
    j = batched.join(v, ["batch_id", "idx"], "left")
    found = F.col("v_confidence").isNotNull() | F.col("v_verified").isNotNull()
    return j.select(
        *[c for c in batched.columns],
        F.when(found, F.col("v_verified")).otherwise(F.lit(False)).alias("verified"),
        F.when(found, F.col("v_confidence")).otherwise(F.lit("low")).alias("confidence"),
        F.when(found, F.col("v_explanation")).otherwise(F.lit(MISSING_EXPLANATION)).alias("explanation"),
        F.when(found, F.col("v_exploit_scenario")).otherwise(F.lit("")).alias("exploit_scenario"),
        F.when(found, F.col("v_patch_suggestion")).otherwise(F.lit("")).alias("patch_suggestion"),
        F.when(found, F.col("v_things_to_verify")).otherwise(F.array(F.lit(MISSING_TODO)))
        .alias("things_to_verify"),
    )


@dataclass
class VerdictResult:
    validated: DataFrame      # findings + six verdict fields (hits and merged misses)
    new_cache: DataFrame      # cache after upsert of the newly merged verdicts
    new_rows: DataFrame       # only the newly merged verdicts, for ``stores.update_cache``
    errors: DataFrame         # (batch_id, error) for documents that could not be parsed
    prompts: DataFrame        # (batch_id, repo, n, prompt)


Provider = Callable[[DataFrame, DataFrame], DataFrame]   # (prompts, batched) -> (batch_id, doc)


class VerdictError(RuntimeError):
    """A verdict document could not be read and the caller asked to stop then."""


def validate_findings(findings: DataFrame, cache: DataFrame, provider: Provider, batch_size: int = BATCH_SIZE,
                      prompt_version: str = PROMPT_VERSION, fail_fast: bool = False) -> VerdictResult:
    """V4 end to end.

    Batches and documents are written once before anything reads them, so the
    provider answers each batch once however often the result is used.  Findings
    of a batch whose document cannot be read stay in ``validated`` with the verdict of a
    missing one (B7), are listed in ``errors`` and are not cached; with
    ``fail_fast`` the first such document raises ``VerdictError`` instead.
    """
    finding_cols = list(findings.columns)
    probed = probe_cache(findings, cache, prompt_version)
    hits = probed.filter("cache_hit").select(*finding_cols, *[F.col("c_" + v).alias(v) for v in VERDICT_COLS])
    misses = probed.filter(~F.col("cache_hit")).select(*finding_cols, "cache_key")
    batched = materialize(assign_batches(misses, batch_size), "verdict-batches")
    prompts = build_prompts(batched)
    docs = materialize(provider(prompts, batched).select("batch_id", "doc"), "verdict-documents")
    verdicts, errors = parse_verdicts(docs)
    if fail_fast and (bad := errors.first()) is not None:
        raise VerdictError(f"batch {bad['batch_id']}: {bad['error']}")
    broken = errors.select("batch_id").distinct()
    # A batch with one bad document gets no verdict from any other either.
    merged = merge_verdicts(batched, verdicts.join(broken, "batch_id", "left_anti"))
    validated = hits.unionByName(merged.select(*finding_cols, *VERDICT_COLS))
    sound = merged.join(broken, "batch_id", "left_anti")
    fresh = sound.select("cache_key", "repo", "position", *VERDICT_COLS)
    return VerdictResult(validated, upsert_cache(cache, fresh), cache_rows(fresh), errors, prompts)


def split_verified(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, dismissed)."""
    return validated.filter(F.col("verified")), validated.filter(~F.col("verified"))


def _rank_map(m: dict[str, int], col, default: int = 3):
    r = F.lit(default)
    for k, v in m.items():
        r = F.when(col == F.lit(k), F.lit(v)).otherwise(r)
    return r


def rank_keys(df: DataFrame) -> DataFrame:
    """O1 sort keys (case-sensitive, unknown = 3); sort by them, then the
    original request order (file, line, ord) to keep it stable."""
    return (df.withColumn("severity_rank", _rank_map(SEVERITY_SORT_RANK, F.col("severity")))
            .withColumn("confidence_rank", _rank_map(CONFIDENCE_SORT_RANK, F.col("confidence"))))


def rank_verified(verified: DataFrame) -> DataFrame:
    """O1: ordered verified findings."""
    return rank_keys(verified).orderBy("repo", "severity_rank", "confidence_rank", "file", "line", "ord")
