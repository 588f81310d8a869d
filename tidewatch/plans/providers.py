"""Verdict providers: DataFrame functions (prompts, batched findings) ->
verdict documents (batch_id, doc).

``labels_provider`` stands in for a model: it answers from the ``labels``
table (finding file = doc_id).  Members without a label get no result, which
exercises the missing-verdict default.  A real model is plugged in the same
way, e.g. with ``mapInPandas`` over ``prompts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_verdict_cols(quality, toxic):
    """The verdict a label stands for (same expressions in the oracle SQL)."""
    verified = quality == F.lit(1)
    confidence = F.when(toxic == 1, "low").when(quality == 1, "high").otherwise("medium")
    explanation = F.concat(F.lit("label quality="), quality.cast("string"), F.lit(", toxic="), toxic.cast("string"))
    return verified, confidence, explanation


def labels_provider(labels: DataFrame):
    lab = labels.select(F.col("doc_id").cast("string").alias("file"), "quality", "toxic")

    def provide(prompts: DataFrame, batched: DataFrame) -> DataFrame:
        del prompts  # the stand-in answers from labels, not from the prompt text
        verified, confidence, explanation = label_verdict_cols(F.col("quality"), F.col("toxic"))
        members = batched.select("batch_id", "idx", "file").join(lab, "file", "inner")
        result = F.struct(F.col("idx").cast("long").alias("index"), verified.alias("verified"),
                          confidence.alias("confidence"), explanation.alias("explanation"),
                          F.lit("").alias("exploit_scenario"), F.lit("").alias("patch_suggestion"),
                          F.array(F.lit("check the label")).alias("things_to_verify"))
        return (members.groupBy("batch_id").agg(F.collect_list(result).alias("results"))
                .select("batch_id", F.to_json(F.struct("results")).alias("doc")))
    return provide
