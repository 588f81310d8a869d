"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight (3, 1, 2 repeating, in code point order of the
sources, null last) and a schedule: how its weight changes over training time
0 .. 1, as straight lines between knots.  Targets share ``budget`` times all
words by weight; a target stops at ``max_epochs`` times its source's words and
the excess is shared again by weight (water filling, solved in closed form over
one row per source).

Each source's documents are put in a seeded order and read round and round;
the words read up to the target are taken (a copy counts if its middle word
lies before the target, so the taken words are within half a document of it).
The integral of the schedule says how many of a source's words are due by time
t; inverting it at a copy's middle word gives the copy's training position, and
``mix_documents`` range-sorts the copies by position.

Defined results: null or empty texts have size 0; a null source is a source of
its own and comes last; repeated rows are separate documents; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bucket_bits, n_words, running, seeded_hash, source_key

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2
# Knots (time, weight) of the schedules, dealt to the sources in the same order as the weights:
# early sources fade, the second kind stays level, the third is phased in and peaks late.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.6, 1.0), (1.0, 1.75)),
)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(__src, __total) -> plus __kind (place in the weight cycle) and __target.
    One row per source passes through these windows, never a document."""
    order = Window.orderBy(F.col("__src").startswith("n"), "__src")
    s = sizes.withColumn("__kind", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("__kind") + 1)
    s = s.withColumn("__w", w).withColumn("__cap", (F.col("__total") * max_epochs).cast("double"))
    # Sources reach their cap in the order of cap / weight.
    s = s.withColumn("__q", F.col("__cap") / F.col("__w"))
    by_cap = Window.orderBy("__q", "__src")
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = (s.withColumn("__goal", F.sum("__total").over(everything).cast("double") * F.lit(float(budget)))
          .withColumn("__level", (F.col("__goal") - F.coalesce(F.sum("__cap").over(done), F.lit(0.0))) / F.sum("__w").over(rest)))
    # The level of the first source that is not capped holds for all after it.
    s = s.withColumn("__fits", F.col("__level") < F.col("__q"))
    level = F.min(F.when(F.col("__fits"), F.struct("__q", "__src", "__level"))).over(everything)
    s = s.withColumn("__lambda", level["__level"])
    target = F.when(F.col("__lambda").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__lambda")))
    return s.select("__src", "__kind", target.alias("__target"))


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time at which ``share`` (0 .. 1) of a source's words are due:
    the inverse of the schedule's integral, solved piece by piece."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, start, piece = sum(areas), 0.0, None
        branches = []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            need = share * F.lit(whole) - F.lit(start)          # area wanted inside this piece
            slope = (w1 - w0) / (t1 - t0)
            if slope == 0:
                t = F.lit(t0) + need / F.lit(w0)
            else:
                t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            start += area
            branches.append((F.lit(start), t))
        piece = branches[-1][1]
        for upto, t in reversed(branches[:-1]):
            piece = F.when(share * F.lit(whole) < upto, t).otherwise(piece)
        out = F.when(kind == k, piece).otherwise(out)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 9)


def plan_mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
             schedules=SCHEDULES, seed: str = "mix-1") -> DataFrame:
    """``docs`` plus __size, __total (the source's words), __target, __copies
    and __positions (one training position per copy)."""
    n = docs.count()
    bits = bucket_bits(n)
    d = (docs.withColumn("__size", n_words(F.col("text"))).withColumn("__src", source_key(F.col("source"))))
    d = d.withColumn("__h", seeded_hash(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    d = d.withColumn("__b", F.shiftright("__h", 60 - bits))
    totals = d.groupBy("__src").agg(F.sum("__size").alias("__total"))
    targets = source_targets(totals, weights, budget, max_epochs)
    d = running(d, "__src", "__b", ["__h", "doc_id", "__size"], "__size").drop("__rank", "__n")
    # A left join, so that AQE may split a hot source; the targets have one row per source.
    d = d.join(targets, "__src", "left")
    mid = [F.lit(2 * e) * F.col("__total") + F.lit(2) * F.col("__before") + F.col("__size") for e in range(max_epochs)]
    taken = [m < F.lit(2.0) * F.col("__target") for m in mid]
    at = [F.when(t, position(m / (F.lit(2.0) * F.col("__target")), F.col("__kind"), schedules)) for t, m in zip(taken, mid)]
    d = d.withColumn("__positions", F.filter(F.array(*at), lambda p: p.isNotNull()))
    return d.withColumn("__copies", F.size("__positions").cast("long"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every taken copy of every document as a row with the
    columns of ``docs``, range-sorted by training position."""
    d = plan_mix(docs, **options)
    d = d.withColumn("__at", F.explode("__positions"))
    return d.orderBy("__at", "__h").select(*docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position, last_position."""
    d = plan_mix(docs.select("doc_id", "text", "source"), **options)
    return d.select(
        "doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"),
        F.get("__positions", F.lit(0)).alias("first_position"),
        F.get("__positions", F.col("__copies").cast("int") - 1).alias("last_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
