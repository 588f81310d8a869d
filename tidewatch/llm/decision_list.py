"""Quality rules as a learned decision list (DataFrame functions only).

Statistics of whole texts are computed by Spark expressions inside each row.
A decision list is learned from labelled statistics by sequential covering:
a rule is a conjunction of thresholds, grown on two thirds of the sample by
information gain, pruned on the other third, and the rows it covers are taken
out before the next rule is grown.  The list is emitted as one ordered Spark
``CASE WHEN`` expression.

Learning sees at most ``SAMPLE_ROWS`` labelled documents (the first in a seeded
order), so what reaches the driver is bounded; documents are judged in full.

Defined results: null and empty texts have no words and fail the base rule;
without labelled rows the list is empty and only the base rule removes; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import seeded_hash, words

SAMPLE_ROWS = 6000
MAX_RULES = 24
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
FEATURES = ("n_words", "word_length", "symbols", "exclamations", "dup_lines", "repeats", "distinct_words", "line_words")


def _count_of(text: Column, char: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


# Sorted list of (hash of three words << bits) | place, one entry per window, with just enough
# bits for the places.  Equal windows are then neighbours, so each is compared with the
# entries beside it (and verified word by word) instead of with all others.
CODED = ("case when __n >= 3 then sort_array(transform(sequence(0, __n - 3), "
         "i -> shiftleft(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)), __bits) | cast(i as bigint))) end")
BESIDE = " or ".join(
    f"(shiftright(x ^ get(__coded, i {d}), __bits) = 0 and "
    f"slice(__w, cast(x & __mask as int) + 1, 3) = slice(__w, cast(get(__coded, i {d}) & __mask as int) + 1, 3))" for d in ("- 1", "+ 1"))
# Words under the sorted places of repeated windows, each counted once.
COVERED = f"""
aggregate(sort_array(transform(filter(coalesce(__coded, array()), (x, i) -> coalesce({BESIDE}, false)), x -> x & __mask)),
          named_struct('upto', 0L, 'n', 0L),
          (a, p) -> named_struct('upto', p + 3, 'n', a.n + 3 - greatest(a.upto - p, 0L)), a -> a.n)"""


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and base_failed; the further features are kept in columns ``__f_*``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__w", words(F.col("text"))).withColumn("__n", F.size("__w"))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("__bits", F.ceil(F.log2(F.col("__n") + 1)).cast("int"))
    d = d.withColumn("__mask", F.expr("shiftleft(1L, __bits) - 1")).withColumn("__coded", F.expr(CODED))
    symbols = sum((_count_of(text, c) for c in SYMBOLS[1:]), _count_of(text, SYMBOLS[0]))
    numbers = {
        "n": F.col("__n").cast("long"), "chars": F.char_length(F.array_join("__w", "")).cast("long"), "symbols": symbols.cast("long"),
        "dup": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "repeat": F.expr(COVERED),
        "exclaim": _count_of(text, "!"), "n_lines": F.size("__lines"), "distinct": F.size(F.array_distinct("__w"))}
    # inline() also keeps Catalyst from pushing a caller's filter on a statistic below these
    # projections, which would compute the nested expressions again for every element.
    d = d.select(*docs.columns, F.inline(F.array(F.struct(*[v.alias(f"__s_{k}") for k, v in numbers.items()]))))
    n, per_word = F.col("__s_n"), lambda c: F.col(c) / F.greatest(F.col("__s_n"), F.lit(1))
    values = {
        "n_words": n.cast("double"), "word_length": per_word("__s_chars"), "symbols": per_word("__s_symbols"),
        "exclamations": per_word("__s_exclaim"), "dup_lines": F.col("__s_dup") / F.greatest(F.col("__s_n_lines"), F.lit(1)),
        "repeats": per_word("__s_repeat"), "distinct_words": per_word("__s_distinct"),
        "line_words": n / F.greatest(F.col("__s_n_lines"), F.lit(1)),
    }
    failed = (n < MIN_WORDS) | (F.col("__s_repeat") * 100 > n * 50)
    own = {"n_words": n, "word_chars": F.col("__s_chars"), "n_symbols": F.col("__s_symbols"),
           "n_dup_lines": F.col("__s_dup"), "n_repeat_words": F.col("__s_repeat"), "base_failed": failed}
    kept = [c for c in docs.columns if c not in own]
    return d.select(*kept, *[v.alias(k) for k, v in own.items()], *[values[f].alias(f"__f_{f}") for f in FEATURES])


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[int, bool, float], ...]  # (feature, value is above, threshold)
    label: int
    covered: int = 0
    wrong: int = 0

    def holds(self, row) -> bool:
        return all((row[f] > t) == above for f, above, t in self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions) + f" -> {self.label}"


def _cuts(rows, steps: int = 48) -> list[list[float]]:
    """Candidate thresholds of each feature: midpoints between neighbouring quantiles."""
    cuts = []
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        picked = values if len(values) <= steps else [values[i * (len(values) - 1) // (steps - 1)] for i in range(steps)]
        cuts.append([(a + b) / 2 for a, b in zip(picked, picked[1:])])
    return cuts


def _grow(rows, cuts, target: int):
    inside, conditions = rows, []
    while True:
        good = sum(r[-1] == target for r in inside)
        if good == len(inside) or not good:
            return conditions
        now, best = math.log2(good / len(inside)), (1e-9, None)
        for f in range(len(FEATURES)):
            for t in cuts[f]:
                up = [r for r in inside if r[f] > t]
                g_up = sum(r[-1] == target for r in up)
                for above, n, g in ((True, len(up), g_up), (False, len(inside) - len(up), good - g_up)):
                    if g and (gain := g * (math.log2(g / n) - now)) > best[0]:
                        best = (gain, (f, above, t))
        if best[1] is None:
            return conditions
        f, above, t = best[1]
        conditions.append(best[1])
        inside = [r for r in inside if (r[f] > t) == above]


def learn(rows: list[tuple]) -> list[Rule]:
    """Sequential covering over (feature values ..., label): rules for the rarer
    label, in order; rows that no rule covers get the commoner one."""
    if not rows:
        return []
    ones = sum(r[-1] for r in rows)
    target = 1 if ones * 2 < len(rows) else 0
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(r[-1] == target for r in grow):
        conditions = _grow(grow, _cuts(grow), target)
        if not conditions:
            break

        def worth(kept: int) -> tuple[float, int]:
            rule = Rule(tuple(conditions[:kept]), target)
            hit = [r[-1] == target for r in prune if rule.holds(r)]
            return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, -kept)

        kept = -max(worth(k) for k in range(1, len(conditions) + 1))[1]
        rule = Rule(tuple(conditions[:kept]), target)
        hit = [r[-1] == target for r in prune if rule.holds(r)]
        if hit and sum(hit) * 2 <= len(hit):
            break
        both = [r[-1] == target for r in grow if rule.holds(r)] + hit
        rules.append(Rule(rule.conditions, target, len(both), len(both) - sum(both)))
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def rule_expression(rules: list[Rule], value) -> Column:
    """Ordered conditional: ``value(i, rule)`` of the first rule that holds, else ``value(-1, None)``."""
    out = None
    for i, r in enumerate(rules):
        test = F.lit(True)
        for f, above, t in r.conditions:
            c = F.col(f"__f_{FEATURES[f]}")
            test = test & ((c > t) if above else (c <= t))
        out = F.when(test, value(i, r)) if out is None else out.when(test, value(i, r))
    return value(-1, None) if out is None else out.otherwise(value(-1, None))


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: str = "rules-1") -> list[Rule]:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality"), seeded_hash(seed, F.col("doc_id")).alias("__order"))
    sample = known.orderBy("__order", "__id", "__quality").limit(sample_rows)  # bounded: it is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    # What fails the base rule is removed anyway; the list is learned on the rest.
    rows = text_statistics(rows.select("text", "__quality", "__order")).filter(~F.col("base_failed"))
    # Repeated ids give one row, the least statistics: at most ``sample_rows`` rows, the same in every run.
    least = F.min(F.struct(*[f"__f_{f}" for f in FEATURES])).alias("__f")
    rows = rows.groupBy("__order", "__quality").agg(least).select("__order", "__f.*", "__quality").collect()
    return learn([tuple(r)[1:] for r in sorted(rows, key=tuple)])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base_failed, kept and the rule that decided (-1: none)."""
    default = 1 if not rules else 1 - rules[0].label
    d = text_statistics(docs)
    verdict = rule_expression(rules, lambda i, r: F.lit((default if r is None else r.label) == 1))
    rule = rule_expression(rules, lambda i, r: F.lit(i))
    d = d.withColumn("kept", ~F.col("base_failed") & verdict).withColumn("rule", rule)
    return d.drop(*[f"__f_{f}" for f in FEATURES])
