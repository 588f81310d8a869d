"""Same-function taint and one-hop cross-function seeding as relational
queries (T1-T9).

Model (per scope; ``scope_id`` partitions everything, so outer variables are
invisible inside a function):
* every plain-name target of an assignment is a *definition* at the
  statement's pre-order ``pos``: ``gen`` (dynamic value), ``alias`` (value is
  a name ``src``), ``kill`` (any other value with exactly one target); other
  multi-target assignments define nothing;
* every function node named like a module-level function gets a ``param``
  definition of each of that function's parameter names at the node's own
  ``pos``: untainted, so pass 1 reads it exactly like "no definition"; in
  pass 2 the seeded ones are tainted.  Resolution is therefore computed once
  for both passes, and pass 2 only grows the tainted set from the seeds;
* the definition reaching a use at ``pos q`` is the latest one with a smaller
  ``pos`` (an as-of lookup: one window over defs + queries, queries ordered
  first on ties, so an assignment takes effect before the calls in its own
  right-hand side but ``x = x`` reads the old ``x``);
* a ``gen`` def is tainted; an ``alias`` def is tainted iff the def reaching
  its ``src`` is tainted, or - for a multi-target alias - the previous def of
  its own target is (the reference leaves such targets untouched);
* links always point to a smaller ``pos``, so one walk through a scope's defs and uses in
  order decides them all (``walk``): Spark sorts them by scope and ``pos``, the walk holds what the names of one scope
  hold at the moment.  A name holds "tainted" or the parameters it comes from, so the same walk serves both
  passes: pass 2 asks which of those parameters are seeded;
* links given as a table are followed by pointer jumping (``resolve_links``): every round each def follows its
  link several times, so paths grow four times as long, and a chain of n steps is settled after log4(n) rounds.
  Every round is a written table in the shared folder.  Tests hold the walk against this form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import PartTable, checkpoint_dir, materialize, ship_package

FILE = ["repo", "path"]
SCOPE = FILE + ["scope_id"]
DEF_KEY = SCOPE + ["var", "pos"]


def definitions(assigns: DataFrame) -> DataFrame:
    """Def events (repo, path, scope_id, var, pos, kind, src, single) from assigns."""
    t = assigns.select(*FILE, "scope_id", "pos", "n_targets", F.col("value.kind").alias("vkind"),
                       F.col("value.ident").alias("vident"), F.explode(F.array_distinct("targets")).alias("var"))
    t = t.filter(F.col("var").isNotNull())
    kind = (F.when(F.col("vkind") == "dynamic", "gen")
            .when(F.col("vkind") == "ident", "alias")
            .when(F.col("n_targets") == 1, "kill"))
    out = t.select(*FILE, "scope_id", "var", "pos", kind.alias("kind"),
                   F.when(F.col("vkind") == "ident", F.col("vident")).alias("src"),
                   (F.col("n_targets") == 1).alias("single"))
    return out.filter(F.col("kind").isNotNull())


def resolve(defs: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (repo, path, scope_id, var, pos, qkind, qvar, qpos, qidx)
    the pos of the latest def of (scope_id, var) strictly before ``pos``
    (``def_pos``, null when none)."""
    d = defs.select(*FILE, "scope_id", "var", "pos", F.lit(1).alias("is_def"),
                    F.lit(None).cast("string").alias("qkind"), F.lit(None).cast("string").alias("qvar"),
                    F.lit(None).cast("int").alias("qpos"), F.lit(None).cast("int").alias("qidx"))
    q = queries.select(*FILE, "scope_id", "var", "pos", F.lit(0).alias("is_def"), "qkind", "qvar", "qpos", "qidx")
    w = (Window.partitionBy(*FILE, "scope_id", "var").orderBy("pos", "is_def")
         .rowsBetween(Window.unboundedPreceding, -1))
    last_def = F.last(F.when(F.col("is_def") == 1, F.col("pos")), ignorenulls=True).over(w)
    return (d.unionByName(q).withColumn("def_pos", last_def).filter(F.col("is_def") == 0)
            .drop("is_def"))


def link_queries(defs: DataFrame) -> DataFrame:
    """Queries whose answers are the links of alias defs: the def reaching the
    source name, and (multi-target alias) the previous def of the target."""
    a = defs.filter(F.col("kind") == "alias")
    src = a.select(*FILE, "scope_id", F.col("src").alias("var"), "pos", F.lit("src").alias("qkind"),
                   F.col("var").alias("qvar"), F.col("pos").alias("qpos"), F.lit(None).cast("int").alias("qidx"))
    prev = a.filter(~F.col("single")).select(
        *FILE, "scope_id", "var", "pos", F.lit("prev").alias("qkind"), F.col("var").alias("qvar"),
        F.col("pos").alias("qpos"), F.lit(None).cast("int").alias("qidx"))
    return src.unionByName(prev)


def link_edges(resolved: DataFrame) -> DataFrame:
    """Edges alias-def -> def it depends on, from resolved link queries."""
    return (resolved.filter(F.col("qkind").isin("src", "prev") & F.col("def_pos").isNotNull())
            .select(*FILE, "scope_id", F.col("qvar").alias("var"), F.col("qpos").alias("pos"),
                    F.col("var").alias("t_var"), F.col("def_pos").alias("t_pos")))


# A link followed this many times per round makes paths (JUMPS + 1) times as long.
JUMPS = 3


@dataclass
class Links:
    """Resolved links: single-link defs with their root, and multi-target aliases."""
    roots: DataFrame   # DEF_KEY, r_var, r_pos
    multi: DataFrame   # DEF_KEY, t_var, t_pos (targets already roots)
    has_multi: bool

    def tainted(self, start: DataFrame) -> DataFrame:
        """Roots that are tainted when the defs ``start`` are (T4)."""
        known = start.select(*DEF_KEY).distinct()
        if not self.has_multi:
            return known
        # Scopes with multi-target aliases are read once more, in order: what a def depends on stands before it.
        none = F.lit(None)
        scopes = self.multi.select(*SCOPE).distinct()
        events = known.join(scopes, SCOPE, "left_semi").select(*DEF_KEY, none.cast("string").alias("t_var"), none.cast("int").alias("t_pos"))
        events = events.unionByName(self.multi).repartition(*SCOPE).sortWithinPartitions(*SCOPE, "pos", F.asc_nulls_first("t_var"))
        new = events.mapInArrow(_settle_in_order, events.select(*DEF_KEY).schema)
        return known.unionByName(materialize(new, "taint-new"))


def _settle_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tainted multi-target aliases.  Rows come by scope and ``pos``; a def without a target is tainted, one with a target
    is if its target is.  Holds the tainted defs of one scope."""
    scope, tainted = None, set()
    for b in batches:
        out = []
        for i, (*at, var, pos, t_var, t_pos) in enumerate(zip(*(b.column(c).to_pylist() for c in [*SCOPE, "var", "pos", "t_var", "t_pos"]))):
            if at != scope:
                scope, tainted = at, set()
            if t_var is None:
                tainted.add((var, pos))
            elif (t_var, t_pos) in tainted and (var, pos) not in tainted:
                tainted.add((var, pos))
                out.append(i)
        yield b.select(DEF_KEY).take(pa.array(out, pa.int32()))


def resolve_links(edges: DataFrame) -> Links:
    """Follow single links to their roots in a logarithmic number of rounds."""
    targets = edges.groupBy(*DEF_KEY).agg(F.collect_set(F.struct("t_var", "t_pos")).alias("to"))  # at most two
    targets = materialize(targets, "taint-links")
    at = targets.filter(F.size("to") == 1).select(*DEF_KEY, F.col("to")[0]["t_var"].alias("r_var"), F.col("to")[0]["t_pos"].alias("r_pos"))
    rounds, open_ = PartTable(edges.sparkSession, "taint-jumps"), at
    while True:
        step = at.select(*SCOPE, F.col("var").alias("r_var"), F.col("pos").alias("r_pos"), F.col("r_var").alias("n_var"), F.col("r_pos").alias("n_pos"))
        jump = open_
        for _ in range(JUMPS):  # several jumps per written table: fewer jobs for long chains
            jump = jump.join(step, SCOPE + ["r_var", "r_pos"], "left").select(
                *DEF_KEY, F.coalesce("n_var", "r_var").alias("r_var"), F.coalesce("n_pos", "r_pos").alias("r_pos"), F.col("n_pos").isNotNull().alias("moved"))
        # Defs that the last jump did not move stand at their root; only the others go on.
        open_ = rounds.add(jump).filter("moved").drop("moved")
        settled = rounds.all().filter(~F.col("moved")).drop("moved")
        if open_.isEmpty():
            break
        at = settled.unionByName(open_)
    multi = targets.filter(F.size("to") > 1).select(*DEF_KEY, F.explode("to").alias("t")).select(*DEF_KEY, "t.t_var", "t.t_pos")
    has_multi = not multi.isEmpty()
    if has_multi:
        r = settled.select(*SCOPE, F.col("var").alias("t_var"), F.col("pos").alias("t_pos"), "r_var", "r_pos")
        multi = materialize(multi.join(r, SCOPE + ["t_var", "t_pos"], "left").select(
            *DEF_KEY, F.coalesce("r_var", "t_var").alias("t_var"), F.coalesce("r_pos", "t_pos").alias("t_pos")), "taint-multi")
    return Links(settled, multi, has_multi)


def rooted(queries: DataFrame, links: Links) -> DataFrame:
    """Resolved queries with the root of the def that reaches them (r_var, r_pos)."""
    r = links.roots.select(*SCOPE, "var", F.col("pos").alias("def_pos"), "r_var", "r_pos")
    q = queries.join(r, SCOPE + ["var", "def_pos"], "left")
    return q.withColumn("r_var", F.coalesce("r_var", "var")).withColumn("r_pos", F.coalesce("r_pos", "def_pos"))


def taint_of(rooted_queries: DataFrame, tainted: DataFrame) -> DataFrame:
    """Mark rooted queries whose reaching def is tainted."""
    t = tainted.select(*SCOPE, F.col("var").alias("r_var"), F.col("pos").alias("r_pos"), F.lit(True).alias("hit"))
    return (rooted_queries.join(t, SCOPE + ["r_var", "r_pos"], "left")
            .withColumn("tainted", F.coalesce(F.col("hit"), F.lit(False))).drop("hit"))


# What a row of the walk is; uses come before the definitions at their place.
USE, GEN, ALIAS, ALIAS_OF_SEVERAL, PARAM, KILL = range(6)


def walk(defs: DataFrame, sink_queries: DataFrame) -> DataFrame:
    """The sink queries with ``tainted`` (the reaching def is tainted in pass 1) and ``params``: the parameters of the
    function around them that the value otherwise comes from; seeding one of those taints it in pass 2.

    One shuffle by scope.  Spark sorts the rows (and spills); a task holds the names of one scope that are not clean."""
    ship_package(defs.sparkSession)
    step = F.when(F.col("kind") == "gen", GEN).when(F.col("kind") == "alias", F.when(F.col("single"), ALIAS).otherwise(ALIAS_OF_SEVERAL)).when(
        F.col("kind") == "param", PARAM).otherwise(KILL)
    d = defs.select(*SCOPE, "pos", step.alias("step"), "var", "src", F.lit(None).cast("int").alias("qidx"))
    q = sink_queries.select(*SCOPE, "pos", F.lit(USE).alias("step"), "var", F.lit(None).cast("string").alias("src"), "qidx")
    events = d.unionByName(q).repartition(*SCOPE).sortWithinPartitions(*SCOPE, "pos", "step")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*SCOPE, "pos", "var", "qidx").schema)
    return events.mapInArrow(_walk_scopes, f"{keys}, tainted boolean, params array<string>")


def _either(a, b):
    """What a name holds that may hold either: True (tainted), or a set of parameters."""
    return True if a is True or b is True else a | b


def _walk_scopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """See ``walk``.  Rows come by scope and ``pos``; uses and defs of one ``pos`` see what stood before it."""
    clean = frozenset()
    scope, at, holds, new = None, None, {}, {}
    for b in batches:
        if not b.num_rows:
            continue
        rows, tainted, params = [], [], []
        # By column: strings become Python objects in one go, and only where a scope ends is looked for in its key.
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in SCOPE]
        begins = [True, *(keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])]
        begins[0] = scope != [k[0] for k in keys]
        scope = [k[-1] for k in keys]
        for i, (begin, pos, step, var, src) in enumerate(zip(begins, *(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("pos", "step", "var", "src")))):
            if begin:
                at, holds, new = pos, {}, {}
            elif pos != at:
                for name, value in new.items():
                    if value:
                        holds[name] = value
                    else:
                        holds.pop(name, None)
                at, new = pos, {}
            if step == USE:
                value = holds.get(var, clean)
                rows.append(i)
                tainted.append(value is True)
                params.append([] if value is True else sorted(value))
                continue
            if step == GEN:
                value = True
            elif step == ALIAS:
                value = holds.get(src, clean)
            elif step == ALIAS_OF_SEVERAL:
                value = _either(holds.get(src, clean), holds.get(var, clean))
            else:
                value = frozenset((var,)) if step == PARAM else clean
            new[var] = _either(new[var], value) if var in new else value
        asked = b.select([*SCOPE, "pos", "var", "qidx"]).take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(tainted, pa.bool_()), pa.array(params, pa.list_(pa.string()))],
                                         names=[*asked.schema.names, "tainted", "params"])


def seeded(sinks: DataFrame, seed_defs: DataFrame) -> DataFrame:
    """``sinks`` (of ``walk``) with ``tainted`` as in pass 2, where the parameters ``seed_defs`` (scope, var) are tainted too."""
    asked = sinks.select(*SCOPE, "pos", "qidx", F.explode("params").alias("var"))
    hit = asked.join(seed_defs.select(*SCOPE, "var"), SCOPE + ["var"], "left_semi").select(*SCOPE, "pos", "qidx", F.lit(True).alias("hit")).distinct()
    return (sinks.join(hit, SCOPE + ["pos", "qidx"], "left")
            .withColumn("tainted", F.col("tainted") | F.coalesce("hit", F.lit(False))).drop("hit"))


def analyse(defs: DataFrame, sink_queries: DataFrame) -> DataFrame:
    """The sink queries with a ``tainted`` flag (pass 1)."""
    checkpoint_dir(defs.sparkSession)
    return materialize(walk(defs, sink_queries), "taint-sinks")
