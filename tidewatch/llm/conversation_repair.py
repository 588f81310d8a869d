"""Conversation repair by a square-root checkpointed dynamic programme.

The cheapest edits (Keep, Rerole, Delete, Insert) that make the role initials of a
conversation read ``(s?(ua)+)?`` are a shortest path over (row, state), where the state is the
last role emitted (none, s, u, a).  The backward costs of all rows are never stored:

1. rows after damage are range-sorted by conversation and turn and cut into blocks.
   The k-th block of a stretch holds max(``LEAST_BLOCK``, 2k) rows, so n rows give about
   sqrt(n) blocks of about sqrt(n) rows, however long a conversation is;
2. every block, on its own, becomes a 4 x 4 matrix of least costs from state to state;
3. walking the blocks of a conversation backwards keeps one cost vector per block, its checkpoint;
4. every block, on its own, recomputes its rows' costs from its checkpoint and walks forward from each of
   the four states, always taking the ASCII-least move that is still cheapest;
5. walking the blocks forwards picks the state each starts in, and thereby its edits.

Only 3 and 5 (a few numbers per block) and the final digest, which hashes the text in order, run through the
blocks of one conversation in sequence; they stream and hold one block.  Rows alike in conversation,
turn, role and text are counted before the sort, so a mass of them is one row: all after the first are duplicates.

Costs: Keep 0, Rerole 3, Delete 4 (blank and duplicate rows must go), Insert 3, and 3 for a truncated row that is not deleted.

Defined results: a null conv_id is a conversation of its own; null role and text are one space, so a null text
is blank; null turns come first; rows of one turn are ordered by role, then text (by bytes); an empty role has no initial
and fits nowhere; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import source_key
from tidewatch.session import materialize, ship_package

LEAST_BLOCK = 64
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
# States: nothing emitted yet, or the last initial emitted.
START, S, U, A = range(4)
STATES = (START, S, U, A)
# The one role that may be inserted (or set) in a state, as the state it leads to.
NEXT = {START: U, S: U, U: A, A: U}
KEPT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
ROLE = {U: "user", A: "assistant"}
# Costs to finish without further rows.
END = (0, 2 * INSERT, INSERT, 0)
MUST_GO = "x"

Batches = Iterator[pa.RecordBatch]


def _moves(kind: str) -> list[list[tuple[str, int, int]]]:
    """Moves that consume a row, per state, in ASCII order: letter, cost, state after.
    A kind is ``x`` (must go) or the initial, in upper case where the row is truncated."""
    out = []
    for q in STATES:
        moves = [("D", DELETE, q)]
        if kind != MUST_GO:
            extra, initial = (TRUNCATED, kind.lower()) if kind.isupper() else (0, kind)
            if (initial, q) in KEPT:
                moves.append(("K", KEEP + extra, KEPT[initial, q]))
            moves.append(("R", REROLE + extra, NEXT[q]))
        out.append(moves)
    return out


MOVES = {kind: _moves(kind) for kind in "xsuaoSUAO"}


def row_kind(role: str, truncated: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def costs_before(kind: str, after: tuple) -> tuple:
    """Cost vector before a row from the one after it; inserts before the row included."""
    c = [min([cost + after[to] for _, cost, to in moves]) for moves in MOVES[kind]]
    u, a = min(c[U], INSERT + c[A]), min(c[A], INSERT + c[U])
    return min(c[START], INSERT + u), min(c[S], INSERT + u), u, a


def block_matrix(kinds: str) -> list[int]:
    """Least cost from state (row) to state (column) through the block, 16 numbers."""
    columns = []
    for to in STATES:
        v = tuple(0 if q == to else NEVER for q in STATES)
        for kind in reversed(kinds):
            v = costs_before(kind, v)
        columns.append(v)
    return [min(columns[to][q], NEVER) for q in STATES for to in STATES]


def walk(kinds: str, copies: list[int], end: tuple, last: bool) -> tuple[list[str], list[int]]:
    """ASCII-least cheapest edits through a block and the state after it, for every
    state before it.  ``end`` is the block's checkpoint; copies after a row's first are deleted."""
    vectors = [tuple(end)]
    for kind in reversed(kinds):
        vectors.append(costs_before(kind, vectors[-1]))
    vectors.reverse()
    audits, ends = [], []
    for q in STATES:
        audit, i = [], 0
        while i < len(kinds):
            left, after = vectors[i][q], vectors[i + 1]
            fits = {letter: to for letter, cost, to in MOVES[kinds[i]][q] if cost + after[to] == left}
            if "D" not in fits and INSERT + vectors[i][NEXT[q]] == left:
                audit.append("I")
                q = NEXT[q]
                continue
            letter = min(fits)
            q = fits[letter]
            audit.append(letter + "D" * (copies[i] - 1))
            i += 1
        while last and END[q]:
            audit.append("I")
            q = NEXT[q]
        audits.append("".join(audit))
        ends.append(q)
    return audits, ends


def edited(state: int, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that a block's edits leave."""
    row, seen = 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield "I", ROLE[state], ""
            continue
        if letter == "K":
            state = KEPT[roles[row][:1], state]
            yield "K", roles[row], texts[row]
        elif letter == "R":
            state = NEXT[state]
            yield "R", ROLE[state], texts[row]
        seen += 1
        if seen == copies[row]:
            row, seen = row + 1, 0


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by a hash of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = part("text")
    bare = text
    for mark in ".!?":
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return conversations.select(
        "conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(part("role")).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, bare).otherwise(text).alias("text"),
        F.when(how == 3, 2).otherwise(1).cast("long").alias("copies"), how.alias("__how")).filter("__how <> 0").drop("__how")


BLOCK_SCHEMA = """conv string, part int, block long, roles array<string>, texts array<string>, copies array<long>,
    marks string, digests array<binary>, turns long, first_turn long, last_turn long, illegal long, first_role string, last_role string"""


def _blocks(least: int):
    """Sorted rows to block rows."""
    def block(conv: str, part: int, number: int, rows: list) -> dict:
        marks, digests, seen = [], [], set()
        for _, role, text, _ in rows:
            said = text.strip(WHITE)
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            # b: blank; d: repeats a row of this block; t: truncated; f: nothing wrong so far.
            mark = "b" if not said else "d" if digest in seen else "t" if said[-1] not in ".!?" else "f"
            seen.add(digest)
            marks.append(mark)
            digests.append(digest if mark in "tf" else None)
        initials = [r[1][:1] for r in rows]
        pairs = [x + y for x, y in zip(initials, initials[1:])]
        turns = [r[0] for r in rows if r[0] is not None]
        return dict(conv=conv, part=part, block=number, roles=[r[1] for r in rows], texts=[r[2] for r in rows], copies=[r[3] for r in rows],
                    marks="".join(marks), digests=digests, turns=len(set(turns)), first_turn=turns[0] if turns else None, last_turn=turns[-1] if turns else None,
                    illegal=sum(p not in ("su", "ua", "au") for p in pairs) + sum(r[3] - 1 for r in rows), first_role=initials[0], last_role=initials[-1])

    def run(batches: Batches) -> Batches:
        conv, number, rows, part = None, 0, [], 0
        for b in batches:
            out = []
            for r in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "part"))):
                part = r[5]
                if rows and (r[0] != conv or len(rows) >= max(least, 2 * number)):
                    out.append(block(conv, part, number, rows))
                    number, rows = (number + 1 if r[0] == conv else 0), []
                conv = r[0]
                rows.append(r[1:5])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
        if rows:
            yield pa.RecordBatch.from_pylist([block(conv, part, number, rows)], schema=_BLOCK)
    return run


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    ("copies", _LONGS), ("marks", pa.string()), ("digests", pa.list_(pa.binary())), ("turns", pa.int64()), ("first_turn", pa.int64()),
                    ("last_turn", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string())])


def cut_blocks(rows: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """Written table of blocks from rows (conv_id, turn, role, text, copies)."""
    r = rows.select(source_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    r = r.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = ["conv", "turn", "role", "text"]  # nulls first
    r = r.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return materialize(r.mapInArrow(_blocks(least), BLOCK_SCHEMA), "conversation-blocks")


def _later_copies(blocks: DataFrame) -> DataFrame:
    """conv, part, block, again: places in the block of rows whose role and text an earlier block has."""
    from pyspark.sql import Window
    key = ["conv", "part", "block"]
    e = blocks.select(*key, F.posexplode("digests").alias("place", "digest")).filter("digest is not null")
    # One row per block and text: a text of every row of a conversation is as many rows as it has blocks.
    first = Window.partitionBy("conv", "digest").orderBy("part", "block")
    e = e.withColumn("__n", F.row_number().over(first)).filter("__n > 1")
    return e.groupBy(*key).agg(F.collect_list("place").alias("again"))


MATRIX_SCHEMA = """conv string, part int, block long, kinds string, copies array<long>, matrix array<long>, blank long, duplicate long, truncated long, extra long,
    turns long, first_turn long, last_turn long, illegal long, first_role string, last_role string"""
_PASS = ("turns", "first_turn", "last_turn", "illegal", "first_role", "last_role")


def _matrices(batches: Batches) -> Batches:
    for b in batches:
        cols = {n: [] for n in ("kinds", "matrix", "blank", "duplicate", "truncated", "extra")}
        for marks, initials, copies, again in zip(*(b.column(c).to_pylist() for c in ("marks", "initials", "copies", "again"))):
            later, kinds, faults = set(again or ()), [], dict.fromkeys("bdt", 0)
            for i, (mark, initial, n) in enumerate(zip(marks, initials, copies)):
                if mark in "bd" or i in later:
                    faults["b" if mark == "b" else "d"] += n
                    kinds.append(MUST_GO)
                else:
                    faults["d"] += n - 1
                    faults["t"] += mark == "t"
                    kinds.append(row_kind(initial, mark == "t"))
            kinds = "".join(kinds)
            for name, value in zip(cols, (kinds, block_matrix(kinds), faults["b"], faults["d"], faults["t"], DELETE * sum(n - 1 for n in copies))):
                cols[name].append(value)
        kinds = {"kinds": pa.string(), "matrix": _LONGS}
        made = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in cols.items()}
        names = [f.split()[0] for f in MATRIX_SCHEMA.split(",")]
        yield pa.RecordBatch.from_arrays([made[n] if n in made else b.column(n) for n in names], names=names)


def _checkpoints(batches: Batches) -> Batches:
    """Blocks of a conversation, last first: each gets the cost vector at its end."""
    conv, v = None, END
    for b in batches:
        ends, lasts, firsts = [], [], []
        for name, m in zip(b.column("conv").to_pylist(), b.column("matrix").to_pylist()):
            lasts.append(name != conv)
            if name != conv:
                conv, v = name, END
            ends.append(list(v))
            v = tuple(min(m[4 * q + to] + v[to] for to in STATES) for q in STATES)
            firsts.append(v[START])
        keep = [n for n in b.schema.names if n != "matrix"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(ends, _LONGS), pa.array(lasts, pa.bool_()), pa.array(firsts, pa.int64())],
                                         names=[*keep, "checkpoint", "last", "from_start"])


def _walks(batches: Batches) -> Batches:
    for b in batches:
        audits, ends = [], []
        for kinds, copies, end, last in zip(*(b.column(c).to_pylist() for c in ("kinds", "copies", "checkpoint", "last"))):
            a, e = walk(kinds, copies, tuple(end), last)
            audits.append(a)
            ends.append(e)
        keep = [n for n in b.schema.names if n not in ("kinds", "copies", "checkpoint")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(audits, pa.list_(pa.string())), pa.array(ends, _LONGS)],
                                         names=[*keep, "audits", "ends"])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
CHOSEN_SCHEMA = "conv string, part int, block long, state int, audit string, last boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def _choices(batches: Batches) -> Batches:
    """Blocks of a conversation, first first: the state each starts in, and its edits;
    the numbers of the whole conversation stand in its last block's row."""
    conv, state, sums, turn, role = None, START, {}, None, ""
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["conv"] != conv:
                conv, state, turn, role = r["conv"], START, None, None
                sums = dict.fromkeys(COUNTS, 0) | {"cost": r["from_start"], "low": None, "turns": 0}
            for name in ("blank", "duplicate", "truncated", "illegal"):
                sums[name] += r[name]
            sums["cost"] += r["extra"]
            if role is not None and role + r["first_role"] not in ("su", "ua", "au"):
                sums["illegal"] += 1
            role = r["last_role"]
            if r["first_turn"] is not None:
                sums["turns"] += r["turns"] - (turn == r["first_turn"])
                sums["low"] = r["first_turn"] if sums["low"] is None else sums["low"]
                turn = r["last_turn"]
                sums["gaps"] = turn - sums["low"] + 1 - sums["turns"]
            out.append(dict(conv=conv, part=r["part"], block=r["block"], state=state, audit=r["audits"][state], last=r["last"], **{c: sums[c] for c in COUNTS}))
            state = r["ends"][state]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CHOSEN)


_CHOSEN = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("last", pa.bool_()),
                     *((c, pa.int64()) for c in COUNTS)])


def choose_edits(blocks: DataFrame) -> DataFrame:
    """One row per block: the state it starts in and its edits (CHOSEN_SCHEMA)."""
    key = ["conv", "part", "block"]
    narrow = blocks.drop("texts", "digests").withColumn("initials", F.transform("roles", lambda r: F.substring(r, 1, 1))).drop("roles")
    m = narrow.join(_later_copies(blocks), key, "left").mapInArrow(_matrices, MATRIX_SCHEMA)
    m = m.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    after = MATRIX_SCHEMA.replace(" matrix array<long>,", "") + ", checkpoint array<long>, last boolean, from_start long"
    c = m.mapInArrow(_checkpoints, after).repartition(*key)
    for name in ("kinds string", "copies array<long>", "checkpoint array<long>"):
        after = after.replace(f" {name},", "")
    w = c.mapInArrow(_walks, after + ", audits array<string>, ends array<long>")
    return w.repartition("conv").sortWithinPartitions(*key).mapInArrow(_choices, CHOSEN_SCHEMA)


def repaired_rows(conversations: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """conv, part, block, place, edit, role, text: the rows of the repaired conversations in order."""
    e = _pieces(conversations, least_block)
    return e.select("conv", "part", "block", F.posexplode("rows").alias("place", "row")).select("conv", "part", "block", "place", "row.*")


def _pieces(rows: DataFrame, least: int) -> DataFrame:
    ship_package(rows.sparkSession)
    blocks = cut_blocks(rows, least)
    chosen = materialize(choose_edits(blocks), "conversation-edits")
    j = chosen.join(blocks.select("conv", "part", "block", "roles", "texts", "copies"), ["conv", "part", "block"])
    names = [f.split()[0] for f in CHOSEN_SCHEMA.split(", ")]
    row = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

    def run(batches: Batches) -> Batches:
        for b in batches:
            made = [[dict(zip(("edit", "role", "text"), x)) for x in edited(*r)]
                    for r in zip(*(b.column(c).to_pylist() for c in ("state", "audit", "roles", "texts", "copies")))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(made, row)], names=[*names, "rows"])

    return j.mapInArrow(run, CHOSEN_SCHEMA + ", rows array<struct<edit:string,role:string,text:string>>")


def _digests(batches: Batches) -> Batches:
    """Blocks of a conversation in order: its edits and the digest of its repaired text."""
    conv, audit, sha, said = None, [], hashlib.sha256(), False
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["conv"] != conv:
                conv, audit, sha, said = r["conv"], [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["said"] is not None:
                sha.update((("\n" if said else "") + r["said"]).encode())
                said = True
            if r["last"]:
                out.append(dict(conv=conv, audit="".join(audit), repaired_sha256=sha.hexdigest(), **{c: r[c] for c in COUNTS}))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_REPORT)


_REPORT = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def report(conversations: DataFrame, rows: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """One row per conv_id of ``conversations``: faults of its ``rows`` (conv_id, turn, role,
    text, copies), cost, audit and repaired_sha256."""
    said = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    p = _pieces(rows, least_block).withColumn("said", said).drop("rows", "state")
    p = p.repartition("conv").sortWithinPartitions("conv", "part", "block")
    found = p.mapInArrow(_digests, "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", source_key(F.col("conv_id")))
    j = ids.join(found, "conv", "left")
    return j.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
