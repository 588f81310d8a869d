"""Conversation repair against a plain shortest path over whole audits."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

from llm_tables import tables

from tidewatch.llm import conversation_repair as cr
from tidewatch.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for r in rows:
        conv, turn = r["conv_id"], r["turn"]
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = r["role"] if r["role"] is not None else " ", r["text"] if r["text"] is not None else " "
        got = out[conv]
        if how:
            role = "user" if how == 4 else role
            text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
            got += [(turn, role, text)] * (2 if how == 3 else 1)
    for got in out.values():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one damaged conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    best = {}
    for i in range(len(rows), -1, -1):
        def one(state, inserts=3, i=i):
            found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if inserts:
                c, a, out = one(follow[state], inserts - 1)
                name = "user" if follow[state] == "u" else "assistant"
                found.append((c + 3, "I" + a, (name + ":",) + out))
            if i < len(rows):
                _, role, text = rows[i]
                c, a, out = best[i + 1, state]
                found.append((c + 4, "D" + a, out))
                if faults[i] not in ("blank", "duplicate"):
                    extra, first = 3 * (faults[i] == "truncated"), role[:1]
                    if first and (first == follow[state] or first == "s" and state == ""):
                        c, a, out = best[i + 1, first]
                        found.append((c + extra, "K" + a, (f"{role}:{text}",) + out))
                    c, a, out = best[i + 1, follow[state]]
                    found.append((c + 3 + extra, "R" + a, ({"u": "user", "a": "assistant"}[follow[state]] + ":" + text,) + out))
            return min(found, default=(1 << 40, "", ()))
        for state in follow:
            best[i, state] = one(state)
    cost, audit, said = best[0, ""]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def want(rows):
    return {conv: repaired(got) for conv, got in damaged(rows).items()}


def got(df):
    out = {r[0]: tuple(r)[1:] for r in df.collect()}
    return out


def test_against_shortest_path(spark, edge):
    assert got(QUERIES["op12_conversation_repair"](spark, edge)) == want(tables()["conversations"])


def conversations(seed, n, rows):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(r.randrange(rows)):
            out.append({"conv_id": conv, "turn": r.choice([turn, turn, turn, turn + 3, None]), "role": r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]),
                        "text": r.choice(["Yes.", "no", "ok!", " ", "", "Why?\n", "Dann . ", "日本", f"own {turn}.", f"own {turn}", None, "a.b.c"])})
    return out


def test_random_conversations_in_small_blocks(spark):
    rows = conversations(12, 150, 12) + [dict(r, conv_id=-1) for r in conversations(3, 40, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    expected = want(rows)
    for least in (1, 3, 64):
        assert got(cr.report(df, cr.damage(df), least)) == expected, least


def test_repeated_rows_and_one_long_conversation(spark):
    r = random.Random(5)
    rows = [{"conv_id": 1, "turn": i, "role": r.choice(["user", "assistant"]), "text": r.choice(["Yes.", "Ok.", f"t{i}.", f"t{i}"])} for i in range(3000)]
    rows += [{"conv_id": 1, "turn": 7, "role": "user", "text": "again."}] * 500 + [{"conv_id": 2, "turn": None, "role": "user", "text": " "}] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    blocks = cr.cut_blocks(cr.damage(df), 4).filter("conv = 's1'")
    assert blocks.count() < 200 and max(len(b.roles) for b in blocks.select("roles").collect()) < 250  # about the square root of the rows
    assert got(cr.report(df, cr.damage(df), 4)) == want(rows)


def test_rows_of_the_repaired_conversations(spark):
    rows = conversations(9, 30, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = defaultdict(list)
    for r in sorted(cr.repaired_rows(cr.damage(df), 3).collect(), key=lambda r: (r.conv, r.part, r.block, r.place)):
        said[int(r.conv[1:])].append(f"{r.role}:{r.text}")
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    for conv, w in want(rows).items():
        assert hashlib.sha256("\n".join(said[conv]).encode()).hexdigest() == w[-1]


def test_walk_takes_the_least_of_equal_edits():
    @cache
    def words(n):
        return [""] if n == 0 else [w + c for w in words(n - 1) for c in "xsuaoSUAO"]
    for kinds in words(4):
        v = cr.END
        for kind in reversed(kinds):
            v = cr.costs_before(kind, v)
        audits, ends = cr.walk(kinds, [1] * 4, cr.END, True)
        assert all(cr.END[e] == 0 for e in ends)
        m = cr.block_matrix(kinds)
        assert v == tuple(min(m[4 * q + to] + cr.END[to] for to in cr.STATES) for q in cr.STATES)
