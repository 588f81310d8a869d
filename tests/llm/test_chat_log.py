"""fold_events against a walk over each message's log: deltas, edits, regenerations, ties, repeats, any arrival order."""

import random

from tidewatch.llm import chat
from tidewatch.llm.chat import fold_events

OPS = ("message", "edit", "regenerate", "delta", "delta", "delta")


def walk(events):
    role, text = "", ""
    for _, _, _, seq, op, r, t in sorted(events, key=lambda e: (e[3], e[4], e[6] is not None, e[6] or "")):
        text = {"delta": text + (t or ""), "regenerate": ""}.get(op, t or "")
    roles = [(e[3], e[5]) for e in events if e[5] is not None]
    return (max(roles)[1] if roles else role), text


def test_logs_are_folded(spark):
    rng, rows = random.Random(9), []
    for conv in range(40):
        for turn in range(3):
            for part in (1, 2):
                for _ in range(rng.randrange(1, 12)):
                    op = rng.choice(OPS)
                    role = rng.choice(("user", "assistant")) if op == "message" else None
                    rows.append((conv, turn, part, rng.randrange(8), op, role, rng.choice(("a", "b ", "c\n", "", None))))
    rows += [rows[i] for i in range(0, len(rows), 7)]  # delivered twice
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, turn long, part int, seq long, op string, role string, text string").repartition(7)
    got = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in fold_events(events).collect()}
    logs = {}
    for e in rows:
        logs.setdefault(e[:3], []).append(e)
    assert got == {k: walk(v) for k, v in logs.items()}


def test_the_log_of_a_table_has_every_kind_of_event(spark, edge):
    """Folding the log of the conversations table, in any order of arrival, gives its rows back."""
    rows = spark.read.parquet(f"{edge}/conversations.parquet")
    for piece in (1, 3, 200):
        log = chat.conversation_events(rows.filter("length(text) < 1000 or text is null"), piece)
        assert {r.op for r in log.select("op").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
        got = chat.fold_events(log.repartition(7, "text")).collect()
        want = rows.filter("length(text) < 1000 or text is null").collect()
        assert sorted((r.conv_id or -1, r.turn if r.turn is not None else -1, r.role, r.text) for r in got) == sorted(
            (r.conv_id or -1, r.turn if r.turn is not None else -1, r.role or "", r.text or "") for r in want)
