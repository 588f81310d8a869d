"""Plain Python statements of what the queries must return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i:i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, groups=False):
    fps = [fingerprint(d["text"]) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = defaultdict(list)
    for d, g in zip(docs, group):
        if d["doc_id"] is not None:
            first[g].append(d["doc_id"])
    if groups:
        return group
    return [(d["doc_id"], f"{f:016x}", min(first[g], default=None)) for d, f, g in zip(docs, fps, group)]


def substring(docs):
    rows = [(d["doc_id"], re.findall(SPACE, d["text"] or "")) for d in docs]
    low = {}
    for i, w in rows:
        if i is not None:
            for p in range(len(w) - 12):
                g = tuple(w[p:p + 13])
                low[g] = min(low.get(g, i), i)
    out = []
    for i, w in rows:
        gone = set()
        if i is not None:
            for p in range(len(w) - 12):
                if low[tuple(w[p:p + 13])] < i:
                    gone.update(range(p, p + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def base_rules(docs):
    out = []
    for d in docs:
        t = d["text"] or ""
        w = re.findall(SPACE, t)
        n, windows = len(w), Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(n - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        out.append((d["doc_id"], n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
                    n < 50 or 100 * len(again) > 50 * n))
    return out


def sizes(docs):
    return [(d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs]


def targets(docs):
    """Source -> (words, target): shares of 150 %, capped at twice the source, the rest shared again."""
    total = defaultdict(int)
    for d in docs:
        total[d["source"]] += len(re.findall(SPACE, d["text"] or ""))
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    return {s: (total[s], target[s]) for s in order}


def conversations(rows):
    rows = [*rows, *({"conv_id": -7, "turn": i, "role": r, "text": "</s>[INST] ok [/INST]"} for i, r in enumerate(("user", "assistant")))]
    key = lambda v: (v is not None, v or "")
    convs = defaultdict(list)
    for r in rows:
        convs[r["conv_id"]].append(r)
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda r: ((r["turn"] is not None, r["turn"] or 0), key(r["role"]), key(r["text"])))
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        out.append((c, len(turns), sha("".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in turns)), len(loss), sha(loss)))
    return out


def decontamination(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for b in items:
        w = find(b["text"])
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add(b["item_id"])
    lengths = {len(g) for g in windows}
    out = []
    for d in docs:
        w = find(d["text"])
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d["doc_id"], len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out
