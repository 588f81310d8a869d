"""Dual-tree search against scoring every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import documents, tables

from tidewatch.llm import lexical_search as ls
from tidewatch.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def all_pairs(docs, items, top=50):
    found = [(d["doc_id"], Counter(words(d["text"]))) for d in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item in items:
        scored = []
        for i, c in found:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(words(item["text"])) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item["item_id"], rank + 1, i, -s) for rank, (s, _, i) in enumerate(scored[:top])]
    return Counter(out)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_terms_of_bytes_and_of_characters():
    for text in ("Grüße, ÄÖ! x9_y", "日本語 の x", "", "--", "A\x7fB\x80C", *(d["text"] or "" for d in documents())):
        assert [t.decode() for t in ls.terms(text.encode())] == words(text)


def test_against_all_pairs(spark, edge):
    assert rows(QUERIES["op11_lexical_search"](spark, edge)) == all_pairs(documents(), tables()["benchmark"])


def corpus(seed, n, topics=6):
    r = random.Random(seed)
    vocabulary = [[f"w{t}x{i}" for i in range(80)] for t in range(topics)] + [[f"common{i}" for i in range(30)]]
    made = lambda t, k: " ".join(r.choice(vocabulary[r.choice([t, t, t, -1])]) for _ in range(k))
    docs = [{"doc_id": i, "text": made(i % topics, r.choice([5, 30, 90, 300]))} for i in range(n)]
    docs += [dict(docs[3], doc_id=n + i) for i in range(n // 3)] + [dict(docs[5])] * 20 + [{"doc_id": None, "text": docs[4]["text"]}]
    items = [{"item_id": i % 20, "text": made(i % topics, 12)} for i in range(30)] + [{"item_id": None, "text": "w1x1 nowhere"}, {"item_id": 99, "text": "nowhere"}]
    return docs, items + [dict(items[2])]


def test_ties_copies_blocks_and_partitions(spark):
    docs, items = corpus(11, 700)
    want = all_pairs(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ls.search(d, b)) == want
    assert rows(ls.search(d, b, most=7)) == want
    assert rows(ls.search(d, b, top=3, cells=900)) == all_pairs(docs, items, 3)


@pytest.mark.parametrize("large", [False, True])
def test_pruning_is_exact_and_prunes(large):
    docs, items = corpus(2, 3000)
    block = ls.Items.of([sorted({w.encode() for w in words(i["text"])}) for i in items])
    n_docs, n_terms = 3000, 300_000
    weights = np.array([1 + 37 * i % 9000 for i in range(len(block.vocabulary))], np.int64) * (1 << 21 if large else 1)
    search = ls.Search(block, weights, n_docs, n_terms, np.zeros(len(items), np.int64), 10)
    assert search.kind is (np.int64 if large else np.float64)
    counts = [[(block.vocabulary[t], n) for t, n in sorted(Counter(w.encode() for w in words(d["text"])).items()) if t in block.vocabulary] for d in docs]
    kept = [i for i, c in enumerate(counts) if c]
    for part in (kept[:1500], kept[1500:]):
        search.add(np.array([docs[i]["doc_id"] or 0 for i in part]), np.array([int(docs[i]["doc_id"] is None) for i in part]), [len(words(docs[i]["text"])) for i in part],
                   np.array([t for i in part for t, _ in counts[i]]), np.array([n for i in part for _, n in counts[i]]), np.array([len(counts[i]) for i in part]))
    for item, held in enumerate(block.held):
        scored = []
        for i in kept:
            m = 50 + 50 * len(words(docs[i]["text"])) * n_docs // n_terms
            s = sum(int(weights[t]) * (10 ** 9 * n // (1000 * n + 20 * m)) for t, n in counts[i] if t in held)
            if s:
                scored.append((-s, docs[i]["doc_id"] is None, docs[i]["doc_id"] or 0))
        scores, nulls, ids = search.best[item]
        assert sorted(scored)[:10] == list(zip((-scores).tolist(), nulls.astype(bool).tolist(), ids.tolist()))
    assert search.scored < 0.7 * search.pairs


def test_nothing_to_search(spark, edge, empty):
    docs, items = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "benchmark"))
    none, no_items = (spark.read.parquet(f"{empty}/{t}.parquet") for t in ("documents", "benchmark"))
    assert ls.search(docs, no_items).count() == 0 and ls.search(none, items).count() == 0
