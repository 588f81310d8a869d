"""Patricia tries, their spills, and exact dedup against a plain grouping."""

import hashlib
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import documents

from tidewatch.llm import exact_dedup
from tidewatch.llm.exact_dedup import Trie, merged
from tidewatch.llm.queries import QUERIES

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def grouped(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[(d["text"] or "").translate(WHITE)].append(d)
    out = []
    for body, rows in groups.items():
        rows.sort(key=lambda d: (-len(d["text"] or ""), d["doc_id"] is None, d["doc_id"] or 0))
        out += [(d["doc_id"], rows[0]["doc_id"], len(rows), i == 0, hashlib.sha256(body.encode()).hexdigest()) for i, d in enumerate(rows)]
    return Counter(out)


def entry(key, i):
    return key, (1, len(key), i, hashlib.sha256(key).digest())


def totals(found):
    out = {}
    for key, owner in found:
        out[key] = merged(out.get(key), owner)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=60), st.integers(300, 5000))
def test_trie_with_spills(keys, most):
    want = totals(entry(k, i) for i, k in enumerate(keys))
    plain, spilt = Trie(), Trie()
    found = []
    for i, k in enumerate(keys):
        plain.insert(*entry(k, i))
        spilt.insert(*entry(k, i))
        if spilt.held > most:
            found += spilt.spill_largest(most)
            assert spilt.held <= max(most // 2, 300)
    listed = list(plain.drain())
    assert dict(listed) == want and [k for k, _ in listed] == sorted(want)
    assert totals([*found, *spilt.drain()]) == want
    # Keys in order: a spilt key never comes again.
    ordered, found = Trie(), []
    for k, i in sorted((k, i) for i, k in enumerate(keys)):
        ordered.insert(*entry(k, i))
        if ordered.held > most:
            found += ordered.spill_before(k)
    found += ordered.drain()
    assert len(found) == len(want) and dict(found) == want


def test_long_chains_of_prefixes():
    trie = Trie()
    for n in range(3000):
        trie.insert(*entry(b"a" * n, n))
    assert sorted(len(k) for k, _ in trie.drain()) == list(range(3000)) and trie.held == 0


def test_against_grouping(spark, edge):
    got = Counter(tuple(r) for r in QUERIES["op13_exact_dedup"](spark, edge).collect())
    assert got == grouped(documents())


def test_small_tries_change_nothing(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet").repartition(3)
    assert Counter(tuple(r) for r in exact_dedup.assign(docs, trie_bytes=2000).collect()) == grouped(documents())


def test_many_copies_and_repeated_rows(spark):
    r = random.Random(13)
    docs = [{"doc_id": i, "text": r.choice(["same text", "same  text ", "sametext", "other", f"own {i}", None, ""])} for i in range(600)]
    docs += [{"doc_id": 7, "text": "same  text "}] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert Counter(tuple(x) for x in exact_dedup.assign(df).collect()) == grouped(docs)


def test_rows_that_stay(spark, edge, clash, empty):
    for folder in (edge, clash):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns
        texts = [(x.text or "").translate(WHITE) for x in kept.collect()]
        assert len(texts) == len(set(texts)) == len({(d["text"] or "").translate(WHITE) for d in documents()})
    assert exact_dedup.deduplicate(spark.read.parquet(f"{empty}/documents.parquet")).count() == 0
