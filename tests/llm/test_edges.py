"""Every query on nulls, empty and very long texts, repeated rows, ties, clashing extra columns and empty tables."""

from collections import Counter

import brute
import pytest
from llm_tables import documents, tables

from tidewatch.llm.queries import QUERIES

DOCS = documents()
# Ids that name one row (or rows alike in every column).
PLAIN = {d["doc_id"] for d in DOCS} - {None, 5}
WANT = {
    "op1_simhash": lambda: brute.simhash(DOCS),
    "op3_substring_dedup": lambda: brute.substring(DOCS),
    "op10_decontamination": lambda: brute.decontamination(DOCS, tables()["benchmark"]),
    "op9_chat_formatting": lambda: brute.conversations(tables()["conversations"]),
    "op6_quality_rules": lambda: brute.base_rules(DOCS),
    "op2_sharding": lambda: brute.sizes(DOCS),
}


def rows(df, width=None):
    return Counter(tuple(r)[:width] for r in df.collect())


@pytest.mark.parametrize("name", sorted(WANT))
def test_against_brute_force(spark, edge, name):
    want = WANT[name]()
    assert rows(QUERIES[name](spark, edge), len(want[0])) == Counter(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_change_nothing(spark, edge, clash, name):
    assert rows(QUERIES[name](spark, edge)) == rows(QUERIES[name](spark, clash))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, edge, name):
    got = QUERIES[name](spark, empty)
    assert got.count() == (1 if name.startswith("op9") else 0)
    assert got.dtypes == QUERIES[name](spark, edge).dtypes


def test_shards_follow_the_rows_law(spark, edge):
    got = QUERIES["op2_sharding"](spark, edge).collect()
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count.get(s, 0) for s in range(24)) <= 1 and set(count) <= set(range(24))
    for s in count:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))


def test_mix_targets(spark, edge):
    want, got = brute.targets(DOCS), QUERIES["op7_curriculum_mix"](spark, edge).collect()
    assert len(got) == len(DOCS)
    source = {d["doc_id"]: d["source"] for d in DOCS}
    for r in got:
        if r.doc_id in PLAIN:
            total, target = want[source[r.doc_id]]
            assert r.source_size == total and r.target == pytest.approx(target)
        assert r.taken in (0, r["size"], 2 * r["size"])


def test_languages_and_scores(spark, edge):
    text = {d["doc_id"]: d["text"] for d in DOCS}
    for r in QUERIES["op8_language_id"](spark, edge).collect():
        letters = any(c.isalpha() for c in text[r.doc_id] or "")
        assert r.doc_id not in PLAIN or (r.lang_pred != "und") == letters
        assert 0 <= r.score <= 1
    got = QUERIES["op4_quality_knn"](spark, edge).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_pages(spark, edge):
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in QUERIES["op5_html_extraction"](spark, edge).collect() if r.n_chars < 1000}
    assert got[(1, "http://a/")] == ("", 0) and got[(2, None)] == ("", 0) and got[(None, "u")] == ("text only", 9)
    assert got[(3, "u")][0] == "T & t\nSome long paragraph of the text here\nNo."


def test_windows_that_many_items_share(spark):
    from tidewatch.llm import decontam
    prefix = " ".join(f"p{i}" for i in range(40))
    items = [{"item_id": i, "text": f"{prefix} own{i}"} for i in range(5000)] + [{"item_id": -1, "text": "quite short"}]
    docs = [{"doc_id": i, "text": f"a{i} {prefix} b{i}"} for i in range(300)] + [{"doc_id": 300 + i, "text": f"x {prefix} own{i} y quite short"} for i in range(3)]
    docs += [{"doc_id": 7, "text": docs[7]["text"]}] * 40 + [{"doc_id": 400, "text": "none of it"}] * 5
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter(brute.decontamination(docs, items))
    for blocks in ({}, {"block_windows": 700}, {"block_bytes": 20_000}):
        assert rows(decontam.scan(d, b, **blocks), 6) == want
    assert Counter(r.doc_id for r in decontam.clean_documents(d, b).collect()) == Counter({400: 5})


def test_slots_follow_the_text(spark, edge, monkeypatch):
    from tidewatch.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "SLOT_BYTES", 5000)  # many more slots than shuffle partitions
    assert rows(QUERIES["op3_substring_dedup"](spark, edge)) == Counter(WANT["op3_substring_dedup"]())
