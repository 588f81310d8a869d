"""Every pipeline stage against a brute-force version of it, each judged on its own input."""

from collections import Counter, defaultdict

import brute
import pytest
from llm_tables import documents, tables

import corpus_pipeline
from tidewatch.llm.common import table


def rows(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, clash, tmp_path_factory):
    """Input and output of every stage, over rows with extra columns of clashing names."""
    root, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, clash, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, clash).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns(spark, clash, stages):
    want = table(spark, clash, "documents").columns
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == want, name
    assert set(stages["shard"][1].columns) >= {"doc_id", "text", "shard", "slot", "text_crc32", "law"}


def test_language(stages):
    before, after = stages["language"]
    told = Counter(tuple(r) for r in before.collect() if any(c.isalpha() for c in r.text or ""))
    kept = rows(after, after.columns)
    assert not kept - told                       # no text without a letter stays
    assert sum((told - kept).values()) <= 3      # apart from texts between two languages all others do


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    docs = [r.asDict() for r in before.collect()]
    groups = defaultdict(list)
    for d, g in zip(docs, brute.simhash(docs, groups=True)):
        groups[g].append(d["doc_id"])
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r.doc_id for r in after.collect()) == want


def test_decontaminate(stages):
    before, after = stages["decontaminate"]
    docs = [r.asDict() for r in before.collect()]
    clean = [tuple(d.values()) for d, found in zip(docs, brute.decontamination(docs, tables()["benchmark"])) if not found[-1]]
    assert Counter(tuple(r) for r in after.collect()) == Counter(clean) and len(clean) < len(docs)


def test_mix(stages):
    before, after = stages["mix"]
    docs = [r.asDict() for r in before.collect()]
    size = lambda d: len((d["text"] or "").split())
    taken, copies = defaultdict(int), rows(after, after.columns)
    assert all(copies[k] <= 2 * n for k, n in rows(before, before.columns).items()) and not set(copies) - set(rows(before, before.columns))
    for r in after.collect():
        taken[r.source] += size(r.asDict())
    for source, (_, target) in brute.targets(docs).items():
        longest = max((size(d) for d in docs if d["source"] == source), default=0)
        assert abs(taken[source] - target) <= longest / 2 + 1, source


def test_shard(stages):
    before, after = stages["shard"]
    columns = [c for c in before.columns if c not in ("size", "shard", "slot", "law")]
    assert rows(before, columns) == rows(after, columns)
    per = Counter(r.shard for r in after.select("shard").collect())
    n = after.count()
    assert all(per.get(s, 0) in (n // 24, n // 24 + 1) for s in range(24))
    assert all(sorted(r.slot for r in after.filter(f"shard = {s}").collect()) == list(range(per[s])) for s in list(per)[:4])


def test_run_and_empty(spark, edge, empty):
    assert corpus_pipeline.run(spark, edge).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert documents()
