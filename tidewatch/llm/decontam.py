"""Benchmark decontamination by a broadcast set of test n-grams (DataFrame functions only).

The benchmark's normalised windows (``window`` consecutive words, or all words
of a shorter item) are hashed and broadcast; every window of every document is
hashed where the document lies and looked up, hits are verified word by word,
and the words inside hit windows are counted per document.  Texts are read
once and never shuffled: only hits and one short row per document are.

The broadcast holds windows only, no items, and is bounded in number and in bytes: the benchmark is dealt into blocks of
at most ``BLOCK_WINDOWS`` distinct windows and about ``BLOCK_BYTES`` of their words, and the documents are scanned once per block
(one block for any benchmark up to that size), so a benchmark of any size gives whole results.

Items are looked up after the scan, and not per document: documents with the same set of hit windows
share one row, whose items are joined, sorted and hashed once, however many documents and items that is.

Defined results: null and empty texts have no words; documents shorter than a
window are still searched for shorter items; every row of a repeated document
gets its own result row (rows alike in doc_id and text, compared by 128 bits of hash, are scanned into one row with a number); an empty benchmark hits nothing; an empty documents
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_weight, lower_ascii, words
from tidewatch.session import materialize

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows and bytes of their words broadcast at once.
BLOCK_WINDOWS, BLOCK_BYTES = 500_000, 32 << 20


def normal_words(text: Column) -> Column:
    return words(lower_ascii(text), NOT_WORD)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of the items: __item, __k (length), __words, __wid (128 bits of the words)."""
    b = benchmark.select(F.col("item_id").cast("string").alias("__item"), normal_words(F.col("text")).alias("__w"))
    b = b.filter(F.size("__w") > 0).withColumn("__k", F.least(F.size("__w"), F.lit(window)))
    b = b.withColumn("__p", F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("__k") + 1)))
    b = b.select("__item", "__k", F.slice("__w", F.col("__p"), F.col("__k")).alias("__words"))
    # Words hold no white space, so the joined words name a window.
    return b.withColumn("__wid", F.md5(F.array_join("__words", " ").cast("binary")))


def distinct_windows(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """__wid, __k, __words, __hash: one row per different window."""
    d = windows.groupBy("__wid").agg(F.first("__k").alias("__k"), F.first("__words").alias("__words"))
    by_length = F.lit(None).cast("long")
    for k in range(1, window + 1):
        by_length = F.when(F.col("__k") == k, window_hash(F.col("__words"), F.lit(0), k)).otherwise(by_length)
    return d.withColumn("__hash", by_length)


def window_hash(array: Column, at: Column, k: int) -> Column:
    """Hash of the k words from place ``at`` (0-based); generated code, no string or array is built."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(k)])


def row_hash() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "doc_id", "text"), F.xxhash64(F.lit(2), "text", "doc_id")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
              block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, windows): one written row per different (doc_id, text) with __a, __b (hashes), doc_id, __n (words),
    __copies, __wids (hit windows, sorted), hit_spans; and the items' windows."""
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    grams = distinct_windows(windows, window)
    size = F.sum(F.octet_length(F.array_join("__words", " ")).cast("long")).alias("b")
    sizes = {r["__k"]: r for r in grams.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), size).collect()}  # at most `window` rows
    lengths = sorted(sizes) or [window]
    n_blocks = max(1, -(-sum(r["n"] for r in sizes.values()) // block_windows), -(-sum(r["b"] for r in sizes.values()) // block_bytes))
    a, b = row_hash()
    d = docs.select("doc_id", "text").select("doc_id", a.alias("__a"), b.alias("__b"), normal_words(F.col("text")).alias("__w"))
    d = d.withColumn("__n", F.size("__w"))
    # Position -1 stands for the document itself; it is never a hit.
    d = d.withColumn("__p", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("__n") - min(lengths), F.lit(-1)))))
    hashes = [(k, window_hash(F.col("__w"), F.col("__p"), k)) for k in lengths]
    if len(hashes) == 1:
        d = d.withColumn("__hash", hashes[0][1]).withColumn("__k", F.lit(hashes[0][0]))
    else:
        d = d.withColumn("__kh", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), h.alias("h")) for k, h in hashes])))
        d = d.withColumn("__hash", F.col("__kh.h")).withColumn("__k", F.col("__kh.k"))
    base = (F.col("__p") == -1) & (F.col("__k") == min(lengths))
    parts = []
    for i in range(n_blocks):
        block = grams if n_blocks == 1 else grams.filter(F.pmod(F.col("__hash"), F.lit(n_blocks)) == i)
        block = block.select(F.col("__hash").alias("__bh"), F.col("__k").alias("__bk"), F.col("__words").alias("__bw"), "__wid")
        # Checked size: a block holds about block_windows windows and block_bytes of words.
        j = d.join(F.broadcast(block), (F.col("__hash") == F.col("__bh")) & (F.col("__k") == F.col("__bk")) & (F.col("__p") >= 0), "left")
        same = (F.col("__bh").isNotNull() & (F.col("__p") + F.col("__k") <= F.col("__n"))
                & (F.slice("__w", F.col("__p") + 1, F.col("__k")) == F.col("__bw")))
        j = j.withColumn("__hit", F.coalesce(same, F.lit(False))).filter(F.col("__hit") | base)
        one = F.lit(0) if i else base.cast("int")
        parts.append(j.select("doc_id", "__a", "__b", "__n", one.alias("__one"),
                              F.when(F.col("__hit"), F.struct(F.col("__p").alias("p"), F.col("__k").alias("k"))).alias("__at"),
                              F.when(F.col("__hit"), F.col("__wid")).alias("__wid")))
    found = reduce(DataFrame.unionAll, parts)
    per = found.groupBy("__a", "__b").agg(
        F.first("doc_id").alias("doc_id"), F.max("__n").alias("__n"), F.sum("__one").alias("__copies"),
        F.sort_array(F.collect_set("__at")).alias("__at"), F.sort_array(F.collect_set("__wid")).alias("__wids"))
    # Merge the sorted windows into disjoint spans.
    none = F.array().cast("array<struct<start:int,length:int>>")
    empty = F.struct(none.alias("spans"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    def step(acc, at):
        joined = at["p"] <= acc["end"]
        closed = F.when(joined | (acc["end"] == acc["start"]), acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), (acc["end"] - acc["start"]).alias("length")))))
        return F.struct(closed.alias("spans"),
                        F.when(joined & (acc["end"] > acc["start"]), acc["start"]).otherwise(at["p"]).alias("start"),
                        F.greatest(acc["end"], at["p"] + at["k"]).alias("end"))
    def finish(acc):
        return F.when(acc["end"] == acc["start"], acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), (acc["end"] - acc["start"]).alias("length")))))
    return materialize(per.withColumn("hit_spans", F.aggregate("__at", empty, step, finish)).drop("__at"), "benchmark-hits"), windows


def scan(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans
    (array of start word and length, merged), one row per row of ``docs``."""
    per, windows = find_hits(docs, benchmark, **options)
    per = per.withColumn("__set", F.when(F.size("__wids") > 0, F.sha2(F.array_join("__wids", ",").cast("binary"), 256)))
    hit = per.filter("__set is not null")
    sets = hit.groupBy("__set").agg(F.first("__wids").alias("__wids"), F.count(F.lit(1)).alias("__rows"))
    pairs = sets.select("__set", "__rows", F.explode("__wids").alias("__wid")).join(windows.select("__wid", "__item").distinct(), "__wid")
    items = pairs.groupBy("__set").agg(F.max("__rows").alias("__rows"), F.array_sort(F.collect_set("__item")).alias("__items"))
    items = materialize(items.select("__set", "__rows", F.size("__items").cast("long").alias("n_items"),
                                     F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256")), "hit-items")
    names = ["doc_id", "__n", "__copies", "hit_spans"]
    # Rows without a hit are not joined to anything.
    clean = per.filter("__set is null").select(*names, F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"))
    known = join_by_weight(hit.select(*names, "__set"), items, "__set", "__rows").select(*names, "n_items", "items_sha256")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    out = clean.unionAll(known).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
    return out.select("doc_id", F.col("__n").cast("long").alias("n_words"), n_hit.alias("n_hit"), "n_items", "items_sha256", (n_hit > 0).alias("contaminated"), "hit_spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their own columns.

    Contaminated rows are a written table of row hashes and taken out by an
    anti join; Spark broadcasts it where its size allows and joins by sorting otherwise.
    """
    per, _ = find_hits(docs, benchmark, **options)
    a, b = row_hash()
    kept = docs.withColumn("__a", a).withColumn("__b", b).join(per.filter(F.size("__wids") > 0).select("__a", "__b"), ["__a", "__b"], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
