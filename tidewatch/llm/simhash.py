"""SimHash near-duplicates by pivot distance tables.

Every text becomes a 64-bit fingerprint of its word shingles.  Two fingerprints
link if at most ``max_bits`` bits differ; linked documents form components.

Finding links without comparing all pairs:

* equal fingerprints are one node, so copies never meet each other;
* the 64 bits are cut into ``max_bits + 2`` blocks.  Two fingerprints that link
  agree in at least two blocks, so each node enters one group per pair of
  blocks, and every link lies inside a group;
* inside a group, each node has a row of distances to ``PIVOTS`` reference
  fingerprints.  The difference of two distances to one reference never exceeds the
  distance of the pair, so a pair with a larger difference in any coordinate is
  discarded; survivors are verified on the fingerprints themselves;
* groups above ``CHUNK`` nodes are dealt into chunks, one task group per pair of
  chunks, so no task gets a whole large group.  A group reports a spanning forest
  of its links (at most one row per node), never its pairs.

Defined results: null, empty and blank texts have fingerprint 0 and link like
any other; a null doc_id never names a component (null if no other id is in
reach); repeated rows are nodes of the same fingerprint; an empty table gives an
empty result; further columns are ignored by ``components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.session import materialize, ship_package

SHINGLE_WORDS = 4
MAX_BITS = 4
PIVOTS = 16
PIVOT_SEED = 20240117
CHUNK = 4096
# Up to this size a group is compared row by shifted row; above it by growing components.
SMALL_GROUP = 24
HASH_SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, step: int = 1 << 16) -> int:
    """Unsigned 64-bit fingerprint of a whole text (long texts in steps of ``step`` shingles)."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    k = min(shingle_words, len(found))
    stops = ends[k - 1:].tolist()
    starts = [0, *(ends[:len(found) - k] + 1).tolist()]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), step):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[i:i + step], stops[i:i + step])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = (fingerprint(t.as_py(), shingle_words) for t in b.column("__text"))
            fp = np.fromiter(values, np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=[*b.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, __k1, __k2 (hash of the row), fp; one row per row of ``docs``."""
    ship_package(docs.sparkSession)
    k1, k2 = row_key(docs)
    d = docs.select("doc_id", k1.alias("__k1"), k2.alias("__k2"), F.col("text").alias("__text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_fingerprints(shingle_words), f"doc_id {kind}, __k1 long, __k2 long, fp long")


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits naming a row's contents (columns that hold maps do not count)."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # A null is hashed as its own mark, so that (null, 'a') and ('a', null) differ.
    marks = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    return F.xxhash64(F.lit(1), marks, *cols), F.xxhash64(F.lit(2), marks, *cols)


def group_keys(fp: Column, max_bits: int = MAX_BITS) -> Column:
    """array<long>: one key per pair of blocks."""
    blocks = max_bits + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for i, ((a, _), (b, width)) in enumerate(combinations(parts, 2)):
        keys.append(F.lit(i << 48).bitwiseOR(F.shiftleft(a, width)).bitwiseOR(b))
    return F.array(*keys)


def pivots() -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def _root(parent: dict, x: int) -> int:
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = p
    return x


def _far(table: np.ndarray, a, b, max_bits: int) -> np.ndarray:
    """Pairs that the pivot table discards."""
    return np.abs(table[a] - table[b]).max(axis=-1) > max_bits


def forest(fp: np.ndarray, group: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside each group; ``group`` is sorted, ``fp`` unsigned."""
    out: list[tuple[int, int]] = []
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_GROUP))
    parent: dict[int, int] = {}
    for shift in range(1, SMALL_GROUP):
        a = small[small + shift < len(group)]
        a = a[group[a] == group[a + shift]]
        if not len(a):
            break
        a = a[~_far(table, a, a + shift, max_bits)]
        a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= max_bits]
        for i in a.tolist():
            x, y = _root(parent, i), _root(parent, i + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, i + shift))
    for s, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        # Grow components from one node at a time; a node that was reached leaves the
        # list, so members of one component are not compared with each other.
        left = s + np.argsort(table[s:s + n, 0], kind="stable")
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                q = queue.pop()
                at = table[left, 0]
                lo, hi = np.searchsorted(at, table[q, 0] - max_bits), np.searchsorted(at, table[q, 0] + max_bits, "right")
                near = np.arange(lo, hi)
                near = near[~_far(table, left[lo:hi], q, max_bits)]
                near = near[np.bitwise_count(fp[left[near]] ^ fp[q]) <= max_bits]
                if len(near):
                    reached = left[near].tolist()
                    out.extend((q, r) for r in reached)
                    queue.extend(reached)
                    left = np.delete(left, near)
    return out


def _links(max_bits: int, flush: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            fp = rows[:, 3].astype(np.int64).view(np.uint64)
            change = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            pairs = np.array(forest(fp, np.cumsum(change), max_bits), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[pairs[:, 0], 3]), pa.array(rows[pairs[:, 1], 3])], names=["a", "b"])

        n = 0
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            n += b.num_rows
            if n >= flush:
                rows = np.concatenate(held)
                # The last group may go on in the next batch.
                cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield links(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield links(np.concatenate(held))
    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect every component."""
    ship_package(nodes.sparkSession)
    keyed = nodes.select("fp", F.explode(group_keys(F.col("fp"), max_bits)).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    dealt = keyed.join(large, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return dealt.mapInArrow(_links(max_bits), "a long, b long")


def components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, __k1, __k2, fp, root (fingerprint naming the component), component_id."""
    fps = materialize(fingerprints(docs, shingle_words), "simhash-fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    member = connected_components(links(nodes, max_bits), "simhash")
    rooted = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(names, "root").select("fp", "root", "component_id")
    return fps.join(labels, "fp")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    c = components(docs.select("doc_id", "text"), **options)
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of every component, with the columns of ``docs``: the one with the
    smallest doc_id (null last), of rows that share it the one with the smallest row hash."""
    c = components(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")).alias("first")
    stay = c.groupBy("root").agg(first).select(F.col("first.__k1").alias("__k1"), F.col("first.__k2").alias("__k2"))
    k1, k2 = row_key(docs)
    kept = docs.withColumn("__k1", k1).withColumn("__k2", k2).join(stay, ["__k1", "__k2"], "left_semi")
    # Rows alike in every column: one of them.
    copy = Window.partitionBy("__k1", "__k2").orderBy("__k1")
    return kept.withColumn("__copy", F.row_number().over(copy)).filter("__copy = 1").select(*[F.col(f"`{x}`") for x in docs.columns])
