"""Exact duplicates by Patricia-trie owners.

A text is its UTF-8 bytes without ASCII white space.  Texts are dealt out by length
and content hash, and every partition inserts their full byte strings into a
compressed radix trie: two texts are equal if, and only if, they end at the same node,
whatever their hashes say.  The node at which a text ends stores its owner (the row
with the most code points, then the smallest doc_id) and the number of rows.

1. every task first inserts the rows it reads into a trie of its own and sends one row per
   node, so a text that a third of all rows hold leaves each task once (or once per spill);
2. partitions by (length, hash) are sorted by their bytes and inserted in that order;
3. rows find their owner by the text's SHA-256.  Keys held by at least a thousandth of all rows are
   broadcast (so there are at most a thousand), the others are joined by shuffle.

Tries are bounded.  One over ``TRIE_BYTES`` spills by subtree: in step 1 its
largest subtrees are sent on as they are, since step 2 joins the parts of a text
again; in step 2 the keys arrive in order, so every subtree left of the newest key is complete and
can be sent.  Nothing is written outside Spark's own shuffle and tables.

Defined results: null counts as empty, and all texts of white space only are one group; a null doc_id
comes after all others, and a group of null ids only has a null keep_id; of rows that are alike in
doc_id and length too, one stays; every repeated row gets a result row of its own; an
empty table gives an empty result; further columns are ignored by ``owners`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewatch.llm.common import join_by_weight
from tidewatch.session import materialize, ship_package

WHITE = " \t\n\x0b\x0c\r"
TRIE_BYTES = 64 << 20
# What a node takes besides its label.
NODE_BYTES = 250
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024

Owner = tuple[int, int, object, bytes]  # rows, code points, doc_id, digest


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.kids, self.owner = label, {}, owner

    def weight(self) -> int:
        return len(self.label) + NODE_BYTES


def merged(a: Owner | None, b: Owner) -> Owner:
    """Rows add up; the owner has more code points or, with as many, the smaller id (null last)."""
    if a is None:
        return b
    first = min(a, b, key=lambda o: (-o[1], o[2] is None, o[2] if o[2] is not None else 0))
    return a[0] + b[0], first[1], first[2], first[3]


class Trie:
    """Compressed radix trie from byte strings to owners."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = Node(key[at:], owner)
                node.kids[key[at]] = leaf
                self.held += leaf.weight()
                return
            label = kid.label
            if not key.startswith(label, at):
                kid = self._split(node, kid, _common(label, key, at))
            node, at = kid, at + len(kid.label)
        node.owner = merged(node.owner, owner)

    def _split(self, parent: Node, kid: Node, n: int) -> Node:
        """Cuts the edge to ``kid`` after n bytes."""
        upper = Node(kid.label[:n])
        kid.label = kid.label[n:]
        upper.kids[kid.label[0]] = kid
        parent.kids[upper.label[0]] = upper
        self.held += NODE_BYTES
        return upper

    def _drain(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        """Owners of a subtree with their keys, in key order; the subtree is left empty."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((node.kids[b], key) for b in sorted(node.kids, reverse=True))
            self.held -= node.weight()
            node.kids, node.owner = {}, None

    def drain(self) -> Iterator[tuple[bytes, Owner]]:
        root, self.root = self.root, Node(b"")
        yield from self._drain(root, b"")
        self.held = 0

    def spill_largest(self, most: int) -> Iterator[tuple[bytes, Owner]]:
        """Sends the largest subtrees of at most half of ``most`` bytes until half of ``most`` is free; all, if that is not enough."""
        order, above = [(self.root, None, b"")], {}
        for node, parent, prefix in order:  # grows while it is walked: parents before kids
            above[id(node)] = parent
            order.extend((k, node, prefix + node.label) for k in node.kids.values())
        size = {}
        for node, _, _ in reversed(order):
            size[id(node)] = node.weight() + sum(size[id(k)] for k in node.kids.values())
        roots = [(size[id(n)], n, p, prefix) for n, p, prefix in order
                 if p is not None and size[id(n)] <= most // 2 and (above[id(p)] is None or size[id(p)] > most // 2)]
        roots += [(size[id(n)], n, p, prefix) for n, p, prefix in order if p is not None and not n.kids and size[id(n)] > most // 2]
        for _, node, parent, prefix in sorted(roots, key=lambda r: -r[0]):
            if self.held <= most // 2:
                break
            parent.kids.pop(node.label[0], None)
            yield from self._drain(node, prefix)
        if self.held > most // 2:  # what is left are the long paths above those subtrees
            yield from self.drain()

    def spill_before(self, last: bytes) -> Iterator[tuple[bytes, Owner]]:
        """Keys arrive in order and ``last`` is the newest: all others are complete."""
        node, at = self.root, 0
        while True:
            if node.owner is not None and at < len(last):
                yield last[:at], node.owner
                node.owner = None
            here = last[at] if at < len(last) else None
            for b in sorted(b for b in node.kids if b != here):
                yield from self._drain(node.kids.pop(b), last[:at])
            if here is None:
                return
            node = node.kids[here]
            at += len(node.label)


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``key[at:]`` (halving, compared as whole slices)."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


NAMES = ["length", "hash", "body", "n", "chars", "id", "digest"]


def _batches(found: Iterator[tuple[bytes, Owner]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for key, owner in found:
        rows.append((key, owner))
        held += len(key)
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield _batch(rows, id_type)
            rows, held = [], 0
    if rows:
        yield _batch(rows, id_type)


def _batch(rows: list[tuple[bytes, Owner]], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([len(k) for k, _ in rows], pa.int64()), pa.array([int.from_bytes(o[3][:8], "big", signed=True) for _, o in rows], pa.int64()),
        pa.array([k for k, _ in rows], pa.binary()), pa.array([o[0] for _, o in rows], pa.int64()), pa.array([o[1] for _, o in rows], pa.int64()),
        pa.array([o[2] for _, o in rows], id_type), pa.array([o[3] for _, o in rows], pa.binary())], names=NAMES)


def normal(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    return (F.sha2(normal(F.col("text")).cast("binary"), 256),
            F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different text: digest, n (rows), chars and id of the row that stays."""
    ship_package(docs.sparkSession)
    id_field = docs.select("doc_id").schema[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), _keyed(docs)[1].alias("chars"))
    white = WHITE.encode()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = Trie(), pa.int64()
        for b in batches:
            kind = b.column("doc_id").type
            for i, body, chars in zip(b.column("doc_id").to_pylist(), b.column("body"), b.column("chars").to_pylist()):
                key = body.as_py().translate(None, white)
                trie.insert(key, (1, chars, i, hashlib.sha256(key).digest()))
                if trie.held > trie_bytes:
                    yield from _batches(trie.spill_largest(trie_bytes), kind)
        yield from _batches(trie.drain(), kind)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = Trie(), pa.int64()
        for b in batches:
            kind = b.column("id").type
            for body, n, chars, i, digest in zip(b.column("body"), *(b.column(c).to_pylist() for c in ("n", "chars", "id", "digest"))):
                key = body.as_py()
                trie.insert(key, (n, chars, i, digest))
                if trie.held > trie_bytes:
                    yield from (x.select(OWN) for x in _batches(trie.spill_before(key), kind))
        yield from (x.select(OWN) for x in _batches(trie.drain(), kind))

    long, binary = LongType(), BinaryType()
    parts = rows.mapInArrow(combine, StructType([
        StructField("length", long), StructField("hash", long), StructField("body", binary), StructField("n", long),
        StructField("chars", long), StructField("id", id_field.dataType), StructField("digest", binary)]))
    dealt = parts.repartition("length", "hash").sortWithinPartitions("body")
    found = dealt.mapInArrow(settle, StructType([
        StructField("n", long), StructField("chars", long), StructField("id", id_field.dataType), StructField("digest", binary)]))
    return found.select(F.lower(F.hex("digest")).alias("digest"), "n", "chars", "id")


OWN = ["n", "chars", "id", "digest"]


def assign(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    found = materialize(owners(docs, trie_bytes), "owners")
    digest, chars = _keyed(docs)
    # Rows alike in all that counts are one row with a number, so that of them exactly one stays.
    rows = docs.select("doc_id", digest.alias("text_sha256"), chars.alias("__chars"))
    rows = rows.groupBy("doc_id", "text_sha256", "__chars").agg(F.count(F.lit(1)).alias("__copies"))
    best = found.select(F.col("digest").alias("text_sha256"), F.col("n").alias("group_size"), F.col("chars").alias("__most"), F.col("id").alias("keep_id"))
    j = join_by_weight(rows, best, "text_sha256", "group_size")
    j = j.withColumn("__first", (F.col("__chars") == F.col("__most")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    j = j.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return j.select("doc_id", "keep_id", "group_size", (F.col("__first") & (F.col("__i") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one per different text, with their own columns."""
    found = materialize(owners(docs, trie_bytes), "owners")
    digest, chars = _keyed(docs)
    best = found.select(F.col("digest").alias("__digest"), F.col("chars").alias("__most"), F.col("id").alias("__keep"))
    rows = docs.withColumns({"__own": digest, "__chars": chars})
    same = (F.col("__own") == F.col("__digest")) & (F.col("__chars") == F.col("__most")) & F.col("doc_id").eqNullSafe(F.col("__keep"))
    kept = rows.join(best, same, "left_semi").dropDuplicates(["__own"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
