"""Ranked lexical search by an exact dual-tree traversal.

A score is a sum over the terms of an item: the term's weight times its impact in
the document.  With all weights and impacts at least zero, the same sum over the
*coordinate maxima* of a set of items and of a set of documents is a bound for all pairs
of the two sets.

1. index: the documents are read once; each becomes a written row of the item terms it
   holds, their counts and its length.  Sizes and document frequencies are sums over that table;
2. items are split top-down along their main direction into a binary tree whose nodes hold the maxima of their
   items' weights;
3. in every task, documents are taken in batches of ``BATCH_DOCS``, put next to documents alike (by the items' upper nodes), and
   made into a tree of ``LEAF_DOCS`` documents per leaf that holds the maxima of their impacts.  Both trees are walked
   together: a pair of nodes whose bound is less than the weakest kth score of the node's
   items is pruned with all that lies below; what remains at the leaves is scored in full;
4. a task sends at most k documents per item, ranked once more over all tasks.

The kth scores of a first search over one sixteenth of the documents (by hash) are lower
bounds of the final ones, so every task of the search over all documents starts with them; this changes how much is pruned, not the result.

Items are taken in blocks of at most ``BLOCK_CELLS`` items x terms and ``BLOCK_ITEMS`` items (an item larger than that is a block of its
own), so what tasks and driver hold of them is bounded, and so is a task's share of documents.

Arithmetic is exact: sums of whole numbers below 2^53 in doubles, or 64-bit integers where they could be larger.

Defined results: null text has no terms; a document without an item's terms is not in its list, nor is one with score zero; of equal scores
the smaller doc_id (a whole number) comes first, null last; repeated documents and repeated items are each listed; an item without terms has no
rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize, ship_package

TOP = 50
BATCH_DOCS, LEAF_DOCS, FAN_OUT = 4096, 8, 8
BLOCK_CELLS, BLOCK_ITEMS = 4_000_000, 1024
SAMPLE_PART = 16
# Terms are runs of digits, ASCII letters and bytes of other characters; A-Z are lower-cased.
_TERM = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

Batches = Iterator[pa.RecordBatch]


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


@dataclass(frozen=True)
class Items:
    """A block of items: term numbers and, per item, the terms it holds."""
    vocabulary: dict[bytes, int]
    held: list[np.ndarray]

    @staticmethod
    def of(texts: list[list[bytes]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        held = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in found}), np.int64) for found in texts]
        return Items(vocabulary, held)


def split_items(weights: np.ndarray) -> list[tuple[int, int]]:
    """Binary tree over the rows of ``weights``: nodes 0.. are the items themselves, later nodes are
    (left, right) pairs of earlier ones; the last node is the root."""
    unit = weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
    gram, pairs = unit @ unit.T, []

    def build(rows: np.ndarray) -> int:
        if len(rows) == 1:
            return int(rows[0])
        g = gram[np.ix_(rows, rows)]
        g = g - g.mean(axis=0) - g.mean(axis=1, keepdims=True) + g.mean()
        order = rows[np.argsort(np.linalg.eigh(g)[1][:, -1], kind="stable")]
        pairs.append((build(order[:len(order) // 2]), build(order[len(order) // 2:])))
        return len(weights) + len(pairs) - 1

    if len(weights):
        build(np.arange(len(weights)))
    return pairs


class Search:
    """Dual-tree search of batches of documents for one block of items."""

    def __init__(self, items: Items, term_weights: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int):
        self.n_docs, self.n_terms, self.top, self.n_items = n_docs, n_terms, top, len(items.held)
        matrix = np.zeros((self.n_items, len(term_weights)))
        for i, held in enumerate(items.held):
            matrix[i, held] = term_weights[held]
        pairs = split_items(matrix)
        # An impact is at most 10^6, so this bounds every sum that is formed.
        self.kind = np.float64 if float(term_weights.sum()) * 1e6 < 2 ** 53 else np.int64
        self.weights = np.zeros((self.n_items + len(pairs), len(term_weights)), self.kind)
        self.weights[:self.n_items] = matrix
        self.kids = {self.n_items + j: pair for j, pair in enumerate(pairs)}
        self.parent = {k: node for node, pair in self.kids.items() for k in pair}
        for node, (a, b) in self.kids.items():
            np.maximum(self.weights[a], self.weights[b], out=self.weights[node])
        # Least score that can still enter an item's list; of a node: the weakest of its items.
        self.need = np.ones(len(self.weights), np.int64)
        self.need[:self.n_items] = np.maximum(floor, 1)
        for node, (a, b) in self.kids.items():
            self.need[node] = min(self.need[a], self.need[b])
        self.best: list[tuple] = [(np.zeros(0, np.int64),) * 3 for _ in range(self.n_items)]
        self.groups = self._upper(8)
        self.scored = self.pairs = 0

    def _upper(self, n: int) -> list[int]:
        """About ``n`` nodes that cover all items."""
        nodes = [len(self.weights) - 1] if len(self.weights) else []
        while len(nodes) < n and any(x in self.kids for x in nodes):
            nodes = [k for x in nodes for k in self.kids.get(x, (x,))]
        return nodes

    def impacts(self, lengths: list[int], tf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = np.array([50 + 50 * n * self.n_docs // self.n_terms for n in lengths], np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts))

    def add(self, ids: np.ndarray, nulls: np.ndarray, lengths: list[int], term: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> None:
        """A batch of documents; ``term`` and ``tf`` are their entries, ``counts`` entries per document."""
        if not len(ids) or not self.n_items:
            return
        impact = self.impacts(lengths, tf, counts)
        # Documents next to each other should have large entries in the same places: order them by
        # the group of items they score best with, then by that score.
        rough = np.stack([np.add.reduceat(impact * self.weights[g][term], np.r_[0, np.cumsum(counts)[:-1]]) for g in self.groups])
        order = np.lexsort((-rough.max(axis=0), rough.argmax(axis=0)))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, counts)
        levels, size = [], LEAF_DOCS
        while True:
            levels.append(_maxima(doc // size, term, impact))
            if size >= len(ids):
                break
            size *= FAN_OUT
        by_doc = np.argsort(doc, kind="stable")
        starts = np.searchsorted(doc[by_doc], np.arange(0, len(ids) + LEAF_DOCS, LEAF_DOCS))
        leaf = (ids[order], nulls[order], doc[by_doc], term[by_doc], impact[by_doc], starts)
        self.pairs += len(ids) * self.n_items
        self._descend(levels, len(levels) - 1, 0, np.array([len(self.weights) - 1]), leaf)

    def _alive(self, nodes: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The item nodes whose bound with these document maxima reaches what they need."""
        return nodes[self.weights[np.ix_(nodes, at)] @ most.astype(self.kind) >= self.need[nodes]]

    def _expand(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([k for x in nodes.tolist() for k in self.kids.get(x, (x,))], np.int64)

    def _descend(self, levels: list, level: int, node: int, nodes: np.ndarray, leaf: tuple) -> None:
        starts, at, most = levels[level]
        if node + 1 >= len(starts) or starts[node] == starts[node + 1]:
            return
        at, most = at[starts[node]:starts[node + 1]], most[starts[node]:starts[node + 1]]
        nodes = self._alive(nodes, at, most)
        if level:
            for kid in range(node * FAN_OUT, (node + 1) * FAN_OUT):
                if not len(nodes):
                    return
                self._descend(levels, level - 1, kid, self._expand(nodes), leaf)
            return
        while len(nodes) and nodes.max() >= self.n_items:
            nodes = self._alive(self._expand(nodes), at, most)
        if len(nodes):
            self._score(node, nodes, at, leaf)

    def _score(self, node: int, items: np.ndarray, at: np.ndarray, leaf: tuple) -> None:
        ids, nulls, doc, term, impact, starts = leaf
        part, first = slice(starts[node], starts[node + 1]), node * LEAF_DOCS
        ids, nulls = ids[first:first + LEAF_DOCS], nulls[first:first + LEAF_DOCS]
        dense = np.zeros((len(ids), len(at)), self.kind)
        dense[doc[part] - first, np.searchsorted(at, term[part])] = impact[part]
        scores = (dense @ self.weights[np.ix_(items, at)].T).astype(np.int64)
        self.scored += scores.size
        hits = scores >= self.need[items]
        for column in np.flatnonzero(hits.any(axis=0)).tolist():
            rows, item = np.flatnonzero(hits[:, column]), int(items[column])
            s, z, i = (np.concatenate(x) for x in zip(self.best[item], (scores[rows, column], nulls[rows], ids[rows])))
            order = np.lexsort((i, z, -s))[:self.top]
            self.best[item] = s[order], z[order], i[order]
            if len(order) == self.top and s[order[-1]] > self.need[item]:
                self.need[item] = s[order[-1]]
                while item in self.parent:
                    item = self.parent[item]
                    self.need[item] = min(self.need[k] for k in self.kids[item])

    def results(self) -> pa.RecordBatch:
        n = [len(s) for s, _, _ in self.best]
        s, z, i = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in (zip(*self.best) if n else ((), (), ())))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(self.n_items, dtype=np.int64), n)), pa.array(i.astype(np.int64), pa.int64(), mask=z.astype(bool)), pa.array(s.astype(np.int64))],
            names=["__item", "doc_id", "score"])


def _maxima(group: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group, its terms in order and their largest value: starts of the groups, terms, values."""
    order = np.lexsort((term, group))
    group, term, value = group[order], term[order], value[order]
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (term[1:] != term[:-1])])
    most = np.maximum.reduceat(value, cut)
    return np.searchsorted(group[cut], np.arange(group[-1] + 2)), term[cut], most


def index_documents(docs: DataFrame, items: Items) -> DataFrame:
    """Written table, one row per document with a term: doc_id, n (terms with repeats), terms and tfs
    (packed numbers of the item terms it holds)."""
    vocabulary = items.vocabulary
    number = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32

    def run(batches: Batches) -> Batches:
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tfs": []}
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                held = sorted((vocabulary[t], n) for t, n in Counter(found).items() if t in vocabulary)
                out["doc_id"].append(i)
                out["n"].append(len(found))
                out["terms"].append(np.array([t for t, _ in held], number).tobytes())
                out["tfs"].append(np.array([n for _, n in held], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["terms"], pa.binary()), pa.array(out["tfs"], pa.binary())],
                                             names=list(out))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    return materialize(rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary"), "search-index")


def document_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents holding each item term: one partial count per task and term, summed by Spark."""
    number = np.uint16 if n_terms <= 1 << 16 else np.uint32

    def run(batches: Batches) -> Batches:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for packed in b.column("terms"):
                total[np.frombuffer(packed.as_buffer(), number)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        out[r["term"]] = r["df"]
    return out


def _search(index: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int) -> DataFrame:
    """Candidates (__item, doc_id, score): every task's best ``top`` documents per item."""
    number = np.uint16 if len(items.vocabulary) <= 1 << 16 else np.uint32
    held = Items({}, items.held)

    def run(batches: Batches) -> Batches:
        search, waiting, n = Search(held, weights, n_docs, n_terms, floor, top), [], 0

        def flush() -> None:
            rows = pa.Table.from_batches(waiting)
            ids = rows.column("doc_id").combine_chunks()
            term = [np.frombuffer(x.as_buffer(), number) for c in rows.column("terms").chunks for x in c]
            tf = [np.frombuffer(x.as_buffer(), np.uint32) for c in rows.column("tfs").chunks for x in c]
            search.add(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), rows.column("n").to_pylist(),
                       np.concatenate(term).astype(np.int64), np.concatenate(tf).astype(np.int64), np.array([len(x) for x in term], np.int64))

        for b in batches:
            for at in range(0, b.num_rows, BATCH_DOCS):
                piece = b.slice(at, BATCH_DOCS)
                if n + piece.num_rows > BATCH_DOCS:
                    flush()
                    waiting, n = [], 0
                waiting.append(piece)
                n += piece.num_rows
        if n:
            flush()
        yield search.results()

    with_terms = index.filter(F.length("terms") > 0)
    return with_terms.mapInArrow(run, "__item long, doc_id long, score long")


def ranked(candidates: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, texts: list[list[bytes]], top: int) -> DataFrame:
    items = Items.of(texts)
    index = index_documents(docs, items)
    totals = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 1
    df = document_frequencies(index, len(items.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    sample = index.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE_PART)) == 0)
    floor = np.zeros(len(items.held), np.int64)
    for r in ranked(_search(sample, items, weights, n_docs, n_terms, floor, top), top).filter(F.col("rank") == top).collect():  # at most one row per item of the block
        floor[r["__item"]] = r["score"]
    return _search(index, items, weights, n_docs, n_terms, floor, top)


def item_blocks(items: DataFrame, cells: int = BLOCK_CELLS, most: int = BLOCK_ITEMS) -> Iterator[list[tuple[object, int, list[bytes]]]]:
    """Blocks of (item_id, copies, terms); the driver holds one block at a time."""
    same = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    block, seen = [], set()
    for r in same.sort("item_id", "text").toLocalIterator():
        found = sorted(set(terms(bytes(r["text"]))))
        if not found:
            continue
        if block and (len(block) >= most or (len(block) + 1) * len(seen.union(found)) > cells):
            yield block
            block, seen = [], set()
        block.append((r["item_id"], r["copies"], found))
        seen.update(found)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, cells: int = BLOCK_CELLS, most: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    parts = []
    for block in item_blocks(items, cells, most):
        names = spark.createDataFrame([(i, item_id, copies) for i, (item_id, copies, _) in enumerate(block)], f"__item long, item_id {kind}, __copies long")
        best = ranked(_search_block(docs, [found for _, _, found in block], top), top)
        parts.append(best.join(F.broadcast(names), "__item").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
                     .select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)
