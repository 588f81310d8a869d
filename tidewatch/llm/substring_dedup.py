"""Removal of repeated passages with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window
over it also starts in a document with a smaller doc_id.

Hashing every window of the corpus would shuffle one entry per word.  Instead:

1. anchors: shorter windows of ``ANCHOR`` words are hashed only where the word's
   place modulo ``PERIOD`` lies in a difference cover.  Whatever the places of two
   equal windows, some shift below PERIOD brings both onto cover places, and
   the anchor there still lies inside the window: two documents that share a window
   share an aligned anchor.  Anchors that only one document has are dropped;
2. extension: around shared anchors, and only there, whole windows are hashed
   (96 bits) and grouped; a window whose smallest document is another one is removed;
3. the documents are read again and the words under removed windows are cut.

Numpy works on packed columns inside tasks; Spark deals them out by hash and brings them back to
their documents.  A task first settles what repeats among its own documents, so
a passage that a third of all rows share leaves each task once, not once per row.
Texts travel compressed, by document.  Entries (12 to 32 bytes each) are dealt into slots, at least one per
``SLOT_BYTES`` of text whatever the number of shuffle partitions, and a task holds one slot's: some 170 MB if every word
of the corpus were repeated.

Windows are compared by 96 bits of hash.  Among n different windows the expected number of chance matches is n^2 / 2^97:
for the 10^13 words of some 60 TB of text, less than one in a thousand for the whole corpus.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing;
rows with equal doc_id do not remove each other's words; a null doc_id is
neither smaller nor larger than another, so such rows are left whole; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_partitions
from tidewatch.session import ship_package

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
# Entries gathered in a task before they are settled and sent on.
FLUSH = 1 << 21
# Text whose entries go to one slot.
SLOT_BYTES = 32 << 20

Batches = Iterator[pa.RecordBatch]


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class Text:
    """Words of a text as byte ranges of the words joined by single spaces."""

    __slots__ = ("joined", "starts", "ends", "n")

    def __init__(self, data: bytes):
        found = data.split()  # bytes split at ASCII white space only
        self.joined, self.n = b" ".join(found), len(found)
        self.ends = np.cumsum(np.fromiter(map(len, found), np.int64, self.n) + 1) - 1
        self.starts = np.r_[0, self.ends[:-1] + 1] if self.n else self.ends

    def spans(self, at: np.ndarray, words: int) -> list[tuple[int, int]]:
        return list(zip(self.starts[at].tolist(), self.ends[at + words - 1].tolist()))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and 64-bit hashes of the anchors (none in texts shorter than a window)."""
        if self.n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(self.n - ANCHOR + 1)
        at = at[np.isin(at % PERIOD, COVER)]
        digest, joined = xxhash.xxh3_64_intdigest, self.joined
        return at, np.array([digest(joined[a:b]) for a, b in self.spans(at, ANCHOR)], np.uint64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the hashes of the windows starting at ``at``."""
        digest, joined = xxhash.xxh3_128_digest, self.joined
        raw = np.frombuffer(b"".join(digest(joined[a:b]) for a, b in self.spans(at, WINDOW)), ">u8").reshape(-1, 2)
        return raw[:, 0].astype(np.uint64), raw[:, 1].astype(np.uint32)

    def without(self, gone: np.ndarray) -> bytes:
        keep = np.flatnonzero(~gone)
        if len(keep) == self.n:
            return self.joined
        runs = np.flatnonzero(np.r_[True, np.diff(keep) > 1]) if len(keep) else keep
        lasts = np.r_[runs[1:] - 1, len(keep) - 1] if len(keep) else keep
        joined = self.joined
        return b" ".join(joined[a:b] for a, b in zip(self.starts[keep[runs]].tolist(), self.ends[keep[lasts]].tolist()))


def _dealt(slot: np.ndarray, kind: int, names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """Entries packed into one row per slot; their order inside a slot is kept."""
    if not len(slot):
        return None
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    ends = np.r_[cut[1:], len(slot)]
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())], pa.binary()) for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(slot[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), *packed],
                                      names=["slot", "kind", *names])


def _unpacked(batch: pa.RecordBatch, rows: list[int], **kinds) -> dict[str, np.ndarray]:
    return {name: np.concatenate([np.frombuffer(batch.column(name)[i].as_buffer(), kind) for i in rows] or [np.zeros(0, kind)])
            for name, kind in kinds.items()}


def _home(uid: np.ndarray, slots: int) -> np.ndarray:
    """The slot a document's text is sent to; as F.pmod does."""
    return np.mod(uid, slots)


def _known(uid: np.ndarray, what: np.ndarray, slots: int, name: str) -> pa.RecordBatch | None:
    """Findings on their way home to their documents."""
    order = np.argsort(uid, kind="stable")
    return _dealt(_home(uid[order], slots), 1, ["uid", name], [uid[order], what[order]])


def _shared_by_task(slots: int):
    """(uid, text) -> packed anchors (kind 0) and anchors already known to be shared (kind 1)."""
    def settle(uids: list, keys: list) -> Iterator[pa.RecordBatch]:
        uid = np.repeat(np.array([u for u, _ in uids], np.int64), [n for _, n in uids])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        shared = again.copy()
        shared[order[:-1][same]] = True
        first = ~again
        yield _dealt((key[first] % np.uint64(slots)).astype(np.int64), 0, ["uid", "key"], [uid[first], (key[first] >> np.uint64(32)).astype(np.uint32)])
        yield _known(uid[shared], (key[shared] >> np.uint64(32)).astype(np.uint32), slots, "key")

    def run(batches: Batches) -> Batches:
        uids, keys, held = [], [], 0
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text")):
                _, key = Text((text.as_py() or "").encode()).anchors()
                if len(key):
                    key = np.unique(key)
                    uids.append((uid, len(key)))
                    keys.append(key)
                    held += len(key)
                if held >= FLUSH:
                    yield from filter(None, settle(uids, keys))
                    uids, keys, held = [], [], 0
        if held:
            yield from filter(None, settle(uids, keys))
    return run


def _shared_overall(slots: int):
    """All anchors of one slot -> those that several documents have, sent home."""
    def run(batches: Batches) -> Batches:
        held = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            passed = np.flatnonzero(kind == 1)
            if len(passed):
                yield b.take(pa.array(passed)).select(["slot", "kind", "uid", "key"])
            held.append(_unpacked(b, np.flatnonzero(kind == 0).tolist(), uid=np.int64, key=np.uint32))
        if held:
            uid, key = (np.concatenate([h[c] for h in held]) for c in ("uid", "key"))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            shared = np.zeros(len(key), bool)
            shared[order[1:][same]] = shared[order[:-1][same]] = True
            if (out := _known(uid[shared], key[shared], slots, "key")) is not None:
                yield out
    return run


class _Findings:
    """What came home for the documents of one slot: uid -> values."""

    def __init__(self, parts: list[dict[str, np.ndarray]], name: str, kind):
        uid = np.concatenate([p["uid"] for p in parts] or [np.zeros(0, np.int64)])
        values = np.concatenate([p[name] for p in parts] or [np.zeros(0, kind)])
        order = np.argsort(uid, kind="stable")
        self.uid, self.values = uid[order], values[order]

    def of(self, uid: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.uid, uid), np.searchsorted(self.uid, uid, "right")
        return self.values[lo:hi]


def _at_home(batches: Batches, name: str, kind) -> Iterator[tuple[_Findings, pa.RecordBatch, list[int]]]:
    """Rows of one slot, findings (kind 1) before documents (kind 2)."""
    parts, found = [], None
    for b in batches:
        kinds = b.column("kind").to_numpy()
        parts.append(_unpacked(b, np.flatnonzero(kinds == 1).tolist(), uid=np.int64, **{name: kind}))
        docs = np.flatnonzero(kinds == 2).tolist()
        if docs:
            found = found or _Findings(parts, name, kind)
            parts = []
            yield found, b, docs


def _text(b: pa.RecordBatch, i: int, unpack) -> Text:
    return Text(unpack.decompress(b.column("text")[i].as_py()))


def _windows_by_task(slots: int):
    """Documents with their shared anchors -> packed windows (kind 0) and removals known already (kind 1)."""
    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        doc, uid = (np.repeat(np.array([r[i] for r in rows], np.int64), [len(r[2]) for r in rows]) for i in (0, 1))
        at, h, g = (np.concatenate([r[i] for r in rows]) for i in (2, 3, 4))
        order = np.lexsort((doc, g, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(doc), bool)
        gone[order] = doc[order] > least
        ask = ~gone
        yield _dealt((h[ask] % np.uint64(slots)).astype(np.int64), 0, ["uid", "at", "doc", "h", "g"], [uid[ask], at[ask], doc[ask], h[ask], g[ask]])
        if (known := _known(uid[gone], at[gone], slots, "at")) is not None:
            none = pa.nulls(known.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*known.columns, none, none, none], names=["slot", "kind", "uid", "at", "doc", "h", "g"])

    def run(batches: Batches) -> Batches:
        unpack, rows, held = zstandard.ZstdDecompressor(), [], 0
        for found, b, docs in _at_home(batches, "key", np.uint32):
            for i in docs:
                uid, doc = b.column("own")[i].as_py(), b.column("doc")[i].as_py()
                keys = found.of(uid) if doc is not None else ()
                if not len(keys):
                    continue
                text = _text(b, i, unpack)
                at, key = text.anchors()
                at = at[np.isin((key >> np.uint64(32)).astype(np.uint32), keys)]
                # Windows that hold a shared anchor start at most WINDOW - ANCHOR words before it.
                mark = np.zeros(text.n + 1, np.int64)
                np.add.at(mark, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
                np.add.at(mark, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[:text.n - WINDOW + 1] > 0)
                if len(starts):
                    rows.append((doc, uid, starts.astype(np.int32), *text.windows(starts)))
                    held += len(starts)
                if held >= FLUSH:
                    yield from filter(None, settle(rows))
                    rows, held = [], 0
        if held:
            yield from filter(None, settle(rows))
    return run


def _removed_overall(slots: int):
    """All windows of one slot -> those that a smaller document has, sent home."""
    def run(batches: Batches) -> Batches:
        held = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            passed = np.flatnonzero(kind == 1)
            if len(passed):
                yield b.take(pa.array(passed)).select(["slot", "kind", "uid", "at"])
            held.append(_unpacked(b, np.flatnonzero(kind == 0).tolist(), uid=np.int64, at=np.int32, doc=np.int64, h=np.uint64, g=np.uint32))
        if held:
            uid, at, doc, h, g = (np.concatenate([x[c] for x in held]) for c in ("uid", "at", "doc", "h", "g"))
            if not len(h):
                return
            order = np.lexsort((doc, g, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = order[doc[order] > least]
            if (out := _known(uid[gone], at[gone], slots, "at")) is not None:
                yield out
    return run


def _cut(batches: Batches) -> Batches:
    """Documents with their removed windows -> what is left of them."""
    unpack = zstandard.ZstdDecompressor()
    for found, b, docs in _at_home(batches, "at", np.int32):
        total, removed, kept = [], [], []
        for i in docs:
            text = _text(b, i, unpack)
            at = found.of(b.column("own")[i].as_py()) if b.column("doc")[i].is_valid else ()
            mark = np.zeros(text.n + 1, np.int64)
            if len(at):
                np.add.at(mark, at, 1)
                np.add.at(mark, at + WINDOW, -1)
            gone = np.cumsum(mark)[:text.n] > 0
            total.append(text.n)
            removed.append(int(gone.sum()))
            kept.append(text.without(gone))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc").take(pa.array(docs)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def _packed_texts(batches: Batches) -> Batches:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = pa.array([pack.compress((t.as_py() or "").encode()) for t in b.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("own"), b.column("doc"), texts], names=["slot", "own", "doc", "text"])


def _home_rows(findings: DataFrame, texts: DataFrame, name: str, slots: int) -> DataFrame:
    """Findings and documents brought together by slot, findings first."""
    blank = F.lit(None)
    left = findings.select("slot", "kind", "uid", name, blank.cast("long").alias("own"), blank.cast("long").alias("doc"), blank.cast("binary").alias("text"))
    right = texts.select("slot", F.lit(2).alias("kind"), blank.cast("binary").alias("uid"), blank.cast("binary").alias(name), "own", "doc", "text")
    return left.unionAll(right).repartitionById(slots, F.col("slot")).sortWithinPartitions("kind")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    assert covers(PERIOD, COVER) and ANCHOR >= 1
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = max(shuffle_partitions(spark), -(-size // SLOT_BYTES))
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    d = d.withColumn("own", F.xxhash64("doc", "text")).withColumn("slot", F.pmod("own", F.lit(slots)).cast("int"))
    texts = d.select("slot", "own", "doc", "text").mapInArrow(_packed_texts, "slot int, own long, doc long, text binary")
    anchors = d.filter("doc is not null and text is not null").select(F.col("own").alias("uid"), "text")
    anchors = anchors.mapInArrow(_shared_by_task(slots), "slot int, kind int, uid binary, key binary")
    shared = anchors.repartitionById(slots, F.col("slot")).mapInArrow(_shared_overall(slots), "slot int, kind int, uid binary, key binary")
    windows = _home_rows(shared, texts, "key", slots).mapInArrow(
        _windows_by_task(slots), "slot int, kind int, uid binary, at binary, doc binary, h binary, g binary")
    removed = windows.repartitionById(slots, F.col("slot")).mapInArrow(_removed_overall(slots), "slot int, kind int, uid binary, at binary")
    left = _home_rows(removed, texts, "at", slots).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
    return left.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
