"""Character n-grams and word shingles of whole texts, worked on in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import slices

#: Questions of one block, and documents of which a matrix is made at once.
_BLOCK, _ROWS = 256, 512
#: Bits of a letter in a packed n-gram; letters that no question has are 0.
_LETTER_BITS = 12
_BUCKETS = 2048
_FLUSH_BYTES = 32 << 20


class _Questions:
    """The n-grams of a block of questions, as numbers where 63 bits hold them."""

    def __init__(self, first: int, texts: list[str], n: int):
        grams = [{t[i : i + n] for i in range(max(0, len(t) - n))} for t in texts]
        self.first, self.n = first, n
        self.sizes = np.array([max(1, len(g)) for g in grams], np.float64)
        known = sorted(set().union(*grams))
        self.number = {g: i for i, g in enumerate(known)}
        self.has = np.zeros((len(known), len(texts)), np.float32)
        for q, own in enumerate(grams):
            self.has[[self.number[g] for g in own], q] = 1
        letters = sorted({c for g in known for c in g})
        self.packs = len(letters) < 1 << _LETTER_BITS and n * _LETTER_BITS < 64
        if self.packs:
            self.letter = np.zeros(0x110000, np.int64)
            self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
            keys = np.array([self._pack(self._letters(g))[0] for g in known], np.int64)
            order = np.argsort(keys)
            self.keys, self.order = keys[order], order
            self.likely = np.zeros(1 << 20, bool)
            self.likely[self._spread(keys)] = True

    def _letters(self, source: str) -> np.ndarray:
        return self.letter[np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _pack(self, letters: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(letters) - self.n + 1), np.int64)
        for i in range(self.n):
            out = (out << _LETTER_BITS) | letters[i : i + len(out)]
        return out

    @staticmethod
    def _spread(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def found(self, source: str) -> np.ndarray:
        """The distinct numbers of the questions' n-grams in a text, its last one left out."""
        if not self.packs:
            own = {source[i : i + self.n] for i in range(max(0, len(source) - self.n))}
            return np.array([self.number[g] for g in own if g in self.number], np.int64)
        keys = self._pack(self._letters(source))[:-1]
        keys = keys[self.likely[self._spread(keys)]]
        if not len(keys):
            return keys
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.unique(self.order[at[self.keys[at] == keys]])


def overlaps(questions: list[str], docs: DataFrame, n: int, least: float) -> DataFrame:
    """(q, doc, overlap) of documents (doc, text) that have any, and at least the share
    ``least``, of the distinct n-grams of question q. A document's are matched where it is read."""
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("overlap", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_Questions(a, questions[a : a + _BLOCK], n) for a in range(0, len(questions), _BLOCK)]
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            for block in blocks:
                if not block.number:
                    continue
                for a in range(0, len(texts), _ROWS):
                    part = texts[a : a + _ROWS]
                    held = np.zeros((len(part), len(block.number)), np.float32)
                    for i, source in enumerate(part):
                        if source:
                            held[i, block.found(source)] = 1
                    # counts are whole numbers far below 2^24: exact
                    count = (held @ block.has).astype(np.float64)
                    share = count / block.sizes
                    row, q = np.nonzero((count > 0) & (share >= least))
                    yield pa.RecordBatch.from_arrays([pa.array((q + block.first).astype(np.int32)), batch.column("doc").take(pa.array(row + a)), pa.array(share[row, q])], schema.names)

    return docs.select("doc", "text").mapInArrow(work, schema)


def shared_shingles(docs: DataFrame, n: int = 5) -> DataFrame:
    """(shingle, n_docs): the MD5 of runs of ``n`` words that several rows of ``docs``
    (text) have. Digests go as blobs of 16 bytes each to one of some thousand buckets, where
    equal ones meet; a task holds one bucket at a time."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(held), ">u8").astype(np.uint64).reshape(-1, 2)
            bucket = (rows[:, 0] >> np.uint64(53)).astype(np.uint16)
            rows = rows[np.argsort(bucket, kind="stable")]
            counts = np.bincount(bucket, minlength=_BUCKETS)
            ends = np.cumsum(counts)
            full = np.flatnonzero(counts)
            blobs = pa.array([rows[ends[b] - counts[b] : ends[b]].tobytes() for b in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blobs], ["bucket", "blob"])

        for batch in slices(batches, "text"):
            for source in batch.column("text").to_pylist():
                # bytes split at the white space that \s has in Java
                words = source.encode().split() if source else []
                if len(words) >= n:
                    own = b"".join([md5(x).digest() for x in set(map(b" ".join, zip(*[words[i:] for i in range(n)])))])
                    held.append(own)
                    size += len(own)
                    if size > _FLUSH_BYTES:
                        yield made()
                        held, size = [], 0
        if size:
            yield made()

    def met(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint64).reshape(-1, 2)
        order = np.argsort(rows[:, 0])
        first = rows[order, 0]
        same = first[1:] == first[:-1]
        # only digests whose first half occurs twice are sorted by both
        rows = rows[order[np.append(same, False) | np.append(False, same)]]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(rows)))
        kept, many = starts[many > 1], many[many > 1]
        spelled = rows[kept].astype(">u8").tobytes().hex()
        return pa.table({"shingle": pa.array([spelled[i : i + 32] for i in range(0, len(spelled), 32)], pa.string()), "n_docs": pa.array(many, pa.int64())})

    parts = docs.select("text").mapInArrow(digests, "bucket int, blob binary")
    return parts.groupBy("bucket").applyInArrow(met, "shingle string, n_docs long")
