"""Work on whole texts in Arrow batches: terms of documents, and rankings over all of them.

A document is one row, so its terms are found and its scores summed where it is read;
what leaves a task are its counts or its best rows, and nothing of a document shuffles.
Results are those of the relational definitions: a product of matrices
only sorts out pairs that can't be among the best, by a margin far above its rounding,
and the others are summed term by term in the question's order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from findery.functions import text

SLICE_BYTES = 4 << 20
SLICE_ROWS = 2048
#: With 11 bits for the row of a slice, these fill 63.
_POSITION_BITS, _TERM_BITS = 31, 21
#: Words that are remembered with their terms; beyond that a task starts anew.
_KNOWN_WORDS = 1 << 19

_IDENTIFIER = re.compile(text.IDENTIFIER)
_PLAIN = re.compile("[A-Z]?[a-z]+")
_CAMEL = re.compile(text.CAMEL)
_RULES = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in text.STEM_RULES]
_STOP = frozenset(text.STOP_WORDS)


def stem(word: str) -> str:
    """``text.stem`` of one word."""
    if word[-1:] in ("s", "g", "d", "r", "y", "e"):
        for pattern, to in _RULES:
            word = pattern.sub(to, word)
    return word


def identifier_terms(word: str) -> list[str]:
    """``text.identifier_terms`` of one identifier."""
    lower = word.lower()
    whole = stem(lower)
    found = [whole] if len(lower) > 2 and lower not in _STOP else []
    if _PLAIN.fullmatch(word):
        return found
    parts = [stem(p) for p in map(str.lower, _CAMEL.findall(word)) if len(p) > 2 and p not in _STOP]
    return found + parts if len(parts) > 1 or (parts and parts[0] != whole) else found


def slices(batches: Iterator[pa.RecordBatch], column: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut to a bounded number of rows, and of bytes of a text ``column``."""
    for batch in batches:
        part = np.arange(batch.num_rows) // SLICE_ROWS
        cuts = np.flatnonzero(np.diff(part)) + 1
        if column is not None and batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            cuts = np.union1d(cuts, np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE_BYTES)) + 1)
        ends = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(ends, ends[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class _Words(dict):
    """Word -> number; the terms of word i are ``flat[start[i] : start[i] + size[i]]``."""

    def __init__(self, numbers: dict[str, int] | None):
        super().__init__()
        #: Terms have the given numbers, others numbers after them.
        self.terms = dict(numbers) if numbers is not None else {}
        self.flat, self.start, self.size = [], [], []
        self._arrays: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._spelled = pa.array([], pa.string())

    def __missing__(self, word: str) -> int:
        own = identifier_terms(word)
        self.start.append(len(self.flat))
        self.size.append(len(own))
        for t in own:
            self.flat.append(self.terms.setdefault(t, len(self.terms)))
        self[word] = number = len(self.size) - 1
        return number

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._arrays is None or len(self._arrays[1]) != len(self.size):
            self._arrays = np.array(self.flat, np.int64), np.array(self.start, np.int64), np.array(self.size, np.int64)
        return self._arrays

    def spelled(self) -> pa.Array:
        if len(self._spelled) != len(self.terms):
            new = list(self.terms)[len(self._spelled) :]
            self._spelled = pa.concat_arrays([self._spelled, pa.array(new, pa.string())])
        return self._spelled


def _counted(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, tf, first position) of the texts, sorted by row and term."""
    found = [_IDENTIFIER.findall(x) if x else [] for x in texts]
    counts = np.array([len(x) for x in found], np.int64)
    n = int(counts.sum())
    at = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int64, n)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    place = np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    flat, start, size = words.arrays()
    if not n or not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    many = size[at]
    ends = np.cumsum(many)
    part = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - many, many)
    term = flat[np.repeat(start[at], many) + part]
    place = np.repeat(place, many) * 64 + part
    if len(place) and int(place.max()) >= 1 << _POSITION_BITS:
        raise OverflowError("a text has too many identifiers for 32-bit positions")
    row = np.repeat(row, many)
    if len(words.terms) <= 1 << _TERM_BITS:
        # row, term and position fit 63 bits, and plain numbers sort quickly
        packed = (row << (_TERM_BITS + _POSITION_BITS)) | (term << _POSITION_BITS) | place
        packed.sort()
        row, term, place = packed >> (_TERM_BITS + _POSITION_BITS), (packed >> _POSITION_BITS) & ((1 << _TERM_BITS) - 1), packed & ((1 << _POSITION_BITS) - 1)
    else:
        order = np.lexsort((place, term, row))
        row, term, place = row[order], term[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(row))), place[first]


def _renewed(words: _Words, numbers: dict[str, int] | None) -> _Words:
    return _Words(numbers) if len(words) > _KNOWN_WORDS or len(words.terms) > _KNOWN_WORDS + len(numbers or ()) else words


def postings(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, first_pos) of each row of ``docs`` (doc, text)."""
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("first_pos", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(None)
        for batch in slices(batches, "text"):
            words = _renewed(words, None)
            row, term, tf, first = _counted(batch.column("text").to_pylist(), words)
            for a in range(0, len(row), 1 << 17):
                b = a + (1 << 17)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row[a:b])), words.spelled().take(pa.array(term[a:b])), pa.array(tf[a:b]), pa.array(first[a:b].astype(np.int32))], ["doc", "term", "tf", "first_pos"])

    return docs.select("doc", "text").mapInArrow(work, schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, tf) of the texts of ``docs`` (doc, text), summed for each task: in how
    many rows a term stands and how often. At the null term, the number of rows that have a
    term, and of all terms in them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df, total = _Words(None), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, length = 0, 0

        def made() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(df), 1 << 17):
                b = a + (1 << 17)
                yield pa.RecordBatch.from_arrays([words.spelled()[: len(df)][a:b], pa.array(df[a:b]), pa.array(total[a:b])], ["term", "df", "tf"])

        for batch in slices(batches, "text"):
            if _renewed(words, None) is not words:
                yield from made()
                words, df, total = _Words(None), np.zeros(0, np.int64), np.zeros(0, np.int64)
            row, term, tf, _ = _counted(batch.column("text").to_pylist(), words)
            n = len(words.terms)
            df = np.pad(df, (0, n - len(df))) + np.bincount(term, minlength=n)
            total = np.pad(total, (0, n - len(total))) + np.bincount(term, tf, n).astype(np.int64)
            rows, length = rows + len(np.unique(row)), length + int(tf.sum())
        yield from made()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows]), pa.array([length])], ["term", "df", "tf"])

    return docs.select("text").mapInArrow(work, "term string, df long, tf long")


def vectors(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """``docs`` with their text replaced by (n_terms, squares, t, tf): how many terms a
    document has, the sum of its squared frequencies, and the numbers and frequencies of
    those terms that ``numbers`` has, in its order. Documents without a term are left out."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    more = [("n_terms", T.LongType()), ("squares", T.LongType()), ("t", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.LongType()))]
    schema = T.StructType([*keep, *[T.StructField(n, k) for n, k in more]])
    names = [f.name for f in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(numbers)
        for batch in slices(batches, "text"):
            words = _renewed(words, numbers)
            row, term, tf, _ = _counted(batch.column("text").to_pylist(), words)
            n = np.bincount(row, tf, batch.num_rows).astype(np.int64)
            squares = np.bincount(row, tf * tf, batch.num_rows).astype(np.int64)
            full = np.flatnonzero(n)
            asked = term < len(numbers)
            row, term, tf = row[asked], term[asked], tf[asked]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows)[full])]).astype(np.int32))
            kept = batch.select(names).take(pa.array(full)) if names else None
            own = [pa.array(n[full]), pa.array(squares[full]), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *own], [*names, "n_terms", "squares", "t", "tf"])

    return docs.select(*names, "text").mapInArrow(work, schema)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, tf) of a batch of vectors."""
    t = batch.column("t")
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64))
    return row, t.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tf").flatten().to_numpy(zero_copy_only=False)


def frequencies(rows: DataFrame, group: str | None = None) -> DataFrame:
    """(t, n) of vectors: in how many documents a term stands; with the number of documents
    at t = -1 and the sum of their lengths at t = -2. By ``group``, if one is given."""
    kind = [T.StructField("g", rows.schema[group].dataType)] if group else []
    schema = T.StructType([*kind, T.StructField("t", T.IntegerType()), T.StructField("n", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in slices(batches):
            row, t, _ = _lists(batch)
            values = batch.column("g").to_pylist() if group else [None] * batch.num_rows
            known = {g: i for i, g in enumerate(dict.fromkeys(values))}
            own = np.array([known[g] for g in values])
            lengths = batch.column("n_terms").to_numpy(zero_copy_only=False)
            for g, i in known.items():
                here = own == i
                number, count = np.unique(t[here[row]], return_counts=True)
                seen = total.setdefault(g, {})
                for k, c in [*zip(number.tolist(), count.tolist()), (-1, int(here.sum())), (-2, int(lengths[here].sum()))]:
                    seen[k] = seen.get(k, 0) + c
        for g, seen in total.items():
            columns = [pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())]
            if group:
                columns = [pa.array([g] * len(seen), to_arrow_type(kind[0].dataType)), *columns]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    picked = [F.col(group).alias("g")] if group else []
    parts = rows.select(*picked, "n_terms", "t", "tf").mapInArrow(work, schema)
    return parts.groupBy(*[f.name for f in kind], "t").agg(F.sum("n").alias("n"))


def group_scores(rows: DataFrame, group: str, weights: dict, averages: dict, k1: float, b: float) -> DataFrame:
    """(query_id, doc, score): BM25 of every document that has a term of its group's
    ``weights`` (group -> array by term number, 0 for terms it doesn't ask for), summed in
    the order of term numbers; ``averages`` has each group's mean length."""
    schema = T.StructType([T.StructField("query_id", rows.schema[group].dataType), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, term, tf = _lists(batch)
            own = batch.column("query_id").to_pylist()
            w = np.zeros(len(row))
            average = np.ones(batch.num_rows)
            for g in set(own) & set(weights):
                here = np.array([x == g for x in own])
                average[here] = averages[g]
                here = here[row]
                w[here] = weights[g][term[here]]
            lengths = batch.column("n_terms").to_numpy(zero_copy_only=False).astype(np.float64)
            damp = k1 * ((1 - b) + b * lengths / average)
            value = w * tf * (k1 + 1) / (tf + damp[row])
            # bincount adds one by one, in this order
            score, full = np.bincount(row, value, batch.num_rows), np.flatnonzero(np.bincount(row, w != 0, batch.num_rows))
            kept = batch.select(["query_id", "doc"]).take(pa.array(full))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score[full])], schema.names)

    return rows.select(F.col(group).alias("query_id"), "doc", "n_terms", "t", "tf").mapInArrow(work, schema)


@dataclass
class Asked:
    """Terms of questions: row i says that question ``query[i]`` has the term with number
    ``term[i]`` at place ``pos[i]``, with the weight ``w[i]``."""

    query: np.ndarray
    pos: np.ndarray
    term: np.ndarray
    w: np.ndarray

    def blocks(self, size: int = 256) -> list[Block]:
        """Questions in blocks of ``size``, so that any number of them can be asked."""
        out = []
        for first in range(0, int(self.query.max()) + 1 if len(self.query) else 0, size):
            here = (self.query >= first) & (self.query < first + size)
            if here.any():
                out.append(Block(first, self.query[here] - first, self.pos[here], self.term[here], self.w[here]))
        return out


class Block:
    def __init__(self, first: int, query: np.ndarray, pos: np.ndarray, term: np.ndarray, w: np.ndarray):
        self.first, self.n = first, int(query.max()) + 1
        self.terms, local = np.unique(term, return_inverse=True)
        order = np.lexsort((pos, query))
        query, local, w, pos = query[order], local[order], w[order], pos[order]
        count = np.bincount(query, minlength=self.n)
        at = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        # by place, so that sums run in the questions' order; unused places have a term that none has
        self.local = np.full((int(count.max()), self.n), len(self.terms), np.int64)
        self.weight, self.pos = np.zeros(self.local.shape), np.zeros(self.local.shape, np.int64)
        self.local[at, query], self.weight[at, query], self.pos[at, query] = local, w, pos
        self.dense = np.zeros((len(self.terms) + 1, self.n))
        np.add.at(self.dense, (local, query), w)


class _Best:
    """A task's best rows for each question of a block."""

    def __init__(self, block: Block, most: int, slack: float):
        self.block, self.most, self.slack = block, most, slack
        self.least = np.full(block.n, -np.inf)
        self.kept: list[list[tuple]] = [[] for _ in range(block.n)]
        self.held = 0

    def wanted(self, approx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, question) of what may be among the best. ``approx`` is off by rounding."""
        if len(approx) >= self.most:
            np.maximum(self.least, np.partition(approx, len(approx) - self.most, axis=0)[len(approx) - self.most], out=self.least)
        margin = self.slack + 1e-9 * np.abs(np.where(np.isfinite(self.least), self.least, 0.0))
        return np.nonzero((approx >= self.least - margin) & (approx > 0))

    def add(self, query: np.ndarray, score: np.ndarray, first: np.ndarray, rows: np.ndarray, order: list, data: list) -> None:
        for q, s, f, r in zip(query.tolist(), score.tolist(), first.tolist(), rows.tolist()):
            self.kept[q].append((-s, f, order[r] is not None, order[r], data[r]))
        self.held += len(query)
        if self.held > 64 * self.most * self.block.n:
            self.prune()

    def prune(self) -> None:
        self.held = 0
        for q, own in enumerate(self.kept):
            own.sort(key=lambda x: x[:4] if x[2] else x[:3])
            out: list[tuple] = []
            equal = 0
            for i, x in enumerate(own):
                if i >= self.most:
                    if -x[0] < -own[self.most - 1][0] - self.slack:
                        break
                equal = equal + 1 if out and out[-1][0] == x[0] else 1
                if i < self.most or (self.slack and equal <= self.most):
                    out.append(x)
            self.kept[q] = out
            self.held += len(out)


def best(rows: DataFrame, asked: Asked, most: int, score: str, k1: float = 1.2, b: float = 0.75, average: float = 1.0, prior: str | None = None, order: str = "doc", norms: np.ndarray | None = None, slack: float = 0.0) -> DataFrame:
    """(q, doc, score, first, ord): of each task the ``most`` documents of each question
    that have the largest scores, among them the best of all. ``rows`` are vectors with
    ``doc``. ``score`` is ``bm25`` (times a column ``prior``) or ``cosine`` (of questions
    with these ``norms``). Equal scores go by ``first``, the place of the first term that
    the document has, then by the column ``order``; documents within ``slack`` of the
    last one come too, so that scores may be rounded afterwards."""
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("ord", rows.schema[order].dataType)])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    blocks = asked.blocks()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [_Best(block, most, slack) for block in blocks]
        for batch in slices(batches):
            row, term, tf = _lists(batch)
            lengths = batch.column("n_terms").to_numpy(zero_copy_only=False).astype(np.float64)
            scale = batch.column("p").to_numpy(zero_copy_only=False).astype(np.float64) if prior else None
            data, places = batch.column("doc").to_pylist(), batch.column("o").to_pylist()
            for state in states:
                _rank(state, row, term, tf, lengths, scale, data, places)
        for state in states:
            state.prune()
            out = [(state.block.first + q, x[4], -x[0], x[1], x[3]) for q, own in enumerate(state.kept) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(5)], schema.names)

    def _rank(state: _Best, row, term, tf, lengths, scale, data, places) -> None:
        block = state.block
        at = np.searchsorted(block.terms, term)
        here = (at < len(block.terms)) & (block.terms[np.minimum(at, len(block.terms) - 1)] == term)
        row, at, tf = row[here], at[here], tf[here].astype(np.float64)
        used, own = np.unique(row, return_inverse=True)
        if not len(used):
            return
        for a in range(0, len(used), 512):
            part = (own >= a) & (own < a + 512)
            docs = used[a : a + 512]
            counts = np.zeros((len(docs), len(block.terms) + 1))
            counts[own[part] - a, at[part]] = tf[part]
            if score == "bm25":
                damp = k1 * ((1 - b) + b * lengths[docs] / average)
                values = np.zeros_like(counts)
                values[own[part] - a, at[part]] = tf[part] * (k1 + 1) / (tf[part] + damp[own[part] - a])
                approx = values @ block.dense
                if scale is not None:
                    approx *= scale[docs][:, None]
            else:
                # sums of whole numbers, so exact
                approx = (counts @ block.dense) / (norms[block.first : block.first + block.n][None, :] * np.sqrt(lengths[docs])[:, None])
            d, q = state.wanted(approx)
            if not len(d):
                continue
            first = np.full(len(d), -1, np.int64)
            total = np.zeros(len(d))
            if score == "bm25":
                for local, weight, pos in zip(block.local, block.weight, block.pos):
                    n = counts[d, local[q]]
                    total = total + weight[q] * n * (k1 + 1) / (n + damp[d])
                    first = np.where((first < 0) & (n > 0), pos[q], first)
                if scale is not None:
                    total = total * scale[docs[d]]
            else:
                total = approx[d, q]
            state.add(q, total, first, docs[d], places, data)

    length = F.col("squares") if score == "cosine" else F.col("n_terms")
    columns = [F.col("doc"), length.alias("n_terms"), "t", "tf", F.col(order).alias("o")]
    if prior:
        columns.append(F.col(prior).alias("p"))
    return rows.select(*columns).mapInArrow(work, schema)
