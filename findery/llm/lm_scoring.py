"""Language-model scoring with Brown class-based bigrams.

Words are put into classes by exchange clustering: over all bigrams of the corpus,
each word moves to the class that raises the likelihood of the class bigrams most.
A text's log probability is the sum, over its tokens, of the smoothed log probability
of the token's class after its predecessor's and of the word within its class.

Texts are tokenised once, into slices of word codes that are written to the shared
folder; every later pass reads those. A round of clustering counts, by map-side
aggregation, the classes left and right of each word of one part of the vocabulary,
shuffles these sparse counts by word, and moves the words of that part together. Counts
are summed as they stream in, so a task holds its words' sums, however many slices
send some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, mix, ref, saved, segment_sum, text_slices, tokens, word_hashes


#: Counts of contexts up to which gains are looked up.
SMALL = 32


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd"), kind) if size else np.zeros(0, kind)


class _Finder:
    """Places of hashes in sorted distinct ``keys`` (-1: not there). Hashes are spread
    evenly, so their first bits lead to a place that is a few steps off."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        edges = (np.arange(1 << self.bits) - (1 << (self.bits - 1))) << (64 - self.bits)
        self.starts = np.searchsorted(keys, edges)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        at = self.starts[(words >> (64 - self.bits)) + (1 << (self.bits - 1))]
        behind = np.flatnonzero(self.keys[at] < words)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < words[behind]]
        return np.where((self.keys[at] == words) & (at < len(self.keys) - 1), at, -1)


def encode_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (ids, sizes, words, codes), one for each slice of texts: ``sizes`` has each
    text's number of tokens (-1 for a null text), ``words`` the hashes of the slice's
    distinct words and ``codes`` the tokens as indices into them. Written."""
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    kind = source.schema["id"].dataType
    arrow = pa.schema([("ids", pa.list_(to_arrow_type(kind))), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("codes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            sizes = np.diff(ends).astype(np.int32)
            sizes[batch.column("text").is_null().to_numpy(zero_copy_only=False)] = -1
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            hashes = word_hashes(words).view(np.int64)[order]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("id").to_pylist()], arrow.field("ids").type), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([_pack(hashes)], pa.binary()), pa.array([_pack(rank[codes])], pa.binary())], schema=arrow)

    shape = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("codes", T.BinaryType())])
    return saved(source.mapInArrow(lean(work), shape), "lm-slices")


def count_words(slices: DataFrame) -> DataFrame:
    """(word, n): the count of each word hash over the whole corpus. Written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for words, codes in zip(batch.column("words").to_pylist(), batch.column("codes").to_pylist()):
                words = _unpack(words, np.int64)
                found.append((words, np.bincount(_unpack(codes, np.uint32), minlength=len(words))))
        if found:
            words, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(words)).astype(np.int64)
            words, n = words[n > 0], n[n > 0]  # a slice may list a word (the empty one) that no token is
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["word", "n"])

    return saved(slices.mapInArrow(lean(work), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class _Classes:
    """Looks up the class (and emission) of the words of a slice. ``table`` is
    (word, class, log emission); while it is small every task gets a copy, else the
    slices' distinct words are joined with it and travel with the slices."""

    def __init__(self, slices: DataFrame, table: DataFrame, limit_mb: float):
        self.copied = table.count() * 16 / 1e6 <= limit_mb
        if self.copied:
            rows = table.select("word", "class", "emission").orderBy("word").toArrow()
            columns = [rows.column(c).combine_chunks().to_numpy() for c in ("word", "class", "emission")]
            self.shared = slices.sparkSession.sparkContext.broadcast(columns)
            self.slices = slices
            return
        self.shared = None

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("words").to_pylist():
                    words = _unpack(blob, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([blob] * 1, pa.binary()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["words", "each"])

        spelled = slices.select("words").distinct().mapInArrow(spell, "words binary, each array<long>").select(F.xxhash64("words").alias("slice"), F.explode("each").alias("word"))
        known = spelled.join(table, "word").groupBy("slice").agg(F.collect_list(F.struct("word", "class", "emission")).alias("known"))
        self.slices = slices.withColumn("slice", F.xxhash64("words")).join(known, "slice", "left").drop("slice")

    def reader(self):
        """A function of a batch that yields (row number, classes, emissions, hashes) of
        each slice's distinct words; -1 where the table lacks the word."""
        shared = self.shared
        copied: list[_Finder] = []

        def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for i, blob in enumerate(batch.column("words").to_pylist()):
                words = _unpack(blob, np.int64)
                if shared is not None:
                    keys, classes, emissions = shared.value
                    if not copied:
                        copied.append(_Finder(keys))
                    find = copied[0]
                else:
                    own = sorted((k["word"], k["class"], k["emission"]) for k in batch.column("known")[i].as_py() or ())
                    keys, classes, emissions = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int32), np.array([x[2] for x in own], np.float64)
                    find = _Finder(keys)
                if not len(keys):
                    yield i, np.full(len(words), -1), np.zeros(len(words)), words
                    continue
                at = find(words)
                hit = at >= 0
                yield i, np.where(hit, classes[at], -1), np.where(hit, emissions[at], 0.0), words

        return read


def _stream(batch: pa.RecordBatch, i: int, classes: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, codes, ends) of slice ``i``: an edge token stands before each text and
    after the last; codes of edge tokens are -1, ``ends`` are the edges' places."""
    sizes = np.maximum(np.array(batch.column("sizes")[i].as_py(), np.int64), 0)
    codes = _unpack(batch.column("codes")[i].as_py(), np.uint32).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    flow = np.full(int(ends[-1]) + 1, -1, np.int64)
    inner = np.ones(len(flow), bool)
    inner[ends] = False
    flow[inner] = codes
    out = np.full(len(flow), edge, np.int64)
    out[inner] = classes[codes]
    return out, flow, ends


def class_bigrams(lookup: _Classes, classes: int) -> np.ndarray:
    """Counts of class pairs over the corpus; class ``classes`` holds rare words and
    ``classes + 1`` the edges of texts."""
    k = classes + 2
    read = lookup.reader()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i, own, _, _ in read(batch):
                flow, _, _ = _stream(batch, i, np.where(own < 0, classes, own), classes + 1)
                total += np.bincount(flow[:-1] * k + flow[1:], minlength=k * k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(k * k, np.int64)
    for row in lookup.slices.mapInArrow(lean(work), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most k * k
        out[row["cell"]] = row["n"]
    return out.reshape(k, k)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to a term that no class changes."""
    pairs = pairs.astype(np.float64)
    return float(_phi(pairs).sum() - _phi(pairs.sum(0)).sum() - _phi(pairs.sum(1)).sum())


def _moves(words: np.ndarray, sizes: np.ndarray, context: np.ndarray, counts: np.ndarray, current: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """The best class of each word: word i has ``sizes[i]`` contexts (class to the right,
    or k + class to the left) with their counts."""
    k = classes + 2
    pairs = pairs.astype(np.float64)
    total_right, total_left = pairs.sum(1), pairs.sum(0)
    # row c of both: counts of class c with what may stand to its right and its left
    sides = np.concatenate([pairs, pairs.T], axis=1)[:classes].T
    # what a context adds to each class follows from its count, which is mostly small
    phi = _phi(sides)
    small = _phi(sides[:, None] + np.arange(SMALL + 1.0)[:, None]) - phi[:, None]
    best = np.empty(len(words), np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 17) // k, "right")) - 1)
        at = slice(int(ends[a]), int(ends[b]))
        who = np.repeat(np.arange(b - a), sizes[a:b])
        own = current[a:b]
        n = counts[at].astype(np.float64)
        added = small[context[at], np.minimum(counts[at], SMALL)]
        large = np.flatnonzero(counts[at] > SMALL)
        added[large] = _phi(sides[context[at][large]] + n[large, None]) - phi[context[at][large]]
        mine = np.maximum(sides[context[at], own[who]] - n, 0)  # as if the word had left its class
        added[np.arange(len(n)), own[who]] = _phi(mine + n) - _phi(mine)
        gain = np.add.reduceat(added, ends[a:b] - ends[a], axis=0)
        weight = np.bincount(who, weights=counts[at] * (context[at] < k), minlength=b - a)
        weights, same = np.unique(weight, return_inverse=True)
        for total in (total_right[:classes], total_left[:classes]):
            lost = (_phi(total + weights[:, None]) - _phi(total))[same]
            mine = np.maximum(total[own] - weight, 0)
            lost[np.arange(b - a), own] = _phi(mine + weight) - _phi(mine)
            gain -= lost
        top = gain.argmax(axis=1)
        better = gain[np.arange(b - a), top] > gain[np.arange(b - a), own] + 1e-6
        best[a:b] = np.where(better, top, own)
        a = b
    return best


def _round(lookup: _Classes, pairs: np.ndarray, classes: int, part: int, parts: int, buckets: int) -> DataFrame:
    """(word, class): the best class of each word of one part of the vocabulary."""
    k = classes + 2
    read = lookup.reader()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("class", pa.binary()), ("sizes", pa.binary()), ("context", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for i, own, _, hashes in read(batch):
                classed = np.where(own < 0, classes, own)
                flow, codes, _ = _stream(batch, i, classed, classes + 1)
                mixed = mix(hashes.view(np.uint64))
                mine = (own >= 0) & (mixed % np.uint64(parts) == np.uint64(part))
                # a word's number among those of this part, by bucket
                slot = (mixed >> np.uint64(32)) % np.uint64(buckets)
                order = np.flatnonzero(mine)
                order = order[np.lexsort((hashes[order], slot[order]))]
                if not len(order):
                    continue
                number = np.full(len(hashes) + 1, -1, np.int64)  # the last is for edges
                number[order] = np.arange(len(order))
                who = number[codes]
                right = np.flatnonzero(who[:-1] >= 0)
                left = np.flatnonzero(who[1:] >= 0) + 1
                keys, n = np.unique(np.concatenate([who[right] * 2 * k + flow[right + 1], who[left] * 2 * k + k + flow[left - 1]]), return_counts=True)
                owner, context = keys // (2 * k), (keys % (2 * k)).astype(np.uint16)
                sizes = np.bincount(owner, minlength=len(order))
                cuts = np.searchsorted(slot[order], np.arange(buckets + 1))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for s in range(buckets):
                    a, b = int(cuts[s]), int(cuts[s + 1])
                    if b > a:
                        at = slice(int(ends[a]), int(ends[b]))
                        yield pa.RecordBatch.from_pydict({"bucket": [s], "words": [_pack(hashes[order[a:b]])], "class": [_pack(classed[order[a:b]].astype(np.uint16))], "sizes": [_pack(sizes[a:b].astype(np.uint16))], "context": [_pack(context[at])], "counts": [_pack(n[at].astype(np.int32))]}, schema=schema)

    def summed(parts: list[tuple]) -> tuple:
        """(words, classes, contexts a word, contexts, counts) of all parts."""
        words, current, sizes, context, counts = map(np.concatenate, zip(*parts))
        distinct, first, who = np.unique(words, return_index=True, return_inverse=True)
        keys, at = np.unique(np.repeat(who, sizes) * 2 * k + context, return_inverse=True)
        return distinct, current[first], np.bincount(keys // (2 * k), minlength=len(distinct)), (keys % (2 * k)).astype(np.uint16), np.bincount(at, weights=counts).astype(np.int64)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        waiting = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("words", "class", "sizes", "context", "counts")]):
                words, current, sizes, context, counts = [_unpack(x, kind) for x, kind in zip(row, (np.int64, np.uint16, np.uint16, np.uint16, np.int32))]
                parts.append((words, current, sizes.astype(np.int64), context, counts.astype(np.int64)))
                waiting += len(context)
                if waiting > 1_000_000:
                    parts, waiting = [summed(parts)], 0
        if parts:
            words, current, sizes, context, counts = summed(parts)
            best = _moves(words, sizes, context.astype(np.int64), counts, current.astype(np.int64), pairs, classes)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best, pa.int32())], names=["word", "class"])

    rows = lookup.slices.mapInArrow(lean(count), "bucket int, words binary, class binary, sizes binary, context binary, counts binary")
    return rows.repartition(buckets, "bucket").mapInArrow(lean(move), "word long, class int")


def cluster(slices: DataFrame, counts: DataFrame, classes: int = 64, min_count: int = 5, sweeps: int = 3, parts: int = 2, limit_mb: float = 128) -> DataFrame:
    """(word, n, class) of every word that occurs at least ``min_count`` times.

    Classes begin with words dealt out by a hash; ``sweeps`` times each of ``parts``
    of the vocabulary moves. Of equal classes a word keeps its own, else takes the first.
    """
    begin = F.pmod(F.xxhash64("word"), F.lit(classes)).cast("int")
    table = saved(counts.where(F.col("n") >= min_count).select("word", "n", begin.alias("class")), "lm-classes")
    buckets = max(1, -(-table.count() // 5_000))
    for r in range(sweeps * parts):
        lookup = _Classes(slices, table.withColumn("emission", F.lit(0.0)), limit_mb)
        pairs = class_bigrams(lookup, classes)
        moved = _round(lookup, pairs, classes, r % parts, parts, buckets).withColumnRenamed("class", "to")
        table = saved(table.join(moved, "word", "left").select("word", "n", F.coalesce("to", "class").alias("class")), "lm-classes")
    return table


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, min_count: int = 5, sweeps: int = 3, parts: int = 2, smoothing: float = 10.0, limit_mb: float = 128) -> DataFrame:
    """(id, n_tokens, log_prob, perplexity) of every row of ``docs`` under the model
    that all of them train.

    Words seen under ``min_count`` times share one class of their own, in which each
    (and any unseen word) is equally likely; the edges of a text are a class too. With
    class counts N, p(d | c) = (N(c, d) + smoothing * p(d)) / (N(c) + smoothing), where
    p(d) is d's share of all tokens and edges, each class counted once more. The end
    of a text counts as one more token in the perplexity.

    Defined results: a null text has null figures; one without tokens has 0 tokens, a
    log probability of 0 and no perplexity; repeated rows count each time and repeat
    their result; texts of any length are scored whole; an empty table gives an empty
    table; a word that would gain as much in several classes goes to the first of them.
    """
    slices = encode_words(docs, id_col, text_col)
    counts = count_words(slices)
    known = cluster(slices, counts, classes, min_count, sweeps, parts, limit_mb)
    sums = known.groupBy("class").agg(F.sum("n").alias("class_n"))
    table = saved(known.join(F.broadcast(sums), "class").select("word", "class", F.log(F.col("n") / F.col("class_n")).alias("emission")), "lm-model")
    rare = counts.where(F.col("n") < min_count).count()
    lookup = _Classes(slices, table, limit_mb)
    transitions = log_transitions(class_bigrams(lookup, classes), smoothing)
    return _score(lookup, transitions, -float(np.log(rare + 1)), classes)


def log_transitions(pairs: np.ndarray, smoothing: float) -> np.ndarray:
    pairs = pairs.astype(np.float64)
    share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    return np.log((pairs + smoothing * share) / (pairs.sum(1, keepdims=True) + smoothing))


def _score(lookup: _Classes, transitions: np.ndarray, rare: float, classes: int) -> DataFrame:
    kind = lookup.slices.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)
    read = lookup.reader()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own, emissions, _ in read(batch):
                emission = np.append(np.where(own < 0, rare, emissions), 0.0)
                flow, codes, ends = _stream(batch, i, np.where(own < 0, classes, own), classes + 1)
                # edges have code -1: the last entry, a log probability of 0
                steps = transitions[flow[:-1], flow[1:]] + emission[codes[1:]]
                sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
                total = segment_sum(steps, ends)
                total[sizes == 0] = 0.0
                gone = sizes < 0
                perplexity = np.exp(np.minimum(-total / (np.maximum(sizes, 0) + 1), 700))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.cast(arrow), pa.array(sizes, pa.int64(), mask=gone), pa.array(total, pa.float64(), mask=gone), pa.array(perplexity, pa.float64(), mask=sizes <= 0)], names=["id", "n_tokens", "log_prob", "perplexity"])

    shape = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    return lookup.slices.mapInArrow(lean(work), shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
