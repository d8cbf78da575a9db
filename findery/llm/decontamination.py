"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by document: each shard holds, for every term of its texts,
the sorted positions at which it occurs, delta-coded. Positions run through the
whole shard, with a gap between documents, so a phrase is found by intersecting
lists shifted by the terms' offsets in the phrase, from the rarest term on, and
never crosses from one document to another. Building needs no shuffle, and the
stored index serves any later benchmark. A query sends to each shard only the
lists of terms that the benchmark has, and the windows of tests whose rarest term
the shard holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, ref, saved, sized_join, table_mb, text_slices, tokens

#: Tokens of a shard after which the next one begins; empty positions between documents.
SHARD_TOKENS = 1_000_000
GAP = 64


def _pack(positions: np.ndarray) -> bytes:
    """Varint deltas of sorted positions."""
    rest = np.diff(positions, prepend=0).astype(np.uint64)
    if rest.max(initial=0) < 128:
        return rest.astype(np.uint8).tobytes()
    columns = []
    while True:
        columns.append(rest)
        if not rest.any():
            break
        rest = rest >> np.uint64(7)
    wide = np.stack(columns[:-1] or columns, axis=1)
    used = np.ones(wide.shape, bool)
    used[:, 1:] = wide[:, 1:] > 0
    more = np.zeros(wide.shape, np.uint8)
    more[:, :-1] = np.where(used[:, 1:], 128, 0)
    return ((wide & np.uint64(127)).astype(np.uint8) | more)[used].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)) * 7
    values = (raw & 127).astype(np.int64) << shift
    return np.cumsum(np.add.reduceat(values, starts)) if len(starts) else np.zeros(0, np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional index of ``docs``: rows (shard, term, n, positions), and for each
    shard one row with a null term that has the ids and first positions of its
    documents. Written to the shared folder. Texts without tokens leave no trace."""
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    id_type = source.schema["id"].dataType
    id_arrow = to_arrow_type(id_type)
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("positions", pa.binary()), ("ids", pa.list_(id_arrow)), ("starts", pa.list_(pa.int64()))])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        vocabulary: dict[str, int] = {}
        terms, where, ids, starts = [], [], [], []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal vocabulary, terms, where, ids, starts, size, number
            if ids:
                codes, at = np.concatenate(terms), np.concatenate(where)
                terms, where = [], []
                at = at[np.argsort(codes, kind="stable")]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(vocabulary)))])
                del codes
                words = list(vocabulary)
                for a, b in term_cuts(bounds):
                    blobs = _pack_all(at[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), pa.array(words[a:b], pa.string()), pa.array(np.diff(bounds[a : b + 1]).astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(b - a, schema.field("ids").type), pa.nulls(b - a, schema.field("starts").type)], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([len(ids)], pa.int32()), pa.array([None], pa.binary()), pa.array([ids], schema.field("ids").type), pa.array([starts], schema.field("starts").type)], schema=schema)
            vocabulary, terms, where, ids, starts = {}, [], [], [], []
            size = 0
            number += 1

        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))
            counts = np.diff(ends)
            full = np.flatnonzero(counts)
            first = size + np.concatenate([[0], np.cumsum(counts[full] + GAP)])
            terms.append(at[codes])
            where.append((np.repeat(first[:-1] - ends[full], counts[full]) + np.arange(len(codes))).astype(np.int32))  # a batch has under 2^31 bytes
            own = batch.column("id").to_pylist()
            ids += [own[i] for i in full.tolist()]
            starts += first[:-1].tolist()
            size = int(first[-1])
            if size >= SHARD_TOKENS:
                yield from flush()
        yield from flush()

    kind = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("positions", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.LongType()))])
    return saved(source.mapInArrow(lean(shards), kind), "positions")


def term_cuts(bounds: np.ndarray, most_terms: int = 20_000, most_positions: int = 200_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of terms, of at most so many terms and positions, or one term:
    what is packed at once follows neither the shard nor its frequent terms."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = int(np.searchsorted(bounds, bounds[a] + most_positions, "right")) - 1
        b = min(max(b, a + 1), a + most_terms, n)
        yield a, b
        a = b


def _pack_all(at: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """``_pack`` of every list at once."""
    deltas = np.diff(at, prepend=0)
    first = bounds[:-1][bounds[:-1] < len(at)]  # the last lists may be empty
    deltas[first] = at[first]
    rest = deltas.astype(np.uint64)
    sizes = np.ones(len(rest), np.int64)
    for k in range(1, 6):
        sizes += rest >= np.uint64(1 << (7 * k))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - sizes
    for k in range(6):
        has = sizes > k
        if not has.any():
            break
        byte = ((rest[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[begin[has] + k] = byte | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
    cuts = np.concatenate([[0], ends])[bounds].tolist()
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def windows(words: list[str], n: int) -> list[tuple[int, list[str]]]:
    """All windows of ``n`` tokens, or the whole text if it is shorter."""
    if len(words) <= n:
        return [(0, words)] if words else []
    return [(i, words[i : i + n]) for i in range(len(words) - n + 1)]


def _near(sorted_: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
    return np.searchsorted(sorted_, at + slack, "right") > np.searchsorted(sorted_, at - slack, "left")


def find(index: DataFrame, tests: DataFrame, test_id: str = "item_id", test_text: str = "text", n: int = 13, rare: int = 8, slack: int = 4, min_tokens: int = 5) -> DataFrame:
    """(id, test id, kind, windows, first_token): which documents hold which test
    passages. ``windows`` is how many of the passage's windows of ``n`` tokens match,
    ``first_token`` the least token number in the document at which one does.

    ``phrase``: all terms of a window stand in the document in a row. ``proximity``
    (only for pairs without a phrase): each of the window's ``rare`` rarest distinct
    terms stands, shifted by its offset, within ``slack`` tokens of the rarest one's.
    A passage of fewer than ``n`` tokens is one window; one of fewer than
    ``min_tokens`` is too short to tell and matches nothing; a window of fewer than
    ``rare`` distinct terms is matched by phrase only.

    Rows with the same id count as one document, and tests with the same id as one
    test; null texts have no tokens; null ids are ids like others; texts of any length
    are indexed and matched whole; of equally rare terms the alphabetically first leads;
    without documents or tests nothing is found. A window with ``slack`` must fit into
    the gap between documents, or it is an error.
    """
    if n + slack >= GAP:
        raise ValueError(f"n + slack must be under {GAP}")
    queries = tests.select(ref(test_id).alias("test"), ref(test_text).alias("text")).where("text IS NOT NULL")
    test_type = queries.schema["test"].dataType
    id_type = index.schema["ids"].dataType.elementType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            spelled = [[words[c] for c in codes[ends[i] : ends[i + 1]].tolist()] for i in range(len(ends) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("test"), pa.array(spelled, pa.list_(pa.string()))], names=["test", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("key", pa.string()), ("window", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])
        for batch in batches:
            for key, words, known in zip(*[batch.column(c).to_pylist() for c in ("key", "words", "known")]):
                totals = {x["term"]: x["total"] for x in known}
                made = [w for _, w in windows(words, n)]
                leads = [min(w, key=lambda t: (totals[t], t)) for w in made]  # noqa: B023
                yield pa.RecordBatch.from_pydict({"term": leads, "key": [key] * len(made), "window": made, "totals": [[totals[t] for t in w] for w in made]}, schema=schema)

    worded = queries.mapInArrow(split, T.StructType([T.StructField("test", test_type), T.StructField("words", T.ArrayType(T.StringType()))])).where(F.size("words") >= min_tokens)
    worded = saved(worded.withColumn("key", F.xxhash64("test", "words").cast("string")), "tests")
    each = worded.select("key", "words").dropDuplicates(["key"])
    parts = each.select("key", F.explode(F.array_distinct("words")).alias("term"))
    terms = saved(parts.select("term").distinct(), "test-terms")
    lists = sized_join(index.where("term IS NOT NULL"), terms, ["term"], "left_semi", 24)
    counts = saved(lists.groupBy("term").agg(F.sum("n").alias("total")), "test-counts")
    known = parts.join(counts, "term", "left").groupBy("key").agg(F.collect_list(F.struct("term", F.coalesce("total", F.lit(0)).alias("total"))).alias("known"))
    made = saved(each.join(known, "key").mapInArrow(cut, "term string, key string, window array<string>, totals array<long>"), "test-windows")
    routed = sized_join(lists.select("shard", "term"), made, ["term"], "inner", 32).select("shard", "key", "window", "totals")

    def match(part: pd.DataFrame) -> pd.DataFrame:
        head = part["starts"].first_valid_index()
        ids, starts = list(part["ids"][head]), np.asarray(part["starts"][head], np.int64)
        own = part[part["term"].notna()]
        blobs: dict[str, bytes] = dict(zip(own["term"], own["positions"]))
        opened: dict[str, np.ndarray] = {}

        def positions(term: str) -> np.ndarray:
            if term not in opened:
                opened[term] = _unpack(blobs[term])
            return opened[term]

        found: dict[tuple[int, str, str], list[int]] = {}
        asked = part[part["key"].notna()]
        for key, window, totals in zip(asked["key"], asked["window"], asked["totals"]):
            offsets: dict[str, int] = {}
            for i, w in enumerate(window):
                offsets.setdefault(w, i)
            rank = dict(zip(window, totals))
            order = sorted(offsets, key=lambda w: (rank[w], w))
            lead = order[0]
            anchors = positions(lead) - offsets[lead]
            exact = anchors
            for w, i in sorted(((w, i) for i, w in enumerate(window)), key=lambda x: (rank[x[0]], x[1])):
                if not len(exact):
                    break
                exact = exact[_near(positions(w), exact + i, 0)] if w in blobs else exact[:0]
            near = anchors[:0]
            if len(order) >= rare:
                near = anchors
                for w in order[1:rare]:
                    if not len(near):
                        break
                    near = near[_near(positions(w), near + offsets[w], slack)] if w in blobs else near[:0]
            for kind, hits in (("phrase", exact), ("proximity", near)):
                if len(hits):
                    docs, first = np.unique(np.searchsorted(starts, hits + offsets[lead], "right") - 1, return_index=True)
                    for d, at in zip(docs.tolist(), (hits[first] - starts[docs]).tolist()):  # hits are in order
                        entry = found.setdefault((d, key, kind), [0, at])
                        entry[0] += 1
                        entry[1] = min(entry[1], at)
        rows = [(ids[d], key, kind, count, max(0, at)) for (d, key, kind), (count, at) in found.items() if kind == "phrase" or (d, key, "phrase") not in found]
        return pd.DataFrame(rows, columns=["id", "key", "kind", "windows", "first_token"]).astype({"windows": "int64", "first_token": "int64"})

    shape = T.StructType([T.StructField("id", id_type), T.StructField("key", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("windows", T.LongType()), T.StructField("first_token", T.LongType())])
    everything = lists.select("shard", "term", "positions").unionByName(index.where("term IS NULL").select("shard", "ids", "starts"), allowMissingColumns=True).unionByName(routed, allowMissingColumns=True)
    hits = sized_join(everything.groupBy("shard").applyInPandas(match, shape), worded.select("key", "test").distinct(), ["key"], "inner", 40)
    best = hits.groupBy("id", "test").agg(F.min("kind").alias("kind"), F.max(F.struct(F.col("kind") == "phrase", "windows")).alias("w"), F.min(F.struct(F.col("kind") == "proximity", "first_token")).alias("f"))
    return best.select("id", "test", "kind", F.col("w.windows").alias("windows"), F.col("f.first_token").alias("first_token"))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_mb: float = 32, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test passage, by phrase or proximity. Defined
    results are those of ``find``; texts without tokens, null ones included, stay."""
    found = find(build_index(docs, id_col, text_col), tests, **options)
    leaked = saved(found.select(F.col("id").alias("leaked")).distinct(), "leaked")
    side = F.broadcast(leaked) if table_mb(leaked, 16) <= limit_mb else leaked
    return docs.join(side, ref(id_col).eqNullSafe(side["leaked"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(build_index(docs), tests).select(F.col("id").alias("doc_id"), F.col("test").alias("item_id"), "kind", "windows", "first_token")
