"""What the operators share: scratch tables, row keys, tokens and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates tokens: anything but letters, digits and combining marks.
SEPARATOR = r"[^\p{L}\p{N}\p{M}]+"

_M_MMAP_THRESHOLD = -3


def _return_large_blocks() -> None:
    """Has the C library give arrays of 1 MB and up back to the system as they are
    freed; by itself it raises that size and keeps them in its heap."""
    try:
        ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, 1 << 20)
    except (AttributeError, OSError):  # another C library
        pass


_return_large_blocks()


class Run:
    """The scratch tables of one run, dropped by ``release``. Tables made while the
    run is entered (``with``) belong to it; others stay until their owner cleans
    the shared folder, as a lazy result may still read them."""

    _open: list[Run] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Run:
        Run._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Run._open.remove(self)

    def release(self) -> int:
        """Drops the tables. Only for callers that have written what was computed from them."""
        gone, self.paths = self.paths, []
        for path in gone:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return len(gone)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir``, which a
    cluster must name. A temporary folder is used only with a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/findery-{name}-{uuid.uuid4().hex}"
    if Run._open:
        Run._open[-1].paths.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage
    and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def ref(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table_mb(df: DataFrame, row_bytes: int) -> float:
    """Size of a (saved) table in MB: counted rows of ``row_bytes`` for the columns of
    fixed width, and the measured bytes of strings, binaries and arrays."""
    wide = [F.octet_length(ref(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide += [F.size(ref(f.name)) * 16 for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    total = F.lit(row_bytes).cast("long")
    for part in wide:
        total = total + F.greatest(F.coalesce(part, F.lit(0)), F.lit(0))
    return (df.select(F.sum(total).alias("b")).first()["b"] or 0) / 1e6


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int, limit_mb: float = 32) -> DataFrame:
    """Equi-join that broadcasts ``right`` only if its counted size is under
    ``limit_mb``; beyond that both sides shuffle on the key."""
    if table_mb(right, row_bytes) <= limit_mb:
        right = F.broadcast(right)
    else:
        right = right.hint("shuffle_merge" if how not in ("left_semi", "left_anti") else "merge")
    return left.join(right, on, how)


def _trim() -> None:
    """Returns free memory to the system: workers are reused, and what they keep adds up.
    What the first collection leaves, modules mostly, later ones don't look at."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work):
    """``work`` (a function of Arrow batches), which gives its memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _trim()

    return run


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``max_bytes`` of ``column``: what
    is worked on at once follows the texts' sizes, not the number of rows."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased tokens of each text: (offsets, codes, distinct). Text i has
    ``codes[offsets[i]:offsets[i+1]]``, indices into ``distinct``. A null text
    has no tokens."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), SEPARATOR)
    ends = lists.offsets.to_numpy()
    flat = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends.astype(np.int64) - int(ends[0])
    if "" in words:
        blank = words.index("")
        full = codes != blank
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return ends, codes, words


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (wraps around)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def rolling(hashed: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-grams of consecutive tokens inside each text, with their
    offsets; a text of fewer than ``n`` tokens has none."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - n + 1, 0)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mix(hashed[starts + i])
    return mix(total), out_offsets


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets (the last one is their number);
    0 for an empty segment. Equal segments have equal sums to the last bit."""
    out = np.zeros(len(offsets) - 1)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), offsets[:-1][full])
    return out


def map_arrow(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(work, schema)`` for columns of any name, dots included."""
    names, made = list(df.columns), [f.name for f in schema.fields]
    inner = [f"c{i}" for i in range(len(made))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(inner)

    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lean(renamed), plain).toDF(*made)


def merged_counts(parts: DataFrame, slice_size: int, rank) -> DataFrame:
    """(slice, ranks): sums the count arrays of each slice and maps them by ``rank``
    (to uint8). ``parts`` is (slice, counts) as ``count_slices`` yields them. The blobs
    stream through a task, which holds a few slices, however many blobs there are."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                raw = zlib.decompress(blob)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, slice_size // 8)))
                own = np.frombuffer(raw, np.uint8 if len(raw) == slice_size // 8 + len(at) else np.uint32, offset=slice_size // 8)
                if s not in total:
                    total[s] = np.zeros(slice_size, np.int64)
                total[s][at] += own.astype(np.int64) + 1
        for s, counts in total.items():
            yield pa.RecordBatch.from_pydict({"slice": [s], "ranks": [zlib.compress(rank(counts).astype(np.uint8).tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("ranks", pa.binary())]))

    return parts.repartition("slice").mapInArrow(lean(merge), "slice int, ranks binary")


def count_slices(cells: np.ndarray, slice_size: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The slices (numbered from ``first``) of an array of uint32 counts that hold any:
    a bit for each cell that isn't 0, and the counts of those, less 1."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    for s in range(len(cells) // slice_size):
        part = cells[s * slice_size : (s + 1) * slice_size]
        if part.any():
            rest = part[part > 0] - 1
            rest = rest.astype(np.uint8) if rest.max() < 256 else rest
            yield pa.RecordBatch.from_pydict({"slice": [first + s], "counts": [zlib.compress(np.packbits(part > 0).tobytes() + rest.tobytes(), 1)]}, schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
