"""Corpus-wide line deduplication with pairs of Bloom filters.

Lines are told apart by a 128-bit hash. Each task sends, for every distinct line of
its texts, the hash and one place where it stands to the bucket of the hash; of a
line that it sees again it already knows that it is a repeat, so a line that a
billion documents share comes to its bucket once a task. A bucket has two Bloom
filters: a bit that is set while it is in *once* goes to *twice*, so a line that
comes again has all its bits in *twice*, no repeat is missed, and a single line is
suspected only by chance. Only suspects go on: they are confirmed by their whole
hash, the first occurrence is chosen by an aggregate with map-side combine, and the
numbers of the lines that go are joined with the documents. Buckets, not filters,
grow in number with the input, and it is one plan at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import fresh, lean, map_arrow, ref, saved, text_slices

#: Lines of a bucket (on average), and lines that a task gathers before it sends them.
BUCKET_LINES, FLUSH_LINES = 500_000, 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, hash as two numbers) of every line that isn't blank."""
    parts = pc.split_pattern(texts, "\n")
    ends = parts.offsets.to_numpy().astype(np.int64)
    trimmed = pc.utf8_trim(parts.values.slice(int(ends[0]), int(ends[-1] - ends[0])), " ")
    ends = ends - ends[0]
    full = np.flatnonzero(pc.binary_length(trimmed).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[full]
    hashed = np.frombuffer(b"".join([xxh3_128_digest(x) for x in trimmed.take(pa.array(full)).to_pylist()]), np.uint64).reshape(-1, 2)
    return owner, full - ends[owner], hashed


def _text_hash(texts: list[str]) -> np.ndarray:
    """Spark's ``xxhash64`` of each text."""
    return np.array([xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)


def _positions(hashed: np.ndarray, log_bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = hashed ^ (hashed >> np.uint64(31))
        return ((spread[:, None] * _ODD[None, :hashes]) >> np.uint64(64 - log_bits)).astype(np.int64)


def suspects(chunks: list[np.ndarray], bits_per_line: int, hashes: int) -> np.ndarray:
    """Which of the hashes are suspected to be in several chunks; each chunk has
    distinct ones. All that are come out True, others by chance."""
    log_bits = max(10, int(np.ceil(np.log2(max(1, sum(map(len, chunks)) * bits_per_line)))))
    once, twice = np.zeros(1 << log_bits, bool), np.zeros(1 << log_bits, bool)
    for chunk in chunks:
        where = _positions(chunk, log_bits, hashes)
        twice[where[once[where]]] = True
        once[where] = True
    return np.concatenate([twice[_positions(chunk, log_bits, hashes)].all(axis=1) for chunk in chunks])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, dropped_col: str | None = None, bits_per_line: int = 16, hashes: int = 4, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """``docs`` with every repeated line removed but for its first occurrence.

    Lines end at newlines and are compared without leading and trailing spaces.
    The first occurrence has the least (id, text hash, line number), null ids last.
    Other columns, whatever their names, pass through; ``length_col`` (if given) is
    set to the new text's length where lines went, and ``dropped_col`` is added with
    the number of lines removed (with underscores in front if ``docs`` has that name).

    Defined results: blank lines are never repeats and stay; a null text stays null
    and an empty one empty; rows with the same id and text count as one document
    and all get that document's result; a document whose lines all go keeps its
    row, with an empty text; texts of any length are read whole; an empty table gives
    an empty table. Lines are taken as equal if their 128-bit hashes are: among 10^12
    different lines any two agree with a chance under 10^-14.

    The filters take ``bits_per_line`` bits for each line; there are as many pairs of
    them as ``bucket_lines`` asks for.
    """
    names = list(docs.columns)
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = source.schema["id"].dataType
    arrow_kind = to_arrow_type(kind)
    n_lines = source.select(F.sum(1 + F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(n_lines) // bucket_lines))
    packed = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("again", pa.binary()), ("doc", pa.binary()), ("no", pa.binary()), ("ids", pa.list_(arrow_kind)), ("ths", pa.list_(pa.int64()))])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *[len(x[0]) for x in held]])
            ids, ths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            doc = np.concatenate([x[2] + b for x, b in zip(held, base)]).astype(np.int32)
            no, hashed = np.concatenate([x[3] for x in held]).astype(np.int32), np.concatenate([x[4] for x in held])
            held.clear()
            order = np.lexsort((hashed[:, 1], hashed[:, 0]))
            hashed, doc, no = hashed[order], doc[order], no[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashed[1:] != hashed[:-1]).any(axis=1)
            again = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
            first = (hashed[new, 0] % np.uint64(buckets)).astype(np.int32)
            # what stands here again is a repeat for sure and passes its bucket by
            part = np.empty(len(order), np.int32)
            part[new], part[~new] = first, buckets + (hashed[~new, 1] % np.uint64(buckets)).astype(np.int32)
            flags = np.ones(len(order), bool)
            flags[new] = again
            order = np.argsort(part, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
            for a, b in zip(cuts, cuts[1:]):
                at = order[a:b]
                used, short = np.unique(doc[at], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (hashed[at], flags[at], short.astype(np.int32), no[at])], pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), ids.take(pa.array(used))), pa.array([ths[used].tolist()], pa.list_(pa.int64()))], schema=packed)

        for batch in text_slices(batches, "text"):
            owner, no, hashed = _lines(batch.column("text"))
            if len(owner):
                held.append((batch.column("id").cast(arrow_kind), _text_hash(batch.column("text").to_pylist()), owner, no, hashed))
            if sum(len(x[2]) for x in held) >= FLUSH_LINES:
                yield from flush()
        if held:
            yield from flush()

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        hashed = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in part["hashes"]]
        again = np.concatenate([np.frombuffer(x, bool) for x in part["again"]])
        if part["part"].iloc[0] < buckets:
            again = again | suspects([h[:, 0] for h in hashed], bits_per_line, hashes)
        base = np.cumsum([0, *[len(x) for x in part["ids"]]])
        doc = np.concatenate([np.frombuffer(x, np.int32) + b for x, b in zip(part["doc"], base)])[again]
        no, both = np.concatenate([np.frombuffer(x, np.int32) for x in part["no"]])[again], np.concatenate(hashed)[again].view(np.int64)
        ids = pd.Series([i for x in part["ids"] for i in x], dtype=object)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "id": ids.iloc[doc].to_numpy(), "th": np.concatenate([np.asarray(x, np.int64) for x in part["ths"]])[doc], "no": no})

    shape = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("hashes", "again", "doc", "no")], T.StructField("ids", T.ArrayType(kind)), T.StructField("ths", T.ArrayType(T.LongType()))])
    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("no", T.IntegerType())])
    suspected = saved(source.mapInArrow(lean(scatter), shape).groupBy("part").applyInPandas(judge, found), "line-suspects")
    first = suspected.groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "no")).alias("at"))
    # a suspect that occurs once is its own first occurrence, so what goes is every suspect but these
    k_id, k_th, k_key, k_gone, k_count = fresh(docs, "k_id", "k_th", "k_key", "k_gone", "k_count")
    both = suspected.select("id", "th", "no", F.lit(False).alias("stays")).unionByName(first.select("at.id", "at.th", "at.no", F.lit(True).alias("stays")))
    gone = both.groupBy("id", "th", "no").agg(F.max("stays").alias("stays")).where("NOT stays").groupBy("id", "th").agg(F.collect_list("no").alias(k_gone))
    gone = gone.select(F.col("id").alias(k_id), F.col("th").alias(k_th), ref(k_gone))
    keyed = docs.withColumn(k_key, F.when(ref(text_col).isNotNull(), F.xxhash64(ref(text_col))))
    joined = keyed.join(gone, ref(id_col).eqNullSafe(ref(k_id)) & (ref(k_key) == ref(k_th)), "left").select(*[ref(c) for c in names], ref(k_gone))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            counts = pc.fill_null(pc.list_value_length(batch.column(k_gone)), 0).cast(pa.int32())
            texts = batch.column(text_col)
            some = np.flatnonzero(counts.to_numpy())
            if len(some):
                texts = texts.to_pylist()
                for i in some.tolist():
                    drop = set(batch.column(k_gone)[i].as_py())
                    texts[i] = "\n".join([x for no, x in enumerate(texts[i].split("\n")) if no not in drop])
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*[texts if c == text_col else batch.column(c) for c in names], counts], names=[*names, k_count])

    done = map_arrow(joined, cut, T.StructType([*docs.schema.fields, T.StructField(k_count, T.IntegerType())]))
    length = lambda c: F.when(ref(k_count) > 0, F.length(ref(text_col))).otherwise(ref(c)).cast(docs.schema[c].dataType).alias(c)
    return done.select(*[length(c) if c == length_col else ref(c) for c in names], *([ref(k_count).alias(fresh(docs, dropped_col)[0])] if dropped_col else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, dropped_col="n_dropped")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no
  FROM documents WHERE text IS NOT NULL
), r AS (
  SELECT *, trim(line) <> '' AND row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, no) > 1 AS gone FROM l
), j AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, j.text AS text, coalesce(j.n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN j USING (doc_id)
"""
