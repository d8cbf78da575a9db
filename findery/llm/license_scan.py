"""License scan by diagonal voting.

The hashes of all rolling word k-grams of every text join the k-grams of the
templates. Each hit votes for a diagonal, the text position less the template
position; inserted or lost words move later hits to a neighbouring diagonal, so
diagonals close to each other are merged. Every merged candidate is verified
against the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import lean, lists, ref, rolling, saved, text_slices, tokens, word_hashes
from .license_texts import TEMPLATES


def _signed(text: str) -> int:
    return int(np.uint64(xxh64_intdigest(text)).view(np.int64))


def _kgrams(texts: DataFrame, k: int) -> DataFrame:
    """(id, th, grams): the k-gram hashes of each text in order."""
    kind = texts.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            ends, codes, words = tokens(batch.column("text"))
            grams, offsets = rolling(word_hashes(words)[codes], ends, k)
            th = [_signed(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow), pa.array(th, pa.int64()), lists(grams.view(np.int64), offsets, pa.int64())], names=["id", "th", "grams"])

    return texts.mapInArrow(lean(work), T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))]))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", template_id: str = "template", template_text: str = "body", k: int = 4, shift: int = 6, min_coverage: float = 0.7, limit_mb: float = 32) -> DataFrame:
    """(id, template, start, end, coverage, votes): where texts hold templates.

    ``start`` and ``end`` are token numbers (end exclusive) of the verified span,
    ``coverage`` the part of the template's tokens found on the merged diagonals, at
    least ``min_coverage``; ``votes`` counts the k-gram hits. Diagonals at most
    ``shift`` apart merge, but no more than half the template's tokens, so that copies
    of a short one that follow each other stay apart.

    A template of fewer than ``k`` tokens is never found. A template inside another
    one's text is reported with it. Null and empty texts hold nothing; rows with the
    same id and text are one document; null ids are ids like others. A template that
    occurs several times in a text has a row for each place. A token that several
    diagonals offer goes to the one with the most votes, then the least. Texts of any
    length are read whole; an empty table of either kind gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where("text IS NOT NULL")
    models = templates.select(ref(template_id).cast("string").alias("id"), ref(template_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    half = F.floor((F.size("grams") + k - 1) / 2).cast("int")
    known = saved(_kgrams(models, k).select(F.col("id").alias("template"), F.least(F.lit(shift), half).alias("reach"), F.posexplode("grams").alias("at", "gram")), "template-grams")
    small = known.count() * 40 / 1e6 <= limit_mb
    side = F.broadcast(known) if small else known
    hits = _kgrams(source, k).select("id", "th", F.posexplode("grams").alias("pos", "gram")).join(side, "gram")
    diagonals = hits.groupBy("id", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.first("reach").alias("reach"))
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    apart = diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > F.col("reach")).cast("int"))
    merged = apart.withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(order))
    candidates = merged.groupBy("id", "th", "template", "cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "diagonal"))).alias("diagonals"), F.sum("votes").alias("votes"))
    found = saved(candidates.groupBy("id", "th").agg(F.collect_list(F.struct("template", "diagonals", "votes")).alias("candidates")), "license-candidates")
    # the templates' words go to every task that verifies; they are few and their size is checked above
    words = {r["id"]: r["text"] for r in models.toLocalIterator()}
    shared = spark.sparkContext.broadcast(words)
    kind = source.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(shared.value)
        ends, codes, spelled = tokens(pa.array([shared.value[n] for n in names], pa.string()))
        wanted = {n: np.array(spelled, object)[codes[ends[i] : ends[i + 1]]] for i, n in enumerate(names)}
        for batch in text_slices(batches, "text"):
            ids = batch.column("id").to_pylist()
            ths = batch.column("th").to_pylist()
            texts = batch.column("text").to_pylist()
            ends, codes, spelled = tokens(batch.column("text"))
            spelled = np.array(spelled, object)
            rows = []
            for i, found in enumerate(batch.column("candidates").to_pylist()):
                if _signed(texts[i]) != ths[i]:
                    continue  # another text under the same id
                own = spelled[codes[ends[i] : ends[i + 1]]]
                for c in found:
                    model = wanted[c["template"]]
                    where = np.full(len(model), -1)
                    for d in c["diagonals"]:
                        at = np.arange(len(model)) + d["diagonal"]
                        inside = (at >= 0) & (at < len(own))
                        same = np.zeros(len(model), bool)
                        same[inside] = own[at[inside]] == model[inside]
                        take = same & (where < 0)
                        where[take] = at[take]
                    hit = where >= 0
                    coverage = hit.sum() / len(model)
                    if coverage >= min_coverage:
                        rows.append((ids[i], c["template"], int(where[hit].min()), int(where[hit].max()) + 1, float(coverage), int(c["votes"])))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [arrow, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["id", "template", "start", "end", "coverage", "votes"])

    weight = F.sum(32 + F.aggregate("candidates", F.lit(0), lambda s, c: s + 64 + 16 * F.size(c["diagonals"])))
    hinted = F.broadcast(found) if (found.select(weight.alias("b")).first()["b"] or 0) / 1e6 <= limit_mb else found
    hinted = hinted.select(F.col("id").alias("k"), "th", "candidates")
    texts = source.join(hinted, F.col("id").eqNullSafe(F.col("k"))).select("id", "th", "text", "candidates")
    shape = T.StructType([T.StructField("id", kind), T.StructField("template", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("coverage", T.DoubleType()), T.StructField("votes", T.LongType())])
    return texts.mapInArrow(lean(verify), shape).distinct()


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, body string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, template_table(spark))
    return found.select(F.col("id").alias("doc_id"), "template", F.col("start").alias("start_token"), F.col("end").alias("end_token"), "coverage", "votes")
