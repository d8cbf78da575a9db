"""The inverted index as relations, and its upkeep.

``postings(field, doc, term, tf, first_pos)`` and ``lengths(field, doc, n_terms)`` hold
all there is; document frequencies and averages are aggregates of them, so replacing
a document's rows is all that an update takes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions import text

from . import scan


def sized_broadcast(df: DataFrame, row_bytes: int, limit_mb: float = 32) -> DataFrame:
    """``df``, marked for broadcast if its counted size stays under ``limit_mb``;
    beyond that the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes / 1e6 <= limit_mb else df


def tasks_for(df: DataFrame, rows: int | float, each: int = 1_000_000) -> int:
    """Partitions so that each has some ``each`` of ``rows``, and no fewer than usual."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-rows // each)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: plans that read it several
    times stay small, and lost executors cost nothing. A cluster must name the folder in
    ``spark.checkpoint.dir``; a temporary one is used only with a local master."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/findery-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeated(docs: DataFrame) -> bool:
    """Whether several rows are of the same ``doc``. Only that column is read."""
    return not docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def postings(docs: DataFrame, doc: str = "doc", body: str = "text", field: str = "body", unique: bool = False) -> DataFrame:
    """Term frequencies of each document, with the place of the first occurrence
    (identifier number, then number within the identifier). A document is counted where
    it is read; only those given in several rows (``unique``: there are none) shuffle."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(body).alias("text"))
    found = scan.postings(rows)
    if not unique and repeated(rows):
        found = found.groupBy("doc", "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))
    return found.select(F.lit(field).alias("field"), "doc", "term", "tf", "first_pos")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, tf) of ``docs`` (doc, text); at the null term, the number of documents
    that have a term, and of all terms in them. Each task sums its own first."""
    rows = docs.select("doc", "text")
    if not repeated(rows):
        return scan.term_counts(rows).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    found = settled(postings(rows))
    total = found.agg(F.lit(None).cast("string").alias("term"), F.count_distinct(F.struct("doc")).alias("df"), F.sum("tf").alias("tf"))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).unionByName(total)


@dataclass
class Vectors:
    """Documents as their frequencies of some terms; ``rows`` as ``scan.vectors`` makes
    them, ``numbers`` those of the terms."""

    rows: DataFrame
    numbers: dict[str, int]


def term_numbers(*terms: DataFrame) -> dict[str, int]:
    """The distinct terms of questions, numbered in order of spelling."""
    return {t: i for i, t in enumerate(sorted({r["term"] for part in terms for r in part.select("term").distinct().collect()}))}


def vectors(docs: DataFrame, numbers: dict[str, int], unique: bool = False) -> Vectors:
    """``docs`` (doc, text, and columns to keep) as vectors of the terms in ``numbers``. Of a
    document given in several rows, the least of each kept column counts."""
    if unique or not repeated(docs.select("doc")):
        return Vectors(settled(scan.vectors(docs, numbers)), numbers)
    kept = [c for c in docs.columns if c not in ("doc", "text")]
    merged = docs.groupBy("doc").agg(*[F.min(c).alias(c) for c in kept]) if kept else None
    return posted_vectors(postings(docs), numbers, merged)


def posted_vectors(posted: DataFrame, numbers: dict[str, int], docs: DataFrame | None = None) -> Vectors:
    """Vectors of a stored index; ``docs`` (doc, ...) has columns to add to them."""
    known = posted.sparkSession.createDataFrame(list(numbers.items()), "term string, t int")
    own = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", F.col("tf").cast("long").alias("tf")))))
    rows = posted.join(sized_broadcast(known, 48), "term", "left").groupBy("doc").agg(F.sum("tf").cast("long").alias("n_terms"), F.sum(F.col("tf") * F.col("tf")).cast("long").alias("squares"), own.alias("own"))
    if docs is not None:
        rows = rows.join(docs.withColumnRenamed("doc", "same"), F.col("doc").eqNullSafe(F.col("same"))).drop("same")
    kept = [c for c in docs.columns if c != "doc"] if docs is not None else []
    return Vectors(settled(rows.select("doc", *kept, "n_terms", "squares", F.col("own.t").alias("t"), F.col("own.tf").alias("tf"))), numbers)


def lengths(posted: DataFrame) -> DataFrame:
    """(field, doc, n_terms) of every document that has a term."""
    return posted.groupBy("field", "doc").agg(F.sum("tf").alias("n_terms"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_stats(sizes: DataFrame) -> DataFrame:
    """(field, n_docs, avg_len)."""
    return sizes.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def path_terms(files: DataFrame) -> DataFrame:
    """(path, term): the distinct terms of each path."""
    return files.select("path", F.explode(text.path_tokens(F.col("path"))).alias("term"))


def definitions(files: DataFrame) -> DataFrame:
    """(symbol, path, ord, n_files): which files define which symbols. Tests and
    examples define nothing; ``n_files`` counts the definers."""
    prod = files.where(text.path_prior(F.col("path")) == 1.0)
    found = prod.select("path", "ord", F.explode(text.definitions(F.col("path"), F.col("text"))).alias("symbol"))
    # counted with map-side combine: names like ``main`` are hot keys
    return found.join(found.groupBy("symbol").agg(F.count("*").alias("n_files")), "symbol").select("symbol", "path", "ord", "n_files")


def vocabulary(*posted: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All distinct terms of the fields and of the paths."""
    found = [p.select("term") for p in posted] + ([paths.select("term")] if paths is not None else [])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def coverage(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, matched, total, zero_match): how many of a query's terms the corpus has."""
    asked = terms.join(known.select("term", F.lit(1).alias("hit")), "term", "left")
    counted = asked.groupBy("query_id").agg(F.count("hit").alias("matched"), F.count("*").alias("total"))
    return counted.withColumn("zero_match", F.col("matched") == 0)


def low_confidence(top: Column, matched: Column, total: Column) -> Column:
    return (total == 0) | (top < 12.0) | (matched / total < 0.45)


# ---- upkeep


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): ``added``, ``removed`` or ``modified`` files between two
    manifests (path, mtime, size)."""
    a, b = old.select("path", F.struct("mtime", "size").alias("was")), new.select("path", F.struct("mtime", "size").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def refresh_kind(changes: DataFrame) -> str:
    """``unchanged``, ``incremental`` (only modified files) or ``full``."""
    kinds = {r["change"] for r in changes.select("change").distinct().collect()}  # at most three
    return "unchanged" if not kinds else "incremental" if kinds == {"modified"} else "full"


def replace_documents(posted: DataFrame, docs: Iterable[str] | DataFrame, fresh: DataFrame, key: str = "doc") -> DataFrame:
    """An index relation with the rows of ``docs`` replaced by those of ``fresh``."""
    if not isinstance(docs, DataFrame):
        docs = posted.sparkSession.createDataFrame([(d,) for d in docs], f"{key} string")
    gone = sized_broadcast(settled(docs.select(key).distinct()), 128)
    return posted.join(gone, key, "left_anti").select(posted.columns).unionByName(fresh.select(posted.columns))
