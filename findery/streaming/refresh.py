"""A stream of changed files kept in an index on disk.

Each micro-batch adds one version: the postings of the files that it brings, and
which files those are. A file's rows are those of its last version, so a batch costs
what it brings, not what the index holds. A version counts once its file list is
written whole, and a repeated batch (after a failure) writes the same version again,
so readers never see half of one. ``compact`` folds all versions into a base and
deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findery.operators import index

_POSTINGS = "field string, doc string, term string, tf long, first_pos int"


def _numbers(spark: SparkSession, path: str, kind: str, inner: str = "") -> list[int]:
    """The numbers of the complete folders ``path/kind`` + number, in order."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath(path))]
    found = [int(n[len(kind) :]) for n in names if n.startswith(kind) and n[len(kind) :].isdigit()]
    return sorted(n for n in found if fs.exists(jpath(f"{path}/{kind}{n}{inner}/_SUCCESS")))


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The postings as of the newest complete version; None before the first one."""
    bases = _numbers(spark, path, "base")
    base = bases[-1] if bases else 0
    versions = [v for v in _numbers(spark, path, "v", "/docs") if v > base]
    if not bases and not versions:
        return None
    old = spark.read.parquet(f"{path}/base{base}") if bases else spark.createDataFrame([], _POSTINGS)
    if not versions:
        return old
    number = F.regexp_extract(F.input_file_name(), r"/v(\d+)/", 1).cast("long")
    docs = spark.read.parquet(*[f"{path}/v{v}/docs" for v in versions]).select("doc", number.alias("version")).groupBy("doc").agg(F.max("version").alias("version"))
    new = spark.read.parquet(*[f"{path}/v{v}/postings" for v in versions]).withColumn("version", number)
    current = new.join(docs, ["doc", "version"], "left_semi").select(old.columns)
    return old.join(docs.select("doc"), "doc", "left_anti").select(old.columns).unionByName(current)


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes version ``batch_id`` + 1 from the batch's files (path, text, seq). Of several
    states of a file the last counts; a null text removes it."""
    newest = batch.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("r = 1")
    newest = index.settled(newest.select(F.col("path").alias("doc"), "text"))
    at = f"{path}/v{batch_id + 1}"
    fresh = index.postings(newest.where("text IS NOT NULL"))
    fresh.select("field", "doc", "term", F.col("tf").cast("long").alias("tf"), "first_pos").write.mode("overwrite").parquet(f"{at}/postings")
    newest.select("doc").write.mode("overwrite").parquet(f"{at}/docs")


def compact(spark: SparkSession, path: str) -> None:
    """Writes what all versions make as one base, then deletes them and older bases. Run
    it while no reader still uses them."""
    bases, versions = _numbers(spark, path, "base"), _numbers(spark, path, "v", "/docs")
    if not versions:
        return
    read_index(spark, path).write.mode("overwrite").parquet(f"{path}/base{versions[-1]}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"v{v}" for v in versions] + [f"base{b}" for b in bases if b != versions[-1]]:
        fs.delete(jpath(f"{path}/{name}"), True)


def maintain(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the upkeep of the index at ``path`` from a stream of changes."""
    writer = changes.writeStream.foreachBatch(lambda batch, i: upsert(batch, i, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
