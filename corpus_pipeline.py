"""Cleaning a document table for training, stage by stage.

``STAGES`` holds (name, function) pairs; each function takes (spark, docs, sf_dir),
where docs is what the stage before kept, read back from Parquet, and works on all
of it. All but the last return the columns of ``documents``; the last adds the
token ids, their number and whether they decode to the text, under names that no
column of ``docs`` has. Scratch tables of a stage are dropped when the next one
begins on the same folder, as its result is written by then.

Every stage takes an empty table, null ids, texts and other columns, repeated rows
and texts of any length: a null text is rejected by language ID (it gives no
evidence), rows with a null id are compared with nothing by the Jaccard join and
stay, and ties go by the least id, as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findery.llm import byte_bpe, decontamination, language_id, line_dedup, ngram_jaccard
from findery.llm.common import Run, scratch_path

#: Bytes of an Arrow batch that goes to a Python worker. Spark's own limit lets the texts
#: of a whole partition be there at once, in the executor and in the worker.
BATCH_BYTES = 4 << 20

#: Runs of the stages by folder and stage number.
_runs: dict[tuple[str, int], Run] = {}


def _run(spark: SparkSession, sf_dir: str, stage: int) -> Run:
    """The run of a stage; those of the stages before it on the same folder are dropped."""
    for key in [k for k in _runs if k[0] == sf_dir and (k[1] < stage or stage == 0)]:
        _runs.pop(key).release()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # stays set: the stage is run after it returns
    run = _runs[sf_dir, stage] = Run(spark)
    return run


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told. The model learns from a bounded
    sample of the labelled rows."""
    with _run(spark, sf_dir, 0):
        return language_id.keep_identified(docs, language_id.fit(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every repeated line of the corpus but its first occurrence."""
    with _run(spark, sf_dir, 1):
        return line_dedup.dedup_lines(docs, length_col="n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar ones."""
    with _run(spark, sf_dir, 2):
        return ngram_jaccard.keep_one(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    with _run(spark, sf_dir, 3):
        return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of the whole text, their number and whether they decode to it."""
    with _run(spark, sf_dir, 4):
        return byte_bpe.encode(docs, byte_bpe.load(), check_out="round_trip")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave of ``documents``. Every stage but the last is
    written to the shared folder and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Language ID and the tokenizer have no equivalent in SQL.
ORACLE_SQL = None
