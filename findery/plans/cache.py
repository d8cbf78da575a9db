"""A persisted index and when it may be used: unchanged, after an update, or not at all."""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import text
from findery.operators import graph, index
from findery.sources import commits, corpus

from . import retrieval

#: Version of the stored layout; a store of another one is not read.
VERSION = 1


def head_commit(root: str) -> str:
    """The commit that a work tree is at, or ``nogit``."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return "nogit"
    return done.stdout.decode().strip() or "nogit"


def cache_key(root: str, with_history: bool, with_docs: bool) -> str:
    return f"{head_commit(root)}:h{int(with_history)}:d{int(with_docs)}"


def manifest(scanned: DataFrame, with_docs: bool) -> DataFrame:
    """(path, mtime, size) of all files that an index may hold; contents stay unread."""
    path = F.col("path")
    wanted = text.is_code(path)
    if with_docs:
        wanted = wanted | text.suffix(path).isin(".rst", ".txt", ".md")
    return scanned.where(wanted).select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"))


class _Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def exists(self, path: str) -> bool:
        fs, at = self.at(path)
        return fs.exists(at)

    def replace(self, new: str, old: str) -> None:
        fs, at = self.at(old)
        fs.delete(at, True)
        if not fs.rename(self.at(new)[1], at):
            raise OSError(f"can't rename {new} to {old}")

    def delete(self, path: str) -> None:
        fs, at = self.at(path)
        fs.delete(at, True)


def save(built: retrieval.Corpus, files: DataFrame, key: str, path: str) -> None:
    """Stores an index with its manifest and key. It is written beside ``path`` and renamed
    once whole, so readers see the old one or the new one."""
    spark = files.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        built.save(beside)
        files.write.parquet(f"{beside}/manifest")
        spark.createDataFrame([(VERSION, key)], "version int, key string").coalesce(1).write.parquet(f"{beside}/key")
        _Files(spark).replace(beside, path)
    finally:
        _Files(spark).delete(beside)


def load(spark: SparkSession, path: str, key: str) -> tuple[retrieval.Corpus, DataFrame] | None:
    """The stored (index, manifest) of this version and key; None if there is none."""
    if not _Files(spark).exists(f"{path}/key"):
        return None
    found = spark.read.parquet(f"{path}/key").first()
    if found is None or (found["version"], found["key"]) != (VERSION, key):
        return None
    return retrieval.Corpus.load(spark, path), spark.read.parquet(f"{path}/manifest")


def update(built: retrieval.Corpus, fresh: DataFrame) -> retrieval.Corpus:
    """The index with the rows of the files in ``fresh`` (as ``corpus.code_files`` gives
    them) replaced: postings, lengths, definitions, imports. History stays as it is."""
    changed = index.settled(fresh.select("path"))
    docs = changed.withColumnRenamed("path", "doc")
    files = index.settled(index.replace_documents(built.files, changed, fresh, "path"))
    body = index.settled(index.replace_documents(built.body, docs, index.postings(fresh.select(F.col("path").alias("doc"), "text"))))
    symbols = index.definitions(fresh).select("symbol", "path", "ord")
    symbols = built.symbols.join(changed, "path", "left_anti").select("symbol", "path", "ord").unionByName(symbols)
    symbols = index.settled(symbols.join(symbols.groupBy("symbol").agg(F.count("*").alias("n_files")), "symbol").select("symbol", "path", "ord", "n_files"))
    out = retrieval.Corpus(files, body, index.settled(index.lengths(body)), built.paths, symbols, index.settled(graph.replace_authored(built.authored, changed, files)))
    out.messages, out.cochange, out.pages, out.page_terms, out.comments = built.messages, built.cochange, built.pages, built.page_terms, built.comments
    return out


def update_pages(built: retrieval.Corpus, fresh: DataFrame) -> None:
    """Replaces the documentation pages in ``fresh`` (path, ord, text), in place."""
    changed = index.settled(fresh.select("path"))
    built.pages = index.settled(index.replace_documents(built.pages, changed, fresh, "path"))
    own = index.postings(fresh.select(F.col("path").alias("doc"), "text"), field="docs")
    built.page_terms = index.settled(index.replace_documents(built.page_terms, changed.withColumnRenamed("path", "doc"), own))


def load_or_build(spark: SparkSession, root: str, path: str, with_history: bool = True, with_docs: bool = True, use_cache: bool = True, reindex: bool = False) -> tuple[retrieval.Corpus, str]:
    """(index, kind) of the tree at ``root``, stored at ``path``. ``unchanged``: as stored;
    ``incremental``: files that the store holds were modified, and were read again; ``full``:
    built anew, as files came or went, a modified one isn't held, the commit or the options
    differ, or ``reindex`` asks for it. Without ``use_cache`` nothing is read or stored."""
    seen = corpus.scan(spark, root)
    key, now = cache_key(root, with_history, with_docs), index.settled(manifest(seen, with_docs))
    stored = load(spark, path, key) if use_cache and not reindex else None
    if stored is not None:
        built, was = stored
        changes = index.settled(index.classify_changes(was, now))
        kind = index.refresh_kind(changes)
        if kind == "unchanged":
            return built, kind
        if kind == "incremental" and (updated := _updated(built, seen, changes, with_docs)) is not None:
            save(updated, now, key, path)
            return updated, kind
    history = commits.git_commits(spark, root) if with_history else None
    built = retrieval.build(index.settled(corpus.code_files(seen)), history, index.settled(corpus.documentation(seen)) if with_docs else None)
    if use_cache:
        save(built, now, key, path)
    return built, "full"


def _updated(built: retrieval.Corpus, seen: DataFrame, changes: DataFrame, with_docs: bool) -> retrieval.Corpus | None:
    """None where a modified file isn't held, or may no longer be."""
    code = changes.where(text.is_code(F.col("path"))).select("path")
    fresh = index.settled(corpus.code_files(seen.join(code, "path", "left_semi")))
    held = built.files.join(code, "path", "left_semi").count()
    if not held == fresh.count() == code.count():
        return None
    out = update(built, fresh) if held else built
    pages = changes.join(code, "path", "left_anti").select("path")
    if with_docs and built.pages is not None and not pages.isEmpty():
        new = index.settled(corpus.documentation(seen.join(pages, "path", "left_semi")))
        if not built.pages.join(pages, "path", "left_semi").count() == new.count() == pages.count():
            return None
        update_pages(out, new)
    return out


def store_path(root: str) -> str:
    """Where the command line keeps a tree's index."""
    return "file://" + os.path.join(os.path.abspath(root), ".findery_cache")
