"""Language identification by words, backing off to character n-grams.

A text's score for a language is the sum over its tokens: a word of the model has
its log frequency in that language; an unseen word falls back to the longest
order of character n-grams (of the word with its edges marked) of which the model
has any, and scores by their mean log frequency; a word none of whose characters
is known says nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, map_arrow, ref, segment_sum, sized_join, text_slices, tokens

MAX_N = 4
_CACHE = 400_000


@dataclass
class Model:
    """Log frequencies: ``grams[n][gram]`` is a tuple with one entry a language
    (order 0: whole words)."""

    languages: list[str]
    grams: list[dict[str, tuple[float, ...]]]

    def word(self, word: str) -> tuple[float, ...]:
        known = self.grams[0].get(word)
        if known is not None:
            return known
        marked = f"^{word}$"
        for n in range(MAX_N, 0, -1):
            table = self.grams[n]
            found = [table[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in table]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found))
        return (0.0,) * len(self.languages)


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 400, min_count: int = 2, smoothing: float = 0.5) -> Model:
    """Trains on a bounded sample of labelled rows: of each language the
    ``rows_per_language`` rows that come first by a hash of their id. Words and
    n-grams seen under ``min_count`` times in the sample are left out.

    Rows without label or text are no examples; without any example the model has
    no languages and every text is undetermined.
    """
    rows = labelled.select(ref(id_col).alias("id"), ref(text_col).alias("text"), ref(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.col("id"))
    chosen = rows.select("id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_language).select("id", "lang").distinct()
    sample = sized_join(rows, chosen, ["id", "lang"], "left_semi", 40)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("c", pa.int64())])
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [codes[ends[i] : ends[i + 1]] for i, x in enumerate(langs) if x == lang]
                counts = np.bincount(np.concatenate(own), minlength=len(words)) if own else np.zeros(0, int)
                grams: list[Counter] = [Counter() for _ in range(MAX_N + 1)]
                for k in np.flatnonzero(counts).tolist():
                    word, c = words[k], int(counts[k])
                    if not has_letter(word):
                        continue
                    grams[0][word] += c
                    marked = f"^{word}$"
                    for n in range(1, MAX_N + 1):
                        for i in range(len(marked) - n + 1):
                            grams[n][marked[i : i + n]] += c
                for n, found in enumerate(grams):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    counted = sample.select("lang", "text").mapInArrow(lean(count), "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    total: dict[tuple[int, str], dict[str, int]] = {}
    for row in counted.toLocalIterator():  # bounded by the sample
        total.setdefault((row["n"], row["gram"]), {})[row["lang"]] = row["c"]
    languages = sorted({lang for by in total.values() for lang in by})
    sums = Counter()
    kinds = Counter()
    for (n, _), by in total.items():
        kinds[n] += 1
        for lang, c in by.items():
            sums[n, lang] += c
    grams: list[dict[str, tuple[float, ...]]] = [{} for _ in range(MAX_N + 1)]
    for (n, gram), by in total.items():
        if sum(by.values()) >= min_count:
            grams[n][gram] = tuple(math.log((by.get(x, 0) + smoothing) / (sums[n, x] + smoothing * kinds[n])) for x in languages)
    return Model(languages, grams)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "pred_lang", confidence_out: str = "confidence", words_out: str = "n_words") -> DataFrame:
    """``docs`` with the most likely language, its posterior under equal priors and
    the number of words used (tokens with a letter that the model says something about).

    Defined results: a null or empty text, one without letters or without any known
    character has language null, confidence 0.0 and 0 words. Equal scores go to the
    language first in alphabetical order. Texts of any length are scored whole. Rows are
    independent, so repeated rows repeat their result; an empty table gives an empty
    table. Outputs get underscores in front where ``docs`` has a column of the name (in
    any case of letters).
    """
    lang_out, confidence_out, words_out = fresh(docs, lang_out, confidence_out, words_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.languages)
        cache: dict[str, int] = {}
        table = [np.zeros(1 << 12, np.float32) for _ in range(n)]
        used = np.zeros(1 << 12, bool)
        for batch in text_slices(batches, text_col):
            ends, codes, words = tokens(batch.column(text_col))
            if len(cache) > _CACHE:
                cache.clear()
            at = np.empty(len(words), np.int64)
            for k, word in enumerate(words):
                i = cache.get(word)
                if i is None:
                    i = cache[word] = len(cache)
                    if i >= len(used):
                        table = [np.concatenate([x, np.zeros(len(x), np.float32)]) for x in table]
                        used = np.concatenate([used, np.zeros(len(used), bool)])
                    values = model.word(word) if has_letter(word) else (0.0,) * n
                    for x, v in zip(table, values):
                        x[i] = v
                    used[i] = any(values)
                at[k] = i
            rows = len(ends) - 1
            counts = segment_sum(used[at][codes], ends).astype(np.int64)
            if n:
                sums = np.stack([segment_sum(x[at][codes], ends) for x in table])
                best = sums.argmax(axis=0)
                confidence = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
                confidence[counts == 0] = 0.0
            else:
                best, confidence = np.zeros(rows, int), np.zeros(rows)
            names = [model.languages[b] if c else None for b, c in zip(best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(confidence, pa.float64()), pa.array(counts, pa.int64())], names=[*batch.schema.names, lang_out, confidence_out, words_out])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(confidence_out, T.DoubleType()), T.StructField(words_out, T.LongType())])
    return map_arrow(docs, score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "pred_lang", "confidence", "n_words")


def keep_identified(docs: DataFrame, model: Model, min_confidence: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (with its columns) whose language is told with at least
    ``min_confidence``; a text that gives no evidence is rejected."""
    lang, confidence, words = fresh(docs, "pred_lang", "confidence", "n_words")
    scored = identify(docs, model, text_col, lang, confidence, words)
    return scored.where(ref(lang).isNotNull() & (ref(confidence) >= min_confidence)).select(*[ref(c) for c in docs.columns])
