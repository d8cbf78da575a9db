"""Toxicity by nearest labelled examples.

A bounded sample of labelled documents forms an inverted index of TF-IDF weights,
in which terms that stand with one label more than chance allows weigh more, cut into blocks of similar examples; for every term each block has the largest
weight in it. Every document of the corpus is a query: the blocks' largest weights
bound its cosine with any example of a block, blocks are scored in the order of
their bounds, and the rest are skipped once no bound can reach the k-th best, so
the k nearest examples are exact. Their labels, weighted by nearness, give a vote
that is calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ref, sized_join, text_slices, tokens


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    block: int
    #: Postings by block: for block b and term t, examples and weights at starts[b][t] to starts[b][t + 1].
    starts: list[np.ndarray]
    examples: list[np.ndarray]
    weights: list[np.ndarray]
    #: Largest weight by term and block.
    largest: np.ndarray
    k: int
    base_rate: float
    #: Calibration: votes and the probabilities at them.
    votes: np.ndarray
    probabilities: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights (of length 1) of the terms of one text."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((weights**2).sum())
        return weights / norm if norm > 0 else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without=None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest examples with a cosine above 0,
        nearest first, ties by the examples' order."""
        bounds = weights @ self.largest[terms]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        floor = 0.0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or bounds[b] < floor - 1e-12:
                break
            begin = self.starts[b][terms]
            width = self.starts[b][terms + 1] - begin
            ends = np.cumsum(width)
            at = np.repeat(begin - ends + width, width) + np.arange(ends[-1])
            found = np.bincount(self.examples[b][at], weights=self.weights[b][at] * np.repeat(weights, width))
            own = np.flatnonzero(found > max(0.0, floor - 1e-12))
            ids = own + b * self.block
            if without is not None:
                keep = np.array([self.ids[i] != without for i in ids.tolist()], bool)
                own, ids = own[keep], ids[keep]
            best, scores = np.concatenate([best, ids]), np.concatenate([scores, found[own]])
            if len(best) > self.k:
                order = np.lexsort((best, -np.round(scores, 9)))[: self.k]
                best, scores = best[order], scores[order]
                floor = scores.min()
        order = np.lexsort((best, -np.round(scores, 9)))
        return best[order], scores[order]

    def vote(self, best: np.ndarray, scores: np.ndarray) -> float:
        """Share of toxic examples, weighted by one over the distance."""
        if not len(best):
            return -1.0
        weights = 1 / (1.05 - np.minimum(scores, 1.0))
        return float((weights * self.labels[best]).sum() / weights.sum())

    def score(self, vote: float) -> float:
        if vote < 0 or not len(self.votes):
            return self.base_rate
        return float(np.interp(vote, self.votes, self.probabilities))


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        if pools and pools[-1][3] == a:
            last = pools[-1]
            last[0] += b * c
            last[1] += c
        else:
            pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    at, value = [], []
    for total, weight, low, high in pools:
        at += [low] if low == high else [low, high]
        value += [total / weight] * (1 if low == high else 2)
    return np.array(at), np.array(value)


def _telling(presence: list[np.ndarray], labels: np.ndarray, terms: int) -> np.ndarray:
    """A factor of each term's weight: 1 unless the share of one label among the examples
    that have the term is no chance. A few words tell a toxic text among hundreds that
    don't, and by IDF alone they hardly count."""
    if not len(labels) or labels.min() == labels.max():
        return np.ones(terms)
    have = np.bincount(np.concatenate(presence), minlength=terms).astype(np.float64)
    toxic = np.bincount(np.concatenate(presence), np.repeat(labels, [len(t) for t in presence]), minlength=terms)
    share = labels.mean()
    # deviations of the likelihood ratio; that of chance alone passes 5 for a side once in 268,000 terms at most
    ratio = sum(x * np.log(np.maximum(x, 1e-9) / (have * s)) for x, s in ((toxic, share), (have - toxic, 1 - share)))
    return 1 + 2 * np.maximum(0, np.sqrt(2 * np.maximum(ratio, 0)) - 5)


def build(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = 1000, k: int = 30, block: int = 128) -> Index:
    """The index of a bounded sample: of each label the ``per_class`` documents that
    come first by a hash of their id. Its terms are all of theirs, so examples have
    their exact vectors; document frequencies count the whole corpus. A query's length
    is taken over the terms that examples have: others change no order of examples.
    A term's ``idf`` holds its factor by ``_telling`` too.

    Labels other than 0 and 1, null ids or texts are no examples. Without examples
    every document has the base rate (0.0 without any label).
    """
    spark = docs.sparkSession
    marks = labels.select(ref(label_id).alias("id"), ref(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    rate = marks.agg(F.avg("label").alias("rate")).first()["rate"] or 0.0
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    present = marks.join(source.select("id").distinct(), "id", "left_semi")
    chosen = present.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_class).select("id", "label")
    rows = sized_join(source, chosen, ["id"], "inner", 16).groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("id").collect()  # bounded by per_class
    ids, marks_of = [r["id"] for r in rows], np.array([r["label"] for r in rows], np.float64)
    ends, codes, words = tokens(pa.array([r["text"] for r in rows], pa.string()))
    bags = [np.unique(codes[ends[i] : ends[i + 1]], return_counts=True) for i in range(len(rows))]
    used = np.unique(codes)
    to_term = np.full(len(words), -1, np.int64)
    to_term[used] = np.arange(len(used))
    vocabulary = {words[w]: i for i, w in enumerate(used.tolist())}
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, texts = np.zeros(len(terms) + 1, np.int64), 0
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            at = np.fromiter((terms.get(w, -1) for w in words), np.int64, len(words))[codes]
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            known = at >= 0
            pairs = np.unique(row[known] * len(terms) + at[known])
            total[:-1] += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))
            texts += len(ends) - 1
        total[-1] = texts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    counted = source.select("text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # bounded by the sample's terms
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in counted:
        df[r["term"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.05) * _telling([to_term[t] for t, _ in bags], marks_of, len(vocabulary))
    # examples that share their most telling common term stand together, so blocks are alike
    index = Index(vocabulary, idf, [], marks_of, block, [], [], [], np.zeros((len(vocabulary), 0)), k, float(rate), np.zeros(0), np.zeros(0))
    vectors = []
    for terms, counts in bags:
        terms = to_term[terms]
        vectors.append((terms, index.vector(terms, counts)))
    lead = [int(t[np.argmax(df[t])]) if len(t) else -1 for t, _ in vectors]
    order = sorted(range(len(rows)), key=lambda i: (lead[i], i))
    index.ids, index.labels = [ids[i] for i in order], marks_of[order]
    vectors = [vectors[i] for i in order]
    blocks = -(-len(rows) // block)
    index.largest = np.zeros((len(vocabulary), blocks))
    for b in range(blocks):
        own = vectors[b * block : (b + 1) * block]
        terms = np.concatenate([t for t, _ in own])
        who = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
        weights = np.concatenate([w for _, w in own])
        at = np.argsort(terms, kind="stable")
        terms = terms[at]
        index.examples.append(who[at])
        index.weights.append(weights[at])
        index.starts.append(np.searchsorted(terms, np.arange(len(vocabulary) + 1)))
        np.maximum.at(index.largest[:, b], terms, weights[at])
    if rows:
        votes = np.array([index.vote(*index.nearest(t, w, index.ids[i])) for i, (t, w) in enumerate(vectors)])
        y = index.labels
        share = y.mean()
        # the sample has as many of either label; the labels' own rate weighs them
        w = np.where(y == 1, rate / share if share else 0.0, (1 - rate) / (1 - share) if share < 1 else 0.0)
        some = (votes >= 0) & (w > 0)
        if some.any():
            index.votes, index.probabilities = _isotonic(votes[some], y[some], w[some])
    return index


def classify(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, toxic, evidence) of every row: the calibrated probability, whether
    it reaches ``threshold``, and the neighbours that voted, nearest first, each as
    ``id:cosine:label``.

    A document that is an example itself doesn't vote on itself. Defined results:
    null, empty and unknown texts have no evidence and the labels' base rate; cosines
    that agree to 9 digits are ties and go by the examples' order in the index;
    repeated rows repeat their result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        examples = set(index.ids)
        size = max(1, len(index.terms))
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            at = np.fromiter((index.terms.get(w, -1) for w in words), np.int64, len(words))[codes]
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            known = at >= 0
            pairs, counts = np.unique(row[known] * size + at[known], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(len(ends)) * size)
            terms = pairs % size
            scores, flags, evidence = [], [], []
            for i, doc in enumerate(batch.column("id").to_pylist()):
                own = terms[cuts[i] : cuts[i + 1]]
                best, cosines = np.zeros(0, np.int64), np.zeros(0)
                if len(own) and index.starts:
                    best, cosines = index.nearest(own, index.vector(own, counts[cuts[i] : cuts[i + 1]]), doc if doc in examples else None)
                score = index.score(index.vote(best, cosines))
                scores.append(score)
                flags.append(score >= threshold)
                evidence.append([f"{index.ids[b]}:{c:.4f}:{int(index.labels[b])}" for b, c in zip(best.tolist(), cosines.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_()), pa.array(evidence, pa.list_(pa.string()))], names=["id", "score", "toxic", "evidence"])

    return source.mapInArrow(work, T.StructType([source.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType()), T.StructField("evidence", T.ArrayType(T.StringType()))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, build(docs, labels)).select(F.col("id").alias("doc_id"), "score", "toxic", "evidence")
