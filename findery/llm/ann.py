"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

The graph starts from random-hyperplane leaves. Each round joins, in Spark, every
node's sampled neighbours and reverse neighbours with their vectors, compares them
with each other (neighbours of neighbours), and keeps the best of each node; pairs
that were compared before are not compared again. A search starts from a query's
entry points and keeps expanding the nearest nodes that were not yet expanded.
Distances are Euclidean on unit vectors (cosine) or on the vectors as they are.

The graph is fitted on a bounded sample, ``nodes`` rows by the hash of their ids, as its
rounds shuffle many times the vectors. Every row is in the index: each stands in the
cell of its nearest node, and a search along the graph gives the cells whose rows a query
is compared with. How many cells is measured, not set: as many as give sampled queries
a share of ``recall`` of the neighbours that brute force over all rows finds. A table
of up to ``nodes`` rows has them all in the graph.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, lists, ref, saved

_PAIRS = "u long, v long, d float"


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Vectors of a list column as float32 rows."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2)), 0)


def _best(u: np.ndarray, v: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest distinct v of each u."""
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    fresh = np.ones(len(u), bool)
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])  # copies of a pair have one distance
    u, v, d = u[fresh], v[fresh], d[fresh]
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.concatenate([start, [len(u)]])))
    keep = rank < k
    return u[keep], v[keep], d[keep]


def _clean(vectors: DataFrame, id_col: str, vector_col: str, cosine: bool) -> DataFrame:
    """(id, vec): one row an id; nulls, empty vectors, null or non-finite entries and
    vectors of another length than the most common one (the longer, if tied) are left out."""
    rows = vectors.select(ref(id_col).cast("long").alias("id"), ref(vector_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vec") == (sizes["n"] if sizes else 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    if cosine:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        rows = rows.withColumn("norm", norm).select("id", F.transform("vec", lambda x: F.when(F.col("norm") > 0, (x / F.col("norm")).cast("float")).otherwise(F.lit(0.0).cast("float"))).alias("vec"))
    return rows


def _leaves(points: DataFrame, n: int, dims: int, trees: int, leaf: int, k: int, seed: int) -> DataFrame:
    """Pairs within random-hyperplane leaves; a leaf that comes out large is cut at random."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    planes = np.random.default_rng(seed).standard_normal((trees, bits, dims)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t in range(trees):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code * trees + t), batch.column("id"), batch.column("vec")], names=["leaf", "id", "vec"])

    placed = points.mapInArrow(place, "leaf long, id long, vec array<float>")
    sizes = placed.groupBy("leaf").count()
    cut = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("id", "leaf"), F.ceil(F.col("count") / (2 * leaf))))

    def near(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["id"].to_numpy(), _matrix(part["vec"])
        d = _squared(x, x)
        np.fill_diagonal(d, np.inf)
        top = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
        return pd.DataFrame({"u": np.repeat(ids, top.shape[1]), "v": ids[top].ravel(), "d": np.take_along_axis(d, top, 1).ravel()})

    return cut.groupBy("leaf", "part").applyInPandas(near, _PAIRS)


def _keep_best(pairs: DataFrame, k: int) -> DataFrame:
    """(u, near): each node's k nearest, as an array of (d, v, fresh) in order; a pair
    counts as fresh unless an old copy of it is there."""
    one = pairs.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return one.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v", "fresh"))), 1, k).alias("near"))


def build_graph(points: DataFrame, k: int = 40, sample: int = 40, rounds: int | None = None, trees: int = 6, leaf: int = 96, stop: float = 0.002, seed: int = 7) -> DataFrame:
    """(u, near) of ``points`` (id, vec): the NN-descent graph.

    ``sample`` bounds how many fresh and how many old neighbours of a node, forward
    and reverse, meet in a round; it ends when fewer than ``stop`` of all edges
    changed, or after ``rounds`` if given.
    """
    first = points.select("vec").first()
    n = points.count()
    if first is None:
        return points.sparkSession.createDataFrame([], "u long, near array<struct<d:float,v:long,fresh:boolean>>")
    pairs = _leaves(points, n, len(first["vec"]), trees, leaf, k, seed).withColumn("fresh", F.lit(True))
    graph = saved(_keep_best(pairs, k), "ann-graph")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ds = [], [], []
            for members in batch.column("members"):
                flat = members.values
                ids, far = flat.field("id").to_numpy(), flat.field("worst").to_numpy()
                is_fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
                x = _matrix(flat.field("vec"))
                order = np.argsort(~is_fresh, kind="stable")
                ids, far, x, m = ids[order], far[order], x[order], int(is_fresh.sum())
                d = _squared(x[:m], x)
                d[ids[:m, None] == ids[None, :]] = np.inf
                a, b = np.nonzero(d < far[:m, None])
                us.append(ids[a]), vs.append(ids[b]), ds.append(d[a, b])
                a, b = np.nonzero(d < far[None, :])
                us.append(ids[b]), vs.append(ids[a]), ds.append(d[a, b])
            if us:
                u, v, d = _best(np.concatenate(us), np.concatenate(vs), np.concatenate(ds).astype(np.float32), k)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32())], names=["u", "v", "d"])

    for r in itertools.count() if rounds is None else range(rounds):
        edges = graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d", "e.fresh")
        both = edges.select(F.col("u").alias("w"), F.col("v").alias("id"), "fresh").unionByName(edges.select(F.col("v").alias("w"), F.col("u").alias("id"), "fresh"))
        both = both.groupBy("w", "id").agg(F.max("fresh").alias("fresh"))
        order = Window.partitionBy("w", "fresh").orderBy(F.xxhash64("id", "w", F.lit(seed + r)))
        picked = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("w", "id", "fresh")
        worst = graph.select(F.col("u").alias("id"), F.when(F.size("near") < k, F.lit(float("inf")).cast("float")).otherwise(F.element_at("near", -1)["d"]).alias("worst"))
        known = points.join(worst, "id", "left").select("id", "vec", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        met = picked.join(known.hint("shuffle_hash"), "id").groupBy("w").agg(F.collect_list(F.struct("id", "worst", "fresh", "vec")).alias("members"))
        found = met.where(F.exists("members", lambda m: m["fresh"])).select("members").mapInArrow(compare, _PAIRS)
        # what a node picked as fresh is old from now on; the rest waits for a later round
        done = picked.where("fresh").select(F.col("w").alias("u"), F.col("id").alias("v"), F.lit(True).alias("done"))
        old = edges.join(done, ["u", "v"], "left").select("u", "v", "d", (F.col("fresh") & F.col("done").isNull()).alias("fresh"))
        graph = saved(_keep_best(old.unionByName(found.withColumn("fresh", F.lit(True))), k), "ann-graph")
        changed = graph.select(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))).alias("c")).first()["c"] or 0
        if changed <= stop * n * k:
            break
    return graph


def _beam(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int, step: int, seen: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of one query: (nodes, squared distances), nearest first."""
    seen[entries] = mark
    ids = entries
    d = ((x[ids] - q) ** 2).sum(1)
    done = np.zeros(len(ids), bool)
    while True:
        if len(ids) > ef:
            order = np.argpartition(d, ef - 1)[:ef]
            ids, d, done = ids[order], d[order], done[order]
        todo = np.flatnonzero(~done)
        if not len(todo):
            break
        if len(todo) > step:
            todo = todo[np.argpartition(d[todo], step - 1)[:step]]
        done[todo] = True
        near = adjacency[ids[todo]].ravel()
        near = near[near >= 0]
        near = np.unique(near[seen[near] != mark])
        seen[near] = mark
        if len(near):
            ids = np.concatenate([ids, near])
            d = np.concatenate([d, ((x[near] - q) ** 2).sum(1)])
            done = np.concatenate([done, np.zeros(len(near), bool)])
    order = np.lexsort((ids, d))
    return ids[order], d[order]


def _fetched(points: DataFrame, graph: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their vectors, and each one's neighbours by position (-1: none)."""
    table = points.orderBy("id").toArrow()
    ids = table.column("id").combine_chunks().to_numpy()
    x = _matrix(table.column("vec").combine_chunks())
    adjacency = np.full((len(ids), max(1, k)), -1, np.int32)
    near = graph.select("u", F.transform("near", lambda e: e["v"]).alias("near")).toArrow()
    for u, v in zip(np.searchsorted(ids, near.column("u").combine_chunks().to_numpy()).tolist(), near.column("near").combine_chunks()):
        v = np.searchsorted(ids, v.values.to_numpy())
        adjacency[u, : len(v)] = v
    return ids, x, adjacency


def search(queries: DataFrame, points: DataFrame, graph: DataFrame, top: int = 10, ef: int = 240, step: int = 8, entries: int = 48, limit_mb: float = 64, seed: int = 7) -> DataFrame:
    """(query, id, rank, distance): the ``top`` points nearest each query (id, vec), by
    greedy search with a list of ``ef``. A query that is a point itself starts from
    its own neighbours and is not its own result; others start from ``entries`` points
    spread over the table.

    Up to ``limit_mb`` of vectors and edges, every task searches a copy of the whole
    graph; beyond it, rounds of joins move all queries' lists along the graph. Both use
    the same lists, steps and end.
    """
    spark = points.sparkSession
    n = points.count()
    first = points.select("vec").first()
    empty = spark.createDataFrame([], "query long, id long, rank int, distance double")
    if first is None:
        return empty
    k = graph.select(F.max(F.size("near")).alias("k")).first()["k"] or 0
    if n * (4 * len(first["vec"]) + 8 + 4 * k) / 1e6 > limit_mb:
        return _search_by_joins(queries, points, graph, top, ef, step, entries, seed)
    ids, x, adjacency = _fetched(points, graph, k)  # within limit_mb
    spread = np.unique(np.linspace(0, n - 1, min(n, entries)).astype(np.int64))
    shared = spark.sparkContext.broadcast((ids, x, adjacency))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, adjacency = shared.value
        seen, mark = np.zeros(len(ids), np.int64), 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            q = _matrix(batch.column("vec"))
            for i, query in enumerate(batch.column("id").to_pylist()):
                at = int(np.searchsorted(ids, query))
                own = at if at < len(ids) and ids[at] == query else -1
                start = spread
                if own >= 0:
                    start = adjacency[own][adjacency[own] >= 0].astype(np.int64)
                    start = np.unique(np.concatenate([start, spread[:8]]))
                mark += 1
                found, d = _beam(x, adjacency, q[i], start, ef, step, seen, mark)
                keep = found != own
                found, d = found[keep][:top], d[keep][:top]
                out[0] += [query] * len(found)
                out[1] += ids[found].tolist()
                out[2] += range(1, len(found) + 1)
                out[3] += np.sqrt(d.astype(np.float64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())], names=["query", "id", "rank", "distance"])

    parts = max(queries.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    return queries.repartition(parts, "id").mapInArrow(work, "query long, id long, rank int, distance double")


def _search_by_joins(queries: DataFrame, points: DataFrame, graph: DataFrame, top: int, ef: int, step: int, entries: int, seed: int) -> DataFrame:
    """The same search with each query's list in a table: a round expands the ``step``
    nearest unexpanded nodes of every list by a join with the graph, until none is left."""
    spark = points.sparkSession
    edges = saved(graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v")).join(points.select(F.col("id").alias("v"), "vec"), "v"), "ann-edges")
    spread = saved(points.orderBy(F.xxhash64("id", F.lit(seed))).limit(entries).select(F.col("id").alias("v"), "vec"), "ann-entries")
    asked = saved(queries.select(F.col("id").alias("query"), F.col("vec").alias("q")), "ann-queries")
    distance = F.aggregate(F.zip_with("q", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    places = [r["v"] for r in spread.select("v").collect()]  # at most ``entries``
    spread_too = asked.withColumn("v", F.explode(F.array(*[F.lit(v) for v in places]))).join(F.broadcast(spread), "v")
    start = asked.join(edges.withColumnRenamed("u", "query"), "query").unionByName(spread_too)
    beam = start.select("query", "v", distance.alias("d"), F.lit(False).alias("done"))
    order = Window.partitionBy("query").orderBy("d", "v")
    while True:
        best = beam.groupBy("query", "v").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        ranked = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ef)
        turn = F.row_number().over(Window.partitionBy("query", "done").orderBy("d", "v"))
        ranked = saved(ranked.withColumn("go", ~F.col("done") & (turn <= step)).select("query", "v", "d", F.col("done").alias("was"), (F.col("done") | F.col("go")).alias("done"), "go"), "ann-beam")
        if ranked.where("go").isEmpty():
            break
        reached = ranked.where("go").select("query", F.col("v").alias("u")).join(edges, "u").join(asked, "query").select("query", "v", distance.alias("d"), F.lit(False).alias("done"))
        beam = ranked.select("query", "v", "d", "done").unionByName(reached)
    best = beam.where(F.col("v") != F.col("query")).groupBy("query", "v").agg(F.min("d").alias("d"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query", F.col("v").alias("id"), "rank", F.sqrt("d").alias("distance"))


def _nearest_node(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    half = (nodes * nodes).sum(1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 1024] @ nodes.T, axis=1) for a in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


class _Nearest:
    """The ``top`` nearest rows of each query as blocks of rows come by, ties by id."""

    def __init__(self, q: np.ndarray, top: int):
        self.q, self.top = q, top
        self.bound = np.full(len(q), np.inf, np.float32)  # the distance a row must not exceed
        self.norm = (q * q).sum(1)
        self.kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray, tags: np.ndarray) -> None:
        """Compares the queries ``own`` with rows ``ids``, ``x``; a row's tag stays with it."""
        norm = (x * x).sum(1)
        for a in range(0, len(x), 8192):
            part, least = x[a : a + 8192], norm[a : a + 8192]
            rows = max(1, (1 << 20) // len(part))
            for c in range(0, len(own), rows):
                some = own[c : c + rows]
                d = self.norm[some][:, None] + least - 2 * (self.q[some] @ part.T)
                slack = 1e-5 * (self.norm[some] + least.max())  # of the product against the difference
                open_ = np.flatnonzero(np.isinf(self.bound[some]))
                if len(open_) and len(part) > self.top:
                    self.bound[some[open_]] = np.partition(d[open_], self.top - 1, axis=1)[:, self.top - 1] + slack[open_]
                i, j = np.nonzero(d <= (self.bound[some] + slack)[:, None])
                if len(i):
                    exact = ((part[j] - self.q[some[i]]) ** 2).sum(1)
                    self.new.append((some[i], ids[a + j], exact, tags[a + j]))
                    self.size += len(i)
                if self.size > max(1 << 18, 4 * self.top * len(self.q)):
                    self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query's position, id, squared distance, tag), by query and nearness."""
        if self.new:
            own, ids, d, tags = (np.concatenate(c) for c in zip(self.kept, *self.new))
            order = np.lexsort((ids, d, own))
            own, ids, d, tags = own[order], ids[order], d[order], tags[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rank = np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate([start, [len(own)]])))
            last = rank == self.top - 1
            self.bound[own[last]] = d[last]
            keep = rank < self.top
            self.kept, self.new, self.size = (own[keep], ids[keep], d[keep], tags[keep]), [], 0
        return self.kept


def _route(x: np.ndarray, adjacency: np.ndarray, q: np.ndarray, probes: int, spread: np.ndarray, seen: np.ndarray, mark: int) -> np.ndarray:
    """The ``probes`` nodes nearest a query, along the graph; by all nodes where it ends before."""
    found = _beam(x, adjacency, q, spread, max(probes, 64), max(8, probes // 8), seen, mark)[0][:probes] if probes < len(x) else spread[:0]
    return found if len(found) == probes else np.argsort(((x - q) ** 2).sum(1), kind="stable")[:probes]


def search_cells(queries: DataFrame, points: DataFrame, nodes: DataFrame, graph: DataFrame, top: int = 10, recall: float = 0.98, tried: int = 200, entries: int = 48, block_mb: float = 32, seed: int = 7) -> DataFrame:
    """(query, id, rank, distance): the ``top`` of all ``points`` nearest each query, a point
    itself, among the cells of the nearest nodes of ``graph``, which has a sample of them.

    ``tried`` queries are compared with all points first, and the cells a query opens are as
    many as these need for ``recall`` of their neighbours. Cells that are opened together
    are up to ``block_mb`` of vectors; one that is larger is cut by the hash of the id.
    """
    spark = points.sparkSession
    k = graph.select(F.max(F.size("near")).alias("k")).first()["k"] or 0
    _, x, adjacency = _fetched(nodes, graph, k)
    some = queries.orderBy(F.xxhash64("id", F.lit(seed))).limit(tried).toArrow()
    empty = spark.createDataFrame([], "query long, id long, rank int, distance double")
    if not some.num_rows:
        return empty
    asked, q = some.column("id").combine_chunks().to_numpy(), _matrix(some.column("vec").combine_chunks())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = np.zeros(len(x), np.int64), _Nearest(q, top + 1)
        for batch in batches:
            rows = _matrix(batch.column("vec"))
            cell = _nearest_node(rows, x)
            count += np.bincount(cell, minlength=len(x))
            best.add(np.arange(len(q)), batch.column("id").to_numpy(), rows, cell)
        own, ids, d, cell = best.result()
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(has), -1), own])), pa.array(np.concatenate([has, ids])), pa.array(np.concatenate([np.zeros(len(has), np.float32), d])), pa.array(np.concatenate([count[has], cell]))], names=["own", "id", "d", "n"])

    measured = saved(points.mapInArrow(lean(measure), "own long, id long, d float, n long"), "ann-measured")
    counts = np.zeros(len(x), np.int64)
    for row in measured.where("own < 0").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row a node
        counts[row["id"]] = row["n"]
    first = Window.partitionBy("own").orderBy("d", "id")
    others = measured.where("own >= 0").join(F.broadcast(spark.createDataFrame(pd.DataFrame({"own": np.arange(len(q)), "query": asked}))), "own").where("id != query")
    true = others.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).select("own", "n").toPandas()
    place = np.argsort(np.argsort(_squared(q, x), axis=1, kind="stable"), axis=1)[true["own"].to_numpy(), true["n"].to_numpy()]
    probes = int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1 if len(place) else 1
    spread = np.unique(np.linspace(0, len(x) - 1, min(len(x), entries)).astype(np.int64))
    while probes < len(x):  # the way along the graph may miss a cell
        seen, opened = np.zeros(len(x), np.int64), np.zeros((len(q), len(x)), bool)
        for i, vec in enumerate(q):
            opened[i, _route(x, adjacency, vec, probes, spread, seen, i + 1)] = True
        if opened[true["own"].to_numpy(), true["n"].to_numpy()].sum() >= recall * len(true):
            break
        probes = min(len(x), probes + probes // 4 + 1)

    most = max(1, min(int(block_mb * 1e6 / (4 * x.shape[1])), int(counts.sum()) // (4 * spark.sparkContext.defaultParallelism) + 1))
    parts, target, block, fill = np.maximum(1, -(-counts // most)), np.zeros(len(x), np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):
        if fill and fill + n > most:
            block, fill = block + 1, 0
        target[c] = block
        fill += n
        if parts[c] > 1:
            block, fill = block + int(parts[c]), 0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _nearest_node(_matrix(batch.column("vec")), x)
            to = target[cell] + batch.column("hash").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(cell), batch.column("id"), batch.column("vec")], names=["block", "cell", "id", "vec"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mark = np.zeros(len(x), np.int64), 0
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                own, cells, to = [], [], []
                for i, vec in enumerate(_matrix(batch.column("vec"))):
                    mark += 1
                    found = _route(x, adjacency, vec, probes, spread, seen, mark)
                    n = parts[found]
                    found = np.repeat(found, n)
                    nth = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
                    own.append(np.full(len(found), i)), cells.append(found), to.append(target[found] + nth)
                own, cells, to = np.concatenate(own), np.concatenate(cells), np.concatenate(to)
                order = np.lexsort((to, own))
                own, cells, to = own[order], cells[order], to[order]
                start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (to[1:] != to[:-1])]))
                which = pa.array(own[start])
                yield pa.RecordBatch.from_arrays([pa.array(to[start]), lists(cells, np.append(start, len(cells)), pa.int32()), batch.column("id").take(which), batch.column("vec").take(which)], names=["block", "cells", "query", "vec"])

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        cell, ids, vecs = (rows.column(c).combine_chunks() for c in ("cell", "id", "vec"))
        wanted, qid, q = (asked.column(c).combine_chunks() for c in ("cells", "query", "vec"))
        cell, ids, qid = cell.to_numpy(), ids.to_numpy(), qid.to_numpy()
        best = _Nearest(_matrix(q), top + 1)
        if len(cell) and len(qid):
            order = np.argsort(cell, kind="stable")
            cell, ids, vecs = cell[order], ids[order], _matrix(vecs)[order]
            flat = wanted.flatten().to_numpy()
            own = np.repeat(np.arange(len(qid)), wanted.value_lengths().to_numpy())
            by = np.argsort(flat, kind="stable")
            flat, own = flat[by], own[by]
            for c in np.intersect1d(cell, flat).tolist():
                a, b = np.searchsorted(cell, [c, c + 1])
                e, f = np.searchsorted(flat, [c, c + 1])
                best.add(own[e:f], ids[a:b], vecs[a:b], cell[a:b])
        own, ids, d, _ = best.result()
        keep = qid[own] != ids
        return pa.table({"query": pa.array(qid[own][keep], pa.int64()), "id": pa.array(ids[keep], pa.int64()), "d": pa.array(d[keep], pa.float32())})

    standing = points.withColumn("hash", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))).mapInArrow(lean(put), "block long, cell long, id long, vec array<float>")
    sent = queries.repartition(max(queries.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), "id").mapInArrow(lean(send), "block long, cells array<int>, query long, vec array<float>")
    found = standing.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(meet, "query long, id long, d float")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("rank") <= top)
    return ranked.select("query", "id", "rank", F.sqrt(F.col("d").cast("double")).alias("distance"))


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10, cosine: bool = True, every: int = 1, nodes: int = 4096, recall: float = 0.98, **options) -> DataFrame:
    """(query, id, rank, distance): the ``top`` nearest other vectors of the vectors whose
    id is divisible by ``every``, among all.

    The index has every row, the graph up to ``nodes`` of them; every row is a query
    unless ``every`` is set. ``recall`` is what sampled queries must reach against brute
    force where the graph has a sample (``search_cells``); ``options`` are those of the
    graph and, where it has all rows, of ``search``. Vectors may have any number of entries. Defined results: rows with a null id or vector, an empty
    vector, a null or non-finite entry, or another number of entries than most are
    left out; of rows with the same id the least vector counts; equal distances go by
    id; with fewer than ``top`` others all of them are returned; a vector alone has
    none; an empty table gives an empty table. A zero vector stays zero under cosine.
    """
    points = saved(_clean(vectors, id_col, vector_col, cosine), "ann-points")
    build = {k: options.pop(k) for k in ("k", "sample", "rounds", "trees", "leaf", "stop", "seed") if k in options}
    asked = points if every == 1 else points.where(F.col("id") % every == 0)
    n = points.count()
    if n <= nodes:
        return search(asked, points, build_graph(points, **build), top, **options)
    turn = F.xxhash64("id", F.lit("node"))
    likely = points.where(F.pmod(turn, F.lit(1 << 30)) < F.lit(int(min(1.0, (nodes + 8 * nodes**0.5 + 64) / n) * (1 << 30))))
    # copies of a node would only know each other
    chosen = saved(likely.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec").orderBy(turn).limit(nodes), "ann-nodes")
    return search_cells(asked, points, chosen, build_graph(chosen, **build), top, recall)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 is searched among all."""
    found = neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)
    return found.select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour_id"), "rank", "distance")
