"""What the registered queries and stages must not leave out."""

import gc
import inspect
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from corpus_pipeline import BATCH_BYTES, remove_benchmark_leaks, remove_near_duplicates
from findery.llm import ann, byte_bpe, decontamination, lm_scoring, ngram_jaccard, toxicity
from findery.llm.common import _trim

from .test_against_brute_force import grams, words


def test_edited_copies_are_similar_by_bigrams(spark, tmp_path):
    base = [f"w{i}" for i in range(40)]
    edited = ["x" if i in (5, 15, 25, 35) else w for i, w in enumerate(base)]
    texts = {1: " ".join(base), 2: " ".join(edited), 3: "something else altogether"}
    two, three = [len(grams(texts[1], n) & grams(texts[2], n)) / len(grams(texts[1], n) | grams(texts[2], n)) for n in (2, 3)]
    assert two >= 0.6 > three
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in ngram_jaccard.similar_pairs(docs).collect()] == [(1, 2, round(two, 9))]
    assert sorted(tuple(r) for r in ngram_jaccard.query(spark, str(tmp_path)).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert sorted(r.doc_id for r in remove_near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_toxicity_neighbours_by_terms_of_one_example(spark):
    texts = {1: "common words here gravel", 2: "common words here", 3: "common words there also", 4: "gravel gravel unseen", 5: "common here also"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    df = Counter(w for t in texts.values() for w in set(words(t)))

    def vector(text):
        v = {w: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[w])) + 0.05) for w, c in Counter(words(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    for r in toxicity.classify(docs, toxicity.build(docs, labels)).collect():
        own = vector(texts[r.id])
        cosines = {i: sum(x * vector(texts[i]).get(w, 0) for w, x in own.items()) for i in (1, 2, 3) if i != r.id}
        want = [i for i in sorted(cosines, key=lambda i: -cosines[i]) if cosines[i] > 0]
        assert [int(e.split(":")[0]) for e in r.evidence] == want


def test_ann_search_is_the_same_by_joins(spark):
    # a ring in which nodes know their two neighbours only: a list of 8 takes over 12 rounds to get across
    n = 400
    at = [(i, [float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n))]) for i in range(n)]
    points = spark.createDataFrame(at, "id long, vec array<float>")
    edges = [(i, [(0.1, (i - 1) % n, False), (0.1, (i + 1) % n, False)]) for i in range(n)]
    graph = spark.createDataFrame(edges, "u long, near array<struct<d:float,v:long,fresh:boolean>>")
    asked = points.where("id IN (7, 200)")
    options = {"top": 40, "ef": 60, "step": 2, "entries": 1}
    both = [sorted((r.query, r.rank, r.id) for r in ann.search(asked, points, graph, limit_mb=limit, **options).select("query", "rank", "id").collect()) for limit in (256, 0)]
    near = [{(q, i) for q, _, i in rows} for rows in both]
    assert len(near[0]) == 80 and near[0] == near[1]


def test_ann_graph_has_no_bound_of_rounds():
    assert inspect.signature(ann.build_graph).parameters["rounds"].default is None


def test_ann_edges_that_were_not_picked_stay_fresh(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((60, 8)))], "id long, vec array<float>").cache()
    # one leaf holds all points, so the graph is exact from the start and only marks change
    fresh = [e.fresh for r in ann.build_graph(points, k=12, sample=3, rounds=1, trees=1, leaf=100).collect() for e in r.near]
    assert len(fresh) == 720 and 720 * 0.5 < sum(fresh) < 720


def test_links_of_short_texts_in_groups_with_a_large_number(spark):
    # each pair has a group of its own, and about a quarter of the groups' numbers fill all bits
    texts = {2 * i + extra: " ".join(f"w{i}x{j}" for j in range(4 + extra)) for i in range(60) for extra in (0, 1)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.class_id, r.n_links) for r in ngram_jaccard.classes(docs).collect()}
    assert got == {i: (i - i % 2, 1) for i in texts}


def test_lm_moves_go_to_the_best_class_with_few_logarithms(monkeypatch):
    rng = np.random.default_rng(3)
    classes, words, each = 16, 400, 20
    k = classes + 2
    pairs = rng.integers(0, 2000, (k, k))
    context = np.concatenate([np.sort(rng.choice(2 * k, each, replace=False)) for _ in range(words)])
    counts = rng.integers(1, 5, words * each)
    counts[rng.choice(words * each, 50, replace=False)] = rng.integers(33, 500, 50)
    current = rng.integers(0, classes, words)

    def phi(x):
        return x * math.log(max(x, 1))

    want = []
    for i in range(words):
        gain = np.zeros(classes)
        weight = sum(int(n) for c, n in zip(context[i * each : (i + 1) * each], counts[i * each :]) if c < k)
        for d in range(classes):
            for c, n in zip(context[i * each : (i + 1) * each].tolist(), counts[i * each : (i + 1) * each].tolist()):
                seen = int(pairs[d, c] if c < k else pairs[c - k, d])
                seen = max(seen - n, 0) if d == current[i] else seen
                gain[d] += phi(seen + n) - phi(seen)
            for total in (int(pairs[d].sum()), int(pairs[:, d].sum())):
                total = max(total - weight, 0) if d == current[i] else total
                gain[d] -= phi(total + weight) - phi(total)
        want.append(int(gain.argmax()) if gain.max() > gain[current[i]] + 1e-6 else int(current[i]))
    made, direct = [], lm_scoring._phi
    monkeypatch.setattr(lm_scoring, "_phi", lambda x: made.append(np.size(x)) or direct(x))
    got = lm_scoring._moves(np.arange(words), np.full(words, each), context, counts, current, pairs, classes)
    assert got.tolist() == want
    assert sum(made) < 0.5 * words * each * classes


def test_toxicity_by_few_words_of_a_long_text(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        text = [f"w{w}" for w in rng.integers(0, 400, 120)]
        text[:2] = rng.choice(["badone", "badtwo", "badthree"], 2).tolist() if i % 3 == 0 else text[:2]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.id: r.toxic for r in toxicity.classify(docs, toxicity.build(docs, labels)).collect()}
    unseen = range(400, 600)
    caught = [got[i] for i in unseen if i % 3 == 0]
    alone = [not got[i] for i in unseen if i % 3]
    assert sum(caught) >= 0.95 * len(caught) and sum(alone) >= 0.95 * len(alone)


def test_jaccard_candidates_share_tokens_of_the_smaller_ones_short_prefix(spark):
    """tokens that only the larger one's part of the order holds opened groups."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, int(m))).astype(np.uint64) * np.uint64(1 << 50) for m in rng.integers(60, 110, 150)]
    ranks = (np.arange(400) // 8).astype(np.uint8)  # of a token's number
    order = [s[np.lexsort((s, ranks[(s >> np.uint64(50)).astype(int)]))] for s in sets]
    long = [set(o[: len(o) - math.ceil(0.6 * len(o) - 1e-9) + 1 + int(0.05 * len(o))].tolist()) for o in order]
    short = [set(o[: len(o) - math.ceil(0.75 * len(o) - 1e-9) + 1 + int(0.05 * len(o))].tolist()) for o in order]
    blobs = []
    for o, a, b in zip(order, long, short):
        flat = sorted((int(x) >> (65 - ngram_jaccard.BITS)) << 1 | (x in b) for x in a)
        blobs.append(bytearray(ngram_jaccard._pack_each(np.array(flat), np.array([0, len(flat)]))[0]))
    units = spark.createDataFrame([(i, [(i + 1) << 40], len(s), blobs[i]) for i, s in enumerate(sets)], "uid long, offers array<long>, size int, prefix binary")
    popular = spark.sparkContext.broadcast(np.zeros(ngram_jaccard.CELLS, np.uint8))
    group = {(i + 1) << 40 >> 24: i for i in range(len(sets))}
    got = {(r.uid, group[r.grp]) for r in ngram_jaccard._candidates(units, popular, 2, 0.6).collect()}
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if min(len(a), len(b)) >= 0.6 * max(len(a), len(b)):
                shared = (short[i] & long[j] if len(a) < len(b) else long[i] & short[j]) if len(a) != len(b) else (short[i] | short[j]) & long[i] & long[j]
                if len(shared) >= 1 + int(0.05 * int(0.6 * len(a))):
                    want.add((i, j))
    assert want and got == want


def test_jaccard_counts_of_a_large_group_are_exact():
    """the frequent grams of a group are counted by a matrix product."""
    rng = np.random.default_rng(5)
    sets = []
    for i in range(2 * ngram_jaccard.DENSE_MEMBERS + ngram_jaccard.DENSE_ROWS):
        base = np.arange(100) if i % 3 else np.arange(50, 150)
        sets.append(np.unique(np.concatenate([base[rng.random(100) < 0.9], rng.integers(150, 5000, i % 15)])).astype(np.uint64))
    for m in (len(sets), 2 * ngram_jaccard.DENSE_MEMBERS):  # members only; members and queries
        kind = [ngram_jaccard.MEMBER if i < m else ngram_jaccard.QUERY for i in range(len(sets))]
        part = pd.DataFrame({"unit": range(len(sets)), "n": 1, "kind": kind, "grams": [s.tobytes() for s in sets]})
        column, dense = ngram_jaccard._frequent(*_bounds(sets[:m]), m)
        assert dense is not None and 0 < len(dense) < len(column)
        a, b, both, _ = ngram_jaccard._verify(part, 0.6)
        want = {}
        for i, x in enumerate(sets):
            for j in range(max(i + 1, 0) if i < m else 0, m):
                shared = len(np.intersect1d(x, sets[j], assume_unique=True))
                if shared >= 0.6 * (len(x) + len(sets[j]) - shared) - 1e-9:
                    want[i, j] = shared
        assert dict(zip(zip(a.tolist(), b.tolist()), both.tolist())) == want


def _bounds(sets):
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    _, first = np.unique(flat[order], return_index=True)
    return np.append(first, len(flat)), owner[order]


def test_bpe_memo_keeps_frequent_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "_CACHE", 60)
    encoder, plain, asked = byte_bpe.Encoder(byte_bpe.load()), byte_bpe.Encoder(byte_bpe.load()), Counter()
    chunk = encoder.chunk
    monkeypatch.setattr(encoder, "chunk", lambda text: asked.update([text]) or chunk(text))
    for i in range(20):
        text = f"frequent don't Étude  words{i} " + " ".join(f"once{i}x{j}" for j in range(30))
        got = encoder.encode(text).tolist()
        assert got == np.frombuffer(plain.chunk(text), np.int32).tolist() and encoder.decode(got) == text
    assert asked["frequent"] == asked[" don't"] == 1 and len(encoder.pieces) + len(encoder.pieces.before) <= 200


def test_lm_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.concatenate([rng.integers(-(1 << 63), 1 << 63, n), [(1 << 63) - 1, -(1 << 63)][: min(n, 2)]]).astype(np.int64))
        asked = rng.permutation(np.concatenate([keys, rng.integers(-(1 << 63), 1 << 63, 300), [0, -1, (1 << 63) - 1]]).astype(np.int64))
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert lm_scoring._Finder(keys)(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    for values in (np.zeros(0, np.uint32), np.arange(1000, dtype=np.uint32)):
        assert lm_scoring._unpack(lm_scoring._pack(values), np.uint32).tolist() == values.tolist()


def test_tasks_end_without_a_look_at_all_modules(spark):
    """op3: each task's end took 0.05 s of garbage collection."""

    def work(batches):
        for _ in batches:
            pass
        _trim()
        yield pa.RecordBatch.from_pydict({"n": [gc.get_freeze_count()]})

    assert spark.range(1).mapInArrow(work, "n long").first()["n"] > 10_000


def test_pipeline_stages_send_workers_small_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of a document that is long enough") for i in range(4)], "doc_id long, text string")
    tests = spark.createDataFrame([("t", "text 1 of a document that is long enough")], "item_id string, text string")
    tests.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in remove_benchmark_leaks(spark, docs, str(tmp_path)).orderBy("doc_id").collect()] == [0, 2, 3]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]}, schema=pa.schema([("n", pa.int64())]))

    wide = spark.range(4000, numPartitions=1).selectExpr("id", "repeat('x', 5000) AS text")
    sent = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(sent) > 20e6 and max(sent) < 2 * BATCH_BYTES


def test_index_packs_few_positions_at_once():
    counts = np.array([5, 900, 0, 3, 40, 40, 40, 1, 0])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    cuts = list(decontamination.term_cuts(bounds, 3, 100))
    assert [t for a, b in cuts for t in range(a, b)] == list(range(len(counts)))
    assert all(b - a == 1 or (b - a <= 3 and counts[a:b].sum() <= 100) for a, b in cuts)
    rng = np.random.default_rng(3)
    at = np.concatenate([np.sort(rng.choice(10**6, c, replace=False)) for c in counts]).astype(np.int32)
    packed = [blob for a, b in cuts for blob in decontamination._pack_all(at[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])]
    assert [decontamination._unpack(blob).tolist() if blob else [] for blob in packed] == [at[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ann_graph_is_bounded_and_every_row_is_found(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[1200:] = x[7]  # 300 copies, more than a block of rows takes
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    fitted, build, cells = [], ann.build_graph, ann.search_cells
    monkeypatch.setattr(ann, "build_graph", lambda points, **options: fitted.append(points.count()) or build(points, **options))
    monkeypatch.setattr(ann, "search_cells", lambda *args: cells(*args, block_mb=0.004))
    got = {}
    for r in ann.neighbours(vectors, every=10, nodes=120, k=12, rounds=3, trees=2).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
        assert r.rank == len(got[r.query])
    assert fitted == [120]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = ((unit[::10, None, :] - unit[None]) ** 2).sum(2)
    d[np.arange(150), np.arange(0, 1500, 10)] = 9
    want = {10 * i: np.lexsort((np.arange(1500), row))[:10].tolist() for i, row in enumerate(d)}
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / 1500 >= 0.9
    assert got[1200] == want[1200] == [7, *range(1201, 1210)]  # equal distances go by id
