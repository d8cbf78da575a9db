"""Each operator against a direct computation."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest

from findery.llm import ann, byte_bpe, decontamination, html_extract, language_id, license_scan, line_dedup, lm_scoring, ngram_jaccard, toxicity

WORD = re.compile(r"[^\W_]+")


def words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


def dedup_brute(rows):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        keep = []
        for line in r.text.split("\n"):
            key = line.strip(" ")
            if key and key in seen:
                continue
            seen.add(key)
            keep.append(line)
        out[r.doc_id] = "\n".join(keep)
    return out


def grams(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard_brute(texts, threshold=0.6, n=2):
    sets = {i: g for i, t in texts.items() if (g := grams(t, n))}
    ids = sorted(sets)
    return {(a, b): j for k, a in enumerate(ids) for b in ids[k + 1 :] if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold - 1e-9}


def leaks_brute(texts, tests, n=13, least=5):
    wanted = set()
    for t in tests:
        w = words(t)
        if len(w) >= least:
            wanted |= {" " + " ".join(w[i : i + n]) + " " for i in range(max(1, len(w) - n + 1))}
    return {i for i, t in texts.items() if any(p in " " + " ".join(words(t)) + " " for p in wanted)}


def test_line_dedup(docs, rows):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == dedup_brute(rows)


def test_language_id_on_held_out_rows(docs):
    train, test = docs.where("doc_id < 100"), docs.where("doc_id >= 100 AND lang IS NOT NULL")
    got = language_id.identify(test, language_id.fit(train)).collect()
    right = sum(r.pred_lang == r.lang for r in got)
    assert right / len(got) >= 0.95


def test_lm_scoring(docs, rows):
    classes, least, smoothing = 8, 3, 10.0
    slices = lm_scoring.encode_words(docs)
    counts = lm_scoring.count_words(slices)
    known = {r.word: r["class"] for r in lm_scoring.cluster(slices, counts, classes, least, 2).collect()}
    from findery.llm.common import word_hashes

    texts = {r.doc_id: words(r.text) for r in rows}
    n = Counter(w for t in texts.values() for w in t)
    spelled = dict(zip(n, word_hashes(list(n)).view(np.int64).tolist()))
    cls = {w: known[spelled[w]] if c >= least else classes for w, c in n.items()}
    edge = classes + 1
    flows = {i: [edge, *[cls[w] for w in t], edge] for i, t in texts.items()}
    pairs = Counter(p for f in flows.values() for p in zip(f, f[1:]))
    k = classes + 2
    # texts of a slice share edges, so pairs of an end and a start don't count
    left, right = Counter(), Counter()
    for (a, b), c in pairs.items():
        left[a] += c
        right[b] += c
    total = sum(pairs.values())
    size = Counter()
    for w, c in n.items():
        size[cls[w]] += c
    rare = sum(c < least for c in n.values())
    move = {(a, b): math.log((pairs[a, b] + smoothing * (right[b] + 1) / (total + k)) / (left[a] + smoothing)) for a in range(k) for b in range(k)}
    emit = {w: -math.log(rare + 1) if cls[w] == classes else math.log(n[w] / size[cls[w]]) for w in n}
    got = {r.id: r for r in lm_scoring.score(docs, classes=classes, min_count=least, sweeps=2).collect()}
    for i, t in texts.items():
        want = sum(move[p] for p in zip(flows[i], flows[i][1:])) + sum(emit[w] for w in t) if t else 0.0
        assert got[i].n_tokens == len(t) and got[i].log_prob == pytest.approx(want, rel=1e-9)
        if t:
            assert got[i].perplexity == pytest.approx(math.exp(-want / (len(t) + 1)), rel=1e-9)


def test_exchange_raises_the_likelihood_and_parts_word_kinds(spark):
    rng = np.random.default_rng(3)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "nva"]
    texts = [(i, " ".join(str(rng.choice(kinds[j % 3])) for j in range(60))) for i in range(60)]
    slices = lm_scoring.encode_words(spark.createDataFrame(texts, "doc_id long, text string"))
    counts = lm_scoring.count_words(slices)
    from pyspark.sql import functions as F

    from findery.llm.common import word_hashes

    def value(sweeps):
        table = lm_scoring.cluster(slices, counts, 3, 1, sweeps)
        look = lm_scoring._Classes(slices, table.withColumn("emission", F.lit(0.0)), 128)
        return table, lm_scoring.objective(lm_scoring.class_bigrams(look, 3))

    (_, before), (table, after) = value(0), value(6)
    assert after > before
    where = {r.word: r["class"] for r in table.collect()}
    found = [{where[h] for h in word_hashes(k).view(np.int64).tolist()} for k in kinds]
    assert [len(f) for f in found] == [1, 1, 1] and len(set.union(*found)) == 3


def test_lm_scoring_is_the_same_when_classes_are_joined(docs):
    a = {r.id: r.log_prob for r in lm_scoring.score(docs, classes=8, sweeps=1).collect()}
    b = {r.id: r.log_prob for r in lm_scoring.score(docs, classes=8, sweeps=1, limit_mb=0).collect()}
    assert a == b


def test_decontamination(spark, sf, docs, rows):
    tests = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontamination.find(decontamination.build_index(docs), tests).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert {r.id for r in found if r.kind == "phrase"} == leaks_brute(texts, [t.text for t in tests.collect()])


def test_decontamination_by_proximity(spark):
    passage = "seven brown foxes jump across nine lazy dogs while twelve quiet owls watch"
    changed = "seven brown foxes quickly jump across nine lazy dogs while twelve very quiet owls watch"
    docs = spark.createDataFrame([(1, f"before {changed} after"), (2, " ".join(sorted(passage.split()))), (3, passage)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.id: r.kind for r in decontamination.find(decontamination.build_index(docs), tests).collect()}
    assert got[3] == "phrase" and got[1] == "proximity" and 2 not in got


def near_brute(texts, tests, n=13, rare=8, slack=4, least=5):
    """(doc, test) -> (kind, windows, first token), by the definition."""
    docs = {i: words(t) for i, t in texts.items()}
    total = Counter(w for t in docs.values() for w in t)
    out = {}
    for d, own in docs.items():
        at = {}
        for p, w in enumerate(own):
            at.setdefault(w, []).append(p)
        for q, text in tests.items():
            w = words(text)
            made = [w[i : i + n] for i in range(max(1, len(w) - n + 1))] if len(w) >= least else []
            hits = {"phrase": [], "proximity": []}
            for window in made:
                exact = [p for p in range(len(own) - len(window) + 1) if own[p : p + len(window)] == window]
                order = sorted(set(window), key=lambda t: (total[t], t))
                shift = {t: window.index(t) for t in order}
                near = []
                if len(order) >= rare:
                    starts = [p - shift[order[0]] for p in at.get(order[0], [])]
                    near = [s for s in starts if all(any(abs(p - s - shift[t]) <= slack for p in at.get(t, [])) for t in order[1:rare])]
                for kind, found in (("phrase", exact), ("proximity", near)):
                    if found:
                        hits[kind].append(max(0, min(found)))
            for kind in ("phrase", "proximity"):
                if hits[kind]:
                    out[d, q] = (kind, len(hits[kind]), min(hits[kind]))
                    break
    return out


def test_decontamination_by_the_definition(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    tests = {i: " ".join(rng.choice(vocabulary, size)) for i, size in enumerate([3, 6, 13, 20, 40, 25])}
    texts = {}
    for i in range(60):
        own = list(rng.choice(vocabulary, 40))
        passage = tests[int(rng.integers(6))].split()
        for _ in range(int(rng.integers(0, 6))):
            passage.insert(int(rng.integers(len(passage))), "x") if rng.random() < 0.5 else passage.pop()
        texts[i] = " ".join([*own[:20], *passage, *own[20:]] if i % 3 else own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = decontamination.find(decontamination.build_index(docs), spark.createDataFrame(list(tests.items()), "item_id long, text string")).collect()
    want = near_brute(texts, tests)
    assert {(r.id, r.test): (r.kind, r.windows, r.first_token) for r in found} == want
    assert {"phrase", "proximity"} == {k for k, _, _ in want.values()}


def diagonals_brute(text, body, k=4, shift=6, least=0.7):
    """(start, end, coverage, votes) of a template's places in a text."""
    own, model = words(text), words(body)
    grams = {}
    for a in range(len(model) - k + 1):
        grams.setdefault(tuple(model[a : a + k]), []).append(a)
    votes = Counter(p - a for p in range(len(own) - k + 1) for a in grams.get(tuple(own[p : p + k]), []))
    reach, clusters = min(shift, len(model) // 2), []
    for d in sorted(votes):
        if clusters and d - clusters[-1][-1] <= reach:
            clusters[-1].append(d)
        else:
            clusters.append([d])
    out = []
    for cluster in clusters:
        where = {}
        for d in sorted(cluster, key=lambda d: (-votes[d], d)):
            for j, w in enumerate(model):
                if j not in where and 0 <= j + d < len(own) and own[j + d] == w:
                    where[j] = j + d
        if len(where) / len(model) >= least:
            out.append((min(where.values()), max(where.values()) + 1, round(len(where) / len(model), 9), sum(votes[d] for d in cluster)))
    return out


def test_license_scan_by_the_definition(spark, docs, rows):
    from findery.llm.license_texts import TEMPLATES

    got = sorted((r.id, r.template, r.start, r.end, round(r.coverage, 9), r.votes) for r in license_scan.scan(docs, license_scan.template_table(spark)).collect())
    want = sorted((r.doc_id, t, *x) for r in rows for t, body in TEMPLATES.items() for x in diagonals_brute(r.text, body))
    assert got == want and len(want) > 0


def test_license_scan_tells_copies_in_a_row_apart(spark):
    line = "Released under the MIT License.\n"
    docs = spark.createDataFrame([(1, line * 4)], "doc_id long, text string")
    templates = spark.createDataFrame([("t", line)], "template string, body string")
    got = sorted((r.start, r.end) for r in license_scan.scan(docs, templates).collect())
    assert got == [(0, 5), (5, 10), (10, 15), (15, 20)]


def language_brute(model, text):
    """Posterior of the best language by the definition, word for word."""
    scores, used = [0.0] * len(model.languages), 0
    for word in words(text):
        if not any(c.isalpha() for c in word):
            continue
        values = model.grams[0].get(word)
        for n in (4, 3, 2, 1):
            if values is None:
                marked = "^" + word + "$"
                found = [model.grams[n][marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in model.grams[n]]
                values = tuple(sum(x) / len(found) for x in zip(*found)) if found else None
        if values is not None and any(values):
            used += 1
            scores = [a + b for a, b in zip(scores, values)]
    if not used:
        return None, 0.0, 0
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return model.languages[best], 1 / sum(math.exp(s - scores[best]) for s in scores), used


def test_language_id_by_the_definition(docs, rows):
    model = language_id.fit(docs, rows_per_language=20)
    for r in language_id.identify(docs, model).collect():
        lang, confidence, used = language_brute(model, r.text)
        assert r.n_words == used and r.confidence == pytest.approx(confidence, abs=1e-3)
        assert r.pred_lang == lang or confidence < 0.51  # near ties fall by rounding


def test_byte_bpe_equals_tiktoken(docs, spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.DEFAULT_VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = spark.createDataFrame([(10**6, "  \t\n x 　y 'LL it's 𝔘nicode é é <|endoftext|> \x00\x1c a b" + "a" * 5000 + "\U0001f600" * 50)], "doc_id long, text string")
    for r in byte_bpe.encode(docs.select("doc_id", "text").unionByName(odd), byte_bpe.load()).collect():
        assert r.tokens == own.encode_ordinary(r.text)


def test_license_scan(spark):
    body = [f"w{i}" for i in range(40)]
    changed = body[:15] + ["extra", "words"] + body[15:30] + body[31:]
    filler = [f"f{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(filler + body + filler)), (2, " ".join(filler + changed)), (3, " ".join(body[:20] + filler)), (4, " ".join(body + filler + body)), (5, " ".join(reversed(body)))], "doc_id long, text string")
    templates = spark.createDataFrame([("t", " ".join(body))], "template string, body string")
    got = sorted((r.id, r.start, r.end, round(r.coverage, 3)) for r in license_scan.scan(docs, templates).collect())
    assert got == [(1, 30, 70, 1.0), (2, 30, 71, 0.975), (4, 0, 40, 1.0), (4, 70, 110, 1.0)]


def test_toxicity_neighbours_are_exact(spark, sf, docs, rows):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    index = toxicity.build(docs, labels, k=5, block=16)
    texts = {r.doc_id: r.text for r in rows}

    def vector(text):
        tf = Counter(index.terms[w] for w in words(text) if w in index.terms)
        v = {t: (1 + math.log(c)) * index.idf[t] for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    known = [vector(texts[i]) for i in index.ids]
    for r in toxicity.classify(docs, index).collect():
        v = vector(texts[r.id])
        all_ = sorted(((round(sum(x * u.get(t, 0) for t, x in v.items()), 9), -i) for i, u in enumerate(known) if index.ids[i] != r.id), reverse=True)
        want = [c for c, _ in all_[:5] if c > 1e-9]
        got = [float(e.split(":")[1]) for e in r.evidence]
        assert got == pytest.approx(want, abs=6e-5)


def test_toxicity_finds_labelled_documents(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r.toxic for r in toxicity.classify(big, toxicity.build(big, labels)).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    right = sum(got[i] == bool(m) for i, m in marks.items())
    assert right / len(marks) >= 0.9


def test_ann_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = x @ x.T
    np.fill_diagonal(d, -2)
    ids = [r.vec_id for r in rows]
    want = {ids[i]: {ids[j] for j in np.argsort(-d[i])[:10]} for i in range(len(ids))}
    for limit in (256, 0):
        got = {}
        for r in ann.neighbours(vectors, limit_mb=limit, k=20, rounds=4, trees=4).collect():
            got.setdefault(r.query, set()).add(r.id)
        assert sum(len(got[i] & want[i]) for i in ids) / (10 * len(ids)) >= 0.9


@pytest.mark.parametrize("n", [2, 3])
def test_ngram_jaccard(docs, rows, n):
    want = jaccard_brute({r.doc_id: r.text for r in rows}, n=n)
    got = {}
    for r in ngram_jaccard.similar_pairs(docs, n=n).collect():
        for a in r.docs_a:
            for b in r.docs_b:
                if a != b:
                    got[min(a, b), max(a, b)] = r.jaccard
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def classes_brute(pairs, ids):
    """id -> (least id connected, number of links)."""
    root, links = {i: i for i in ids}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_ngram_jaccard_classes(docs, rows, block):
    # blocks of 60 grams: every group is opened in many parts
    want = classes_brute(jaccard_brute({r.doc_id: r.text for r in rows}), [r.doc_id for r in rows])
    got = {r.id: (r.class_id, r.n_links) for r in ngram_jaccard.classes(docs, block_grams=block).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 3000)] + [(5000, 5001), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in ngram_jaccard.components(chain).collect()}
    assert len({roots[i] for i in range(1, 3001)}) == 1 and roots[5000] == roots[5001] != roots[1] and len(roots) == 3002


def density_brute(tree):
    """(tag, children or text) trees: composite text density by recursion."""
    body = [0, 0, 0, 0]

    def measure(node, link):
        tag, inner = node
        if isinstance(inner, str):
            return [len(inner), 0, len(inner) if link else 0, 0]
        total = [0, 0, 0, 0]
        for child in inner:
            m = measure(child, link or child[0] == "a")
            for i in range(4):
                total[i] += m[i]
            if child[0] != "#":
                total[1] += 1
                total[3] += child[0] == "a"
        return total

    body = measure(tree, False)

    def density(node, link):
        c, t, lc, lt = measure(node, link)
        if not c:
            return 0.0
        t, lt = max(1, t), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + body[2] / max(1, body[0]) * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, math.e))

    def total(node, link):
        return sum(density(x, link or x[0] == "a") for x in node[1] if x[0] != "#") if not isinstance(node[1], str) else 0.0

    return density(tree, False), total(tree, False)


def test_html_density():
    tree = ("body", [("div", [("a", [("#", "home")]), ("a", [("#", "news")])]), ("article", [("p", [("#", "x" * 200)]), ("p", [("#", "y" * 150), ("a", [("#", "link")])])])])

    def markup(node):
        return node[1] if node[0] == "#" else f"<{node[0]}>" + "".join(map(markup, node[1])) + f"</{node[0]}>"

    density, total = html_extract.densities(html_extract.Dom(f"<html>{markup(tree)}</html>"))
    assert (density[0], total[0]) == pytest.approx(density_brute(tree))
    text, tag, _ = html_extract.extract_one(f"<html><head><title>t</title></head>{markup(tree)}</html>")
    assert tag == "article" and text == "x" * 200 + "\n" + "y" * 150 + "link"


def test_html_pages_lose_navigation(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = html_extract.extract(pages).collect()
    assert len(out) == pages.count() and all(r.content is not None for r in out)
    assert json.dumps([r.content for r in out]).count("<script") == 0
