"""Exact word n-gram Jaccard self-join with a token-group matrix.

Documents with the same set of n-grams form one unit. Similar units are
partitioned into groups: each offers the few least hashes among its rare tokens,
and goes to the one that most units offer. A pair can reach the threshold only if
the two share enough of the rarest tokens of each (a prefix in one global order,
lengthened so that more than one must be shared), so the matrix of tokens and
groups is built from these prefixes: it counts how many prefix tokens of a unit
each group's union holds, and a unit queries the groups that hold enough, of a
fitting size (a group whose members share too little with each other and with all
queries stays closed). In an opened group the overlap with every member is counted
exactly, but only if the overlap with the union of all its tokens can reach the
threshold. Thousands of copies that share their tokens are one or few
groups, so candidates grow with the number of groups, not of pairs. A large group
is opened block by block, so a task holds two blocks of it, and what comes out of a
block is one row for each unit: how many documents it is linked with, and one edge
to the least unit that it is connected with there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from .common import count_slices, fresh, lean, merged_counts, mix, ref, rolling, saved, sized_join, table_mb, text_slices, tokens, word_hashes
from .decontamination import _pack, _pack_all, _unpack

#: Cells of the sketches of word and of gram counts, and of a slice of them.
CELLS, GRAM_CELLS, SLICE = 1 << 22, 1 << 24, 1 << 18
#: Keys that a unit offers for its group; bits of a group's number (groups that share one are one).
OFFERS, GROUP_BITS = 12, 40
#: By which part of its size a prefix is lengthened, and so many more tokens must be shared.
LONGER = 0.05
#: Bits of a prefix token: ``_pack_all`` holds no more, and what it cuts off are lost pairs. The
#: last one marks the short prefix, those before it are the token's hash.
BITS = 42
#: Prefix tokens that one task gets, and those that it looks at at a time.
BUCKET_TOKENS, PART_TOKENS = 3_000_000, 1_000_000
#: Grams (of members, and of queries) that one task holds of an opened group.
BLOCK_GRAMS = 2_000_000
#: Members from which a block's frequent grams are counted by a matrix product, its cells, and the rows of one product.
DENSE_MEMBERS, DENSE_CELLS, DENSE_ROWS = 48, 16_000_000, 256
#: Roles of a unit in a group: member compared with other members, member compared with queries only, query.
MEMBER, HOST, QUERY = 0, 1, 2


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts as eighths of log2."""
    return (np.log2(counts + 1) * 8).clip(0, 255)


def _collected(slices: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(cells, np.uint8)
    for row in slices.toLocalIterator():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["ranks"]), np.uint8)
    return out


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of each hashed word, then of each hashed n-gram, over all texts: a gram
    occurs at most as often as its rarest word, and as its cell says, and the lesser
    of the two orders tokens by rarity. The size is fixed; what shares a cell only
    loses some of the order's use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_gram = np.zeros(CELLS, np.uint32), np.zeros(GRAM_CELLS, np.uint32)
        for batch in text_slices(batches, "text"):
            ends, codes, words = tokens(batch.column("text"))
            hashed = word_hashes(words)
            np.add.at(by_word, _at(hashed, CELLS), np.bincount(codes, minlength=len(words)).astype(np.uint32))
            grams, _ = rolling(hashed[codes], ends, n)
            np.add.at(by_gram, _at(grams, GRAM_CELLS), np.uint32(1))
        yield from count_slices(by_word, SLICE)
        yield from count_slices(by_gram, SLICE, CELLS // SLICE)

    return _collected(merged_counts(texts.mapInArrow(lean(count), "slice int, counts binary"), SLICE, _rank), CELLS + GRAM_CELLS)


def _popularity(rows: DataFrame) -> np.ndarray:
    """How many documents offer each hashed key, in eighths of log2: by it a document
    picks its group without any join. Its size is fixed; keys that share a cell only
    make for other groups, not for other results."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            np.add.at(cells, _cells(batch.column("offers").flatten().to_numpy(zero_copy_only=False)), np.uint32(1))
        yield from count_slices(cells, SLICE)

    return _collected(merged_counts(rows.select("offers").mapInArrow(lean(count), "slice int, counts binary"), SLICE, _rank), CELLS)


def _at(hashed: np.ndarray, cells: int) -> np.ndarray:
    return (mix(hashed) & np.uint64(cells - 1)).astype(np.int64)


def _cells(keys: np.ndarray) -> np.ndarray:
    return _at(keys.astype(np.int64).view(np.uint64), CELLS)


def _groups(offers: pa.Array, popular: np.ndarray) -> np.ndarray:
    """The number of each row's group: the most popular key of its offers (of equal ones
    the largest)."""
    keys = offers.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(offers).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((keys, popular[_cells(keys)], row))
    return (keys[order][np.cumsum(sizes) - 1].view(np.uint64) >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


def gram_sets(texts: pa.Array, n: int, ranks: np.ndarray | None = None):
    """For each text its n-gram set as sorted hashes (with their rarity, if ``ranks``
    is given). A text of fewer than ``n`` tokens has the one gram of all its tokens."""
    ends, codes, words = tokens(texts)
    hashed = word_hashes(words)[codes]
    sizes = np.diff(ends)
    rarity = None
    if ranks is not None:
        rarity = ranks[_at(word_hashes(words), CELLS)][codes]
    grams, starts = rolling(hashed, ends, n)
    least = None
    if rarity is not None:
        counts = np.diff(starts)
        first = np.repeat(ends[:-1] - starts[:-1], counts) + np.arange(starts[-1])
        least = rarity[first] if len(first) else np.zeros(0, np.uint8)
        for i in range(1, n):
            least = np.minimum(least, rarity[first + i])
        least = np.minimum(least, ranks[CELLS + _at(grams, GRAM_CELLS)])
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        elif size < n:
            whole, _ = rolling(hashed[ends[i] : ends[i + 1]], np.array([0, size]), size)
            yield whole, (np.zeros(0, np.uint8) if rarity is None else rarity[ends[i] : ends[i + 1]].min(keepdims=True))
        else:
            own = grams[starts[i] : starts[i + 1]]
            own, at = np.unique(own, return_index=True)
            yield own, (np.zeros(0, np.uint8) if least is None else least[starts[i] : starts[i + 1]][at])


def _needed(size: int, threshold: float) -> int:
    """Least overlap of a set of ``size`` with any partner at ``threshold``."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def _least(size: int, threshold: float) -> int:
    """Least overlap of a set of ``size`` with any partner that is no smaller."""
    return _needed(size, 2 * threshold / (1 + threshold))


def _shared(size: float) -> int:
    """How many tokens of two prefixes must agree, for a set of ``size`` and no smaller one."""
    return 1 + int(LONGER * size)


def _units(docs: DataFrame, n: int, threshold: float, ranks) -> DataFrame:
    """(id, uid, unit, size, offers, prefix) of every document; one without tokens has no
    unit. ``uid`` numbers the rows."""
    kind = docs.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in text_slices(batches, "text"):
            units, sizes, offers, cut, flat = [], [], [], [0], []
            for own, rarity in gram_sets(batch.column("text"), n, ranks.value):
                size = len(own)
                units.append(xxh64_intdigest(own.tobytes()))
                sizes.append(size)
                order = np.lexsort((own, rarity))[: size - _needed(size, threshold) + _shared(size)] if size else np.zeros(0, int)
                offers.append(np.sort(mix(own[order]))[:OFFERS].view(np.int64))
                short = np.arange(len(order)) < size - _least(size, threshold) + _shared(size)
                flat.append(np.sort((own[order] >> np.uint64(65 - BITS)).astype(np.int64) << 1 | short))
                cut.append(cut[-1] + len(order))
            blobs = _pack_each(np.concatenate(flat), np.array(cut))
            none = np.array(sizes) == 0
            uids = pa.array(np.arange(uid, uid + len(units)))
            uid += len(units)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow), uids, pa.array(np.array(units, np.uint64).view(np.int64), mask=none), pa.array(np.array(sizes, np.int32)), pa.array([x.tolist() for x in offers], pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["id", "uid", "unit", "size", "offers", "prefix"])

    shape = T.StructType([T.StructField("id", kind), T.StructField("uid", T.LongType()), T.StructField("unit", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("offers", T.ArrayType(T.LongType())), T.StructField("prefix", T.BinaryType())])
    return docs.mapInArrow(lean(work), shape)


def _pack_each(flat: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Each sorted list as 48-bit little-endian values: they hardly compress."""
    raw = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return [raw[a * 6 : b * 6] for a, b in zip(cut.tolist(), cut[1:].tolist())]


def _unpack_each(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) // 6 for b in blobs], np.int64)
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.int64).ravel(), sizes


def _candidates(units: DataFrame, popular, buckets: int, threshold: float) -> DataFrame:
    """(uid, grp, own, size): which groups each unit queries. Of two groups the unit of the
    lower one queries the other; ``own`` marks that others of its own group share enough.
    A partner has at least ``threshold`` of the unit's size, so its prefix and the
    unit's share at least what that size needs. With a partner that is no smaller a unit
    shares more of itself, so the tokens that the two must share stand in its short
    prefix: what is in neither's, or only in that of the larger, does not count."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a unit's row is a varint step from the one before and one number for group and size
        schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("who", pa.binary()), ("uids", pa.binary()), ("table", pa.binary())])
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                part = part.take(pc.array_sort_indices(part.column("uid")))
                flat, sizes = _unpack_each(part.column("prefix").to_pylist())
                who = np.repeat(np.arange(part.num_rows, dtype=np.uint16), sizes)
                uids = part.column("uid").to_numpy()
                table = (_groups(part.column("offers"), popular.value) << 24) | np.minimum(part.column("size").to_numpy(), (1 << 24) - 1)
                order = np.argsort(flat, kind="stable")
                flat, who = flat[order], who[order]
                bounds = np.searchsorted(flat, (np.arange(buckets + 1, dtype=np.float64) * (2.0 ** (BITS - 1) / buckets)).astype(np.int64) << 1)
                bounds[-1] = len(flat)
                packed = _pack_all(flat, bounds)
                for k in range(buckets):
                    own = who[bounds[k] : bounds[k + 1]]
                    if len(own):
                        used, short = np.unique(own, return_inverse=True)
                        yield pa.RecordBatch.from_pydict({"bucket": [k], "hashes": [packed[k]], "who": [short.astype(np.uint16).tobytes()], "uids": [_pack(uids[used])], "table": [table[used].tobytes()]}, schema=schema)

    def total(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return [(keys, np.bincount(place, np.concatenate([c for _, c in found])).astype(np.int64))]

    def meet_part(flat: np.ndarray, at: np.ndarray, groups: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row * groups + group, tokens in common) with ``groups`` numbered in order."""
        order = np.argsort(flat, kind="stable")
        flat, at = flat[order], at[order]
        flat, short = flat >> 1, (flat & 1).astype(bool)
        edges = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
        runs = np.diff(edges)
        # the short ones come last in a run
        keep = np.repeat((runs > 1) & short[edges[1:] - 1], runs)
        flat, at, short = flat[keep], at[keep], short[keep]
        if not len(flat):
            return []
        run = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
        many, group, size = int(groups.max()) + 1, groups[at], sizes[at]
        # groups of each run, with the spans of sizes of those in the run and of the short ones
        order = np.lexsort((group, run))
        r, g, s = run[order], group[order], size[order]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])]))
        g_run, g_key, g_min, g_max = r[new], g[new], np.minimum.reduceat(s, new), np.maximum.reduceat(s, new)
        g_many = np.diff(np.append(new, len(r))) > 1
        is_short = short[order]
        s_min = np.minimum.reduceat(np.where(is_short, s, 1 << 62), new)
        s_max = np.maximum.reduceat(np.where(is_short, s, -1), new)
        low, high = np.searchsorted(g_run, run, "left"), np.searchsorted(g_run, run, "right")
        step = np.concatenate([[0], np.cumsum(high - low)])
        found, a = [], 0
        while a < len(run):
            b = max(a + 1, int(np.searchsorted(step, step[a] + 4_000_000, "right")) - 1)
            w = high[a:b] - low[a:b]
            left = np.repeat(np.arange(a, b), w)
            right = np.repeat(low[a:b] - (step[a:b] - step[a]), w) + np.arange(int(w.sum()))
            own = g_key[right] == group[left]
            ok = (g_key[right] > group[left]) | (own & g_many[right])
            left, right = left[ok], right[ok]
            mine = size[left]
            smaller = (s_min[right] <= mine) & (s_max[right] >= threshold * mine - 1e-9)
            larger = short[left] & (g_max[right] >= mine) & (g_min[right] * threshold - 1e-9 <= mine)
            ok = smaller | larger
            found.append(np.unique(at[left[ok]] * many + g_key[right[ok]], return_counts=True))
            a = b
        return total(found)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unpack(x) for x in part["hashes"]]
        who = [np.frombuffer(x, np.uint16) for x in part["who"]]
        tables = [np.frombuffer(x, np.int64) for x in part["table"]]
        base = np.cumsum([0, *[len(t) for t in tables]])
        table, uids = np.concatenate(tables), np.concatenate([_unpack(x) for x in part["uids"]])
        # unsigned: a group's number may fill its bits up to the sign
        keys, groups = np.unique((table.view(np.uint64) >> np.uint64(24)).astype(np.int64), return_inverse=True)
        sizes = table & ((1 << 24) - 1)
        low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes) + 1
        steps = max(1, sum(map(len, hashes)) // PART_TOKENS)
        edges = [(low + (high - low) * i // steps) & ~1 for i in range(steps)] + [high]
        cuts = [np.searchsorted(h, edges) for h in hashes]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(steps):
            flat = np.concatenate([h[c[i] : c[i + 1]] for h, c in zip(hashes, cuts)])
            at = np.concatenate([w[c[i] : c[i + 1]].astype(np.int64) + b for w, c, b in zip(who, cuts, base)])
            found += meet_part(flat, at, groups, sizes)
            if sum(len(k) for k, _ in found[1:]) > max(1_000_000, len(found[0][0]) if found else 0):
                found = total(found)
        if not found:
            return pd.DataFrame({"uid": [], "grp": [], "own": [], "size": [], "n": []}).astype({"own": bool})
        (pairs, n), = total(found)
        row, grp = np.divmod(pairs, len(keys))
        return pd.DataFrame({"uid": uids[row], "grp": keys[grp], "own": groups[row] == grp, "size": sizes[row], "n": n})

    rows = units.select("uid", "offers", "size", "prefix").mapInArrow(lean(blocks), "bucket int, hashes binary, who binary, uids binary, table binary")
    met = rows.groupBy("bucket").applyInPandas(meet, "uid long, grp long, own boolean, size long, n long")
    counted = met.groupBy("uid", "grp").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("own").alias("own"))
    return counted.where(F.col("n") >= 1 + F.floor(F.lit(LONGER) * F.floor(F.col("size") * threshold))).select("uid", "grp", "own", "size")


def _places(union: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams that ``union`` holds stand in it, and which ones these are."""
    at = np.searchsorted(union, grams)
    at[at == len(union)] = 0
    hit = union[at] == grams
    return at[hit], hit


def _frequent(bounds: np.ndarray, owner: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The grams that many of ``m`` members have, as a matrix of 0 and 1 (grams by members),
    with each gram's row (-1: none). Sums below 2^24 are exact in it."""
    if m < DENSE_MEMBERS:
        return np.zeros(0, np.int64), None
    width = np.diff(bounds)
    many = np.flatnonzero(width > m // 64 + 1)
    many = many[np.argsort(-width[many], kind="stable")[: max(1, DENSE_CELLS // m)]]
    column = np.full(len(width), -1, np.int64)
    column[many] = np.arange(len(many))
    dense = np.zeros((len(many), m), np.float32)
    at = np.repeat(column, width)
    dense[at[at >= 0], owner[at >= 0]] = 1
    return column, dense


def _verify(part: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """Opens one block of a group: its members among themselves (if they are to be) and
    the queries against them. The similar pairs, as rows of the returned frame, their
    overlaps and the frame."""
    part = part.sort_values("kind", kind="stable").drop_duplicates("unit")
    kind = part["kind"].to_numpy()
    m = int((kind != QUERY).sum())
    among = bool((kind == MEMBER).any())
    sets = [np.frombuffer(x, np.uint64) for x in part["grams"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    rows_a, rows_b, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if m and len(sets) > 1:
        flat = np.concatenate(sets[:m])
        owner = np.repeat(np.arange(m, dtype=np.int32), sizes[:m])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        union, first = np.unique(flat, return_index=True)
        bounds = np.concatenate([first, [len(flat)]])
        column, dense = _frequent(bounds, owner, m)
        for i in range(0 if among else m, len(sets)):
            if dense is not None and (i - (0 if among else m)) % DENSE_ROWS == 0:
                some = sets[i : i + DENSE_ROWS]
                rows = np.zeros((len(some), len(dense)), np.float32)
                at, hit = _places(union, np.concatenate(some))
                row = np.repeat(np.arange(len(some)), sizes[i : i + DENSE_ROWS])[hit]
                rows[row[column[at] >= 0], column[at][column[at] >= 0]] = 1
                counted = rows @ dense
            own = sets[i]
            at, _ = _places(union, own)
            if len(at) < _needed(len(own), threshold):
                continue  # even the whole group's union holds too little of it
            both = 0
            if dense is not None:
                both = counted[(i - (0 if among else m)) % DENSE_ROWS].astype(np.int64)
                at = at[column[at] < 0]
            low, width = bounds[at], bounds[at + 1] - bounds[at]
            step = np.concatenate([[0], np.cumsum(width)])
            both = both + np.bincount(owner[np.repeat(low - step[:-1], width) + np.arange(step[-1])], minlength=m)
            good = both >= threshold * (sizes[:m] + len(own) - both) - 1e-9
            if i < m:
                good[: i + 1] = False
            at = np.flatnonzero(good)
            rows_a.append(np.full(len(at), i)), rows_b.append(at), overlaps.append(both[at])
    return np.concatenate(rows_a), np.concatenate(rows_b), np.concatenate(overlaps), part


def _pairs_of(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    a, b, both, part = _verify(part, threshold)
    units, sizes = part["unit"].to_numpy(np.int64), np.array([len(x) // 8 for x in part["grams"]], np.int64)
    return pd.DataFrame({"a": units[a], "b": units[b], "both": both, "jaccard": both / (sizes[a] + sizes[b] - both)})


def _links_of(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(unit, root, links): of each unit that is similar to any, how many documents it
    is linked with here, and the least unit that it is connected with."""
    a, b, _, part = _verify(part, threshold)
    units, weight = part["unit"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    links = np.bincount(a, weight[b], len(units)) + np.bincount(b, weight[a], len(units))
    root = np.argsort(np.argsort(units))
    while True:  # least labels flow along all pairs, and each to the label of its label
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = np.minimum(root, root[np.argsort(units)][root])
        if (root == before).all():
            break
    some = np.unique(np.concatenate([a, b]))
    return pd.DataFrame({"unit": units[some], "root": np.sort(units)[root[some]], "links": links[some].astype(np.int64)})


def _blocks(roles: DataFrame, block_grams: int) -> DataFrame:
    """(uid, grp, sub, kind) from (uid, grp, size, member): groups of more than
    ``block_grams`` grams are opened block by block. Block i meets itself, every later
    block and every part of the queries, each in a task of its own."""
    weight = roles.groupBy("grp").agg(F.sum(F.when(F.col("member"), F.col("size")).otherwise(0)).alias("m"), F.sum(F.when(F.col("member"), 0).otherwise(F.col("size"))).alias("q"))
    big = saved(weight.where((F.col("m") > block_grams) | (F.col("q") > block_grams)).select("grp", F.ceil(F.col("m") / block_grams).cast("int").alias("nb"), F.ceil(F.col("q") / block_grams).cast("int").alias("qb")), "gram-blocks")
    known = sized_join(roles, big, ["grp"], "left", 16)
    kind = F.when(F.col("member"), MEMBER).otherwise(QUERY)
    plain = known.where("nb IS NULL").select("uid", "grp", F.lit(0).cast("long").alias("sub"), kind.alias("kind"))
    split = known.where("nb > 0").withColumn("wide", (F.col("nb") + F.col("qb")).cast("long")).withColumn("i", F.pmod(F.xxhash64("uid"), F.when(F.col("member"), F.col("nb")).otherwise(F.col("qb"))).cast("int"))

    def at(row, column, kind):
        return F.struct((row.cast("long") * F.col("wide") + column).alias("sub"), F.lit(kind).alias("kind"))

    i, nb, qb = F.col("i"), F.col("nb"), F.col("qb")
    host = F.transform(F.sequence(F.lit(0), nb + qb - 1), lambda j: F.when(j > i, at(i, j, HOST)))
    guest = F.transform(F.sequence(F.lit(0), nb - 1), lambda j: F.when(j < i, at(j, i, QUERY)))
    of_member = F.concat(F.array(at(i, i, MEMBER)), host, guest)
    of_query = F.transform(F.sequence(F.lit(0), nb - 1), lambda j: at(j, nb + i, QUERY))
    places = split.select("uid", "grp", F.explode(F.filter(F.when(F.col("member"), of_member).otherwise(of_query), lambda x: x.isNotNull())).alias("x"))
    return plain.unionByName(places.select("uid", "grp", "x.sub", "x.kind"))


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, verify, shape: str, block_grams: int = BLOCK_GRAMS) -> tuple[DataFrame, DataFrame]:
    """(units with their documents, what ``verify`` makes of each opened block)."""
    spark = docs.sparkSession
    source = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).where(F.col("id").isNotNull())
    ranks = spark.sparkContext.broadcast(_sketch(source.select("text"), n))
    everyone = saved(_units(source, n, threshold, ranks), "gram-units")
    rows = everyone.where("unit IS NOT NULL")
    # of documents with the same set, the one with the least id stands for the unit
    copies = saved(rows.groupBy("unit").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("n"), F.min(F.struct("id", "uid")).alias("at")).where("rows > 1").select("unit", "n", F.col("at.uid").alias("first")), "gram-copies")
    units = sized_join(rows, copies, ["unit"], "left", 24).where("first IS NULL OR uid = first")
    popular = spark.sparkContext.broadcast(_popularity(rows))
    total = rows.agg(F.sum(F.length("prefix")).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(total) // (6 * BUCKET_TOKENS)))
    queries = saved(_candidates(units, popular, buckets, threshold), "gram-candidates")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(_groups(batch.column("offers"), popular.value)), batch.column("size")], names=["uid", "grp", "size"])

    members = units.select("uid", "offers", "size").mapInArrow(lean(place), "uid long, grp long, size int")
    opened = queries.select("grp").distinct()
    roles = members.join(opened, "grp", "left_semi").select("uid", "grp", F.col("size").cast("long").alias("size"), F.lit(True).alias("member"))
    roles = saved(roles.unionByName(queries.where("NOT own").select("uid", "grp", "size", F.lit(False).alias("member"))), "gram-places")
    roles = _blocks(roles, block_grams).groupBy("uid").agg(F.collect_set(F.struct("grp", "sub", "kind")).alias("roles"))
    # one document stands for its unit; its text brings the unit's roles along
    firsts = sized_join(rows.select("id", "uid", "unit"), copies, ["unit"], "left", 24).where("first IS NULL OR uid = first").select("id", "uid", "unit", F.coalesce("n", F.lit(1)).alias("n"))
    involved = saved(firsts.join(roles, "uid").select(F.col("id").alias("k"), "unit", "n", "roles"), "gram-roles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            made = [own for own, _ in gram_sets(batch.column("text"), n)]
            units = np.array([xxh64_intdigest(x.tobytes()) for x in made], np.uint64).view(np.int64)
            fits = np.flatnonzero(units == batch.column("unit").to_numpy(zero_copy_only=False))
            found = batch.column("roles").take(pa.array(fits))
            at = np.repeat(fits, pc.list_value_length(found).to_numpy(zero_copy_only=False)).tolist()
            flat = found.flatten()
            for a in range(0, len(at), 1024):
                own = at[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(units[own]), batch.column("n").take(pa.array(own)), pa.array([made[i].tobytes() for i in own], pa.binary()), *[flat.field(c).slice(a, len(own)) for c in ("grp", "sub", "kind")]], names=["unit", "n", "grams", "grp", "sub", "kind"])

    texts = sized_join(source.withColumnRenamed("id", "k"), involved, ["k"], "inner", 24).select("unit", "n", "text", "roles")
    grams = texts.mapInArrow(lean(sets), "unit long, n long, grams binary, grp long, sub long, kind int")
    return everyone, grams.groupBy("grp", "sub").applyInPandas(lambda part: verify(part, threshold), shape)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.6) -> DataFrame:
    """(doc_a, doc_b, docs_a, docs_b, jaccard, overlap): all pairs of different n-gram
    sets with a Jaccard similarity of at least ``threshold``. ``docs_a`` and ``docs_b``
    list the documents that have the one and the other set (any of the one is as
    similar to any of the other), ``doc_a`` < ``doc_b`` are their least ids. Documents
    with the same set have one row of similarity 1, with both lists the same and the
    two least ids. Where copies are many, ``classes`` says the same in one row a document.

    Every document is compared; nothing is capped. Defined results are those of ``classes``.
    """
    rows, pairs = _join(docs, id_col, text_col, n, threshold, _pairs_of, "a long, b long, both long, jaccard double")
    ids = saved(rows.where("unit IS NOT NULL").groupBy("unit").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("size").alias("size")), "gram-ids")
    same = ids.where(F.size("ids") > 1).select(F.element_at("ids", 1).alias("doc_a"), F.element_at("ids", 2).alias("doc_b"), F.col("ids").alias("docs_a"), F.col("ids").alias("docs_b"), F.lit(1.0).alias("jaccard"), F.col("size").cast("long").alias("overlap"))
    both = sized_join(pairs, ids.select(F.col("unit").alias("a"), F.col("ids").alias("x")), ["a"], "inner", 16)
    both = sized_join(both, ids.select(F.col("unit").alias("b"), F.col("ids").alias("y")), ["b"], "inner", 16)
    swap = F.element_at("x", 1) > F.element_at("y", 1)
    both = both.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("docs_a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("docs_b"), "jaccard", F.col("both").alias("overlap"))
    both = both.select(F.element_at("docs_a", 1).alias("doc_a"), F.element_at("docs_b", 1).alias("doc_b"), "docs_a", "docs_b", "jaccard", "overlap")
    return same.unionByName(both)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (u, v): one node stands for each connected
    component. Each round every node goes to the one of its neighbours and itself that
    comes first in an order drawn anew, and the edges are those of what is left, until
    none is: a round leaves a constant part of the nodes, whatever the shape of the
    component, and only edges of what is left are read again."""
    edges, r, steps = saved(edges.where("u <> v").distinct(), "edges"), 0, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(r)).alias("o"), F.col(c).alias("x"))  # noqa: B023, E731
        to = saved(both.groupBy("u").agg(F.least(F.first(turn("u")), F.min(turn("v"))).alias("t")).select(F.col("u").alias("node"), F.col("t.x").alias("root")), "hooks")
        steps.append(to)
        moved = edges.join(to.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(to.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        edges, r = saved(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges"), r + 1
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    follow = lambda later, step: saved(step.join(later.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return reduce(follow, reversed(steps[:-1]), steps[-1])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.6, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(id, class_id, n_links) of every document: ``n_links`` is the number of other
    documents whose n-gram set has a Jaccard similarity of at least ``threshold`` with
    its own (1 for copies), ``class_id`` the least id of all that are connected with it
    by such links (its own, if it has none).

    Every document is compared; nothing is capped. Defined results: null, empty and
    tokenless texts are similar to nothing; a text of fewer than ``n`` tokens has its
    whole token sequence as its one gram; rows with the same id are one document, which
    has the links of all its texts, and those with the same set count once; rows with a
    null id are compared with nothing and have no row; texts of any length are compared
    whole; an empty table gives an empty table.
    """
    rows, found = _join(docs, id_col, text_col, n, threshold, _links_of, "unit long, root long, links long", block_grams)
    found = saved(found, "gram-links")
    ids = saved(rows.select("id", "unit").distinct(), "gram-ids")
    # the texts of a document with several belong together
    several = ids.groupBy("id").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).where("least < most").select("id", "least")
    edges = found.select(F.col("unit").alias("u"), F.col("root").alias("v")).unionByName(ids.join(several, "id").where("unit <> least").select(F.col("unit").alias("u"), F.col("least").alias("v")))
    roots = components(edges)
    per_unit = ids.where("unit IS NOT NULL").groupBy("unit").agg((F.count("*") - 1).alias("copies"))
    links = per_unit.join(found.groupBy("unit").agg(F.sum("links").alias("links")), "unit", "left").join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left")
    links = links.where("copies > 0 OR links > 0 OR root IS NOT NULL").select("unit", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "unit").alias("root"))
    placed = saved(ids.join(links, "unit", "left"), "gram-placed")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    placed = sized_join(placed, saved(least, "gram-least"), ["root"], "left", 16)
    return placed.groupBy("id").agg(F.coalesce(F.min("least"), F.first("id")).alias("class_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.6) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the least
    id. Groups are the classes of ``classes``; a document that is similar to none
    stays, and so do rows with a null id. Rows that repeat the id that stays all stay."""
    k_gone = fresh(docs, "gone")[0]
    gone = saved(classes(docs, id_col, text_col, n, threshold).where(F.col("class_id") < F.col("id")).select(F.col("id").alias(k_gone)), "gram-gone")
    side = F.broadcast(gone) if table_mb(gone, 16) <= 32 else gone
    return docs.join(side, ref(id_col) == side[k_gone], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS t FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, CASE WHEN len(t) < 2 THEN [t[1]] ELSE list_distinct([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) END AS s FROM w WHERE len(t) > 0
), d AS (SELECT doc_id, list_sort(s) AS s FROM g), u AS (
  SELECT s, min(doc_id) AS unit, count(*) AS docs, len(s) AS n FROM d GROUP BY s
), x AS (SELECT unit, n, unnest(s) AS gram FROM u), p AS (
  SELECT a.unit AS a, b.unit AS b
  FROM x a JOIN x b ON a.gram = b.gram AND a.unit < b.unit GROUP BY a.unit, b.unit HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (
  SELECT unit AS node, unit AS reached FROM u UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS class_id FROM r GROUP BY node), l AS (
  SELECT u.unit, any_value(u.docs) - 1 + coalesce(sum(o.docs), 0) AS links FROM u LEFT JOIN e ON u.unit = e.a LEFT JOIN u o ON e.b = o.unit GROUP BY u.unit
)
SELECT t.doc_id, coalesce(c.class_id, t.doc_id) AS class_id, CAST(coalesce(l.links, 0) AS BIGINT) AS n_links
FROM documents t LEFT JOIN d USING (doc_id) LEFT JOIN u ON d.s = u.s LEFT JOIN c ON c.node = u.unit LEFT JOIN l ON l.unit = u.unit
"""
