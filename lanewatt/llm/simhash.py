"""Near-duplicates: SimHash fingerprints and their self-join by a traversal of binary tries; classes by exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, new_folder, quoted, remove_folder, spread_join, stored

SEED = 42
BUDGET = 4
BITS = 64
#: Node pairs of no more pairs of values than this are compared outright.
LEAF_PAIRS = 4
#: Fingerprints of a subtree that is dealt out as one, about, and rows of a task.
SUBTREE = 4096
TASK_ROWS = 400_000
FRONTIER = 1 << 18


def shingle_hashes(text: str, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles: A-Z lower-cased, words parted by ASCII white space, joined by spaces.

    Fewer words than ``words`` make one shingle, no word none. ``distinct`` counts each shingle once.
    """
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if words > 1:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
        parts = [joined[s:e] for s, e in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)]
    if distinct:
        parts = list(set(parts))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in parts), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if set in over half of the hashes; of none, zero."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """An independent hash of hashes for the k-th fingerprint; the 0-th is the hash itself."""
    if not k:
        return hashes
    h = hashes ^ np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int, distinct: bool, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty((batch.num_rows, count), np.uint64)
        for i, text in enumerate(batch.column(1)):
            hashes = shingle_hashes(text.as_py() or "", words, distinct)
            for k in range(count):
                out[i, k] = majority(remix(hashes, k))
        flat = pa.array(out.view(np.int64).reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * count), flat)], ["doc_id", "fps"])


def fingerprints(documents: DataFrame, words: int = 4, distinct: bool = False, count: int = 1) -> DataFrame:
    """(doc_id, fps): ``count`` fingerprints of every whole text; a null text counts as empty and has zeros."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, words=words, distinct=distinct, count=count), "doc_id long, fps array<long>")


# The trie self-join. A node is a range of the sorted fingerprints that share a prefix; a pair of nodes carries the
# number of bits by which their prefixes differ.


class _Trie:
    def __init__(self, values: np.ndarray):
        self.values, self.ones = values, {}

    def split(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the children with bit 1 begin."""
        if depth not in self.ones:
            bit = (self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
        ones = self.ones[depth]
        return hi - (ones[hi] - ones[lo])


def trie_pairs(values: np.ndarray, pairs: np.ndarray, budget: int, exact: int = 0, tally: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` differing bits, as they are found.

    ``pairs`` are the root node pairs (a_lo, a_hi, b_lo, b_hi), equal halves for a self-join; within each range
    ``values`` is sorted. Node pairs descend together and add up the bits by which their prefixes differ; a pair beyond
    its budget, which is nil over the first ``exact`` bits, is dropped with all below it. The last few values of a node
    pair are compared outright. A long frontier is halved and its halves done one after the other, so memory stays
    bounded. ``tally`` counts the node pairs that were split, dropped and compared.
    """
    trie = _Trie(values)
    tally = {} if tally is None else tally
    stack = [(0, pairs.astype(np.int64), np.zeros(len(pairs), np.int64))]
    while stack:
        depth, nodes, used = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half], used[:half]), (depth, nodes[half:], used[half:])]
            continue
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        leaf = (sizes <= LEAF_PAIRS) | (depth == BITS)
        tally["compared"] = tally.get("compared", 0) + int(leaf.sum())
        yield from _compare(values, nodes[leaf], budget)
        nodes, used = nodes[~leaf], used[~leaf]
        if not len(nodes):
            continue
        tally["split"] = tally.get("split", 0) + len(nodes)
        allowed = 0 if depth < exact else budget
        a_lo, a_hi, b_lo, b_hi = nodes.T
        a_mid, b_mid = trie.split(a_lo, a_hi, depth), trie.split(b_lo, b_hi, depth)
        same = (a_lo == b_lo) & (a_hi == b_hi)
        children, budgets = [], []
        for a, b, cost, keep in (
            ((a_lo, a_mid), (b_lo, b_mid), 0, None),
            ((a_mid, a_hi), (b_mid, b_hi), 0, None),
            ((a_lo, a_mid), (b_mid, b_hi), 1, None),
            ((a_mid, a_hi), (b_lo, b_mid), 1, ~same),
        ):
            some = (a[1] > a[0]) & (b[1] > b[0])
            some = some if keep is None else some & keep
            ok = some & (used + cost <= allowed)
            tally["dropped"] = tally.get("dropped", 0) + int((some & ~ok).sum())
            children.append(np.stack((a[0][ok], a[1][ok], b[0][ok], b[1][ok]), axis=1))
            budgets.append(used[ok] + cost)
        stack.append((depth + 1, np.concatenate(children), np.concatenate(budgets)))


def _compare(values: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = nodes[:, 3] - nodes[:, 2]
    sizes = (nodes[:, 1] - nodes[:, 0]) * wide
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // 2_000_000 + 1) * 2_000_000)
    for part, size, width in zip(np.split(nodes, cuts), np.split(sizes, cuts), np.split(wide, cuts), strict=True):
        if not len(part):
            continue
        which = np.repeat(np.arange(len(part)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        i, j = part[which, 0] + k // width[which], part[which, 2] + k % width[which]
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        yield i[near], j[near]


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the classes of i and j pairwise; a class is labelled by its smallest member. Returns those of the pairs that
    joined two classes: a forest, enough to join the same classes again."""
    kept_i, kept_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        labels[high] = np.minimum(a, b)[first]
        kept_i.append(i[first])
        kept_j.append(j[first])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
    return np.concatenate(kept_i), np.concatenate(kept_j)


def _link_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    group, side, exact = (np.asarray(table.column(n)).astype(np.int64) for n in ("group", "side", "exact"))
    rot = np.asarray(table.column("rot")).astype(np.int64).view(np.uint64)
    order = np.lexsort((rot, side, group))
    group, side, rot, exact = group[order], side[order], rot[order], exact[order]
    labels = np.arange(len(rot))
    again = np.flatnonzero((group[1:] == group[:-1]) & (side[1:] == side[:-1]) & (rot[1:] == rot[:-1])) + 1
    found = [union(labels, again - 1, again)]
    first = np.ones(len(rot), bool)
    first[again] = False
    kept = np.flatnonzero(first)
    group, side, rot, exact = group[kept], side[kept], rot[kept], exact[kept]
    new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
    ends = np.append(new[1:], len(rot))
    roots, other = {}, {}
    for lo, hi in zip(new.tolist(), ends.tolist(), strict=True):
        mine = roots.setdefault(int(exact[lo]), [])
        if side[lo] == 0:
            mine.append((lo, hi, lo, hi))
        elif side[lo] == 1:
            other[int(group[lo])] = (lo, hi)
        elif int(group[lo]) in other:
            mine.append((*other[int(group[lo])], lo, hi))
    for width, pairs in roots.items():
        if pairs:
            for i, j in trie_pairs(rot, np.array(pairs), budget, width):
                found.append(union(labels, kept[i], kept[j]))
    node = table.column("node").combine_chunks()
    a, b = (node.take(pa.array(order[np.concatenate(side)])) for side in zip(*found, strict=True))
    yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def links(nodes: DataFrame, count: int = 1, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between ``nodes`` (node, fps) whose k-th fingerprints differ in at most ``budget`` bits, for any k.

    Enough links to join every class, not every pair; each is within the budget itself. Fingerprints within the budget
    agree on one of budget + 1 blocks of bits at least, so a fingerprint goes, once a block, into a trie of fingerprints
    rotated so that the block comes first, and no bit of that block may differ there. A trie is dealt out by the
    subtrees under a prefix of the block, as long as makes them about ``SUBTREE`` fingerprints (a small table has one
    trie a block). A subtree of many times that is cut into tiles, and every pair of tiles (a tile with itself too)
    is a join of its own: nothing is left out, and no task holds much more than the others.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    blocks = budget + 1
    widths = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    starts = [sum(widths[:k]) for k in range(blocks)]
    prefix = min(min(widths), max(0, (n - 1) // SUBTREE).bit_length())
    fp = F.col("fp")
    rotated = F.array(*[
        F.struct(F.lit(k).alias("block"), F.lit(w).alias("exact"), (fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s))).alias("rot"))
        for k, (s, w) in enumerate(zip(starts, widths, strict=True))
    ])
    rows = nodes.select("node", F.posexplode("fps").alias("k", "fp")).select("node", "k", F.explode(rotated).alias("r")).select("node", "k", "r.block", "r.exact", "r.rot")
    rows = rows.withColumn("key", F.shiftrightunsigned("rot", BITS - prefix) if prefix else F.lit(0).cast("long"))
    most = 4 * max(SUBTREE, n >> prefix)
    hot = stored(rows.groupBy("k", "block", "key").count().where(F.col("count") > most).select("k", "block", "key", F.ceil(F.col("count") / most).cast("int").alias("tiles")), "hot")
    tile, tiles = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.coalesce("tiles", F.lit(1))
    if hot.isEmpty():
        dealt = rows.select("node", "rot", "exact", F.xxhash64("k", "block", "key").alias("group"), F.lit(0).alias("side"))
    else:  # fewer than rows / most of them, so always few
        wide = rows.join(F.broadcast(hot), ["k", "block", "key"], "left").withColumn("tile", F.coalesce(tile, F.lit(0)))
        wide = wide.withColumn("u", F.explode(F.sequence(F.lit(0), tiles - 1)))
        low, high = F.least("tile", "u"), F.greatest("tile", "u")
        side = F.when(low == high, 0).when(F.col("tile") == low, 1).otherwise(2)
        dealt = wide.select("node", "rot", "exact", F.xxhash64("k", "block", "key", low, high).alias("group"), side.alias("side"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * blocks * count // TASK_ROWS + 1)
    kind = nodes.schema["node"].dataType.simpleString()
    return dealt.repartition(tasks, "group").mapInArrow(partial(_link_batches, budget=budget), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the class's smallest node.

    Alternating star contraction: every node hooks its larger neighbours to the smallest neighbour, then its smaller
    ones. Each round is written to the shared folder, and the one before it deleted; the rounds grow as the logarithm of
    the longest chain. Minima are pre-aggregated, and the centre of a large class, which many edges share, is joined
    apart, so a class of any size meets neither in one row nor in one task.
    """
    spark = edges.sparkSession

    def both(x: Column, y: Column, u: Column, v: Column) -> Column:
        return F.explode(F.array(F.struct(x.alias("a"), y.alias("b")), F.struct(u.alias("a"), v.alias("b")))).alias("e")

    a, b, m = F.col("a"), F.col("b"), F.col("m")
    path = new_folder(spark, "edges")
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", path)
    state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    while state[0]:
        total, before = 2 * state[0], state
        ways = edges.select(both(a, b, b, a)).select("e.*")
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("_n"))
        hooked = new_folder(spark, "hooked")
        large = stored(spread_join(ways, least, "a", total).where("b > a").select(b.alias("a"), m.alias("b")).where("a <> b").distinct(), "hooked", hooked)
        small = spread_join(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")), "a", total)
        made = new_folder(spark, "edges")
        edges = stored(small.select(both(b, m, a, m)).select("e.*").where("a <> b").distinct(), "edges", made)
        remove_folder(spark, path)
        remove_folder(spark, hooked)
        state, path = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first(), made
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _identity() -> list:
    """Columns (id, count) of a group of rows with one ``node``: ids sort by the smallest doc_id, those without one last."""
    least = F.min("doc_id")
    return [F.struct(least.isNull().alias("none"), F.coalesce(least, F.lit(0)).alias("rep"), F.first("node").alias("node")).alias("id"), F.count("*").alias("_n")]


def _doc_of(identity: Column) -> Column:
    return F.when(~identity["none"], identity["rep"])


def near_duplicates(documents: DataFrame, words: int = 4, distinct: bool = False, count: int = 1, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fps, component_id), one row a row of ``documents``.

    Two texts are linked if any of their ``count`` fingerprints differ in at most ``budget`` bits; component_id is the
    smallest doc_id that can be reached (nulls don't count; null if no id can be). Empty and null texts have the
    fingerprint zero and are linked like any other. Equal fingerprints meet as one node, so copies cost nothing. Classes
    are made of ids that sort by doc_id, so that a class's root tells its component_id.
    """
    rows = stored(fingerprints(documents, words, distinct, count), "fingerprints")
    rows = rows.withColumn("node", F.element_at("fps", 1) if count == 1 else F.xxhash64("fps"))
    nodes = stored(rows.groupBy(F.col("node").alias("own")).agg(*_identity(), F.first("fps").alias("fps")), "nodes")
    roots = components(links(nodes.select(F.col("id").alias("node"), "fps"), count, budget)).select(F.col("node.node").alias("own"), "root")
    named = nodes.select("own", "id", "_n").join(roots, "own", "left").select(F.col("own").alias("node"), _doc_of(F.coalesce("root", "id")).alias("component_id"), "_n")
    return spread_join(rows, named, "node", rows.count()).select("doc_id", "fps", "component_id")


def document_classes(documents: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``documents`` by 4-word shingles and Hamming distance 4."""
    out = near_duplicates(documents)
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.element_at("fps", 1))), 16, "0").alias("fingerprint"), "component_id")


# Classes by exact similarity of sets of five-word shingles.
#
# Fingerprints of these sets are joined by the trie first, which finds texts that differ little. It can't find them all:
# two sets of similarity 0.8 differ in 10 of 64 bits on the mean, and a budget that holds a thousand of them but one
# leaves blocks of three bits. Bands of minima find the rest, and no pair is taken for near before its sets were compared.

WORDS = 5
SIMILARITY = (4, 5)
#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**7)**32 = 0.0005, at 0.85 with 1e-6.
BANDS, ROWS = 32, 7
#: Minima that two sketches must have alike for their sets to be compared, of 224: fewer at 0.8 with probability 0.0001.
ALIKE = 157
#: Sets of no more shingles than this go along whole with their sketches, by 32 bits of each hash, and are counted at once.
SMALL = 256
TILE = 512
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The sorted set of a text's hashed shingles of five words."""
    return np.unique(shingle_hashes(text, WORDS, True))


def set_key(hashes: np.ndarray) -> int:
    """One number for a whole set, so that equal sets are one node."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - 2**63


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One key a band, and the sketch: a key is a hash of the band's number and of the set's minima under ``ROWS``
    independent hashes, the sketch a byte of each minimum. Of an empty set there is neither."""
    if not len(hashes):
        return np.empty(0, np.int64), b""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_MIX[0][:, None] * hashes[None, at : at + 512] + _MIX[1][:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = remix(keys ^ column, 1)
    return keys.view(np.int64), (remix(least, 2) & np.uint64(255)).astype(np.uint8).tobytes()


def is_similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets share at least 0.8 of what they hold together."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    part, whole = SIMILARITY
    return whole * shared >= part * (len(x) + len(y) - shared)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py() or "") for text in batch.column(2)]
        keys, sketches = zip(*[band_keys(x) for x in sets], strict=True) if sets else ((), ())
        ends = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
        flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]))
        prints = pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), prints, pa.ListArray.from_arrays(ends, flat), pa.array(sketches, pa.binary())],
            ["address", "doc_id", "node", "n", "fp", "keys", "sketch"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py() or "") for text in batch.column(0)]
        small = [(x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() if len(x) <= SMALL else None for x in sets]
        whole = [x.astype("<u8").tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array(whole, pa.binary()), pa.array(small, pa.binary())], ["node", "hashes", "small"])


def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(c) for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array([is_similar(np.frombuffer(i.as_py(), "<u8"), np.frombuffer(j.as_py(), "<u8")) for i, j in zip(x, y, strict=True)], pa.bool_()))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (node, hashes) are similar."""
    wide = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return wide.mapInArrow(_similar_batches, "a long, b long")


def _sizes_allow(a: str, b: str):
    part, whole = SIMILARITY
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _alike(table: pa.Table) -> pa.Table:
    """The pairs of a tile, or of two, that may be similar by their sizes and sketches, and have not one root yet."""
    side, node, n, root = (np.asarray(table.column(c)) for c in ("side", "node", "n", "root"))
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    part, whole = SIMILARITY
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = [None if s is None else frozenset(np.frombuffer(s, "<u4").tolist()) for s in table.column("small").to_pylist()]
    alone = not side.any()
    others = np.arange(len(node)) if alone else np.flatnonzero(side == 2)
    for i in range(len(node)) if alone else np.flatnonzero(side == 1):
        j = others[others > i] if alone else others
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * whole >= np.maximum(n[j], n[i]) * part)]
        j = j[(sketches[j] == sketches[i]).sum(axis=1) >= ALIKE]
        if small[i] is not None:  # shorter hashes may only add to what two sets share
            j = j[[small[k] is None or (part + whole) * len(small[i] & small[k]) >= part * int(n[i] + n[k]) for k in j]]
        found_a.append(np.minimum(node[i], node[j]))
        found_b.append(np.maximum(node[i], node[j]))
    return pa.table([np.concatenate(found_a), np.concatenate(found_b)], names=["a", "b"])


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` by the tiles that they meet in: (key, kind, low, high, side, node, n, root, sketch, small).

    Of a key's members, those of its largest root need not meet each other. They are cut into tiles once, and only those
    of the other roots meet all tiles: an odd member of a million near copies costs a copy of itself a tile, and the near
    copies one row each. The others meet among themselves, every two tiles of them in a task apart.
    """
    tile = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.ceil(n / TILE), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / TILE), F.lit(1)).cast("int") - 1))
    n_big, n_other = F.col("big.c"), F.col("_n") - F.col("big.c")
    own = ["node", "n", "root", "sketch", "small"]
    big, other = members.where("root = big.root"), members.where("root <> big.root")
    from_big = big.select("key", F.lit(1).alias("kind"), every(n_other).alias("low"), tile(n_big).alias("high"), F.lit(2).alias("side"), *own)
    to_big = other.select("key", F.lit(1).alias("kind"), tile(n_other).alias("low"), every(n_big).alias("high"), F.lit(1).alias("side"), *own)
    wide = other.withColumn("tile", tile(n_other)).withColumn("u", every(n_other))
    low, high = F.least("tile", "u"), F.greatest("tile", "u")
    side = F.when(low == high, 0).when(F.col("tile") == low, 1).otherwise(2)
    among = wide.select("key", F.lit(0).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"), *own)
    return from_big.unionByName(to_big).unionByName(among)


def _largest_roots(members: DataFrame) -> DataFrame:
    """(key, big, rows, roots): of each key its largest root (c, root), its members and the number of its roots."""
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    return by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("big"), F.sum("c").alias("rows"), F.count("*").alias("roots"))


def _across(members: DataFrame) -> DataFrame:
    """(a, b): pairs of ``members`` (key, node, n, root, sketch, small) that share a key but not a root, and whose sketches,
    and small sets, are alike, each once: only the pairs that may be similar leave a task. Members may bring their key's
    rows ``_n`` and largest root ``big`` along."""
    if "big" not in members.columns:
        members = members.join(_largest_roots(members).select("key", "big", F.col("rows").alias("_n")), "key")
    return _dealt(members).groupBy("key", "kind", "low", "high").applyInArrow(_alike, "a long, b long").distinct()


def _address() -> Column:
    """What a row is found by again: a digest of its doc_id and text, nulls told apart from values."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.unhex(F.sha2(said.cast("binary"), 256))


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (address, doc_id, node) of ``documents``, and classes (node, root, _n): equal sets are one node, _n its rows.

    Nodes whose fingerprints the trie links, and nodes that share a band, are candidates. Each node of a band is compared
    with one node of its tile of the band first, and the classes that come of it and of the trie are made; then all pairs
    of a band that are still in different classes are compared, by their sketches and, if these are alike, exactly. So no
    candidate pair is left out, and a large class of near copies does not cost its square.
    """
    texts = documents.select(_address().alias("address"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.mapInArrow(_sketch_batches, "address binary, doc_id long, node long, n int, fp long, keys array<long>, sketch binary"), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")]
    nodes = stored(rows.groupBy(F.col("node").alias("own")).agg(*_identity(), F.min("address").alias("address"), *firsts).withColumnRenamed("own", "node"), "nodes")
    tried = stored(links(nodes.where("n > 0").select("node", F.array("fp").alias("fps"))), "tried")

    bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(bands.groupBy("key").agg(F.count("*").alias("among")).where("among > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("among"), F.lit(0))).first()[0]
    members = stored(spread_join(bands, shared.withColumn("_n", F.col("among")), "key", total), "members")

    wanted = members.select("node").union(tried.select("a")).union(tried.select("b")).distinct()
    wanted = nodes.select("node", "address").join(wanted, "node", "left_semi")
    read = texts.join(wanted.select("address"), "address", "left_semi")
    if not rows.groupBy("address").count().where("count > 1").isEmpty():  # rows told twice are read once
        read = read.dropDuplicates(["address"])
    sets = stored(read.select("text").mapInArrow(_set_batches, "node long, hashes binary, small binary"), "sets")
    small, sets = sets.select("node", "small"), sets.select("node", "hashes")

    tile = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("among") / TILE))
    first = F.min(F.struct("node", "n")).over(Window.partitionBy("key", "tile"))
    star = members.withColumn("tile", tile).withColumn("c", first).where("node <> c.node").where(_sizes_allow("n", "c.n"))
    star = stored(star.select(F.col("c.node").alias("a"), F.col("node").alias("b")).union(tried.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "star")
    near = stored(_similar(star, sets), "near")

    placed = members.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.select("key", "node", "n", "root"), "placed")
    mixed = _largest_roots(placed).where("roots > 1").select("key", "big", "rows", F.col("rows").alias("_n"))
    apart = _across(spread_join(placed, mixed, "key", total).withColumnRenamed("rows", "_n").join(nodes.select("node", "sketch"), "node").join(small, "node")).join(star, ["a", "b"], "left_anti")
    edges = stored(near.union(_similar(stored(apart, "apart"), sets)), "edges")

    ids = nodes.select("node", "id")
    named = edges.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(named).select(F.col("node.node").alias("node"), "root")
    return rows.select("address", "doc_id", "node"), nodes.select("node", "id", "_n").join(roots, "node", "left").select("node", F.coalesce("root", "id").alias("root"), "_n")


def similar_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row a row of ``documents``: classes of texts linked by a similarity of 0.8 or more.

    Similarity is that of the sets of five-word shingles (a text of fewer words is one shingle): the shared ones by all
    of both. component_id is the smallest doc_id of the class (null if none has one), and texts without a word are one
    class.
    """
    rows, classes = _classes(documents)
    named = classes.select("node", _doc_of(F.col("root")).alias("component_id"), "_n")
    return spread_join(rows, named, "node", rows.count()).select("doc_id", "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class of similar texts left: that of the smallest doc_id, nulls after all others.

    Rows are told apart by doc_id and text together: unlike texts under one doc_id are judged each by itself, and rows
    without a doc_id like any other. Of rows with the same doc_id and text, the one least by its other columns stays
    (of those that can be ordered). Texts without a word, null ones too, are one class.
    """
    rows, classes = _classes(documents)
    rows = spread_join(rows, classes.select("node", "root", "_n"), "node", rows.count())
    rows = stored(rows.groupBy("root", "address").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")), "addresses")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "address", "copies")).alias("best")).select("best.address", "best.copies")
    best = stored(best, "best")
    gone = rows.select("address").join(best, "address", "left_anti")
    name = free_name(documents.columns, "row_address")
    left = documents.withColumn(name, _address()).join(gone.withColumnRenamed("address", name), name, "left_anti")
    own = quoted(documents.columns)
    if best.where("copies > 1").isEmpty():
        return left.select(*own)
    repeated = best.where("copies > 1").select(F.col("address").alias(name))
    whole = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(own)])
    order = F.struct(*[c for c, f in zip(own, documents.schema, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    one = left.join(repeated, name, "left_semi").groupBy(name).agg(F.min_by(whole, order).alias("row"))
    one = one.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(documents.columns)])
    return left.join(repeated, name, "left_anti").select(*own).union(one)
