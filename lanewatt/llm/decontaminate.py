"""Benchmark decontamination: SimHash windows of an item's size, looked up in a multi-index of Hamming blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, spread_join, stored, text_or_empty

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
#: Bits of the sieve a shingle of the benchmark, the most bits of a sieve, and the bits that a shingle sets.
SIEVE_SHARE = 512
SIEVE_BITS = 1 << 29
PROBES = 3
#: Items of one size that a task holds, and regions of text that it searches for them, about.
ITEMS_A_TASK = 2000
REGIONS_A_TASK = 20_000
MATCHES = "doc_id long, item_id long, start_word long, n_words long, start long, end long, hamming int, similarity double"
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], k: int = WORDS) -> list[str]:
    """Word shingles; fewer words than ``k`` make one, no word none."""
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Weighted similarity of two bags of shingles: shared weight by joint weight, a shingle's weight its count."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    joint = sum(a.values()) + sum(b.values()) - shared
    return shared / joint if joint else 0.0


def _bits(shingles: list[str]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _window_fingerprints(shingles: list[str], per_window: int) -> np.ndarray:
    """SimHash of every run of ``per_window`` shingles, by running sums of bits."""
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(shingles), axis=0, dtype=np.int32)))
    ones = total[per_window:] - total[:-per_window]
    return np.packbits(ones * 2 > per_window, axis=1, bitorder="little").view("<u8").reshape(-1)


class HammingIndex:
    """All stored fingerprints within ``radius`` of a query, by blocks.

    Fingerprints within the radius differ in at most radius // blocks bits in one of the blocks at least; each block's
    table lists, for every value of the block, the fingerprints that near. So a look-up in every table misses none.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.width = prints, radius, 64 // blocks
        near = [0] + [sum(1 << b for b in c) for d in range(1, radius // blocks + 1) for c in combinations(range(self.width), d)]
        self.tables = []
        for k in range(blocks):
            own = (prints >> np.uint64(k * self.width)) & np.uint64((1 << self.width) - 1)
            values = (own[:, None] ^ np.array(near, np.uint64)[None, :]).astype(np.int64)
            order = np.argsort(values, axis=None, kind="stable")
            starts = np.searchsorted(values.reshape(-1)[order], np.arange((1 << self.width) + 1))
            self.tables.append((starts, (order // len(near)).astype(np.int32)))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, fingerprint index, distance) of all pairs within the radius."""
        found = []
        for k, (starts, items) in enumerate(self.tables):
            value = ((queries >> np.uint64(k * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            size = starts[value + 1] - starts[value]
            which = np.repeat(np.arange(len(queries)), size)
            at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[value], size)
            found.append(which.astype(np.int64) * len(self.prints) + items[at])
        both = np.unique(np.concatenate(found)) if len(self.prints) else np.empty(0, np.int64)
        q, i = both // max(1, len(self.prints)), both % max(1, len(self.prints))
        far = np.bitwise_count(queries[q] ^ self.prints[i])
        ok = far <= self.radius
        return q[ok], i[ok], far[ok]


class WordHashes:
    """Hashes of words from running sums over all their bytes: a byte weighs a power of an odd number, whose inverse takes
    the word's place in the text out again. Equal words have equal hashes; others may too, which costs a comparison."""

    STEP = 20_000

    def __init__(self):
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        parts = [self._of(words[k : k + self.STEP]) for k in range(0, len(words), self.STEP)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def _of(self, words: list[str]) -> np.ndarray:
        raw = np.frombuffer("\0".join(words).encode(), np.uint8)
        if len(raw) > len(self.powers):
            size = 1 << len(raw).bit_length()
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _PRIME)], dtype=np.uint64)
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(_PRIME), -1, 2**64)))], dtype=np.uint64)
        gaps = np.flatnonzero(raw == 0)
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(raw)]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverses[starts]


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, by the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out ^= out >> np.uint64(29)
        out *= _PRIME
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= _PRIME
    return out


class Sieve:
    """A Bloom filter of the benchmark's shingle hashes: of bounded size, and it passes every hash that was put in."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.bits, self.table = bits, np.zeros(bits // 64, np.uint64)
        self.table[words] = values.view(np.uint64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that pass."""
        at = np.arange(len(hashes))
        for k in range(PROBES):
            slot = probe(hashes[at], k, self.bits)
            at = at[(self.table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return at


def probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit of a hash in a sieve of a power of two of bits."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    return (mixed >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            if words:
                n = min(WORDS, len(words))
                shingles = shingles_of(words)
                fp = int(_window_fingerprints(shingles, len(shingles))[0])
                rows.append((item, text, len(words), n, fp - 2**64 if fp >= 2**63 else fp, np.unique(shingle_hashes(known.of(words), n)).view(np.int64)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item_id", "text", "size", "n", "fp", "hashes"])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, size, n, fp, hashes): each distinct item's words, shingle length, fingerprint and shingle hashes."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return stored(items.mapInArrow(_item_batches, "item_id long, text string, size int, n int, fp long, hashes array<long>"), "items")


def _probe_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        slots = np.unique(np.concatenate([probe(hashes, k, bits) for k in range(PROBES)]))
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.uint64(1) << (slots & 63).astype(np.uint64)).view(pa.int64())], ["word", "value"])


def build_sieve(items: DataFrame) -> Sieve:
    """The sieve of all items' shingles: ``SIEVE_SHARE`` bits each as far as ``SIEVE_BITS`` allow.

    A large benchmark only makes the sieve pass more texts that the joins after it drop again. The driver gets words of
    64 bits, at most ``SIEVE_BITS`` / 64 of them, whatever the benchmark.
    """
    count = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    bits = min(SIEVE_BITS, max(1 << 12, 1 << (SIEVE_SHARE * count).bit_length()))
    hashes = items.select(F.explode("hashes").alias("h"))
    words = hashes.mapInArrow(partial(_probe_batches, bits=bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    return Sieve(bits, np.asarray(words.column("word")).astype(np.int64), np.asarray(words.column("value")).astype(np.int64))


def _suspect_batches(batches: Iterator[pa.RecordBatch], sieve, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        keep, anchors = [], []
        for i, text in enumerate(batch.column(2)):
            own = known.of(words_of(text.as_py() or ""))
            mine = []
            for n in lengths:
                hashes = shingle_hashes(own, n)
                at = sieve.value.passes(hashes)
                mine += [{"n": n, "at": p, "hash": h} for p, h in zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True)]
            if mine:
                keep.append(i)
                anchors.append(mine)
        kind = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(anchors, kind)], ["doc_id", "address", "text", "anchors"])


def _region_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of words of a text whose windows of an item's size hold one of that item's shingles."""
    names = ["address", "size", "first_word", "words", "starts", "ends"]
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for batch in batches:
        rows = []
        for address, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            words, spans = words_of(text), _spans(text)
            for want in wanted:
                size, n, last = want["size"], want["n"], max(0, len(words) - want["size"])
                runs: list[list[int]] = []
                for p in sorted(want["places"]):
                    lo, hi = min(max(0, p - size + n), last), min(p, last)
                    if runs and lo <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                for lo, hi in runs:
                    own = spans[lo : hi + size]
                    rows.append((address, size, lo, words[lo : hi + size], [s for s, _ in own], [e for _, e in own]))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def search_region(words: list[str], size: int, index: HammingIndex, bags: list[Counter], threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(item, window's first word, differing bits, similarity) of each item's best window in a run of words."""
    n = min(WORDS, size)
    shingles = shingles_of(words, n)
    per = min(size, len(words)) - n + 1
    best: dict[int, tuple] = {}
    q, i, far = index.search(_window_fingerprints(shingles, per))
    for w, k, h in zip(q.tolist(), i.tolist(), far.tolist(), strict=True):
        sim = similarity(Counter(shingles[w : w + per]), bags[k])
        if sim >= threshold and (k not in best or (sim, -w) > best[k][:2]):
            best[k] = (sim, -w, h)
    for k, (sim, w, h) in best.items():
        yield k, -w, h, sim


FOUND = "address binary, item_id long, start_word long, n_words long, start long, end long, hamming int, similarity double"


def contaminated_texts(documents: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Suspects (doc_id, address) of ``documents``, and matches by the text's address (``FOUND``), best windows only.

    1. One pass over the documents keeps the texts that hold a shingle which the sieve passes. A window of any
       similarity to an item shares a shingle with it, so no match is lost.
    2. The shingles' hashes are joined with those of the items, which tells each text what sizes to make windows of and
       where; chance passes of the sieve go.
    3. Windows of an item's size around these places are fingerprinted and looked up in the multi-index of the
       fingerprints of all items of that size; what lies within ``radius`` is compared exactly.

    The benchmark is joined, never sent to all tasks nor gathered on the driver: items of a size are dealt out in blocks
    of about ``ITEMS_A_TASK``, and the regions of text of a size in blocks of about ``REGIONS_A_TASK``.
    """
    spark = documents.sparkSession
    items = benchmark_items(benchmark)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 1 to 5
    sieve = spark.sparkContext.broadcast(build_sieve(items))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty().cast("string").cast("binary"), 256)).alias("address"), F.col("text").cast("string").alias("text"))
    anchors = "anchors array<struct<n:int,at:int,hash:long>>"
    suspects = stored(texts.mapInArrow(partial(_suspect_batches, sieve=sieve, lengths=lengths), f"doc_id long, address binary, text string, {anchors}"), "suspects")

    once = stored(suspects.groupBy("address").agg(F.first("anchors").alias("anchors")).select("address", F.explode("anchors").alias("a")).select("address", "a.n", "a.at", "a.hash"), "anchors")
    known = items.select("n", "size", F.explode("hashes").alias("hash")).groupBy("n", "hash").agg(F.collect_set("size").alias("sizes"))
    known = known.join(once.groupBy("n", "hash").agg(F.count("*").alias("_n")), ["n", "hash"]).select(F.struct("n", "hash").alias("key"), "sizes", "_n")
    placed = spread_join(once.select("address", "at", F.struct("n", "hash").alias("key")), known, "key", once.count())
    wanted = placed.select("address", "at", "key.n", F.explode("sizes").alias("size")).groupBy("address", "n", "size").agg(F.collect_set("at").alias("places"))
    wanted = wanted.groupBy("address").agg(F.collect_list(F.struct("size", "n", "places")).alias("wanted"))
    whole = suspects.select("address", "text").join(wanted.select("address"), "address", "left_semi").groupBy("address").agg(F.first("text").alias("text"))
    regions = whole.join(wanted, "address").mapInArrow(_region_batches, "address binary, size int, first_word int, words array<string>, starts array<int>, ends array<int>")
    regions = stored(regions, "regions")

    blocks = items.groupBy("size").agg(F.ceil(F.count("*") / ITEMS_A_TASK).cast("int").alias("item_blocks"))
    deals = regions.groupBy("size").agg(F.ceil(F.count("*") / REGIONS_A_TASK).cast("int").alias("region_blocks"))
    grid = stored(blocks.join(deals, "size"), "grid")
    dealt_items = items.join(grid, "size").select(
        "size", F.pmod(F.xxhash64("item_id", "text"), F.col("item_blocks").cast("long")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("region_blocks").cast("long") - 1)).alias("r"), "item_id", "text", "fp"
    )
    dealt_regions = regions.join(grid, "size").select(
        "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("item_blocks").cast("long") - 1)).alias("i"), F.pmod(F.xxhash64("address", "first_word"), F.col("region_blocks").cast("long")).alias("r"), "address", "first_word", "words", "starts", "ends"
    )

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        rows = []
        if ours.num_rows and theirs.num_rows:
            size = theirs.column("size")[0].as_py()
            ids = theirs.column("item_id").to_pylist()
            bags = [Counter(shingles_of(words_of(t))) for t in theirs.column("text").to_pylist()]
            index = HammingIndex(np.asarray(theirs.column("fp")).astype(np.int64).view(np.uint64), radius)
            for address, first, words, starts, ends in zip(*(ours.column(c) for c in ("address", "first_word", "words", "starts", "ends")), strict=True):
                words, first = words.as_py(), first.as_py()
                n_words = min(size, len(words))
                for k, w, far, sim in search_region(words, size, index, bags, threshold):
                    rows.append((address.as_py(), ids[k], first + w, n_words, starts[w].as_py(), ends[w + n_words - 1].as_py(), far, sim))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.binary(), *[pa.int64()] * 5, pa.int32(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    key = ["size", "i", "r"]
    found = stored(dealt_regions.groupBy(*key).cogroup(dealt_items.groupBy(*key)).applyInArrow(search, FOUND), "found")
    first = F.struct("similarity", -F.col("start_word"))
    best = found.groupBy("address", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "start", "end", "hamming", "similarity"), first).alias("m"))
    return suspects.select("doc_id", "address"), stored(best.select("address", "item_id", "m.*"), "matches")


def _spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of the words in the text itself; lower-casing may change lengths, so words are found anew."""
    lower = text.lower()
    if len(lower) == len(text):
        return [m.span() for m in _WORD.finditer(lower)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(lower)]


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``MATCHES``: for each document and benchmark item, the best window of similarity ``threshold`` or more, if any; the
    first of equals.

    Words are runs of letters and digits in lower case; shingles have five words. Windows have the item's size and slide
    by one word; of a text shorter than the item, the whole is the window. Null and empty texts match nothing; items of
    fewer than five words match as a whole; items told twice count once; equal texts are searched once, and every row
    with such a text, repeated rows and rows without a doc_id too, has the results.
    """
    rows, matches = contaminated_texts(documents, benchmark, threshold, radius)
    counts = rows.groupBy("address").agg(F.count("*").alias("_n"))
    told = matches.groupBy("address").agg(F.collect_list(F.struct("item_id", "start_word", "n_words", "start", "end", "hamming", "similarity")).alias("m")).join(counts, "address")
    return spread_join(rows, told, "address", rows.count()).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark passage, whatever their doc_id; each row is judged by
    its own text."""
    _, matches = contaminated_texts(documents, benchmark)
    name = free_name(documents.columns, "text_address")
    kept = documents.withColumn(name, F.unhex(F.sha2(text_or_empty().cast("string").cast("binary"), 256)))
    return kept.join(matches.select(F.col("address").alias(name)).distinct(), name, "left_anti").select(*quoted(documents.columns))
