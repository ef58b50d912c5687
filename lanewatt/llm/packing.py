"""Packing tokenized documents into sequences by best fit and a swap-based local search."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
GROUP = 2000
#: How empty a group's bin must be, as a share, for its pieces to be dealt and packed again.
SLACK = 0.06
WORD_CACHE = 400_000
#: A space beside other white space, which may be one pre-token with it.
_BESIDE_BLANK = re.compile(r" [^\S ]|[^\S ] ")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = [f.split()[0] for f in PIECES.split(", ")]


def public_vocabulary() -> str:
    """The folder of the public tokenizers' files; a parameter of the query's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteTokenizer:
    """Ids of the 50k byte-level BPE as little-endian unsigned 32-bit bytes.

    A space between two characters that are no white space always begins a new pre-token of this vocabulary's pattern, so
    a text without other spaces can be cut there, and the ids of its words remembered.
    """

    def __init__(self, ranks_path: str, specials: dict[str, int]):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.words: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "  " in text or _BESIDE_BLANK.search(text):
            return self.raw(text)
        first, *rest = text.split(" ")
        words, out = self.words, [self.raw(first)]
        get, add, ordinary = words.get, out.append, self.encoding.encode_ordinary
        for w in rest:
            ids = get(w)
            if ids is None:
                ids = self.raw(" " + w) if "<|" in w else array("I", ordinary(" " + w)).tobytes()  # no mark of a special id
                if len(words) < WORD_CACHE and len(w) < 40:
                    words[w] = ids
            add(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def byte_tokenizer(ranks_path: str) -> ByteTokenizer:
    return ByteTokenizer(ranks_path, {"<|endoftext|>": 50256})


def _piece_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tokenizer, tail = byte_tokenizer(ranks_path), end.to_bytes(4, "little")
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = tokenizer.encode(text.as_py() or "") + tail
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                length = (n - at) % capacity or capacity
                rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                at, k = at + length, k + 1
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(documents: DataFrame, ranks_path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: whole texts' ids, then ``end``; of a longer document the first piece is the
    shorter one. Null texts count as empty and have the end id alone."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_piece_batches, ranks_path=ranks_path, end=end, capacity=capacity), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece, longest first, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (gap, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            gap, b = room.pop(at)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (gap - lengths[i], b))
    return bins


def _exchange(a: list[tuple[int, int]], b: list[tuple[int, int]], gap: int) -> tuple[list, list] | None:
    """What leaves a for b and b for a, so that b gains most, at most ``gap``: one or two pieces for none or one, or one
    for two. Equal lengths are alike, so only distinct ones are tried: never more than 63 in a bin of 2048."""
    ours, theirs = {}, {}
    for x in a:
        ours.setdefault(x[0], []).append(x)
    for x in b:
        theirs.setdefault(x[0], []).append(x)
    give, have = sorted(ours), sorted(theirs)
    best, most = None, 0
    for k, p in enumerate(give):
        for q in [0, *give[:k], *([p] if len(ours[p]) > 1 else [])]:
            size = p + q
            if most < size <= gap:
                best, most = ((p, q), (0, 0)), size
            at = bisect_left(have, size - gap)  # the smallest whose return leaves a gain of at most gap
            if at < len(have) and most < size - have[at] <= gap:
                best, most = ((p, q), (have[at], 0)), size - have[at]
        for m, h in enumerate(have):
            at = bisect_left(have, p - gap - h, m)
            if at == m and len(theirs[h]) < 2:
                at += 1
            if at < len(have) and most < p - h - have[at] <= gap:
                best, most = ((p, 0), (h, have[at])), p - h - have[at]
        if most == gap:
            break
    if best is None:
        return None
    (p, q), (h, i) = best
    go = [ours[p][-1]] + ([ours[q][-2 if p == q else -1]] if q else [])
    return go, ([theirs[h][-1]] if h else []) + ([theirs[i][-2 if h == i else -1]] if i else [])


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins one by one: what an ill-filled bin holds goes to fuller ones by moves and swaps.

    Each exchange carries tokens from a bin to one at least as full, so the sum of squared fills grows with every step
    and the search ends: at the least number of bins that the total allows, or when no exchange is left. The emptiest
    bin gives first; one that can't give waits until another exchange has changed the bins, and a pair of bins is tried
    again only if one of them has changed. The result never has more bins than before.
    """
    least = -(-sum(lengths) // capacity)
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    rest = [sorted((lengths[i], i) for i in b) for b in bins if sum(lengths[i] for i in b) < capacity]
    fills = [sum(x[0] for x in b) for b in rest]
    version = [0] * len(rest)
    tried: dict[tuple[int, int], tuple[int, int]] = {}
    stuck: set[int] = set()
    while len(full) + sum(map(bool, rest)) > least:
        live = [k for k in range(len(rest)) if rest[k] and k not in stuck]
        if not live:
            break
        source = min(live, key=lambda k: fills[k])
        moved = False
        for target in sorted((k for k in range(len(rest)) if rest[k] and k != source and fills[source] <= fills[k] < capacity), key=lambda k: fills[k]):
            now = version[source], version[target]
            if tried.get((source, target)) == now:
                continue
            found = _exchange(rest[source], rest[target], capacity - fills[target])
            if not found:
                tried[source, target] = now
                continue
            for pieces_, giver, taker in ((found[0], source, target), (found[1], target, source)):
                for x in pieces_:
                    rest[giver].remove(x)
                    insort(rest[taker], x)
            for k in (source, target):
                fills[k], version[k] = sum(x[0] for x in rest[k]), version[k] + 1
            moved = True
            if not rest[source]:
                break
        stuck = set() if moved else stuck | {source}
    return full + [[i for _, i in b] for b in rest if b]


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """One group's pieces with their bins (from 0) and places; a group holds about ``GROUP`` pieces."""
    table = table.sort_by([(n, "ascending") for n in ("doc_id", "piece", "ids_crc32", "row")])
    lengths = table.column("length").to_pylist()
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    place, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            place[i], offset[i] = b, at
            at += lengths[i]
        fill[members] = at
    out = table.select(["group", "row", *NAMES])
    for name, col in (("bin", place), ("offset", offset), ("fill", fill)):
        out = out.append_column(name, pa.array(col))
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, slack: float = SLACK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``rows`` of ``PIECES``: no sequence over ``capacity``, none with a hole.

    Full pieces are sequences of their own. The others are dealt by hash into groups of about ``group``; each group is
    packed by best fit and local search. A group's ill-filled bins (over ``slack`` of a sequence empty) are opened again
    and their pieces dealt into fewer groups, round after round, until one group is left, or a round ends with as many
    bins as it opened: so the waste is that of one group, not of all. ``group`` bounds what a task holds. Every piece
    has one place; equal rows are pieces of their own, and dealt apart.
    """

    def pack_group(table: pa.Table) -> pa.Table:
        return _pack_group(table, capacity)

    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    alone = F.struct(F.lit(-1).alias("level"), F.col("row").alias("group"), F.lit(0).cast("long").alias("bin"))
    done = [rows.where(whole).select(*NAMES, alone.alias("bin"), F.lit(0).cast("long").alias("offset"))]
    left, level, opened = rows.where(~whole).select("row", *NAMES), 0, None
    while n := left.count():
        groups = -(-n // group)
        key = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups))
        packed = stored(left.select(key.alias("group"), "row", *NAMES).groupBy("group").applyInArrow(pack_group, f"group long, row long, {PIECES}, bin long, offset long, fill long"), "packed")
        name = F.struct(F.lit(level).alias("level"), "group", "bin").alias("bin")
        again = F.col("fill") < int(capacity * (1 - slack))
        bins = packed.groupBy("group", "bin").agg(F.min("fill").alias("fill")).agg(F.count("*").alias("bins"), F.count_if(again).alias("again")).first()
        if groups == 1 or (opened is not None and bins["bins"] >= opened):
            done.append(packed.select(*NAMES, name, "offset"))
            break
        done.append(packed.where(~again).select(*NAMES, name, "offset"))
        left, level, opened = packed.where(again).select("row", *NAMES), level + 1, bins["again"]
    out = reduce(DataFrame.unionByName, done)
    # level and group in the upper bits, the bin in the lower: unique, as a group has far fewer than 2**14 bins
    tag = F.when(F.col("bin.level") < 0, -1 - F.col("bin.group")).otherwise((F.col("bin.level") * (1 << 40) + F.col("bin.group")) * (1 << 14) + F.col("bin.bin"))
    return out.select(*NAMES, tag.cast("long").alias("sequence_id"), "offset")


def packed_documents(documents: DataFrame, ranks_path: Callable[[], str] = public_vocabulary) -> DataFrame:
    """All ``documents`` packed: null and empty texts are one end token, repeated rows and rows without a doc_id have
    pieces of their own, columns beside doc_id and text are left out, and an empty table gives no rows."""
    return pack(pieces(documents, ranks_path()))
