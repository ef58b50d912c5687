"""Cross-tokenizer alignment: byte-range fragments of two token streams, composed by an associative operation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored
from .packing import ByteTokenizer

#: Documents of more bytes go through ranges of about so many bytes, and these through a tree of so many children a node.
RANGE = 1 << 16
FAN = 16
#: Pair counts are sent to all tasks (16 bytes each) if there are no more than this; beyond it the links are joined with them.
PAIRS_SENT = 4_000_000
#: Tokens of either stream that are aligned at once, about, and pairs that a task holds before it hands them on.
BLOCK_TOKENS = 1 << 18
HELD_PAIRS = 1 << 20
WORD_CACHE = 200_000
# a space beside white space or a text's end is no sure token boundary of both vocabularies; any other space is one
_UNSURE = re.compile(r"(?:\A|\s) | (?:\s|\Z)")
_SURE = re.compile(r"(?<=\S) (?=\S)")
ROWS = "uid long, doc_id long, at long, kind int, start long, a binary, b binary"
RANGES = "uid long, doc_id long, at long, ok boolean, a_start long, b_start long, a binary, b binary"
FRAGMENT = (
    "uid long, doc_id long, at long, ok boolean, cut boolean, head_at long, head_a binary, head_b binary, tail_start long, "
    "tail_a binary, tail_b binary, seams array<struct<at: long, start: long, a: binary, b: binary>>"
)
FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
IDS = np.dtype("<u2")


@lru_cache(maxsize=1)
def public_vocabularies() -> tuple[str, str]:
    """The two public vocabularies' files; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens, and the ids of words already seen.

    No piece of either vocabulary goes on over a single space between two other characters, so words are encoded one by
    one; texts with other white space around a space are encoded whole. Ids are two bytes each.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteTokenizer(a_path, {})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_a, n_b = self.a.encoding.n_vocab, self.b.get_piece_size()
        if max(n_a, n_b) > 1 << 16:
            raise ValueError("ids of over two bytes")
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece that goes on over a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(self.a.encoding.decode_single_token_bytes(i)) for i in range(n_a)], np.int64)
        self.b_len = np.array([len(p) for p in self.b_bytes], np.int64)
        self.n_b = n_b
        self.said = [f"{i}{end}".encode() for i in range(max(n_a, n_b)) for end in (",", "|", ";")]
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode(self, part: str) -> tuple[bytes, bytes] | None:
        b = self.b.encode(part, num_threads=1)
        if b"".join([self.b_bytes[i] for i in b]) != (" " + part).encode():
            return None
        return np.array(self.a.encoding.encode_ordinary(" " + part), IDS).tobytes(), np.array(b, IDS).tobytes()

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """The ids of ``" " + text`` and of ``text``; None if it is empty or the latter's bytes differ from the former."""
        if not text:
            return None
        if _UNSURE.search(text):
            return self._encode(text)
        out = []
        for word in text.split(" "):
            ids = self.words.get(word, self)
            if ids is self:
                ids = self._encode(word)
                if len(self.words) < WORD_CACHE and len(word) < 40:
                    self.words[word] = ids
            if ids is None:
                return None
            out.append(ids)
        return b"".join([a for a, _ in out]), b"".join([b for _, b in out])


@lru_cache(maxsize=2)
def tokenizer_pair(paths: tuple[str, str]) -> TokenizerPair:
    return TokenizerPair(*paths)


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, IDS)


# The monoid. A fragment stands for a byte range of a document: the tokens of either stream that end in it.


@dataclass
class Fragment:
    """An open head (tokens up to the first common end), groups closed within, and an open tail (tokens after the last).

    Without a common end (``cut`` is False) all tokens are the head. ``seams`` are the groups that were closed where two
    fragments met, each with the range in which it closed and its first byte; the groups closed within one range are kept
    apart (``closed_part``), so that what is composed stays small however long the document.
    """

    at: int
    ok: bool = True
    cut: bool = False
    head_at: int = 0
    head_a: bytes = b""
    head_b: bytes = b""
    tail_start: int = 0
    tail_a: bytes = b""
    tail_b: bytes = b""
    seams: list[tuple[int, int, bytes, bytes]] = field(default_factory=list)


def fragment(pair: TokenizerPair, at: int, a: bytes, b: bytes, a_start: int, b_start: int) -> tuple[Fragment, tuple[int, bytes, bytes]]:
    """The fragment of the tokens ``a`` and ``b`` of one range, which begin at two places of the document's bytes, and
    the closed part: its first byte and the tokens between the first and the last common end."""
    x, y = ids_of(a), ids_of(b)
    ends_a, ends_b = a_start + np.cumsum(pair.a_len[x]), b_start + np.cumsum(pair.b_len[y])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(at, head_at=at, head_a=a, head_b=b), (0, b"", b"")
    (a1, a2), (b1, b2) = (2 * (np.searchsorted(ends, common[[0, -1]]) + 1) for ends in (ends_a, ends_b))
    made = Fragment(at, True, True, at, a[:a1], b[:b1], int(common[-1]), a[a2:], b[b2:])
    return made, (int(common[0]), a[a1:a2], b[b1:b2])


def compose(f: Fragment, g: Fragment) -> Fragment:
    """``f`` followed by ``g``; associative. Where both have a common end, the tail of one and the head of the other close
    a group. Not ok if either is not."""
    ok = f.ok and g.ok
    if not f.cut:
        a, b = f.head_a + g.head_a, f.head_b + g.head_b
        return Fragment(f.at, ok, g.cut, g.head_at if g.cut else f.head_at, a, b, g.tail_start, g.tail_a, g.tail_b, g.seams)
    if not g.cut:
        return Fragment(f.at, ok, True, f.head_at, f.head_a, f.head_b, f.tail_start, f.tail_a + g.head_a, f.tail_b + g.head_b, f.seams)
    seam = (g.head_at, f.tail_start, f.tail_a + g.head_a, f.tail_b + g.head_b)
    return Fragment(f.at, ok, True, f.head_at, f.head_a, f.head_b, g.tail_start, g.tail_a, g.tail_b, [*f.seams, seam, *g.seams])


def _text_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Whole documents, each one run of aligned tokens."""
    pair, schema = tokenizer_pair(paths), _arrow(ROWS)
    for batch in batches:
        n, out = batch.num_rows, [pair.encode(t.as_py() or "") or (b"", b"") for t in batch.column(2)]
        zero = pa.array(np.zeros(n, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), zero, zero.cast(pa.int32()), zero, pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", ")) if kind in kinds])


def _piece_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, at, piece): long texts cut at sure boundaries, once ``size`` characters are full."""
    for batch in batches:
        for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lo = at = 0
            while lo is not None:
                cut = _SURE.search(text, lo + size)
                piece = text[lo : cut.start() if cut else len(text)]
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([at], pa.int64()), pa.array([piece], pa.string())], ["uid", "doc_id", "at", "piece"])
                at += len(piece.encode()) + 1
                lo = cut.end() if cut else None


def split_ranges(pair: TokenizerPair, a: bytes, b: bytes, at: int, size: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """The streams that begin at byte ``at``, cut where the document's bytes fill ranges of ``size``: (at, first byte of
    the first stream's tokens, the same of the second's, tokens, tokens). A token belongs to the range that it ends in."""
    x, y = ids_of(a), ids_of(b)
    ends_a, ends_b = at + np.cumsum(pair.a_len[x]), at + np.cumsum(pair.b_len[y])
    marks = np.arange(at // size + 1, -(-int(ends_a[-1]) // size) + 1) * size
    i = np.concatenate(([0], np.searchsorted(ends_a, marks, "right")))
    j = np.concatenate(([0], np.searchsorted(ends_b, marks, "right")))
    begin_a, begin_b = np.concatenate(([at], ends_a)), np.concatenate(([at], ends_b))
    return [
        (max(at, int(marks[k]) - size), int(begin_a[i[k]]), int(begin_b[j[k]]), a[2 * i[k] : 2 * i[k + 1]], b[2 * j[k] : 2 * j[k + 1]]) for k in range(len(marks))
    ]


def _range_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], size: int) -> Iterator[pa.RecordBatch]:
    pair, schema = tokenizer_pair(paths), _arrow(RANGES)
    for batch in batches:
        for uid, doc_id, at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = pair.encode(piece)
            rows = [(r[0], True, *r[1:]) for r in split_ranges(pair, *ids, at, size)] if ids else [(at, False, at, at, b"", b"")]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (uid, doc_id, *r), strict=True)) for r in rows], schema)


def _fragment_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], closed: bool) -> Iterator[pa.RecordBatch]:
    """The fragments of ranges, or their closed parts."""
    pair = tokenizer_pair(paths)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            made, (start, a, b) = fragment(pair, r["at"], r["a"], r["b"], r["a_start"], r["b_start"])
            if not closed:
                made.ok = r["ok"]
                out.append({"uid": r["uid"], "doc_id": r["doc_id"], **vars(made)})
            elif a:
                out.append({"uid": r["uid"], "doc_id": r["doc_id"], "at": r["at"], "kind": 1, "start": start, "a": a, "b": b})
        yield pa.RecordBatch.from_pylist(out, _arrow(ROWS) if closed else FRAGMENT_ARROW)


SEAM = ("at", "start", "a", "b")
FRAGMENT_ARROW = pa.schema([*_arrow(FRAGMENT.split(", seams")[0]), pa.field("seams", pa.list_(pa.struct([("at", pa.int64()), ("start", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])))])


def _compose_group(rows: pa.Table) -> pa.Table:
    rows = sorted(rows.to_pylist(), key=lambda r: r["at"])
    ids = {k: rows[0][k] for k in ("uid", "doc_id")}
    parts = [Fragment(**{k: v for k, v in r.items() if k not in (*ids, "seams")}, seams=[tuple(s[k] for k in SEAM) for s in r["seams"]]) for r in rows]
    whole = vars(reduce(compose, parts))
    whole["seams"] = [dict(zip(SEAM, s, strict=True)) for s in whole["seams"]]
    return pa.Table.from_pylist([{**ids, **whole}], FRAGMENT_ARROW)


# Runs of aligned tokens: either stream begins and ends at the same bytes.


@dataclass
class Block:
    """Some runs end to end: ids, ends in bytes, and for each run where it stops in either stream and in bytes."""

    pair: TokenizerPair
    a: np.ndarray
    b: np.ndarray
    stop_a: np.ndarray
    stop_b: np.ndarray

    def __post_init__(self):
        self.ends_a, self.ends_b = np.cumsum(self.pair.a_len[self.a]), np.cumsum(self.pair.b_len[self.b])
        total = int(self.ends_a[-1]) if len(self.a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[self.ends_a], in_b[self.ends_b] = True, True
        self.common, self.ends = np.flatnonzero(in_a & in_b), np.flatnonzero(in_a | in_b)
        self.stop = np.concatenate(([0], self.ends_a))[self.stop_a]

    def pairs(self) -> np.ndarray:
        """One number a link, in order: between two ends that follow each other lies one token of either stream."""
        return self.a[np.searchsorted(self.ends_a, self.ends)].astype(np.int64) * self.pair.n_b + self.b[np.searchsorted(self.ends_b, self.ends)]

    def per_run(self, places: np.ndarray) -> np.ndarray:
        """How many of the sorted ``places`` (in bytes) each run has."""
        upto = np.searchsorted(places, self.stop, "right")
        return np.diff(upto, prepend=0)

    def said(self) -> list[bytes]:
        """Each run's groups as ``a1,a2|b1;...``, with a semicolon behind every group."""
        group_a, group_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        n = len(self.common)
        many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        words = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.diff(group_a, append=n) > 0, np.diff(group_b, append=n) > 0
        words[np.arange(len(self.a)) + (np.cumsum(many_b) - many_b)[group_a]] = self.a.astype(np.int64) * 3 + last_a
        words[np.arange(len(self.b)) + np.cumsum(many_a)[group_b]] = self.b.astype(np.int64) * 3 + 2 * last_b
        stops = [0, *(self.stop_a + self.stop_b).tolist()]
        get = self.pair.said.__getitem__
        return [b"".join(map(get, words[lo:hi].tolist())) for lo, hi in zip(stops[:-1], stops[1:], strict=True)]

    def groups(self) -> Iterator[list[tuple[int, int, list[int], list[int]]]]:
        """Each run's groups: first byte and end in the run, ids, ids."""
        to_a, to_b = (np.searchsorted(ends, self.common) + 1 for ends in (self.ends_a, self.ends_b))
        first = lo = 0
        for stop, n in zip(self.stop.tolist(), self.per_run(self.common).tolist(), strict=True):
            made, begin = [], first
            for k in range(lo, lo + n):
                a0, b0 = (int(to_a[k - 1]), int(to_b[k - 1])) if k else (0, 0)
                made.append((begin - first, int(self.common[k]) - first, self.a[a0 : to_a[k]].tolist(), self.b[b0 : to_b[k]].tolist()))
                begin = int(self.common[k])
            yield made
            first, lo = stop, lo + n


def blocks(pair: TokenizerPair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Block]]:
    """The batch's runs in blocks of about ``BLOCK_TOKENS`` tokens: (first row, row after the last, block)."""
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    lo = size = 0
    for i in range(len(a)):
        size += len(a[i]) // 2
        if size >= BLOCK_TOKENS or i == len(a) - 1:
            sizes = [np.cumsum([len(x) // 2 for x in side[lo : i + 1]], dtype=np.int64) for side in (a, b)]
            yield lo, i + 1, Block(pair, ids_of(b"".join(a[lo : i + 1])), ids_of(b"".join(b[lo : i + 1])), *sizes)
            lo, size = i + 1, 0


def _pair_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """(pair, n), summed within the task for as many pairs as it may hold."""
    pair = tokenizer_pair(paths)
    keys, counts = [], []

    def merged() -> pa.RecordBatch:
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], ["pair", "n"])

    for batch in batches:
        for _, _, block in blocks(pair, batch):
            own, n = np.unique(block.pairs(), return_counts=True)
            keys.append(own)
            counts.append(n)
            if sum(map(len, keys)) > HELD_PAIRS:
                sum_up = merged()
                keys, counts = [sum_up.column(0).to_numpy()], [sum_up.column(1).to_numpy()]
                if len(keys[0]) > HELD_PAIRS // 2:
                    yield sum_up
                    keys, counts = [], []
    if keys:
        yield merged()


def _fact_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], counts, digest: bool) -> Iterator[pa.RecordBatch]:
    """Per run its counts, those of its links if the pair counts are at hand, and the digest of its groups if asked for."""
    pair = tokenizer_pair(paths)
    for batch in batches:
        for lo, hi, block in blocks(pair, batch):
            n_a, n_b = np.diff(block.stop_a, prepend=0), np.diff(block.stop_b, prepend=0)
            n_groups, n_links = block.per_run(block.common), block.per_run(block.ends)
            best = sums = np.zeros(hi - lo, np.int64)
            if counts is not None:
                known, number, most = counts.value
                links = block.pairs()
                n = number[np.searchsorted(known, links)] if len(links) else np.zeros(0, np.int64)
                upto = np.cumsum(n_links)
                best, sums = (np.diff(np.concatenate(([0], np.cumsum(x)))[upto], prepend=0) for x in (n == most[links % pair.n_b], n))
            said = [hashlib.sha256(s[:-1]).hexdigest() if s else "" for s in block.said()] if digest else [""] * (hi - lo)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, best, sums)], pa.array(said)], ["uid", "doc_id", *FACTS, "groups_sha256"])


def _link_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """(uid, pair, links): each run's links, summed by pair."""
    pair = tokenizer_pair(paths)
    for batch in batches:
        for lo, hi, block in blocks(pair, batch):
            run, links = np.repeat(np.arange(hi - lo), block.per_run(block.ends)), block.pairs()
            order = np.lexsort((links, run))
            run, links = run[order], links[order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(run) != 0) | (np.diff(links) != 0)))) if len(run) else np.zeros(0, np.int64)
            uid = batch.column("uid").to_numpy()[lo:hi][run[first]]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links[first]), pa.array(np.diff(first, append=len(run)))], ["uid", "pair", "links"])


def _digest_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """(uid, groups_sha256) of runs sorted by document: one document after the other streams through one hash."""
    pair = tokenizer_pair(paths)
    uid, hashed = None, None
    for batch in batches:
        ids, done = batch.column("uid").to_pylist(), []
        for lo, _, block in blocks(pair, batch):
            for k, said in enumerate(block.said()):
                if ids[lo + k] != uid:
                    done += [(uid, hashed.hexdigest())] if hashed else []
                    uid, hashed = ids[lo + k], hashlib.sha256(said[:-1])
                else:
                    hashed.update(b";" + said[:-1])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.int64()), pa.array([h for _, h in done])], ["uid", "groups_sha256"])
    if hashed:
        yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([hashed.hexdigest()])], ["uid", "groups_sha256"])


def _group_batches(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    pair = tokenizer_pair(paths)
    for batch in batches:
        for lo, _, block in blocks(pair, batch):
            for k, made in enumerate(block.groups()):
                uid, doc_id, start = (batch.column(c)[lo + k].as_py() for c in ("uid", "doc_id", "start"))
                rows = [{"uid": uid, "doc_id": doc_id, "start": start + s, "stop": start + e, "a_ids": a, "b_ids": b} for s, e, a, b in made]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))


class Alignment:
    """Both token streams of every row of ``documents``, aligned by bytes.

    ``short`` has a run a document, ``long`` a row a document of over ``size`` bytes (uid, doc_id, ok), ``parts`` their
    runs: the closed parts of ranges and the seams between. A row's ``uid`` is its own, whatever its doc_id. Documents
    that are null, empty, or not given back by the second vocabulary have no tokens.

    Long documents are cut at sure boundaries, the pieces dealt out, encoded, cut into byte ranges whose ends are no
    boundaries, and the ranges' fragments composed in a tree of ``FAN`` children a node; one without any sure boundary
    is encoded whole, in one task, and ranged from there on.
    """

    def __init__(self, documents: DataFrame, paths: tuple[str, str] | None = None, size: int = RANGE):
        self.paths, self.size = paths or public_vocabularies(), size
        rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
        self.short = stored(rows.where(~is_long).mapInArrow(partial(_text_batches, paths=self.paths), ROWS), "tokens")
        pieces = rows.where(is_long).mapInArrow(partial(_piece_batches, size=2 * size), "uid long, doc_id long, at long, piece string")
        ranges = stored(pieces.repartition("uid", "at").mapInArrow(partial(_range_batches, paths=self.paths, size=size), RANGES), "token-ranges")
        tree = ranges.mapInArrow(partial(_fragment_batches, paths=self.paths, closed=False), FRAGMENT)
        last, width = ranges.agg(F.max("at")).first()[0] or 0, size
        while width <= last:
            width *= FAN
            tree = tree.groupBy("uid", F.floor(F.col("at") / width).alias("node")).applyInArrow(_compose_group, FRAGMENT)
        whole = stored(tree.groupBy("uid", F.lit(0).alias("node")).applyInArrow(_compose_group, FRAGMENT), "token-seams")
        self.long = whole.select("uid", "doc_id", "ok")
        good = whole.where("ok")
        heads = good.select("uid", "doc_id", F.col("head_at").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("start"), F.col("head_a").alias("a"), F.col("head_b").alias("b"))
        seams = good.select("uid", "doc_id", F.explode("seams").alias("s")).select("uid", "doc_id", "s.at", F.lit(0).alias("kind"), "s.start", "s.a", "s.b")
        closed = ranges.mapInArrow(partial(_fragment_batches, paths=self.paths, closed=True), ROWS).join(good.select("uid"), "uid", "left_semi")
        self.parts = stored(closed.unionByName(heads).unionByName(seams), "token-runs")

    def runs(self) -> DataFrame:
        return self.short.unionByName(self.parts)

    def groups(self) -> DataFrame:
        """(uid, doc_id, start, stop, a_ids, b_ids): every group, with its bytes in space + text."""
        return self.runs().mapInArrow(partial(_group_batches, paths=self.paths), "uid long, doc_id long, start long, stop long, a_ids array<int>, b_ids array<int>")

    def pairs(self) -> DataFrame:
        """(pair, n): an id pair (a id times the second vocabulary's size, plus b id) and its links in all documents."""
        return self.runs().mapInArrow(partial(_pair_batches, paths=self.paths), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

    def facts(self, most_sent: int = PAIRS_SENT) -> DataFrame:
        """A row a document: doc_id, ``FACTS`` and groups_sha256.

        Pair counts of a checked size are sent to the tasks; more are joined with the documents' links, hot pairs apart.
        """
        pairs = stored(self.pairs(), "token-pairs")
        spark, n_b = pairs.sparkSession, tokenizer_pair(self.paths).n_b
        counts = None
        if pairs.count() <= most_sent:
            table = pairs.toArrow()
            order = np.argsort(table["pair"].to_numpy())
            known, number = table["pair"].to_numpy()[order], table["n"].to_numpy()[order]
            most = np.zeros(n_b, np.int64)
            np.maximum.at(most, known % n_b, number)
            counts = spark.sparkContext.broadcast((known, number, most))
        schema = ", ".join(["uid long, doc_id long", *(f"{c} long" for c in FACTS), "groups_sha256 string"])
        short = self.short.mapInArrow(partial(_fact_batches, paths=self.paths, counts=counts, digest=True), schema)
        sums = self.parts.mapInArrow(partial(_fact_batches, paths=self.paths, counts=counts, digest=False), schema)
        sums = sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in FACTS])
        digests = self.parts.repartition("uid").sortWithinPartitions("uid", "at", "kind").mapInArrow(partial(_digest_batches, paths=self.paths), "uid long, groups_sha256 string")
        long = self.long.join(sums, "uid", "left").join(digests, "uid", "left")
        long = long.select("uid", "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in FACTS], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
        out = short.unionByName(long)
        if counts is None:
            links = self.runs().mapInArrow(partial(_link_batches, paths=self.paths), "uid long, pair long, links long")
            most = pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
            judged = pairs.join(most, F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"), F.col("n").alias("_n"))
            total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            told = spread_join(links, judged, "pair", total).groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
            out = out.drop("n_best", "count_sum").join(told, "uid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
        return out.select("doc_id", *FACTS, "groups_sha256")


def document_alignment(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: tokens of either vocabulary, groups, links, and how common its links are in all texts.

    Null and empty texts, and those that the second vocabulary does not give back, have zeros and no digest; repeated rows
    are documents of their own and count twice; an empty table gives no rows; other columns are not read.
    """
    return Alignment(documents.select("doc_id", "text")).facts()
