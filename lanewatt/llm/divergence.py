"""Source divergence: term counts by a sort of word-start pointers, and how far sources of one language lie apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_DOCUMENTS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Bytes of text whose pointers are sorted at once, about.
BLOCK_BYTES = 1 << 22
#: Slices of no more pointers are sorted outright, by so many bytes from where they are known to agree.
SMALL, WIDE = 1 << 13, 24
#: Terms that are compared between all sources at once, as one matrix.
MATRIX_CELLS = 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"


def _letters() -> np.ndarray:
    """Every byte as it counts in a term: A-Z lower-cased, a-z and all bytes of other code points as they are, else 0."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[:65] = out[91:97] = out[123:128] = 0
    return out


LETTERS = _letters()


def term_pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, lengths): the buffer with everything outside of terms as 0, and where its terms begin."""
    letters = np.concatenate((LETTERS[data], np.zeros(WIDE, np.uint8)))
    inside = np.concatenate(([False], letters > 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return letters, edges[0::2], edges[1::2] - edges[0::2]


def _digits(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each term from ``depth`` on, as one big-endian number; what is behind the term's end is 0."""
    at = np.minimum(starts + depth, len(letters) - 8)
    window = np.lib.stride_tricks.sliding_window_view(letters, 8)[at]
    behind = np.clip(8 - (lengths - depth), 0, 8).astype(np.uint64) * np.uint64(8)
    digits = np.ascontiguousarray(window).view(">u8").ravel().astype(np.uint64)
    # a shift by all 64 bits is none, so it is made in two halves
    half = behind >> np.uint64(1)
    rest = behind - half
    return ((digits >> half) >> rest << half) << rest


def sorted_terms(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the pointers in the order of their terms, stable, and whether a pointer begins a run of equal terms.

    Multikey quicksort with digits of eight bytes: a slice that agrees up to a depth is parted by a pivot's digit into less,
    equal and greater; the equal part goes on behind that digit, unless the term ends there. Small slices are sorted by
    several digits outright, and only their ties go on.
    """
    order = np.arange(len(starts))
    first = np.zeros(len(starts), bool)
    stack = [(0, len(starts), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi == lo:
            continue
        first[lo] = True
        own = order[lo:hi]
        if hi - lo <= SMALL:
            keys = [_digits(letters, starts[own], lengths[own], depth + 8 * k) for k in range(WIDE // 8)]
            by = np.lexsort(keys[::-1])
            order[lo:hi] = own[by]
            new = np.zeros(hi - lo, bool)
            new[0] = True
            for key in keys:
                new[1:] |= np.diff(key[by]) != 0
            first[lo:hi] = new
            edges = np.append(np.flatnonzero(new), hi - lo)
            on = (np.diff(edges) > 1) & (np.maximum.reduceat(lengths[order[lo:hi]], edges[:-1]) > depth + WIDE)  # some of the run goes on
            stack += [(lo + int(a), lo + int(b), depth + WIDE) for a, b in zip(edges[:-1][on], edges[1:][on], strict=True)]
            continue
        digit = _digits(letters, starts[own], lengths[own], depth)
        pivot = np.partition(digit[:: max(1, len(digit) // 63)], 31 if len(digit) >= 63 else 0)[31 if len(digit) >= 63 else 0]
        less, same = digit < pivot, digit == pivot
        parts = (own[less], own[same], own[~(less | same)])
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), lo + len(parts[0]) + len(parts[1])
        stack += [(lo, a, depth), (b, hi, depth)]
        first[a] = True
        if int(pivot) & 0xFF:  # the digit is full, so its terms may go on
            stack.append((a, b, depth + 8))
    return order, first


def _gathered(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The terms as strings."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[at]))


def term_counts(texts: pa.Array, group: np.ndarray, groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, n, docs) of the texts of one block, where ``group`` has each text's group: a row a term and group."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    # a zero between texts, so that no term runs from one into the next
    apart = np.insert(data, edges[1:-1], 0) if len(edges) > 2 else data
    letters, starts, lengths = term_pointers(apart)
    document = np.searchsorted(edges[1:] + np.arange(len(texts)), starts, "right")
    order, first = sorted_terms(letters, starts, lengths)
    run, doc = np.cumsum(first) - 1, document[order]
    fresh = first.copy()  # in a run, documents ascend: the sort is stable
    fresh[1:] |= np.diff(doc) != 0
    key = run * groups + group[doc]
    own, at = np.unique(key, return_inverse=True)
    heads = order[np.flatnonzero(first)][own // groups]
    return _gathered(letters, starts[heads], lengths[heads]), own % groups, np.bincount(at, minlength=len(own)), np.bincount(at[fresh], minlength=len(own))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source, text = batch.columns
        pairs = pa.StructArray.from_arrays([lang, source], ["lang", "source"]).to_pylist()
        numbers: dict[tuple[str, str], int] = {}
        group = np.array([numbers.setdefault((p["lang"], p["source"]), len(numbers)) for p in pairs], np.int64)
        names = [pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1)]
        size = np.cumsum(pc.binary_length(text).to_numpy())
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
            terms, of, n, docs = term_counts(text.slice(lo, hi - lo), group[lo:hi], len(numbers))
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([names[0].take(at), names[1].take(at), terms, pa.array(n), pa.array(docs)], [f.split()[0] for f in COUNTS.split(", ")])
            lo = hi


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, sources): the terms of at least ``least`` documents of a language, with their occurrences in all and
    in each source that has any. A row is a document of its own; null text, lang and source count as ''."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(_count_batches, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return stored(terms.where(F.col("docs") >= least).select("lang", "term", "n", "sources"), "kept-terms")  # a list has a term's sources


def _share(n: str, total: str, terms: str):
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR terms)), exact for counts of up to 20 digits."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0))")


def group_totals(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total) of every group that occurs, without any kept term too."""
    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    return groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])


def _exact_shares(n: np.ndarray, base: np.ndarray) -> np.ndarray:
    if len(n) and int(n.max()) + PRIOR >= 2**63 // UNIT:  # in whole numbers without bound
        return np.array([1 + UNIT * (int(x) + PRIOR) // int(b) for x, b in zip(n, base, strict=True)], np.int64)
    return 1 + UNIT * (n + PRIOR) // base


def _distance_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): for each two sources of a language, in order, the sum of their shares' differences over
    the terms that the task has seen. What is held is one number for each two sources, as many as the result has."""
    known: dict[str, tuple] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        of_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            of_lang.setdefault(lang, []).append(i)
        for lang, rows in of_lang.items():
            part = batch.take(pa.array(rows))
            if lang not in known:
                groups = part.column("groups")[0].as_py()
                base = np.array([g["total"] + PRIOR * g["terms"] for g in groups], np.int64)
                known[lang] = (pa.array([g["source"] for g in groups], pa.string()), base, _exact_shares(np.zeros(len(base), np.int64), base), np.zeros((len(base), len(base)), np.int64))
            sources, base, none, sums = known[lang]
            step = max(1, MATRIX_CELLS // len(base))
            for lo in range(0, len(rows), step):
                block = part.column("sources").slice(lo, step)
                flat, row = block.flatten(), np.repeat(np.arange(len(block)), pc.list_value_length(block).to_numpy())
                at, n = pc.index_in(flat.field("source"), sources).to_numpy(), flat.field("n").to_numpy()
                share = np.tile(none, (len(block), 1))
                share[row, at] = _exact_shares(n, base[at])
                for g in range(len(base) - 1):
                    sums[g, g + 1 :] += np.abs(share[:, g + 1 :] - share[:, g : g + 1]).sum(axis=0)
    for lang, (sources, base, _, sums) in known.items():
        one, two = np.triu_indices(len(base), 1)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), sources.take(pa.array(one)), sources.take(pa.array(two)), pa.array(sums[one, two])], ["lang", "source", "item", "value"])


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms lie from its language and from other sources.

    Part ``pair`` has a row for every other source of the language: the sum over the language's kept terms of the
    differences of the two shares. Part ``term`` has the ``top`` terms whose share in the source is above the language's.
    Shares are whole billionths with ``PRIOR`` added to every count. Ranks follow value, descending, then the item's bytes.

    Texts are read once; within a task, pointers to word starts are sorted over the Arrow buffers, and the runs of equal
    terms give occurrences and documents by source. What is shuffled is a row a term and source. Null text, lang or source
    count as ''; repeated rows are documents of their own; a text without a term makes its group occur all the same; an
    empty table gives no rows; other columns are not read.
    """
    kept = kept_terms(documents, least)
    groups = stored(group_totals(documents, kept), "term-groups")
    in_group = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    shares = in_group.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (_share("n", "total", "terms") - _share("lang_n", "lang_total", "terms")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "terms"))).alias("groups"))  # the sources of one language
    sums = kept.select("lang", "sources").join(lists, "lang").select("lang", "sources", "groups").mapInArrow(_distance_batches, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # a row for each two sources of a language is the result asked for
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
