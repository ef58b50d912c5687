"""Source divergence against brute force, and the pointer sort against Python's."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lanewatt.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string"


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, least=30, top=50):
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def corpus(seed=0):
    rng = random.Random(seed)
    pool = ["alpha", "Beta", "GAMMA", "é", "Éa", "日本語", "x" * 40 + "a", "x" * 40 + "b", "x" * 24, "x" * 8, "abcdefgh", "abcdefghi", "a"] + [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = []
    for i in range(700):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s2", "", None, "s3"])
        words = rng.choices(pool, k=rng.randint(0, 40), weights=[1 + (zlib.crc32(f"{source}{j}".encode()) % 7) for j in range(len(pool))])
        rows.append((i % 50, rng.choice([" ", "-1", "\n"]).join(words) + rng.choice(["", "!", "​"]), lang, source, "x"))
    rows += [(None, None, "en", "empty", "x"), (1, "", "de", "a", "x"), (1, "12 34", "de", "b", "x"), (1, "rare", "it", "one", "x")]
    return rows + [(9, "alpha the same text", "en", "s1", "x")] * 300


def test_rows_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1, 16, divergence.SMALL])
def test_pointer_sort_is_stable_and_finds_equal_runs(monkeypatch, small):
    monkeypatch.setattr(divergence, "SMALL", small)
    rng = random.Random(1)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "z" * 100, "z" * 99 + "y", *("z" * k for k in (7, 8, 16, 23, 24, 25, 48, 72)), "é", "ÉÉ"] + ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(300)]
    text = " ".join(rng.choices(words, k=3000))
    letters, starts, lengths = divergence.term_pointers(np.frombuffer(text.encode(), np.uint8))
    order, first = divergence.sorted_terms(letters, starts, lengths)
    found = [t.encode() for t in terms_of(text)]
    assert [bytes(letters[s : s + n]) for s, n in zip(starts, lengths, strict=True)] == found
    assert order.tolist() == sorted(range(len(found)), key=lambda i: (found[i], i))
    assert first.tolist() == [k == 0 or found[i] != found[order[k - 1]] for k, i in enumerate(order)]


def test_counts_of_a_block_that_is_a_slice():
    texts = ["no", "One two", "", "two", "ONE one é", "skipped"]
    terms, group, n, docs = divergence.term_counts(pa.array(texts).slice(1, 4), np.array([0, 0, 1, 0]), 2)
    got = sorted(zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist(), strict=True))
    assert got == [("one", 0, 3, 2), ("two", 0, 1, 1), ("two", 1, 1, 1), ("é", 0, 1, 1)]


def test_shares_are_exact_for_large_counts():
    n, base = np.array([10**12, 3, 0]), np.array([3 * 10**13 + 7, 10**6 + 1, 5])
    assert divergence._exact_shares(n, base).tolist() == [1 + 10**9 * (int(x) + 5) // int(b) for x, b in zip(n, base, strict=True)]
