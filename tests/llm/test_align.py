"""Cross-tokenizer alignment against brute force over whole texts with the vocabularies' own libraries."""

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from lanewatt.llm import align

SCHEMA = "doc_id long, text string, a string"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_level():
    """The usual table of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(libraries, texts):
    a_lib, b_lib = libraries
    table, rows, counts = byte_level(), [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(table[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append(([], [], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (s2, e2) in near(b, spans[1], s, e)]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([x for x, (_, e) in zip(a, spans[0], strict=True) if lo < e <= hi], [y for y, (_, e) in zip(b, spans[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *common], common, strict=False)]
        rows.append((a, b, groups, links))
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def near(ids, spans, s, e):
    return [(i, span) for i, span in zip(ids, spans, strict=True) if span[0] < e and s < span[1]]


def texts():
    rng = random.Random(5)
    plain = ["Hello wörld, this is  a test", "a\n \nb", " lead", "trail ", "<|endoftext|> <s> </s> <0x41>", "▁ piece", "日本語 テキスト", "é Å", "x" * 300, "\x00\x01", "1234567 don't I'll", " ", "\n"]
    word = lambda: "".join(rng.choices("abcdefgh éüñ.-'\n", k=rng.randint(1, 12)))
    made = ["".join(word() + rng.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [None, "", *plain, *made, *plain[:3], "long " * 400 + "été" * 300 + " " + "words here, " * 200 + "日本語" * 200, "bad ▁" + " word" * 700]


@pytest.mark.parametrize("size,sent", [(align.RANGE, align.PAIRS_SENT), (200, align.PAIRS_SENT), (97, 0), (align.RANGE, 0)])
def test_facts_equal_brute_force(spark, libraries, size, sent):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in align.Alignment(docs.select("doc_id", "text"), size=size).facts(sent).collect())
    assert got == Counter((d, *facts) for (d, *_), facts in zip(rows, brute(libraries, texts()), strict=True))


def test_groups_cover_the_bytes_of_every_document(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], SCHEMA)
    got = {}
    made = align.Alignment(docs, size=150)
    for r in made.groups().collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    for i, t in enumerate(texts()):
        spans = sorted(got.get(i, []))
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == len((" " + t).encode())
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert len(got) > 60


def test_composition_is_associative_and_independent_of_the_cuts():
    pair = align.tokenizer_pair(align.public_vocabularies())
    rng = random.Random(2)
    for text in [t for t in texts() if t and pair.encode(t)]:
        a, b = pair.encode(text)
        want = align.Block(pair, align.ids_of(a), align.ids_of(b), np.array([len(a) // 2]), np.array([len(b) // 2]))
        for size in (1, 3, 10, 64, 10**6):
            made, closed = [], []
            for at, a0, b0, x, y in align.split_ranges(pair, a, b, 0, size):
                f, part = align.fragment(pair, at, x, y, a0, b0)
                made.append(f)
                closed += [(at, 1, *part)] if part[1] else []
            whole = reduce(align.compose, made)
            tree = list(made)
            while len(tree) > 1:  # in any bracketing
                k = rng.randrange(len(tree) - 1)
                tree[k : k + 2] = [align.compose(tree[k], tree[k + 1])]
            assert tree[0] == whole and whole.cut and not whole.tail_a and not whole.tail_b
            runs = sorted([*closed, (whole.head_at, 0, 0, whole.head_a, whole.head_b), *((at, 0, *rest) for at, *rest in whole.seams)])
            said = b"".join(align.Block(pair, align.ids_of(x), align.ids_of(y), np.array([len(x) // 2]), np.array([len(y) // 2])).said()[0] for *_, x, y in runs)
            assert said == want.said()[0]


def test_words_encode_as_whole_texts(libraries):
    pair = align.tokenizer_pair(align.public_vocabularies())
    for t in texts():
        ids = pair.encode(t or "")
        if ids:
            assert align.ids_of(ids[0]).tolist() == libraries[0].encode(" " + t, add_special_tokens=False).ids
            assert align.ids_of(ids[1]).tolist() == libraries[1].encode(t)


def test_an_empty_table_gives_no_rows(spark):
    assert align.document_alignment(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, "x"), (1, "", "x")], SCHEMA)
    assert [tuple(r)[1:] for r in align.document_alignment(only).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
