"""Near-duplicates, packing, decontamination, media, archives and classifiers against brute force and round trips."""

import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from lanewatt.llm import decontaminate, labelled, ogg, packing, quality, simhash, toxicity, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fps string, group string"


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]


# Near-duplicates.


def brute_fingerprint(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    for _ in prints:
        again = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(prints))]
        if again == label:
            return label
        label = again
    return label


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "One two", "one TWO", "É é", "x" * 20_000]
    for _ in range(25):
        base = words(rng, 300)
        texts.append(" ".join(base))
        for _ in range(6):
            base = list(base)
            base[rng.randrange(300)] = "changed"
            texts.append(" ".join(base))
    texts += [texts[8]] * 40
    got = {r["doc_id"]: r for r in simhash.document_classes(table(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(prints)
    assert simhash.document_classes(table(spark, [])).count() == 0


def test_null_ids_take_the_smallest_id_of_their_class(spark):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.document_classes(table(spark, ["a b", "a b", "q r s t u"], [None, 7, None])).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_trie_finds_every_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(60)], np.uint64) for c in centres])
    values = np.unique(values)
    n = len(values)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= 4}
    got = [(int(i), int(j)) for a, b in simhash.trie_pairs(values, np.array([[0, n, 0, n]]), 4) for i, j in zip(a, b, strict=True)]
    assert set(got) == want and len(got) == len(want)


def test_the_trie_splits_and_drops(spark):
    """At sf0.01 most pairs go by pruning; outright comparisons are of a few values each."""
    prints = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    values = np.unique([r["fps"][0] for r in simhash.fingerprints(prints).collect()]).astype(np.int64).view(np.uint64)
    values.sort()
    n, tally = len(values), {}
    near = sum(len(i) for i, _ in simhash.trie_pairs(values, np.array([[0, n, 0, n]]), 4, 12, tally))
    assert tally["split"] > n / 4 and tally["dropped"] > n / 4 and tally["compared"] * simhash.LEAF_PAIRS < n * n / 100
    same = values >> np.uint64(52)
    assert near == sum(int(np.triu(np.bitwise_count(values[same == k][:, None] ^ values[same == k][None, :]) <= 4, 1).sum()) for k in np.unique(same))


def test_hot_blocks_are_tiled_without_loss(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(simhash, "SUBTREE", 256)
    values = {rng.randrange(1 << 20) for _ in range(2500)} | {(1 << 63) | rng.randrange(1 << 12) for _ in range(300)}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    nodes = spark.createDataFrame([(v, [v]) for v in signed], "node long, fps array<long>")
    pairs = simhash.links(nodes)
    got = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    arr = np.array(signed, np.int64).view(np.uint64)
    label = np.arange(len(arr))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    simhash.union(label, i, j)
    groups, mine = {}, {}
    for k, v in enumerate(signed):
        groups.setdefault(label[k], set()).add(v)
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_deduplication_keeps_one_of_a_class(spark):
    rng = random.Random(2)
    base = words(rng, 200)
    near = list(base)
    near[50] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join(words(rng, 200)), None, "", "short text"]
    docs = table(spark, texts, [5, 4, 9, 1, 2, None, 8]).union(table(spark, [" ".join(base)], [9]))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["4", "1", "2", "8"])


def test_rows_are_judged_by_their_own_texts(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    item = " ".join(words(rng, 30))
    rows = [(3, a), (5, a), (5, b), (6, c), (None, c), (None, d), (None, d), (7, "x " + item), (7, d + " more"), (None, "y " + item), (8, None)]
    docs = spark.createDataFrame([(i, t, k, {"k": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` long, m map<string,long>")
    out = sorted((str(r["doc_id"]), r["text"], r["a.b"]) for r in simhash.deduplicate(docs).where("`a.b` not in (7, 9)").collect())
    assert [(i, t) for i, t, _ in out] == sorted([("3", a), ("5", b), ("6", c), ("7", d + " more"), ("8", None)], key=lambda x: x[0])
    twice = simhash.deduplicate(spark.createDataFrame([(1, a, k, {"k": k}) for k in (5, 2, 9)], docs.schema)).collect()
    assert [(r["doc_id"], r["a.b"], r["m"]) for r in twice] == [(1, 2, {"k": 2})]
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 10]


def test_similar_classes_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "one two", "two one", "One  two", "a b c d e", "e d c b a"]
    for n in (8, 12, 30, 80, 200, 600):
        for _ in range(6):
            base = words(rng, n)
            for share in (0.75, 0.82, 0.9, 0.97):
                kept = round(n * share)
                texts += [" ".join(base[:kept]), " ".join(base[n - kept :]), " ".join(base + words(rng, n - kept))]
            swapped = list(base)
            swapped[n // 2] = "other"
            texts += [" ".join(base), " ".join(rng.sample(base, n)), " ".join(swapped), " ".join(base[:-1])]
    chain = words(rng, 60)
    for _ in range(20):
        chain = chain[3:] + words(rng, 3)
        texts.append(" ".join(chain))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    sets = []
    for text in texts:
        parts = (text or "").lower().split()
        sets.append({tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set())
    label = list(ids)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    for _ in sets:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(table(spark, texts, ids)).collect()}
    assert got == dict(zip(ids, label, strict=True))
    assert simhash.similar_classes(table(spark, [])).count() == 0
    assert sorted(r["doc_id"] for r in simhash.deduplicate(table(spark, texts, ids)).collect()) == sorted(set(label))


def test_members_of_many_tiles_all_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    sketch = bytes(simhash.BANDS * simhash.ROWS)
    members = spark.createDataFrame([(k, v, 10 + (v == 9) * 90, 10, v // 2, sketch, None) for k in (1, 2) for v in range(10)], "key long, node long, n int, among long, root long, sketch binary, small binary")
    got = sorted(map(tuple, simhash._across(members).collect()))
    assert got == [(a, b) for a in range(9) for b in range(a + 1, 9) if a // 2 != b // 2]


# Packing.


@pytest.fixture(scope="module")
def hugging_face():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_cache_gives_the_ids_of_the_whole_text(hugging_face):
    texts = [
        "", " ", "a", " a b", "a  b   c ", "a\n b \n c\t d", "it's they'll 123 45,6", "é ñ ß 中文 x", "x<|endoftext|> y <|endoftext|>", "tail ", "a  b  c", "\r\n \r\n x", "don 't", "a" * 3000,
        "emoji 😀 👩‍👩‍👧 z", "a 　 b", "\x00 \x1c x", "a\x1c b", "q\x85 r",
    ]
    tokenizer = packing.byte_tokenizer(packing.public_vocabulary())
    for t in texts * 2:
        assert np.frombuffer(tokenizer.encode(t), "<u4").tolist() == hugging_face.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_whole_and_gapless(spark, hugging_face):
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|>"] + [" ".join(words(rng, rng.choice((3, 40, 300, 700, 2500)))) for _ in range(120)]
    docs = table(spark, texts).union(table(spark, ["again"], [7]))
    rows = packing.packed_documents(docs).collect()
    own, seq = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for d, t in enumerate(texts):
        if d == 7:
            continue
        ids = hugging_face.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(own[d], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 2048 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for members in seq.values():
        members.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in members] == [sum(x["length"] for x in members[:k]) for k in range(len(members))]
        assert sum(r["length"] for r in members) <= 2048
    assert len(seq) <= len(packing.best_fit([r["length"] for r in rows], 2048))
    assert packing.packed_documents(table(spark, [])).count() == 0


def test_rounds_join_the_groups_leavings(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice((rng.randrange(1, 900), rng.randrange(900, 1200))), i) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), group=300).collect()
    assert Counter((r["doc_id"], r["length"]) for r in out) == Counter((r[0], r[3]) for r in rows)
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= 1.02 * len(packing.best_fit([r[3] for r in rows], 2048)) + 1


def test_local_search_empties_a_bin_that_best_fit_leaves():
    lengths = [5, 5, 4, 4, 3, 3, 3, 3]  # capacity 10: best fit makes 4 bins, 3 hold all
    bins = packing.best_fit(lengths, 10)
    better = packing.local_search(lengths, bins, 10)
    assert len(better) == 3 and sorted(i for b in better for i in b) == list(range(8))
    assert all(sum(lengths[i] for i in b) <= 10 for b in better)
    rng = random.Random(0)
    for _ in range(30):
        lengths = [rng.randrange(1, 60) for _ in range(40)]
        bins = packing.best_fit(lengths, 100)
        better = packing.local_search(lengths, bins, 100)
        assert len(better) <= len(bins) and sorted(i for b in better for i in b) == list(range(40)) and all(sum(lengths[i] for i in b) <= 100 for b in better)


# Decontamination.


def brute_matches(docs, items):
    out = {}
    for d, text in docs:
        w = decontaminate.words_of(text or "")
        for k, item in items:
            v = decontaminate.words_of(item or "")
            if not v or not w:
                continue
            n, bag = min(5, len(v)), Counter(decontaminate.shingles_of(v))
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                best = max(best, decontaminate.similarity(Counter(decontaminate.shingles_of(w[s : s + len(v)], n)), bag))
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


def test_windows_match_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randrange(15, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "tiny words here"), (33, "the cat sat on the mat " * 4)]
    docs = [(0, None), (1, ""), (2, "tiny, WORDS here! yes"), (3, "the cat sat on the mat " * 60)]
    for d in range(4, 60):
        text = words(rng, 150)
        item = decontaminate.words_of(items[rng.randrange(30)][1])
        for _ in range(rng.choice((0, 0, 1, 2))):
            item[rng.randrange(len(item))] = "edit"
        at = rng.randrange(150)
        docs.append((d, " ".join(text[:at]) + "\n" + " ".join(item).upper() + ". " + " ".join(text[at:])))
    docs.append((60, items[0][1][:-4]))
    got = decontaminate.contaminated(table(spark, [t for _, t in docs]), spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")).collect()
    want = brute_matches(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == want and len(got) == len(want) > 30
    texts = dict(docs)
    for r in got:
        assert decontaminate.words_of(texts[r["doc_id"]][r["start"] : r["end"]]) == decontaminate.words_of(texts[r["doc_id"]])[r["start_word"] : r["start_word"] + r["n_words"]]


def test_benchmark_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_TASK", 3)
    monkeypatch.setattr(decontaminate, "REGIONS_A_TASK", 2)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", 1 << 12)
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 20))) for i in range(16)]
    docs = table(spark, [t for _, t in items], range(16))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(16)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs.union(table(spark, ["clean", items[0][1], None], [99, None, 98])), bench)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["98", "99"]


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 200, dtype=np.uint64)
    queries = np.concatenate([prints ^ np.array([sum(1 << int(b) for b in rng.choice(64, 12, replace=False)) for _ in prints], np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    index = decontaminate.HammingIndex(prints, radius=15)
    q, i, far = index.search(queries)
    d = np.bitwise_count(queries[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(d <= 15)), strict=True))


# Media.


@pytest.mark.parametrize("size", [0, 1, 254, 255, 575, 576, 577, 5000, 65_536, 300_001])
def test_ogg_round_trip(size):
    payload = random.Random(size).randbytes(size)
    samples = ogg.padded(payload)
    data = ogg.write_ogg(samples)
    back, facts = ogg.read_samples(data)
    assert back == samples and len(samples) % 576 == 0 and len(samples) >= 576
    assert facts["last"] == len(samples) and facts["streams"] == 2
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_samples(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.read_samples(data[:-1])


def test_checksum_is_the_plain_bitwise_one():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return crc

    for n in (0, 1, 7, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.page_checksum(data) == slow(data)


def test_packets_may_span_pages():
    w = ogg.StreamWriter(7)
    packets = [b"a" * 255 * 40, b"", b"b" * 255, b"c" * 10]
    for k, p in enumerate(packets):
        w.packet(p, k + 1, last=k == 3)
    stream = ogg.demultiplex(b"".join(p for _, p in w.pages))[7]
    assert [p for p, _ in stream.packets] == packets and stream.pages > 1 and stream.packets[-1][1] == 4


def test_media_of_documents(spark):
    texts = [None, "", "é" * 1000, "same", "same", "x" * 50_000]
    rows = ogg.document_media(table(spark, texts)).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and by[3]["media_sha256"] == by[4]["media_sha256"] and by[0]["feature"] == by[1]["feature"]


# Archives.


def test_archives_round_trip(spark):
    big, small = "é<p>" * 400, "tiny"
    rows = [(1, "http://a/1 2\r\nX: y", big), (9, "u", big), (5, None, big), (None, "u", big), (2, "u", small), (3, "u", small), (4, "u", None), (-6, "u", "y" * 30_000), (7, "u", "z" * 1000), (7, "u", "z" * 1000)]
    pages = spark.createDataFrame([(*r, "e", "d") for r in rows], "page_id long, url string, html string, digest string, top string")
    got = sorted(map(str, (tuple(r) for r in warc.archived_pages(pages).collect())))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        revisit = len(raw) >= 1000 and i != max(same)
        want.append(str((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)))
    assert got == sorted(want)
    assert warc.archived_pages(pages.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, count, offset):
        return self.data[offset : offset + count]


def test_directories_with_64_bit_fields_and_notes():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(zipfile.ZipInfo("a/é.warc"), "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b", b"12345" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a note with PK\x05\x06 in it"
    file = Bytes(raw.getvalue())
    members = warc.read_directory(file, len(file.data))
    assert set(members) == {"a/é.warc", "b"}
    assert file.read_at(5, warc.data_offset(file, members["a/é.warc"])) == b"hello"
    with pytest.raises(warc.WarcError):
        warc.data_offset(file, members["b"])
    # the same with its directory told by 64-bit records only
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("m", b"data")
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    _, _, _, _, n, length, offset, _ = warc._END.unpack_from(data, end)
    wide = warc._END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, offset) + warc._LOCATOR.pack(b"PK\x06\x07", 0, end, 1)
    full = warc._END.pack(b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = Bytes(data[:end] + wide + full)
    assert file.read_at(4, warc.data_offset(file, warc.read_directory(file, len(file.data))["m"])) == b"data"


# Classifiers.


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


def test_held_out_rule_and_sample(spark):
    ids = list(range(50)) + [-3]
    got = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", labelled.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    docs = table(spark, [f"t{i}" for i in range(50)])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = [tuple(r) for r in labelled.training_sample(docs, marks, "quality", (10, 10)).collect()]
    assert labelled.fitted(labelled.training_sample(docs, marks, "quality", (10, 10)), sorted) == sorted(sample)
    assert labelled.fitted(labelled.training_sample(docs, marks.limit(0), "quality", (10, 10)), len) == 0
    assert Counter(y for _, y in sample) == {0: 10, 1: 10}
    assert all(zlib.crc32(t[1:].encode()) % 5 and t != "t1" and int(t[1:]) % 2 == y for t, y in sample)


def test_misspelt_insults_are_found():
    rng = random.Random(3)
    def text(bad):
        w = words(rng, 60)
        for _ in range(4 * bad):
            w[rng.randrange(60)] = rng.choice(("zorkblatt", "zorkblat", "zorkblatts"))
        return " ".join(w)

    model = toxicity.fit([(text(k % 2), k % 2) for k in range(400)])
    scores = [model.score(text(k % 2).replace("zorkblatts", "zorkblattzz")) for k in range(100)]
    assert auc(scores, [k % 2 for k in range(100)]) > 0.95
    assert 0 <= model.score("") <= 1 and toxicity.fit([]).score("x") == 0.5


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    chain = quality.Chain(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)))
    docs = [rng.normal(size=(n, quality.FEATURES)) for n in (4, 1, 6, 3)]
    for X, got in zip(docs, chain.marginals(docs), strict=True):
        n, z = len(X), X @ chain.emit
        total, good = 0.0, np.zeros(n)
        for s in range(2**n):
            y = [s >> k & 1 for k in range(n)]
            p = np.exp(sum(z[k] * y[k] for k in range(n)) + sum(chain.move[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert np.allclose(got, good / total)


@pytest.mark.parametrize("module,label,sf,least", [(toxicity, "toxic", "sf0.1", 0.95), (quality, "quality", "sf0.01", 0.95)])
def test_held_out_accuracy(spark, module, label, sf, least):
    root = f"/root/testdata/{sf}"
    docs, marks = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    awkward = table(spark, [None, ""], [None, 10**6]).select(*docs.columns)
    out = module.scored(docs.unionByName(awkward), marks).join(marks, "doc_id", "left").toPandas()
    assert len(out) == docs.count() + 2 and out["score"].between(0, 1).all()
    held = out[out["held_out"] & out[label].notna()]
    assert len(held) > 40 and auc(held["score"], held[label]) >= least, auc(held["score"], held[label])


def test_an_enormous_text_costs_the_sample_no_other(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = table(spark, [f"text {i:03}" for i in ids], ids)
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    whole = [tuple(r) for r in labelled.training_sample(docs, marks, "quality", (60, 60)).collect()]
    assert len(whole) == len(ids)
    first = int(whole[0][0][5:])
    longer = docs.where(f"doc_id <> {first}").union(table(spark, ["x" * 5000], [first]))
    assert [tuple(r) for r in labelled.training_sample(longer, marks, "quality", (60, 60), 2000).collect()] == whole[1:]
    with pytest.raises(Exception, match="no labelled text of class"):
        labelled.training_sample(docs.where("doc_id % 2 = 0").union(table(spark, ["x" * 5000], [ids[1] | 1])), marks, "quality", (60, 60), 2000).collect()


def test_toxicity_scores_equal_a_slow_sum():
    """A text's score from its words one by one: n-grams of three to six characters with marks, averaged word by word."""
    rng = random.Random(8)
    model = toxicity.fit([(" ".join(words(rng, 30) + ["vorgmalt"] * (k % 2)), k % 2) for k in range(120)])

    def bucket(gram):
        h = ord(gram[0]) & 0xFFFFFFFF
        for ch in gram[1:]:
            h = (h * 16777619 & 0xFFFFFFFF) ^ ord(ch)
        h = h * (2654435761 + 2 * len(gram)) & 0xFFFFFFFF
        return (h ^ h >> 15) & (toxicity.BUCKETS - 1)

    for text in ("", "vorgmalt", "Vorgmaltz is, like, A word", " ".join(words(rng, 40))):
        known = list(dict.fromkeys(toxicity._WORD.findall(text.lower())))
        z = model.bias
        for w in known:
            marked = f"\0{w}\0"
            grams = [marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1)]
            for g in grams:
                z += float(model.logits[bucket(g)]) * toxicity.SCALE / (len(grams) * (len(known) + toxicity.BLANKS) ** 0.5)
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_filters_and_scores_on_empty_tables(spark):
    docs, none = table(spark, ["a b", None]), table(spark, [])
    marks = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert module.scored(none, marks).count() == 0
        assert all(0 <= r["score"] <= 1 for r in module.scored(docs, marks.limit(0)).collect())
    assert toxicity.drop_toxic(none, marks).count() == 0 and toxicity.drop_toxic(docs, marks.limit(0)).count() == 2
    assert simhash.deduplicate(none).count() == 0 and decontaminate.drop_contaminated(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_feature_takes_every_sample():
    payload = bytearray(ogg.padded(bytes(range(250)) * 8))
    facts = ogg.read_samples(ogg.write_ogg(bytes(payload)))[1]
    said = ogg.feature(bytes(payload), facts)
    for at in (0, 575, 576, len(payload) - 1):
        payload[at] ^= 1
        assert ogg.feature(bytes(payload), facts) != said
        payload[at] ^= 1


def test_search_has_no_piece_limit():
    """Bins of over 64 pieces swap two for one as others do: seven 3s and a 1 a bin, with gaps that only such swaps close."""
    rng = random.Random(1)
    for _ in range(5):
        lengths = [rng.choice((1, 2, 3, 5)) for _ in range(900)]
        bins = packing.best_fit(lengths, 200)
        better = packing.local_search(lengths, bins, 200)
        assert len(better) == -(-sum(lengths) // 200) and sorted(i for b in better for i in b) == list(range(900))


def test_an_odd_member_of_a_band_meets_near_copies_without_dealing_them_anew(spark):
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 256, simhash.BANDS * simhash.ROWS, np.uint8).tobytes()
    rows = [(1, k, 50, 7, sketch) for k in range(5000)] + [(1, 9000, 50, 8, sketch), (1, 9001, 50, 9, bytes(len(sketch)))]
    rows += [(2, k, 50, k % 3, sketch) for k in range(40)]
    members = spark.createDataFrame(rows, "key long, node long, n int, root long, sketch binary").withColumn("small", F.lit(None).cast("binary"))
    members = members.withColumn("_n", F.when(F.col("key") == 1, 5002).otherwise(40).cast("long"))
    members = members.withColumn("big", F.when(F.col("key") == 1, F.struct(F.lit(5000).cast("long").alias("c"), F.lit(7).cast("long").alias("root"))).otherwise(F.struct(F.lit(14).cast("long").alias("c"), F.lit(0).cast("long").alias("root"))))
    dealt = simhash._dealt(members)
    assert dealt.count() <= 2 * len(rows) and dealt.groupBy("node", "key").count().where("node < 5000 AND key = 1").agg(F.max("count")).first()[0] == 1
    assert dealt.groupBy("key", "kind", "low", "high").count().agg(F.max("count")).first()[0] < 3 * simhash.TILE
    got = {tuple(r) for r in simhash._across(members).collect()}
    want = {(k, 9000) for k in range(5000)} | {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 != j % 3}
    assert got == want


def test_ids_beside_other_white_space():
    """Words are encoded apart only where the vocabulary's own library would part them too."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own, rng = packing.byte_tokenizer(packing.public_vocabulary()), random.Random(1)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for _ in range(4000):
        text = "".join(rng.choice("ab.1' \n\t\r\u00a0\u2003\u3000") for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
