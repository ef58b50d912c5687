"""Line dedup against brute force, and the runs that it counts with."""

import hashlib
import random
from collections import Counter

import pytest
from lanewatt.llm import lines

SCHEMA = "doc_id long, text string, t1 string, n_lines string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute(texts, threshold=10, before=None):
    seen = Counter(before or {})
    for t in texts:
        seen.update({k for k in map(key_of, (t or "").split("\n")) if k})
    out = []
    for t in texts:
        old = (t or "").split("\n")
        new = [x for x in old if seen[key_of(x)] < threshold]
        out.append((len(old), len(old) - len(new), "\n".join(new)))
    return out


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    pool = [f"Line {i} É" for i in range(60)] + ["  SHARED licence\t", "shared LICENCE", " shared licence", "\x1fkey", "Éa", "éa", ""]
    texts = [None, "", "\n", "\n\n", "one"]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.2 else f"own {rng.random()}" for _ in range(rng.randint(1, 12))) for _ in range(n)]
    return texts + ["the same\ntext"] * 700 + ["many " + "\n".join(f"l{i % 3000}" for i in range(6000))] * 11


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 7 else None, t, "x", "y") for i, t in enumerate(corpus())]


def test_frequent_lines_go_and_others_stay(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute([t for _, t, *_ in rows])
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.document_lines(docs).collect())
    assert got == Counter((d, n, gone, hashlib.sha256(left.encode()).hexdigest()) for (d, *_), (n, gone, left) in zip(rows, want, strict=True))
    assert lines.document_lines(docs.limit(0)).count() == 0


def test_columns_are_carried_and_null_texts_stay_null(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = lines.drop_frequent_lines(docs)
    assert out.columns == ["doc_id", "text", "t1", "n_lines", "n_dropped"]
    want = brute([t for _, t, *_ in rows])
    assert Counter((r["text"], r["t1"], r["n_lines"]) for r in out.collect()) == Counter((None if t is None else left, "x", n) for (_, t, *_), (n, _, left) in zip(rows, want, strict=True))


def test_runs_are_levelled_and_settled_lines_are_added_once(spark):
    runs = lines.LineRuns(spark, threshold=3, fanout=2)
    seen = Counter()
    for k in range(7):
        batch = [(h, -h, n, n) for h, n in ((1, 3), (2, 1), (100 + k, 1))]
        runs.add(spark.createDataFrame(batch, lines.RUN))
        seen.update({h: n for h, _, n, _ in batch if seen[h] < 3})
        levels = Counter(level for level, _ in runs.runs())
        assert max(levels.values()) < 2  # a binary counter of runs
        assert {r["h1"]: r["n"] for r in runs.totals().collect()} == dict(seen)
    assert sorted(Counter(level for level, _ in runs.runs())) == [0, 1, 2]
    assert {r["h1"] for r in runs.settled().collect()} == {1, 2} and seen[1] == 3 and seen[2] == 3
    for _, name in runs.runs():
        for part in runs.table([name]).rdd.glom().map(lambda rows: [r["h1"] for r in rows]).collect():
            assert part == sorted(part)


def test_a_run_that_was_not_finished_is_not_read(spark, tmp_path):
    runs = lines.LineRuns(spark, f"file://{tmp_path}/runs", threshold=2, fanout=4)
    runs.add(spark.createDataFrame([(1, 1, 1, 1)], lines.RUN))
    spark.createDataFrame([(2, 2, 9, 9)], lines.RUN).write.parquet(f"{runs.folder}/0-lost")
    (tmp_path / "runs" / "0-lost" / "_SUCCESS").unlink()
    assert [r["h1"] for r in runs.totals().collect()] == [1]


def test_deliveries_count_with_earlier_ones(spark):
    runs = lines.LineRuns(spark, threshold=10)
    first, second = ["a\nb"] * 6 + ["c"] * 12, ["a\nd"] * 4 + ["b", "c\ne"]
    one = spark.createDataFrame([(i, t) for i, t in enumerate(first)], "doc_id long, text string")
    two = spark.createDataFrame([(i, t) for i, t in enumerate(second)], "doc_id long, text string")
    lines.drop_frequent_lines(one, runs=runs).count()
    got = Counter(r["text"] for r in lines.drop_frequent_lines(two, runs=runs).collect())
    seen = Counter(k for t in first for k in set(t.split("\n")))
    assert got == Counter(t for *_, t in brute(second, before=seen)) and got["d"] == 4 and got["b"] == 1 and got["e"] == 1
