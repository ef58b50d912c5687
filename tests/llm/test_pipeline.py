"""The pipeline on the smallest tables: each stage against what brute force says of the rows that it got."""

import corpus_pipeline
import pytest
from lanewatt.llm import decontaminate, packing

from .test_documents import brute_matches
from .test_native import brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "en", "s", 0), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0), (10**6 + 1, "password: hunter2hunter2 is said here by one who knows", "en", "s", 54)], docs.schema)
    seen = [docs.unionByName(extra).persist()]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).persist())
    return [(df.columns, df.collect()) for df in seen]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(cols == stages[0][0] for cols, _ in stages[:-1])


def key(rows):
    return {(r["doc_id"], r["text"]) for r in rows}


def test_filters_take_rows_away_and_change_none(stages):
    for (_, before), (_, after) in zip(stages[:3], stages[1:4], strict=True):
        assert key(after) <= key(before)


def test_one_of_each_class_is_left(stages):
    """By brute force over sets of five-word shingles: linked at 0.8, one row a class, the smallest doc_id, nulls last."""
    (_, before), (_, after) = stages[1], stages[2]

    def shingles(text):
        parts = (text or "").encode().lower().split()
        return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()

    sets = [shingles(r["text"]) for r in before]
    label = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in sets:
        was = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == was:
            break
    classes = {}
    for r, c in zip(before, label, strict=True):
        classes.setdefault(c, []).append((r["doc_id"] is None, r["doc_id"]))
    assert sorted(str(r["doc_id"]) for r in after) == sorted(str(min(c)[1]) for c in classes.values())


def test_no_benchmark_passage_is_left_and_nothing_else_goes(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    (_, before), (_, after) = stages[2], stages[3]
    shingles = {s for _, t in items for s in decontaminate.shingles_of(decontaminate.words_of(t))}
    near = [(r["doc_id"], r["text"]) for r in before if shingles & set(decontaminate.shingles_of(decontaminate.words_of(r["text"] or "")))]
    bad = {d for d, _ in brute_matches(near, items)}
    assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in bad)


def test_secrets_are_masked(stages):
    (_, before), (_, after) = stages[3], stages[4]
    assert sorted(str(r["doc_id"]) for r in before) == sorted(str(r["doc_id"]) for r in after)
    was = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert brute_spans(was[r["doc_id"]]) or r["text"] == was[r["doc_id"]]
        assert not brute_spans(r["text"])


def test_packing_holds_every_token(stages):
    (_, before), (_, after) = stages[4], stages[5]
    tokenizer = packing.byte_tokenizer(packing.public_vocabulary())
    assert sum(r["length"] for r in after) == sum(len(tokenizer.encode(r["text"] or "")) // 4 + 1 for r in before)


def test_run_gives_the_last_stage(spark, stages):
    assert set(corpus_pipeline.run(spark, SF).columns) == set(stages[-1][0])
