"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most characters of a sample's texts together.
SAMPLE_CHARS = 40_000_000


def held_out():
    """Whether a doc_id is kept from learning: crc32 of its decimal digits, modulo 5, is 0. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _within_batches(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    used, seen = {}, set()
    for batch in batches:
        keep = []
        for n, y in zip(pc.utf8_length(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.add(y)
            keep.append(used.get(y, 0) + n <= share)
            if keep[-1]:
                used[y] = used.get(y, 0) + n
        yield batch.filter(pa.array(keep, pa.bool_()))
    if seen - set(used):
        raise ValueError(f"no labelled text of class {sorted(seen - set(used))} fits into {share} characters")


def training_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label) in one partition: up to ``per_class`` whole texts labelled 0 and labelled 1, chosen by a hash of
    their ids; never held-out rows.

    Each class has half of the characters. A text that no longer fits into them is passed over whole and the list goes
    on; a class of which no text fits is an error. Ids that are null, or labelled both ways, are not learnt from.
    """
    told = (
        labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("_high")).where("label = _high").where(~held_out())
        .select("doc_id", "label", F.xxhash64("doc_id").alias("_order"))
    )
    picked = None
    for value in (0, 1):
        part = told.where(F.col("label") == value).orderBy("_order", "doc_id").limit(per_class[value])
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most sum(per_class) ids are sent: a bound that does not grow with the data
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "_order").agg(F.min("text").alias("text"))
    in_order = rows.select("text", "label", "_order", "doc_id").repartition(1).sortWithinPartitions("_order", "doc_id").select("text", "label")
    return in_order.mapInArrow(partial(_within_batches, share=chars // 2), in_order.schema)  # over sum(per_class) rows at most


def _fit_batches(batches: Iterator[pa.RecordBatch], fit: Callable) -> Iterator[pa.RecordBatch]:
    rows = [(t, int(y)) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])


def fitted(sample: DataFrame, fit: Callable):
    """The model that ``fit`` makes of the sample's rows, fitted in one task: the sample is bounded, and the driver gets
    the model alone. A lost executor costs the fit, which is run again and gives the same."""
    made = sample.mapInArrow(partial(_fit_batches, fit=fit), "model binary").limit(1).collect()
    return pickle.loads(made[0]["model"]) if made else fit([])
