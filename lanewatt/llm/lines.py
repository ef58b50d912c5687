"""Line dedup: document counts of line hashes in levelled sorted runs, and texts without their frequent lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_folder, once, quoted, remove_folder, spread_join, spread_left, stored, text_or_empty

# What is stripped from a line's ends, and the letters that are lower-cased.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n long, m long"
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    """128 bits of a key, the second half seeded apart."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Runs of (h1, h2, n, m): a line hash, its documents and its distinct texts in the batches that the run came from.

    A batch first merge-anti-joins all runs: hashes that have reached ``threshold`` documents there are settled and leave
    the batch. What is left is its own run, sorted by hash, on level 0. When a level holds ``fanout`` runs, they are merged
    into one run of the next level, so there are never more than ``fanout`` runs a level, and a hash is rewritten once a
    level. A run that was lost before its last file was written has no ``_SUCCESS`` mark and is not read; runs that were
    merged are named in the run that replaced them and are not read either, so a merge counts wholly or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: int = 10, fanout: int = 3):
        if threshold < 1 or fanout < 2:
            raise ValueError("threshold must be at least 1 and fanout at least 2")
        self.spark, self.folder, self.threshold, self.fanout = spark, folder or new_folder(spark, "line-runs"), threshold, fanout

    def _filesystem(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, str]]:
        """(level, name) of the runs that count; a name is ``level-id`` or ``level-id-of-id.id``, the latter a merged run."""
        path, fs = self._filesystem()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        names = [n for n in names if fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        replaced = {i for n in names if "-of-" in n for i in n.split("-of-")[1].split(".")}
        return sorted((int(n.split("-")[0]), n) for n in names if n.split("-")[1] not in replaced)

    def table(self, names: list[str] | None = None) -> DataFrame:
        names = [n for _, n in self.runs()] if names is None else names
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{n}" for n in names])

    def totals(self, names: list[str] | None = None) -> DataFrame:
        return self.table(names).groupBy(*HASH).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    def settled(self) -> DataFrame:
        return self.totals().where(F.col("n") >= self.threshold)

    def _write(self, run: DataFrame, name: str) -> None:
        run.sortWithinPartitions(*HASH).write.parquet(f"{self.folder}/{name}")

    def add(self, batch: DataFrame) -> None:
        """Add ``batch`` (h1, h2, n, m; each hash once) as a run, without what is settled; merge levels that are full."""
        known = [n for _, n in self.runs()]
        if known:
            batch = batch.join(self.settled().select(*HASH).hint("merge"), HASH, "left_anti")
        self._write(batch.select(*HASH, "n", "m"), f"0-{uuid.uuid4().hex}")
        level = 0
        while len(full := [n for at, n in self.runs() if at == level]) >= self.fanout:
            of = ".".join(n.split("-")[1] for n in full)
            self._write(self.totals(full), f"{level + 1}-{uuid.uuid4().hex}-of-{of}")
            level += 1


def text_keys(documents: DataFrame, text: str = "text", least_chars: int = 1) -> DataFrame:
    """(t1, t2, keys, n): every distinct text by its hash, the hashes of its distinct line keys, and its rows."""
    column = text_or_empty(text)
    keys = F.filter(F.transform(lines_of(column), line_key), lambda k: F.length(k) >= least_chars)
    rows = documents.select(line_hash(column).alias("t"), F.array_distinct(F.transform(keys, line_hash)).alias("keys"))
    return rows.groupBy(F.col("t.h1").alias("t1"), F.col("t.h2").alias("t2")).agg(F.first("keys").alias("keys"), F.count("*").alias("n"))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` less those whose key's hash is in ``drop``, which is dealt into the root of its size of lists, so that
    a text of many lines and many drops costs no product of the two."""
    buckets = F.ceil(F.sqrt(F.size(drop))).cast("long")

    def kept(lists: Column) -> Column:
        hashed = F.transform(lines, lambda line: F.struct(line.alias("line"), F.xxhash64(line_key(line)).alias("h")))
        left = F.filter(hashed, lambda x: ~F.array_contains(F.get(lists, F.pmod(x["h"], F.size(lists)).cast("int")), x["h"]))
        return F.transform(left, lambda x: x["line"])

    dealt = F.transform(F.sequence(F.lit(0).cast("long"), buckets - 1), lambda k: F.filter(drop, lambda h: F.pmod(h, buckets) == k))
    return F.when(F.size(drop) > 0, once(dealt, kept)).otherwise(lines)


def drop_frequent_lines(documents: DataFrame, threshold: int = 10, least_chars: int = 1, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """``documents`` with every line left out whose key, of ``least_chars`` code points at least, stands in ``threshold``
    documents or more, and columns ``n_lines`` (before) and ``n_dropped``.

    A key is a line stripped of white space at both ends, A-Z in lower case. Each row is a document of its own, whatever
    its doc_id; a line counts once a document. With ``runs`` of earlier deliveries their documents count too (and
    their threshold holds); these documents are added to them. Null texts count as empty and are one empty line, which
    stays; an empty table gives no rows. All columns are carried along; those named like the two results are replaced.

    1. One pass makes the line hashes of each distinct text; copies of a text are one row from there on, with a count.
    2. The texts are dealt by hash into ``batches``, each added to the runs, so that lines settled by one batch are not
       counted, shuffled or stored again by the next ones.
    3. The settled hashes meet the texts' hashes; what a text has of them goes back to the rows of that text. Only hashes
       travel, and lines or texts with a great share of the rows are joined apart.
    """
    spark = documents.sparkSession
    own = runs or LineRuns(spark, threshold=threshold)
    texts = stored(text_keys(documents, least_chars=least_chars), "line-keys")
    for k in range(batches):
        part = texts.where(F.pmod("t2", F.lit(batches)) == k).select("n", F.explode("keys").alias("key"))
        own.add(part.groupBy(F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).agg(F.sum("n").alias("n"), F.count("*").alias("m")))
    # a settled line's texts are known from the batch that settled it, a like share of all
    settled = stored(own.settled().select(*HASH, (F.col("m") * batches).alias("_n")), "settled-lines")
    pairs = texts.select("t1", "t2", F.explode("keys").alias("key")).select("t1", "t2", "key.h1", "key.h2")
    total = texts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    hit = spread_join(pairs, settled, HASH, total)
    drops = stored(hit.groupBy("t1", "t2").agg(F.collect_set("h1").alias("drop")), "line-drops")
    if runs is None:
        remove_folder(spark, own.folder)
    keep = [c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")]
    t1, t2, drop = (free_name([*documents.columns, "n_lines", "n_dropped"], c) for c in ("t1", "t2", "drop"))
    hashed = documents.select(*quoted(keep), F.xxhash64(text_or_empty()).alias(t1), F.xxhash64(F.lit(1), text_or_empty()).alias(t2))
    joined = spread_left(hashed, drops.toDF(t1, t2, drop), [t1, t2], texts.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("n").alias("_n")))
    lines = lines_of(F.col("text"))
    left = F.when(F.col(drop).isNotNull(), _without(lines, F.col(drop)))
    kept = free_name([*joined.columns, "n_lines", "n_dropped"], "kept")
    cut = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn(kept, left)
    return cut.select(
        *[c if name != "text" else F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text") for name, c in zip(keep, quoted(keep), strict=True)],
        "n_lines", F.when(F.col(kept).isNotNull(), F.col("n_lines") - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` its lines, those dropped, and the digest of the text that is left (null: empty)."""
    out = drop_frequent_lines(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))
