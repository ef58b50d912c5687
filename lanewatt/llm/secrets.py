"""Secret scanning over a ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, new_folder, once, quoted, spread_join, spread_left, stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """One kind of secret: a pattern, and a pattern that the (sub)group of a match must hold to count."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in their listed order. Keywords are spelt with both cases so that every regular
# expression engine folds ASCII letters only, and what they begin with is looked for first.
RULES = (
    Rule("assign", 1, r"""(?=[PpSsTtAa][AaEeOoPp][SsCcKkIi])([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
BLOCK = 256
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"
LEDGER = "blob_id binary, kind string, version int"
FINDINGS = "blob_id binary, kind string, version int, start long, end long"


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """All leftmost non-overlapping matches of a rule in a text as spans (code points, end exclusive), native.

    ``split`` gives the text between the matches and ``regexp_extract_all`` the matches; running lengths of both give the
    offsets; each is made once a text. Where a match that is too short can't hide a longer one, the length is put into
    the pattern, so that most texts show no match at all. Offsets run on within blocks of ``BLOCK`` matches, and from
    block to block, so time grows with the text's matches and not with their square.
    """
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+"):
        fixed = len(pattern.split("[")[0])
        pattern = f"{pattern[:-1]}{{{rule.least - fixed},}}"

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["len"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        found = F.when(p["group"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def block_spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step, lambda acc: acc["found"])

    def onward(starts: Column, block: Column) -> Column:
        length = F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + p["gap"] + p["len"])
        return F.concat(starts, F.array(F.element_at(starts, -1) + length))

    def cut(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)))

    def run_on(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0).cast("long")), onward)
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), block_spans))

    def pieces_of(raw: Column) -> Column:
        gaps = F.transform(F.slice(raw["gaps"], F.lit(1), F.size(raw["whole"])), lambda gap: F.length(gap))
        lengths = F.zip_with(gaps, raw["whole"], lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("len")))
        return F.zip_with(lengths, raw["part"], lambda p, g: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), F.length(g).alias("group")))

    raw = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("part"),
    )
    spans = once(raw, lambda r: once(pieces_of(r), lambda p: once(cut(p), run_on)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``blobs`` (blob_id, content, todo: the kinds to scan), one row a span."""
    found = F.concat(
        *[F.when(F.array_contains("todo", r.kind), _matches(F.col("content"), r, k)).otherwise(F.array().cast(SPAN)) for k, r in enumerate(rules)]
    )
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    return blobs.select("blob_id", F.explode(found).alias("s")).select(
        "blob_id", F.col("s.kind").alias("kind"), versions[F.col("s.kind")].alias("version"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )


class BlobLedger:
    """Tables ``scanned`` (blob, kind, rule version) and ``findings`` under one shared folder, both append-only.

    A scan appends its findings first and its ledger rows last. A scan lost between the two is done anew and its
    findings are appended again; readers take findings distinct, so they count once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "blob-ledger")

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        fields = ", ".join(f"CAST(NULL AS {kind}) AS {field}" for field, kind in (f.split() for f in schema.split(", ")))
        self.spark.sql(f"SELECT {fields} LIMIT 0").write.mode("append").parquet(path)  # so that a new ledger can be read
        return self.spark.read.schema(schema).parquet(path)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the contents in ``versions`` (path, content) that no earlier scan has seen under the rules' present versions.

        Returns (path, blob_id, spans), one row a row of ``versions``: spans by start, then the rules' order. Null
        contents count as empty; equal contents are scanned once, whatever their number and their paths; only ids, not
        contents, are grouped. A content is fetched from the path that has it on the fewest rows; where that path
        repeats it too, its rows are made one, within the tasks that read them first.
        """
        named = versions.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("blob_id", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
        paths = stored(named.select("path", "blob_id"), "paths")
        blobs = (
            paths.groupBy("blob_id", "path").agg(F.count("*").alias("n")).groupBy("blob_id").agg(F.min(F.struct("n", "path")).alias("from"), F.sum("n").alias("_n"))
        )
        blobs = stored(blobs, "blobs")
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        pairs = blobs.select("blob_id", "from", "_n", F.explode(wanted).alias("r")).select("blob_id", "from", "_n", "r.kind", "r.version")
        seen = self.table("scanned", LEDGER)
        unseen = stored(pairs.join(seen, ["blob_id", "kind", "version"], "left_anti").groupBy("blob_id", "from", "_n").agg(F.collect_set("kind").alias("todo")), "unseen")
        total = blobs.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        single, repeated = unseen.where("from.n = 1").alias("u"), unseen.where("from.n > 1")
        fresh = named.alias("v").join(single, F.col("v.path").eqNullSafe(F.col("u.from.path")) & (F.col("v.blob_id") == F.col("u.blob_id"))).select("v.blob_id", "content", "todo")
        again = spread_join(named, repeated, "blob_id", total).where(F.col("path").eqNullSafe(F.col("from.path")))
        again = again.groupBy("blob_id").agg(F.first("content").alias("content"), F.first("todo").alias("todo"))
        scan_blobs(fresh.unionByName(again), rules).write.mode("append").parquet(f"{self.folder}/findings")
        version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        unseen.select("blob_id", F.explode("todo").alias("kind")).select("blob_id", "kind", version[F.col("kind")].alias("version")).write.mode("append").parquet(f"{self.folder}/scanned")
        return self.by_path(paths, rules, blobs.select("blob_id", "_n"))

    def by_path(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES, counts: DataFrame | None = None) -> DataFrame:
        """Join the findings of the rules' present versions back to every path of a blob; a blob on a great share of the
        paths (``counts`` has each one's as ``_n``) is joined apart."""
        rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
        current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
        spans = (
            self.table("findings", FINDINGS).where(current).distinct()
            .groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))
        )  # grouped by blob: as many as one text's matches
        if counts is None:
            counts = paths.groupBy("blob_id").agg(F.count("*").alias("_n"))
        return spread_left(paths, spans, "blob_id", counts).select("path", "blob_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def document_secrets(documents: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Per row of ``documents``: counts by kind and all spans, as ``kind:start:end`` joined by commas.

    With a ``ledger`` of earlier scans only unseen blobs and rule versions are scanned; without one a new ledger is made.
    Null texts count as empty, repeated rows and rows without a doc_id have their rows, columns beside doc_id and text
    are left out, and an empty table gives no rows.
    """
    ledger = ledger or BlobLedger(documents.sparkSession)
    found = ledger.scan(documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("path").cast("long").alias("doc_id"), _count("assign").alias("n_assign"), _count("access").alias("n_access"), _count("hex").alias("n_hex"),
        F.sha2(said.cast("binary"), 256).alias("base_sha256"), said.alias("spans"),
    )


def merged(spans: DataFrame) -> DataFrame:
    """(blob_id, cuts): the runs of overlapping spans of ``spans`` (blob_id, start, end), sorted and disjoint."""
    order = Window.partitionBy("blob_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.select("blob_id", "start", "end", (reach.isNull() | (F.col("start") >= reach)).cast("int").alias("fresh"))
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = begun.withColumn("run", run).groupBy("blob_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # as many as one text's matches


def redact(text: Column, cuts: Column, mask: str = "[secret]") -> Column:
    """``text`` with each of the sorted, disjoint ``cuts`` replaced by ``mask``; native, and linear in the text.

    The text is cut as UTF-32, where the place of a code point is known, and the pieces are joined at once.
    """

    def piece(units: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)["end"])
        end = F.coalesce(F.get(cuts, k)["start"], F.octet_length(units) / 4)
        part = F.substring(units, (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), part), "UTF-32")  # a byte-order mark, so that none of the text's own is one

    def join(units: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: piece(units, k)), mask)

    return F.when(F.size(cuts) > 0, once(F.encode(text, "UTF-32"), join)).otherwise(text)


def redact_documents(documents: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """``documents`` with every secret in their texts masked, and n_chars set to match; no row is dropped.

    Rows find their spans by the content's address, so repeated or null ids do no harm. Texts without a secret, null
    ones too, stay as they are. A text on a great share of the rows is joined apart.
    """
    ledger = ledger or BlobLedger(documents.sparkSession)
    found = ledger.scan(documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    blob, cuts = free_name(documents.columns, "blob_address"), free_name(documents.columns, "secret_spans")
    spans = found.where(F.size("spans") > 0).groupBy("blob_id").agg(F.first("spans").alias("spans")).select("blob_id", F.explode("spans").alias("s"))
    dirty = stored(merged(spans.select("blob_id", "s.start", "s.end")).toDF(blob, cuts), "dirty")
    masked = documents.withColumn(blob, F.unhex(F.sha2(text_or_empty().cast("binary"), 256)))
    masked = spread_left(masked, dirty, blob, found.groupBy(F.col("blob_id").alias(blob)).agg(F.count("*").alias("_n")))
    text = F.when(F.col(cuts).isNotNull(), redact(F.col("text"), F.col(cuts))).otherwise(F.col("text"))
    out = masked.withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*quoted(documents.columns))
