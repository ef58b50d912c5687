"""Landing by parts, marker files by ranges, matrices by blocks, blocks of columns."""

import io
import json
import os

import pytest
from lanewatt.sources import ingest, landing, ranges, scratch
from pyspark.sql import functions as F

ROWS = "station_id long, ts timestamp_ntz, v double"


def rows(spark, *items):
    return spark.createDataFrame([(s, t, float(v)) for s, t, v in items], "station_id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs}


def test_deliveries_touch_their_own_parts_only(spark, tmp_path):
    table = landing.StationMonths(spark, f"file://{tmp_path}/t", buckets=1)
    assert table.read() is None and table.land(rows(spark)) == {}
    table.land(rows(spark, (1, "2024-01-05 00:00", 1), (1, "2024-02-01 00:00", 2), (2, "2024-02-01 00:00", 3), (2, "2024-02-01 00:00", 3)))
    before = files(tmp_path / "t" / "data")
    touched = table.land(rows(spark, (1, "2024-02-01 00:00", 2), (1, "2024-03-01 00:00", 4)).withColumn("extra", F.lit("x")))
    assert set(touched) == {("2024-02", 0), ("2024-03", 0)} and table.version() == 2
    after = files(tmp_path / "t" / "data")
    assert all(after[f] == at for f, at in before.items())  # nothing that was written has changed
    got = sorted((r["station_id"], str(r["ts"])[:7], r["v"], r["extra"] or "") for r in table.read().collect())
    assert got == [(1, "2024-01", 1.0, ""), (1, "2024-02", 2.0, ""), (1, "2024-02", 2.0, "x"), (1, "2024-03", 4.0, "x"), (2, "2024-02", 3.0, "")]
    assert table.read(1).count() == 3 and table.manifest()[("2024-01", 0)] != table.manifest()[("2024-02", 0)]
    with pytest.raises(ValueError, match="without"):
        table.land(rows(spark, (None, "2024-01-05 00:00", 1)))


def test_a_delivery_that_lost_the_race_changes_nothing(spark, tmp_path):
    table = landing.StationMonths(spark, f"file://{tmp_path}/t")
    table.land(rows(spark, (1, "2024-01-05 00:00", 1)))
    with pytest.raises(RuntimeError, match="another delivery"):
        table._swap_in({("2024-01", 0): "gone"}, 1)
    assert table.read().count() == 1


def features(n):
    out = []
    for k in range(n):
        note = ['{"properties": {}, "geometry": {}}', "ü { [", 'a "quoted" \\ text', "x" * (k * 7 % 300)][k % 4]
        own = {"type": "Feature", "properties": {"note": note, "Route": f"I {k % 3}", "PM": k / 4}, "geometry": {"type": "Point", "coordinates": [-118 - k / 100, 34.5]}}
        out.append(dict(reversed(own.items())) if k % 5 == 0 else own)
    return out


@pytest.mark.parametrize("size", [1, 37, 500, 4096, 10**6])
def test_every_feature_is_in_one_range(size):
    want = features(60)
    raw = json.dumps({"type": "FeatureCollection", "name": "{", "features": want}, ensure_ascii=False).encode()
    got = [f for lo in range(0, len(raw), size) for f in ranges.feature_rows(io.BytesIO(raw), len(raw), lo, min(lo + size, len(raw)))]
    assert [f for _, f in got] == want and len({at for at, _ in got}) == 60
    assert all(raw[at : at + 1] == b"{" for at, _ in got)


def test_broken_features_are_told_and_others_read(spark, tmp_path):
    text = json.dumps({"features": features(40)})
    broken = text.replace('"I 1", "PM": 1.0', '"I 1", "PM": oops', 1).replace('"PM": 2.5', '"PM": null', 1)[:-300]  # and cut off
    (tmp_path / "m.json").write_text(broken)
    good, bad = ingest.read_marker_ranges(spark, f"file://{tmp_path}/m.json", [0, 1, 2], 700)
    assert good.rdd.getNumPartitions() > 5
    problems = [r["problem"] for r in bad.orderBy("offset").collect()]
    assert any(p.startswith("not JSON") for p in problems) and "no PM" in problems
    assert good.count() >= 36 and good.where("pm = 1.0").count() == 0


def test_a_matrix_is_numbered_over_its_blocks(spark, tmp_path):
    lines = [",".join(str(r * 3 + c) for c in range(3)) for r in range(900)] + ["", " "]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted(tuple(r) for r in ingest.read_matrix_csv(spark, str(tmp_path / "m.csv")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [(r, c, float(r * 3 + c)) for r in range(900) for c in range(3)]


def test_blocks_of_columns_and_back(spark):
    long = spark.createDataFrame([(t, c, float(t + c)) for t in range(3) for c in (0, 1, 7, 8, 200)], "step long, cell long, v double")
    blocks = ingest.long_to_blocks(long, "step", "v", 8)
    assert blocks.count() == 9 and {len(r["values"]) for r in blocks.collect()} == {8}
    assert sorted(ingest.blocks_to_long(blocks, "step", "v", 8).collect()) == sorted(long.collect())
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    assert sorted(tuple(r) for r in ingest.blocks_to_long(blocks, "step", "v", 8, cells).collect()) == [(t, c, float(t + 1) if c == 1 else 0.0) for t in range(3) for c in (1, 2)]


def test_a_job_leaves_no_scratch_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    with pytest.raises(RuntimeError), scratch.scratch_job(spark):
        kept = scratch.written(spark.range(3), "outer")
        with scratch.scratch_job(spark):
            assert scratch.written(spark.range(5), "inner").count() == 5
        assert kept.count() == 3 and not any(n.startswith("inner") for n in set(os.listdir(root)) - before)
        raise RuntimeError
    assert set(os.listdir(root)) == before
