"""Streams over several files against their batch twins."""

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from numberboard.operators.classify import classify
from numberboard.operators.latest import current_price
from numberboard.plans.changes import admit_new_plates
from numberboard.sources.fixtures import derive
from numberboard.streaming import jobs as ST
from numberboard.streaming.epochs import EpochTable

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return derive(spark, SF_DIR)


def in_files(df, order, path, parts=3):
    """Write a batch as files of increasing order, the oldest first."""
    edges = df.approxQuantile(order, [part / parts for part in range(1, parts)], 0.0)
    low = float("-inf")
    for high in [*edges, float("inf")]:
        part = df.where((F.col(order) > low) & (F.col(order) <= high))
        part.coalesce(1).write.mode("append").parquet(path)
        low = high


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_admission_over_files(spark, views, tmp_path):
    batch, plates = views["new_plates_batch"], views["plates"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(batch, "request_id", source)
    stream = ST.read_stream(spark, source, batch.schema, files_per_batch=1)
    ST.stream_admit(stream, plates, out, str(tmp_path / "checkpoint"))
    twin = admit_new_plates(batch, plates)
    decided = ST.read_epochs(spark, out, twin.schema)
    assert decided.select("epoch").distinct().count() == 3
    assert rows(decided.select("request_id", "status", "plates_id").fillna(-1)) == rows(
        twin.select("request_id", "status", "plates_id").fillna(-1)
    )


def test_price_over_files(spark, views, tmp_path):
    prices = views["price_rows"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(prices, "price", source)
    checkpoint = str(tmp_path / "checkpoint")
    stream = ST.read_stream(spark, source, prices.schema, files_per_batch=1)
    ST.run_latest_price(stream, out, checkpoint)
    twin = current_price(views["price_history"]).select("plates_id", "price_history_id", "price")
    assert rows(ST.read_latest_price(spark, out)) == rows(twin)
    # New prices continue from the stored state.
    newer = spark.createDataFrame([(2_000_000_000, 5, 77)], "price_history_id int, plates_id int, price int")
    newer.selectExpr("*", "TIMESTAMP_NTZ '2024-06-01' AS add_date").write.mode("append").parquet(source)
    ST.run_latest_price(stream, out, checkpoint)
    latest = {row.plates_id: row.price for row in ST.read_latest_price(spark, out).collect()}
    assert latest[5] == 77 and len(latest) == len({*latest})


def test_classify_over_files(spark, views, tmp_path):
    plates = views["plates"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(plates, "plates_id", source)
    stream = ST.read_stream(spark, source, plates.schema, files_per_batch=1)
    ST.run_to_table(ST.stream_classify(stream), out, str(tmp_path / "checkpoint"))
    assert rows(spark.read.parquet(out)) == rows(classify(plates))


def test_admission_folds_and_prunes(spark, views, tmp_path):
    """Many micro-batches: decisions as of one batch, folded folders, and a retry that changes nothing."""
    batch, plates = views["new_plates_batch"].limit(60).cache(), views["plates"]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(batch, "request_id", source, parts=6)
    stream = ST.read_stream(spark, source, batch.schema, files_per_batch=1)
    ST.stream_admit(stream, plates, out, str(tmp_path / "checkpoint"), buckets=4, fan=2)
    twin = admit_new_plates(batch, plates)
    decided = ST.read_epochs(spark, out, twin.schema)
    columns = ["request_id", "status", "plates_id"]
    assert rows(decided.select(*columns).fillna(-1)) == rows(twin.select(*columns).fillna(-1))
    folders = sorted(p.relative_to(tmp_path).as_posix() for p in (tmp_path / "out-state/admitted").glob("level=*/group=*"))
    assert [f.split("admitted/")[1] for f in folders] == ["level=0/group=4", "level=0/group=5", "level=1/group=2", "level=2/group=0"]


def test_arrivals_are_written_by_many_tasks_in_order(spark, tmp_path):
    """Each part comes in several files, and one run of the stream takes them as one micro-batch."""
    prices = spark.range(4_000, numPartitions=4).selectExpr(
        "CAST(id AS INT) AS price_history_id", "CAST(id % 7 AS INT) AS plates_id", "CAST((id * 7919) % 4000 AS INT) AS price"
    )
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    seen, top = set(), -1
    for epoch, _ in enumerate(ST.arrivals(prices, "price", source)):
        new = {str(p) for p in (tmp_path / "in").glob("*.parquet")} - seen
        part = spark.read.parquet(*new).agg(F.min("price"), F.max("price")).first()
        assert len(new) == 4 and part[0] > top
        seen, top = seen | new, part[1]
        ST.run_latest_price(ST.read_stream(spark, source, prices.schema), out, checkpoint, fan=2)
        assert ST.last_epoch(spark, f"{out}/done") == epoch
    assert epoch == 3 and spark.read.parquet(source).count() == 4_000
    assert rows(ST.read_latest_price(spark, out, fan=2)) == rows(current_price(prices))


def test_folders_follow_the_digits(spark, tmp_path):
    table = EpochTable(str(tmp_path), T.StructType.fromDDL("k int, v int"), lambda r: r.groupBy("k").agg(F.max("v").alias("v")), fan=3)
    for epoch in range(11):
        table.write(spark.createDataFrame([(epoch % 2, epoch), (5, epoch)], "k int, v int"), epoch)
        if epoch in (2, 4, 8, 10):  # a retry of the newest micro-batch
            table.write(spark.createDataFrame([(epoch % 2, epoch), (5, epoch)], "k int, v int"), epoch)
        newest = {r.k: r.v for r in table.read(spark, epoch + 1).groupBy("k").agg(F.max("v").alias("v")).collect()}
        assert newest == {k: v for k, v in ((5, epoch), (epoch % 2, epoch), ((epoch - 1) % 2, epoch - 1)) if v >= 0}
    assert table.folders(11) == [(2, 0), (0, 9), (0, 10)]
    assert table.read(spark, 11).count() == 3 + 4
    assert not (tmp_path / "level=0/group=0").exists() and table.read(spark, 0).count() == 0
