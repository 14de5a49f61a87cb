"""The event-at-a-time jobs as Structured Streaming queries over a file source.

Each has a batch twin that gives the same rows. Sinks are Parquet folders, one per micro-batch where
a batch may be retried: a retry overwrites its own folder, so nothing is delivered twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PLATE_IDENTITY
from ..operators.classify import classify
from ..plans.changes import admit_against
from .epochs import FAN, EpochTable, last_epoch

#: Buckets of listed identities.
BUCKETS = 16
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    files: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def arrivals(df: DataFrame, order: str, path: str, parts: int = 4) -> Iterator[None]:
    """Write a table to a folder in the order of a column, a part at a time; run the stream after each.

    Every part is written by as many tasks as read it. Their files need no order among themselves, since a run
    of the stream takes all files that are new as one micro-batch.
    """
    low = float("-inf")
    for high in [*df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.001), float("inf")]:
        df.where((F.col(order) > low) & (F.col(order) <= high)).write.mode("append").parquet(path)
        yield
        low = high


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that has arrived to a Parquet table, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str, checkpoint: str
) -> None:
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_epochs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the micro-batches have written so far, with their ``epoch``; empty before the first one."""
    dated = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    try:
        return spark.read.schema(dated).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], dated)
        raise


# -- classify ----------------------------------------------------------------------------------


def stream_classify(plates_stream: DataFrame) -> DataFrame:
    """Pattern memberships of plates as they arrive: stateless, the batch expressions unchanged."""
    return classify(plates_stream)


# -- admission ---------------------------------------------------------------------------------


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PLATE_IDENTITY), F.lit(buckets)).cast("int").alias("bucket")


def stream_admit(
    batch_stream: DataFrame, plates: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, fan: int = FAN
) -> None:
    """Admit plates as they arrive; an identity once listed is never forgotten.

    Each micro-batch is decided in request order against the catalogue and the earlier micro-batches.
    Files must be offered in request order. The catalogue's identities are written once, by buckets of
    their hash, before the first micro-batch; what later ones admit goes to folders that fold as they grow.
    A micro-batch reads the buckets that its requests fall into, no other column, and the highest id from the
    state that the one before has left, so its work follows the batch. Choose ``buckets`` by
    the catalogue: about a million identities each.
    """
    spark = plates.sparkSession
    listed_schema = T.StructType([*plates.select(*PLATE_IDENTITY).schema.fields, T.StructField("bucket", T.IntegerType())])
    state, base = f"{path}-state", f"{path}-state/catalogue"
    admitted = EpochTable(f"{state}/admitted", listed_schema, partition=("bucket",), fan=fan)
    if last_epoch(spark, f"{state}/highest") < 0:  # the mark of the catalogue, as if of a micro-batch 0, comes last
        listed = plates.select(*PLATE_IDENTITY, _bucket(buckets)).distinct()
        listed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(base)
        top = plates.agg(F.coalesce(F.max("plates_id"), F.lit(0)).cast("long").alias("plates_id"))
        top.write.mode("overwrite").parquet(f"{state}/highest/epoch=0")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        touched = [row.bucket for row in batch.select(_bucket(buckets)).distinct().collect()]  # at most ``buckets``
        catalogue = spark.read.schema(listed_schema).parquet(base)
        known = catalogue.unionByName(admitted.read(spark, epoch)).where(F.col("bucket").isin(touched)).drop("bucket")
        highest = spark.read.schema("plates_id long").parquet(f"{state}/highest/epoch={epoch}").first().plates_id
        decisions = admit_against(batch, known, F.lit(highest))
        decisions.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        new = spark.read.schema(decisions.schema).parquet(f"{path}/epoch={epoch}").where(F.col("status") == "admitted")
        admitted.write(new.select(*PLATE_IDENTITY, _bucket(buckets)), epoch)
        top = new.agg(F.coalesce(F.max("plates_id"), F.lit(highest)).cast("long").alias("plates_id"))
        top.write.mode("overwrite").parquet(f"{state}/highest/epoch={epoch + 1}")

    run_each_batch(batch_stream, handle, "append", checkpoint)


# -- current price -----------------------------------------------------------------------------


def stream_latest_price(price_stream: DataFrame) -> DataFrame:
    """Running current price per plate. State: one row per plate. Equal ids keep the higher price."""
    newest = F.max(F.struct("price_history_id", "price")).alias("_newest")
    return price_stream.groupBy("plates_id").agg(newest).select("plates_id", "_newest.*")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest price of each plate. Prices only get newer, so this is what the last micro-batch that names it wrote."""
    return stream_latest_price(rows).select(LATEST_PRICE_SCHEMA.names)


def _prices(path: str, fan: int) -> EpochTable:
    return EpochTable(f"{path}/prices", LATEST_PRICE_SCHEMA, _newest, fan=fan)


def run_latest_price(price_stream: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> None:
    """Write the plates whose price changed in each micro-batch; folders fold to the newest row per plate.

    The running state is kept by RocksDB, on disk and not on the heap: a cluster's disks bound it.
    """
    table, spark = _prices(path, fan), price_stream.sparkSession

    def handle(changed: DataFrame, epoch: int) -> None:
        spark = changed.sparkSession
        table.write(changed, epoch)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done/epoch={epoch}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        run_each_batch(stream_latest_price(price_stream), handle, "update", checkpoint)
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


LATEST_PRICE_SCHEMA = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in ("plates_id", "price_history_id", "price")]
)


def read_latest_price(spark: SparkSession, path: str, fan: int = FAN) -> DataFrame:
    """Current price per plate, from at most fan - 1 folders of each level."""
    return _newest(_prices(path, fan).read(spark, last_epoch(spark, f"{path}/done") + 1))
