"""Streams over a folder or file of events. Each run drains what is there and returns the table the stream wrote.

The stream's table and checkpoint lie under ``spark.checkpoint.dir``; only where
that is unset, as in local tests, under a temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.session import shared_folder


def _events(spark: SparkSession, path: str) -> DataFrame:
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, mode: str, write) -> str:
    """Run a stream over everything available; ``write(batch, epoch, folder)`` stores each batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, epoch: write(batch, epoch, folder)).start()
    query.awaitTermination()
    return folder


def _upsert(batch: DataFrame, epoch: int, folder: str) -> None:
    """Every epoch's rows in a folder of their own, so that a repeated epoch replaces itself."""
    batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")


def _stored(stream: DataFrame, folder: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last epoch."""
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("r")).select(*keys, "r.*")


def latest_wins(spark: SparkSession, path: str) -> DataFrame:
    """user_id, ts, event_type of each user's newest event."""
    stream = _events(spark, path).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.ts", "m.event_type")
    folder = _drain(stream, "update", _upsert)
    return _newest(_stored(stream, folder), ["user_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def hourly_counts(spark: SparkSession, path: str, lateness: str = "3650 days") -> DataFrame:
    """start, event_type, n: events of each hour; later ones than ``lateness`` are left out."""
    stream = _events(spark, path).withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    folder = _drain(stream, "update", _upsert)
    return _newest(_stored(stream, folder), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def reactive_counts(spark: SparkSession, path: str) -> DataFrame:
    """event_type, n, kept up to date as events arrive."""
    stream = _events(spark, path).groupBy("event_type").agg(F.count("*").alias("n"))
    folder = _drain(stream, "update", _upsert)
    return _newest(_stored(stream, folder), ["event_type"])


def first_of_key(spark: SparkSession, path: str, lateness: str = "3650 days") -> DataFrame:
    """user_id, event_type: the first of each key passes, repeats within the lateness don't."""
    stream = _events(spark, path).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    folder = _drain(stream, "append", _upsert)
    return _stored(stream, folder).select("user_id", "event_type")
