"""The engine's windows, sessions and deduplication over streams. Late rows are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_folder, shared_folder


def sliding(events: DataFrame, at: str, value: str, length: str = "30 days", step: str = "1 day", late: str = "1 day", keys: list[str] = ()) -> DataFrame:
    """n and mean of each backward window that ends at a step."""
    w = F.window(at, length, step)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.end").alias("end"), *keys, "n", "mean")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    s = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(s, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_key(events: DataFrame, at: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: work that is repeated after a failure counts once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def to_shared(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it has written: in complete mode the rows of the last batch, else those of all.

    Rows and state go from the tasks to the shared folder, not to the driver. A batch that is repeated replaces its own rows.
    """
    spark = stream.sparkSession
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "stream-state")
    batches: dict[int, str] = {}

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{batch}")
        batches[batch] = f"{path}/{batch}"

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        drop_folder(spark, state)
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*([batches[max(batches)]] if mode == "complete" else batches.values()))
