"""New recordings as a stream: a table that grows by the keys it lacks, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def grow(stream: DataFrame, table: str, key: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Appends extract() of the keys that the table lacks, batch by batch; a batch that is tried again adds nothing."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(table).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = rows.select(key).limit(0)
        extract(rows.join(known, key, "left_anti")).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, group: str) -> DataFrame:
    """Rows and mean value of each group in each window; rows later than `late` are not waited for."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n"))
