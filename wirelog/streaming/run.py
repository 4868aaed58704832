"""Running a finite stream to its end and reading the result back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelog.session import scratch_path


def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process what the sources hold now. In update mode every row keeps the number of the
    micro-batch that wrote it in ``batch``."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if output_mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

        query = writer.outputMode(output_mode).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(path)
