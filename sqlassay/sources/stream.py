"""Check results arriving over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sqlassay.session import fresh_path


def check_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 64
) -> DataFrame:
    """Parquet files of check results as a stream, a bounded number of files per batch.

    A batch holds the rows of one check in one task, so its size bounds that task.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the written rows.

    Output and progress go to the shared folder, so a restarted run goes on from there.
    """
    spark = stream.sparkSession
    target = fresh_path(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{target}-progress").start(f"{target}-rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}-rows")
