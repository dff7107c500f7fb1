"""Triples that arrive as a stream: running counts and an append-only store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.schema import TRIPLE


def read(spark, path: str) -> DataFrame:
    """New Parquet files of triples under ``path``."""
    return spark.readStream.schema(TRIPLE).parquet(path)


def counts(stream: DataFrame) -> DataFrame:
    """predicate, n: triples so far; the state holds one row for each predicate of the vocabulary."""
    return stream.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def append_store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch to a predicate-partitioned store; file sinks commit a batch once."""
    named = stream.withColumn("p", F.regexp_extract("predicate", r"([^/#]+)$", 1))
    return named.writeStream.partitionBy("p").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=path, format="parquet", outputMode="append")


def append_known_once(stream: DataFrame, known_path: str, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the triples of subjects that no earlier batch had, as a repeated extraction does.

    ``known_path`` keeps the subjects seen, a folder for each batch, so that a batch done again
    after a failure overwrites its own and compares with the earlier ones alone.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], "subject string")
        if number:
            try:
                known = spark.read.schema("subject string, batch long").parquet(known_path).where(F.col("batch") < number).select("subject").distinct()
            except Exception as missing:  # nothing has been written yet
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
        batch.join(known, "subject", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.select("subject").distinct().write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
