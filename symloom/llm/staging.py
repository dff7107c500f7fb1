"""Written tables in the shared folder, used to cut lineage between steps of an operator."""

from pyspark.sql import SparkSession

from symloom.staging import discard, shared_dir, stage

__all__ = ["discard", "shared_dir", "small_batches", "stage"]

BATCH = 1024  # rows sent to a Python worker at a time


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends ``BATCH`` rows at a time to Python workers, or fewer if it was set so.

    Executors hold a batch outside the heap, and workers two, whole texts included.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)
