"""Symbol tables from Parquet or JSON, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.schema import TABLES


class AssemblyNotFound(FileNotFoundError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All symbol tables under ``path`` as ``name.parquet`` or ``name.json``; tables without file are empty."""
    if not exists(spark, path):
        raise AssemblyNotFound(f"Assembly not found: {path}")
    out = {}
    for name, schema in TABLES.items():
        for kind in ("parquet", "json"):
            if exists(spark, f"{path}/{name}.{kind}"):
                out[name] = spark.read.schema(schema).format(kind).load(f"{path}/{name}.{kind}")
                break
        else:
            out[name] = spark.createDataFrame([], schema)
    return out


def of_rows(spark: SparkSession, **rows: list[dict]) -> dict[str, DataFrame]:
    """Symbol tables of plain Python rows; missing columns are null."""
    out = {}
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        own = [tuple(r.get(f) for f in empty.columns) for r in rows.get(name, [])]
        out[name] = spark.createDataFrame(own, schema)
    return out
