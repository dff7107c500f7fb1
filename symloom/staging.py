"""Written tables in the shared folder, used to cut lineage between rounds of a loop."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Keys of which hashes are sent to every task, to leave out rows that can't join.
SMALL = 4_000_000


def near(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without those that have no partner in ``keys``, as far as hashes tell, while there are few ``keys``; else all.

    A join on the columns of ``keys`` must follow.
    """
    if keys.count() > SMALL:
        return rows
    one = F.xxhash64(*[F.col(c) for c in keys.columns])
    return rows.join(F.broadcast(keys.select(one.alias("_near")).distinct()), one == F.col("_near"), "left_semi")


def stage(df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder, in folders of column ``by`` if given, and reads it back.

    The files outlive lost executors.  They go with ``discard``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symloom/{uuid.uuid4().hex}"
    write = df.write.option("compression", codec) if codec else df.write
    (write.partitionBy(by) if by else write).parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._symloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_symloom_path", None)
        spark = _written.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now; the next may not
            continue
