"""Symbol tables of an assembly together with those of the assemblies it refers to.

An assembly is a folder ``NAME`` of symbol tables; its table ``manifest`` (assembly, name ..) tells
what it refers to.  Ids mean the same symbol in every folder, so a table may repeat rows of another
assembly's: the loaded assembly's own win, then one of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.operators import closure
from symloom.schema import TABLES
from symloom.sources import tables

#: Tables that others contribute to, by key.  The rest describe members and types in full, and only the loaded assembly's are.
SHARED = {"assemblies": ["asm_id"], "namespaces": ["ns_id"], "types": ["type_id"], "type_args": ["type_id", "pos"], "members": ["member_id"], "params": ["owner_member_id", "ordinal"]}


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _children(spark: SparkSession, path: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [f.getPath().toString() for f in found if f.isDirectory()] if found else []


class Loader:
    """Loads assemblies.  Search folders, a loaded assembly's own among them, stay for later loads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.references, self.search = spark, [], []

    def add_reference(self, path: str) -> None:
        """A folder to load after all that is referred to; ignored where there is none."""
        if tables.exists(self.spark, path):
            self.references.append(path.rstrip("/"))

    def add_search_dir(self, path: str) -> None:
        if tables.exists(self.spark, path):
            self.search.append(path.rstrip("/"))

    def paths(self, path: str) -> list[str]:
        """Folders of the assemblies that ``path`` needs, itself left out.

        Names are compared without case and looked up in the search folders in order.  Listings
        and the result are names of assemblies, no rows.
        """
        path = path.rstrip("/")
        self.search.append(path.rsplit("/", 1)[0] if "/" in path else ".")
        first = {_name(path).lower(): path}
        for folder in self.search:
            for child in _children(self.spark, folder):
                first.setdefault(_name(child).lower(), child)
        extra: dict[str, str] = {}
        for more in self.references:
            extra.setdefault(_name(more).lower(), more)
        rows = lambda pairs: self.spark.createDataFrame([(*p, 0) for p in pairs.items()], "name string, path string, dir_rank int")
        refs = self._manifests([p for p in first.values() if p != path]).where(F.lower("assembly") != _name(path).lower())
        refs = refs.select(F.col("assembly").alias("name"), F.col("name").alias("ref")).unionByName(self._manifests([path]).select(F.lit(_name(path)).alias("name"), F.col("name").alias("ref")))
        root = self.spark.createDataFrame([(_name(path),)], "name string")
        found = closure.assembly_closure(root, refs, rows(first).withColumnRenamed("name", "file_name"), rows(extra).drop("dir_rank"))
        return sorted(r.path for r in found.collect() if r.path != path)

    def _manifests(self, folders: list[str]) -> DataFrame:
        return self._read("manifest", folders)

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        """One table of many folders, in one scan of each format."""
        parts = [self.spark.createDataFrame([], TABLES[name])]
        left = folders
        for kind in ("parquet", "json"):
            here = [p for p in left if tables.exists(self.spark, f"{p}/{name}.{kind}")]
            left = [p for p in left if p not in here]
            if here:
                parts.append(self.spark.read.schema(TABLES[name]).format(kind).load([f"{p}/{name}.{kind}" for p in here]))
        return reduce(DataFrame.unionByName, parts)

    def load(self, path: str) -> dict[str, DataFrame]:
        """The symbol tables of ``path``, its references' rows added; only its own assemblies are targets."""
        own = tables.load(self.spark, path)
        others = self.paths(path)
        if not others:
            return own
        for name, key in SHARED.items():
            more = self._read(name, others)
            if name == "assemblies":
                more = more.withColumn("is_target", F.lit(False))
            if name == "types":
                more = more.withColumn("walk_rank", F.lit(None).cast("long"))
            place = Window.partitionBy(*key).orderBy(*more.columns)
            more = more.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
            own[name] = own[name].unionByName(more.join(own[name].select(*key), key, "left_anti").select(*own[name].columns))
        return own
