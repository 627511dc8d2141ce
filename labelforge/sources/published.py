"""Several tables made visible at once. A version's tables are written beside the old ones, then its manifest; readers take the
newest version that has a complete manifest, so a crash between the writes leaves what was visible before.

Defined cases: without any complete manifest there is no version; a version that was begun and not finished is never read,
its number is not used again, and `publish` may simply be called anew; empty tables are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, folder: str, ended: bool) -> list[int]:
    """Numbers of the folders version=N; with `ended`, of those whose writer has set its mark of success."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return [int(p.getName().split("=")[1]) for p in found if not ended or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def current(spark: SparkSession, root: str) -> int | None:
    return max(_versions(spark, f"{root}/_manifest", True), default=None)


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Writes all tables as one new version and then makes it visible; its number."""
    spark = next(iter(tables.values())).sparkSession
    begun = [v for name in [*tables, "_manifest"] for v in _versions(spark, f"{root}/{name}", False)]
    version = max(begun, default=0) + 1
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/version={version}")
    spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1).write.parquet(f"{root}/_manifest/version={version}")
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the visible version; an error where there is none or it lacks the table."""
    version = current(spark, root)
    if version is None or spark.read.parquet(f"{root}/_manifest/version={version}").where(F.col("name") == name).isEmpty():
        raise LookupError(f"{root} has no visible table {name}")
    return spark.read.parquet(f"{root}/{name}/version={version}")
