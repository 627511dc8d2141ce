"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch ends at so many rows or bytes, whichever comes first: long texts and sets make short batches.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: The word of every contract here, `[^\x20\x09-\x0D]+`: bytes.split() without an argument splits at the same six bytes.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local master gets a temporary
    one; on a cluster that is an error, as executors would write where nobody else can read. What operators write there
    stays until the folder is cleared, since results are read from it lazily."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="labelforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: cuts the lineage, and Catalyst then knows the true size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python this package, as one zip file per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="labelforge-")) / "labelforge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in root.rglob("*.py"):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of a bounded number of rows and bytes."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def fold(column: Column) -> Column:
    """crc32 of the id as text, for the folds that the contracts name."""
    return F.crc32(column.cast("string").cast("binary"))


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class WordTable(dict):
    """Word -> value, made on first use; emptied when full, so that memory stays bounded."""

    def __init__(self, make: Callable, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value
