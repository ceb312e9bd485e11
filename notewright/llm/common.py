"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of anything but the six ASCII white-space characters.
WORD = rb"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this process where it is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="notewright-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str, codec: str = "zstd", parts: list[str] | None = None) -> str:
    """Writes df as Parquet in the shared folder, in a folder for each value of parts, and returns the path; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/notewright-{name}-{uuid.uuid4().hex[:12]}"
    WRITTEN.append(path)
    df.write.option("compression", codec).partitionBy(*parts or []).parquet(path)
    return path


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df with its lineage cut: written to the shared folder and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, codec))


#: Tables of this process that stand in the shared folder, for clean().
WRITTEN: list[str] = []


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables of this process: once its results are written, nothing reads them again."""
    while WRITTEN:
        drop_table(spark, WRITTEN.pop())


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_memory() -> None:
    """Gives a worker's free memory back, which it would keep from task to task and stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """So many rows go to a worker at once in what is run inside: for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes (or None) of a string column, without a decode and an encode of each value."""
    return column.cast(pa.large_binary()).to_pylist()


def zipped(df: DataFrame, column: str) -> DataFrame:
    """df with a string column as compressed bytes, for shuffles; null stays null."""
    from pyspark.sql import types as T

    k = df.columns.index(column)
    fields = [T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema.fields]

    def run(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            cols = list(batch.columns)
            cols[k] = pa.array([None if t is None else zip_(t) for t in as_bytes(cols[k])], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(run, T.StructType(fields))


def unzipped(column: pa.Array) -> list:
    """Bytes (or None) of a column of zipped()."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    return [None if z is None else unzip(z) for z in column.to_pylist()]


def text_slices(values: list, most: int = 4_000_000):
    """Ranges (a, b) of values that hold about `most` characters or bytes at a time; one long value stands alone."""
    a = size = 0
    for b, x in enumerate(values):
        n = len(x) if x else 0
        if size and size + n > most:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(values):
        yield a, len(values)


def is_held(column: str, mod: int, remainder: int):
    """crc32 of the id as text, modulo mod, equals remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod == remainder
