"""Tables between the stages of a query."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of this process in the shared folder, for clean().
WRITTEN: list[str] = []


#: The same tables' names in the catalogue, where they have one.
NAMED: list[str] = []
#: Rows of a bucket of dealt(), about.
BUCKET = 400_000

#: Tables that many queries of a session read, by what they are of.
_ONCE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The staged table that `make` gives, made when it is first asked for in a session."""
    key = (spark.sparkContext.applicationId, name, of)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def clean(spark) -> None:
    """Removes them: once a query's result is written, nothing reads them again."""
    _ONCE.clear()
    while NAMED:
        spark.sql(f"drop table if exists {NAMED.pop()}")
    while WRITTEN:
        _delete(spark, WRITTEN.pop())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share, which clean() removes."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="notewright-")
        spark.sparkContext.setCheckpointDir(base)
    WRITTEN.append(f"{base.rstrip('/')}/stage-{name}-{uuid.uuid4().hex[:12]}")
    return WRITTEN[-1]


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written to the folder that driver and executors share and read again, so what stands on it is planned anew."""
    path = new_path(df.sparkSession, name)
    write = df.write.option("compression", codec) if codec else df.write
    write.parquet(path)
    schema, spark = df.schema, df.sparkSession
    del df, write
    free_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    return out


def told(df: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `make` adds to its keys: what turns on a few texts alone is worked out once for each different one of them, not for each row."""
    each = staged(make(df.select(*keys).distinct()), "told")
    each = each.withColumnsRenamed({k: f"{k}__" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys))
    return df.join(each, same).drop(*(f"{k}__" for k in keys))


#: Of what staged() gave, where it lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(table: DataFrame) -> None:
    """Removes what staged() wrote, once nothing will read it again."""
    path = _PATHS.pop(table)
    WRITTEN.remove(path)
    _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def buckets(spark: SparkSession, rows: int) -> int:
    """How many buckets of dealt() a table of about so many rows has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET))


def dealt(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """staged() in n buckets of the key, so groupings, windows and joins by it (and more) move no rows. df comes of repartition(n, key): a task writes a bucket."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"stage_{name}_{uuid.uuid4().hex[:12]}"
    NAMED.append(table)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    free_shuffles(spark)
    return spark.table(table)


def kept(df: DataFrame, name: str, key: str, n: int | None) -> DataFrame:
    """dealt() in n buckets, or staged() where the tables beside it lie in none."""
    return staged(df, name) if n is None else dealt(df.repartition(n, key), name, key, n)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
