"""Writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import resume
from .stage import staged


def write_jsonl(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", True)
    (w.partitionBy(*partition) if partition else w).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], strict: bool = False) -> None:
    """Declared fields alone; strict: others are an error."""
    if strict and set(df.columns) - set(fields):
        raise ValueError(f"columns without a field: {sorted(set(df.columns) - set(fields))}")
    df.select(*(f for f in fields if f in df.columns)).write.mode("overwrite").option("header", True).csv(path)


#: Case metrics lie in so many parts, by a hash of the case.
PARTS = 64


def flush_metrics(cases: DataFrame, path: str, fields: list[str], summarize: Callable[[DataFrame], DataFrame], key: str = "case_id", parts: int = PARTS) -> None:
    """Adds the metrics of cases, or puts them in place of those there are, as JSON lines and CSV, and writes the summary of all anew.

    The rows are worked out once: they are staged with what their parts hold of other cases, and only these parts are
    written. The summary is made of the table. Rows without a key share a part.
    """
    spark = cases.sparkSession
    new = staged(cases.select(*(f for f in fields if f in cases.columns)).withColumn("part", F.pmod(F.hash(F.col(key).cast("string")), F.lit(parts))), "metrics")
    at = f"{path.rstrip('/')}/case_metrics"
    held = _read(spark, f"{at}.parquet")
    if held is not None:
        others = held.join(new.select("part").distinct(), "part", "left_semi").join(new.select(key).distinct(), key, "left_anti")
        new = staged(new.unionByName(others, allowMissingColumns=True), "metrics")
    put = lambda: new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part")
    put().parquet(f"{at}.parquet")
    put().option("ignoreNullFields", True).json(f"{at}.jsonl")
    put().option("header", True).csv(f"{at}.csv")
    summary = staged(summarize(spark.read.parquet(f"{at}.parquet").drop("part")), "summary")
    write_jsonl(summary, f"{path}/aggregate_metrics.json")
    write_csv(summary, f"{path}/aggregate_metrics.csv", summary.columns)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_stage(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds to a stage's table what it doesn't hold yet."""
    done = _read(df.sparkSession, path)
    (resume(df, done, keys) if done is not None else df).write.mode("append").parquet(path)
