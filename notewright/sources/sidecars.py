"""Sidecars of cases: JSON files named after them, and diagnostics written beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", "map<string, string>").alias("entries"))
    return rows.withColumn("file", F.url_decode(F.col("file")))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, payload): of each `<case>_result.json` the value of its first key, as JSON text."""
    rows = _files(spark, path).where(F.col("file").endswith("_result.json"))
    return rows.select(F.regexp_replace("file", "_result\\.json$", "").alias("case_id"), F.get(F.map_values("entries"), F.lit(0)).alias("payload"))


def mappings(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """(case_id, payload): of the first file (by name) that begins with a case's id and ends in _result.json, the first value whose key holds the id."""
    files = _files(spark, path).where(F.col("file").endswith("_result.json"))
    named = cases.select("case_id").distinct().join(files, F.col("file").startswith(F.col("case_id")))
    first = named.groupBy("case_id").agg(F.min_by("entries", "file").alias("entries"))
    keys = F.filter(F.map_keys("entries"), lambda k: k.contains(F.col("case_id")))
    return first.where(F.size(keys) > 0).select("case_id", F.element_at("entries", F.element_at(keys, 1)).alias("payload"))


def with_fallback(cases: DataFrame, *payloads: DataFrame) -> DataFrame:
    """cases with the payload of the first source that has one; cases without any go."""
    out = cases
    for k, p in enumerate(payloads):
        out = out.join(p.select("case_id", F.col("payload").alias(f"p{k}")), "case_id", "left")
    names = [f"p{k}" for k in range(len(payloads))]
    return out.withColumn("payload", F.coalesce(*names)).drop(*names).where("payload is not null")


def write_unmatched(unmatched: DataFrame, path: str) -> None:
    """JSON lines in one folder for each case."""
    unmatched.write.mode("overwrite").partitionBy("case_id").json(path)
