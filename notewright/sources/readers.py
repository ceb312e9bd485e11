"""Readers with the semantics of case, gold and sidecar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_text


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; a line that can't be read stops the query (strict) or gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their places, from 1.

    Files are read in splits. A first pass tells each split's lines (one row a split), so a line's place is the lines of the splits
    before its own and its place within that; no row is shuffled for it.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    return rows.join(splits.select("file", "at", "first", before.alias("before")), ["file", "at"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def scan_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, prefix: str = "") -> DataFrame:
    """JSON lines with their file and line (columns of these names after the prefix); blank lines are none. A line that can't be read is an error that names both, or has `bad` (not strict)."""
    rows = read_lines(spark, path).where(F.btrim("value", F.lit(" \t\r")) != "")
    r = F.from_json("value", f"{schema}, bad__ string", {"columnNameOfCorruptRecord": "bad__", "mode": "PERMISSIVE"})
    rows = rows.withColumn("r", r).withColumn("bad", F.col("r").isNull() | F.col("r.bad__").isNotNull())
    if strict:
        where = F.concat(F.regexp_replace("file", "^file:/+", "/"), F.lit(":"), F.col("line").cast("string"), F.lit(": not a JSON object"))
        rows = rows.withColumn("r", F.when(F.col("bad"), F.raise_error(where)).otherwise(F.col("r")))
    place = [F.col("file").alias(f"{prefix}file"), F.col("line").alias(f"{prefix}line")]
    if strict:
        return rows.select(*place, "r.*").drop("bad__")
    return rows.select(*place, "bad", F.when(F.col("bad"), F.col("value")).alias("value"), "r.*").drop("bad__")


def is_jsonl(spark: SparkSession, path: str) -> bool:
    """By the name, else by the first line that isn't blank."""
    if path.rstrip("/").endswith((".jsonl", ".ndjson")):
        return True
    if path.rstrip("/").endswith(".csv"):
        return False
    first = spark.read.text(path).where(F.btrim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("{")


#: Where a case's id and its summary stand if not in columns of these names.
FILE_COLUMNS, SUMMARY_COLUMNS = ("case_id", "encounter_id", "id", "uid"), ("summary_draft", "summary_gt_note", "summary_asgari_error")


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A data set of JSON lines or CSV, with columns file and summary out of the first of their stand-ins that there is; an error if it is empty."""
    if is_jsonl(spark, path):
        found = spark.read.schema(schema).json(path).schema if schema else spark.read.json(path).schema
        rows = scan_jsonl(spark, path, "row__ struct<>" if not found.fields else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.fields), prefix="scan_")
        df = rows.drop("scan_file", "scan_line")
    else:
        df = read_csv(spark, path, schema)
    for name, options in (("file", FILE_COLUMNS), ("summary", SUMMARY_COLUMNS)):
        if name not in df.columns and any(c in df.columns for c in options):
            df = filled(df, name, options)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def keyed(df: DataFrame, raters: tuple[str, ...] = ("annotator", "rater", "labeler")) -> DataFrame:
    """Gold or predicted lists by case: rows without a case id go; the annotator is the first of the columns that isn't blank, else "unknown"."""
    found = [c for c in raters if c in df.columns]
    who = F.coalesce(F.nullif(first_text(*found), F.lit("")), F.lit("unknown")) if found else F.lit("unknown")
    return df.where(F.btrim(F.coalesce(F.col("case_id").cast("string"), F.lit(""))) != "").withColumn("annotator", who)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def with_order(df: DataFrame) -> DataFrame:
    """Adds ord: rows of one file in their order; across files by file name."""
    return df.withColumn("ord", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")))


def read_json_dir(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, raw): one file a case, named after it."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return df.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "").alias("case_id"), F.col("value").alias("raw"))


def cases(df: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cases by the first of file, case_id and id that isn't blank. Of rows with one id the last holds, at the first one's place."""
    names = [c for c in ("file", "case_id", "id") if c in df.columns]
    key = first_text(*names)
    rows = df.withColumn("case_key", key).where("case_key <> ''")
    if ids is not None:
        rows = rows.where(F.col("case_key").isin(*ids))
    w = Window.partitionBy("case_key")
    rows = rows.withColumns({"first__": F.min("ord").over(w), "last__": F.max("ord").over(w)}).where("ord = last__").drop("last__")
    return rows.orderBy("first__").limit(limit).drop("first__") if limit else rows.withColumnRenamed("first__", "place")


def last_by(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in df.columns if c not in (key, "ord")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), "ord").alias("r")).select(key, "r.*")


def filled(df: DataFrame, target: str, options: tuple[str, ...]) -> DataFrame:
    """target from the first of the columns that there is; an error if there is none."""
    found = next((c for c in options if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {options} is a column")
    return df.withColumn(target, F.col(found))


def resume(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
