"""Objects out of nested answers, with a limit for each kind of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .propositions import json_text


def objects(df: DataFrame, limits: dict[str, int], *, key: str = "id", column: str = "raw", depth: int = 8) -> DataFrame:
    """(key, kind, place, item): the objects of lists under the given names, wherever they stand in a JSON text, in the order of their lists (an object's lists by name).

    limits: how many of each kind (the name of its list) a text may have; the first ones stay. Lists are walked level by
    level, all texts at once, `depth` levels at most; within an object taken, lists of other kinds are walked, too. What can't be read has none.
    """
    spark = df.sparkSession
    level = df.select(key, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("listed"), F.try_parse_json(json_text(F.col(column))).alias("v")).where("v is not null")
    found = None
    for _ in range(depth):
        inner = spark.sql("select t.*, e.pos, e.key as name, e.value from {t} t, lateral variant_explode(t.v) e", t=level)
        # an entry of an object has a name, one of a list goes by the name of the list
        level = inner.select(key, F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"), F.coalesce("name", "kind").alias("kind"), F.col("name").isNull().alias("listed"), F.col("value").alias("v"))
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        text = level.select(key, "path", "kind", "listed", F.to_json("v").alias("item"))
        text = staged(text, "walk")
        if text.isEmpty():
            break
        here = text.where(F.col("listed") & F.col("kind").isin(*limits) & F.col("item").startswith("{")).select(key, "path", "kind", "item")
        found = here if found is None else found.unionByName(here)
        level = text.select(key, "path", "kind", "listed", F.parse_json("item").alias("v"))
    if found is None:
        found = df.select(key, F.array().cast("array<int>").alias("path"), F.lit("").alias("kind"), F.lit("").alias("item")).limit(0)
    limit = F.lit(0)
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy("path")) - 1
    return found.withColumn("place", place).where(F.col("place") < limit).select(key, "kind", "place", "item")
