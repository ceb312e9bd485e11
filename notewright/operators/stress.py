"""Stress sets: which injected errors a view of the note can show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def visible(injections: DataFrame, views: DataFrame) -> DataFrame:
    """Injections (case_id, ord, axis, severity, sentence) with in_view: the sentence stands in the case's view."""
    both = injections.join(views.select("case_id", flat(F.col("view")).alias("view__")), "case_id", "left")
    s = flat(F.col("sentence"))
    return both.withColumn("in_view", (s != "") & F.coalesce(F.col("view__").contains(s), F.lit(False))).drop("view__")


def subsets(injections: DataFrame) -> DataFrame:
    """Per case how many injections each subset keeps: omissions in view, major hallucinations, major omissions."""
    axis, severity = F.lower(F.trim("axis")), F.lower(F.trim("severity"))
    return injections.groupBy("case_id").agg(
        F.count_if((axis == "omission") & F.col("in_view")).alias("s_only"), F.count_if((axis == "hallucination") & (severity == "major")).alias("major_hallucinations"), F.count_if((axis == "omission") & (severity == "major")).alias("major_omissions"), F.count("*").alias("injections")
    )
