"""Scores of judgments and their summaries over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL_CREDIT = 0.5
CHECKLIST = {"a": ("factual_accuracy", "omissions", "hallucinations"), "b": ("organization", "conciseness"), "c": ("terminology", "attribution", "temporality")}


def support(df: DataFrame, keys: list[str], label: str = "judgment") -> DataFrame:
    """(supported + half of partial) / rows that aren't low_value, 0 if there are none."""
    n = lambda v: F.count_if(F.col(label) == v)
    out = df.groupBy(*keys).agg(n("supported").alias("supported"), n("partial").alias("partial"), n("low_value").alias("low_value"), n("missing").alias("missing"), n("contradicted").alias("contradicted"), (F.count("*") - n("low_value")).alias("denominator"))
    return out.withColumn("score", F.when(F.col("denominator") > 0, (F.col("supported") + PARTIAL_CREDIT * F.col("partial")) / F.col("denominator")).otherwise(0.0))


def safety(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of findings (kind, type, severity) by kind, severity and type."""
    n = lambda c: F.count_if(c)
    h, o, major = F.col("kind") == "hallucination", F.col("kind") == "omission", F.col("severity") == "major"
    types = {t: h & (F.col("type") == t) for t in ("fabrication", "negation", "contextual", "causality")} | {t: o & (F.col("type") == t) for t in ("current_issues", "pmfs_issues", "information_plan")}
    return df.groupBy(*keys).agg(n(h).alias("hallucinations"), n(h & major).alias("major_hallucinations"), n(o).alias("omissions"), n(o & major).alias("major_omissions"), *(n(c).alias(t) for t, c in types.items()))


def likert(c: Column, default: int = 1) -> Column:
    """A score from 1 to 5, else the default."""
    return F.when(c.between(1, 5), c).otherwise(default)


def checklist(df: DataFrame) -> DataFrame:
    """Means of each part of a rubric row, of all of them, and the total."""
    every = [s for part in CHECKLIST.values() for s in part]
    total = lambda names: sum((likert(F.col(s)).cast("double") for s in names), F.lit(0.0))
    means = {f"{k}_mean": total(v) / len(v) for k, v in CHECKLIST.items()}
    yes = lambda c: F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))) == "yes", 1).otherwise(0)
    return df.withColumns(means | {"abc_mean": total(every) / len(every), "total": total(every).cast("int"), "omission_yes": yes(F.col("omission")), "hallucination_yes": yes(F.col("hallucination"))})


def section_score(df: DataFrame) -> DataFrame:
    """Clamped score and issues by severity of a section judgment (score double, issues array<string> of severities)."""
    n = lambda s: F.size(F.filter("issues", lambda x: x == s))
    return df.withColumns({"score": F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), "major": n("major"), "minor": n("minor")})


def grid_summary(cases: DataFrame, grid: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of the metrics in every cell of the grid, cells without a case included."""
    aggs = [F.count("*").alias("n_cases")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_stdev")]
    return grid.join(cases.groupBy(*keys).agg(*aggs), keys, "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0)))
