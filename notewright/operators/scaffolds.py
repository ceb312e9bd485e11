"""Scaffolds of notes out of recognised entities and the relations of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import terms as W
from ..functions.normalize import any_of
from ..functions.text import normalize, safe_text


def utterance(c) -> Column:
    """Without the speaker's mark in front, blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(safe_text(c), r"^\[[^\]]+\]\s*", ""), r"\s+", " "))


def generic(entity: Column, sentence: Column) -> Column:
    """An entity that a question names, and no one has."""
    s = normalize(sentence)
    return normalize(entity).isin(*W.GENERIC_ENTITIES) & (sentence.contains("?") | s.startswith("have you") | s.startswith("do you") | s.startswith("and what"))


def concept(entity: Column, kind: Column) -> Column:
    """The plain name of an entity."""
    t = F.regexp_replace(F.lower(safe_text(entity)), r"\b(this|that|these|those|a|an|the|my|your|his|her|their|some|any)\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\b(out|before|ever|had)\b", " "), r"[^a-z0-9\s/-]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, " stones$", " stone"), " injuries$", " injury")
    t = F.when((t == "appendix") | t.contains("appendix out"), "appendectomy").otherwise(t)
    t = F.when(t.isin(*W.FINGER_PAINS), "finger pain").otherwise(t)
    return F.when(t != "", t).otherwise(infer.concept(entity, F.initcap(F.coalesce(kind, F.lit("")))))


def planning(kind: Column, sentence: Column) -> Column:
    s = normalize(sentence)
    return F.when(any_of(s, W.SOCIAL_SENTENCES), "Demographics and Social Determinants of Health").when(normalize(kind).isin("problem", "bodyloc") & any_of(s, W.VISIT_SENTENCES), "Patient Intent").otherwise("")


def bucket(kind: Column, sentence: Column, relations: Column) -> Column:
    s = normalize(sentence)
    inside = F.concat(F.lit(" "), s, F.lit(" "))
    denied = F.array_contains(relations, "negation") | s.startswith("no ") | inside.contains(" denies ") | inside.contains(" no ")
    return (
        F.when(any_of(s, W.UNSURE_SENTENCES), "Pertinent Unknowns").when(denied, "Pertinent Negatives").when(any_of(s, ("uncertain", "possible")), "Pertinent Unknowns")
        .when(any_of(s, W.PAST_SENTENCES), "Medical History").when(normalize(kind).isin(*W.POSITIVE_TYPES), "Pertinent Positives").otherwise("Medical History")
    )


def section(kind: Column, sentence: Column) -> Column:
    k, s = normalize(kind), normalize(sentence)
    return (
        F.when(k.isin("treatment", "drug") & any_of(s, W.TREATED_SENTENCES), "Plan").when(k.isin("test", "labvalue") | any_of(s, W.TESTED_SENTENCES), "Findings")
        .when(any_of(s, W.PLANNED_SENTENCES), "Plan").when(any_of(s, W.JUDGED_SENTENCES), "Assessment").otherwise("History of Present Illness")
    )


def entities(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities (case_id, ord, line, entity, type, sentence) with concept, bucket, planning and section; relations: (case_id, line, relation).

    Relations of a line are joined to its entities; entities or sentences that are blank go, and generic ones.
    """
    of_line = relations.where(safe_text("relation") != "").groupBy("case_id", "line").agg(F.collect_set(normalize("relation")).alias("relations"))
    r = rows.withColumns({"sentence": utterance("sentence"), "entity": utterance("entity")}).where("sentence <> '' and entity <> ''").where(~generic(F.col("entity"), F.col("sentence")))
    r = r.join(of_line, ["case_id", "line"], "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))
    kind, sentence = F.col("type"), F.col("sentence")
    return r.withColumns({"concept": concept(F.col("entity"), kind), "bucket": bucket(kind, sentence, F.col("relations")), "planning": planning(kind, sentence), "section": section(kind, sentence)}).drop("relations")


def resolved(found: DataFrame) -> DataFrame:
    """(case_id, bucket, concept, first_line, evidence): each concept of a bucket with three of its sentences; unknowns that another bucket settles go."""
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "bucket", "concept", "sentence").orderBy("ord"))).where("r = 1")
    per = first.groupBy("case_id", "bucket", "concept").agg(F.min("line").alias("first_line"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"]), 1, 3), " || ").alias("evidence"))
    settled = F.max(F.when(F.col("bucket").isin("Pertinent Positives", "Pertinent Negatives"), 1).otherwise(0)).over(Window.partitionBy("case_id", "concept"))
    return per.withColumn("settled", settled).where("not (bucket = 'Pertinent Unknowns' and settled = 1)").drop("settled")
