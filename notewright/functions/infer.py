"""Attributes of a proposition out of its text, where they aren't given: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as W
from .normalize import any_of, assertion_status, folded, lookup
from .text import event_tokens, normalize, safe_text


def first_hit(c: Column, words) -> Column:
    """The first of the words that c holds, or null."""
    return F.coalesce(*(F.when(c.contains(w), w) for w in words))


def filled(given: Column, otherwise: Column) -> Column:
    return F.coalesce(F.nullif(safe_text(given), F.lit("")), otherwise)


def speaker(text: Column) -> Column:
    t = F.lower(safe_text(text))
    inside = F.concat(F.lit(" "), t, F.lit(" "))
    return (
        F.when(t.startswith("the patient") | t.startswith("patient ") | inside.contains(" the patient "), "patient")
        .when(t.startswith("the clinician") | t.startswith("the doctor") | inside.contains(" the doctor "), "clinician")
        .when(any_of(t, W.RESULT_SPEAKERS), "test_result")
    )


def predicate(text: Column) -> Column:
    t = F.lower(safe_text(text))
    return F.coalesce(first_hit(t, W.PREDICATES), F.when(any_of(t, W.PLANNING_VERBS), "plans").when(any_of(t, W.HOLDING_VERBS), "has"))


def status(text: Column) -> Column:
    t = F.lower(safe_text(text))
    return F.when(any_of(t, W.NEGATED_WORDS), "negated").when(any_of(t, W.UNCERTAIN_WORDS), "uncertain").otherwise("affirmed")


def temporality(text: Column) -> Column:
    t = F.lower(safe_text(text))
    return F.coalesce(*(F.when(any_of(t, words), time) for time, words in W.TIMES.items()))


def category(text: Column, said: Column, who: Column) -> Column:
    t = F.lower(safe_text(text))
    s = F.coalesce(said, F.lit(""))
    return (
        F.when(any_of(t, W.ALLERGY_WORDS), "Allergy").when(any_of(t, W.COMPLAINT_WORDS), "ChiefComplaint")
        .when((s.isin(*W.PLAN_PREDICATES) & any_of(t, W.DRUG_WORDS)) | any_of(t, W.TAKING_WORDS), "MedicationPlan")
        .when(s.isin(*W.ORDER_PREDICATES) & any_of(t, W.TEST_WORDS), "TestPlan").when(any_of(t, W.RETURN_WORDS), "FollowUpPlan")
        .when(s.isin(*W.DIAGNOSIS_PREDICATES) | any_of(t, W.DIAGNOSIS_NAMES), "Diagnosis")
        .when((F.coalesce(who, F.lit("")) == "test_result") | any_of(t, W.FINDING_WORDS), "Finding")
        .when(any_of(t, W.SYMPTOM_NAMES), "Symptom").when(any_of(t, W.EXAM_NAMES), "Finding").otherwise("History")
    )


def tags(text: Column, kind: Column, said: Column) -> Column:
    """Sorted tags of the claims a text makes."""
    t, k, s = F.lower(safe_text(text)), F.coalesce(kind, F.lit("")), F.coalesce(said, F.lit(""))
    found = {
        "causal": any_of(t, W.CAUSAL_TAG_WORDS), "diagnostic": k == "Diagnosis", "exam": k == "Finding", "medication": (k == "MedicationPlan") | any_of(t, W.MEDICATION_TAG_WORDS),
        "plan": k.isin("TestPlan", "FollowUpPlan") | s.isin(*W.PLAN_TAG_PREDICATES), "quantitative": t.rlike(r"\p{Nd}"), "safety_relevant": any_of(t, W.SAFETY_TAG_WORDS),
        "symptom": k == "Symptom", "temporal": any_of(t, W.TEMPORAL_TAG_WORDS),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in found.items())))


def visit_state(text: Column, state: Column, time: Column) -> Column:
    t, s = F.lower(safe_text(text)), F.lower(safe_text(state))
    return (
        F.when(s == "negated", "ruled_out").when(s == "uncertain", "uncertain")
        .when(any_of(t, W.ENDED_WORDS), F.when(any_of(t, W.IMPROVED_WORDS), "improving").otherwise("resolved"))
        .when(any_of(t, W.WORSE_WORDS), "worsening").when(any_of(t, W.SAME_WORDS), "stable").when(F.lower(safe_text(time)) == "past", "historical").otherwise("active")
    )


def concept(text: Column, kind: Column) -> Column:
    t = F.lower(safe_text(text))
    return F.coalesce(
        first_hit(t, W.CONCEPT_DRUGS), first_hit(t, W.CONCEPT_DIAGNOSES), F.when(t.contains("blood pressure"), "blood pressure"), F.when(t.contains("kidney function"), "kidney function test"),
        F.when(t.contains("cholesterol"), "cholesterol test"), F.when(t.contains("blood work"), "blood work"), F.when(t.contains("pain"), F.coalesce(F.concat(F.lit("pain:"), first_hit(t, W.CONCEPT_SITES)), F.lit("pain"))),
        F.when(t.contains("cough"), "cough"), F.when(any_of(t, ("sensation", "numb", "tingling")), "sensory change"),
        F.nullif(F.array_join(F.slice(event_tokens(safe_text(text)), 1, 4), " "), F.lit("")), F.nullif(safe_text(kind), F.lit("")), F.lit("clinical_state"),
    )


FIELDS = ("speaker", "predicate", "status", "temporality", "category", "visit_state", "concept")


def enriched(df, text: str = "text"):
    """df's rows with a text, blank fields filled from it; cap_type is the category; tags are worked out where none are given."""
    t = F.col(text)
    df = df.where(safe_text(t) != "").withColumns({c: F.lit(None).cast("string") for c in FIELDS if c not in df.columns})
    df = df.withColumns({"speaker": filled("speaker", speaker(t)), "predicate": filled("predicate", predicate(t)), "status": filled("status", status(t)), "temporality": filled("temporality", temporality(t))})
    df = df.withColumn("category", filled("category", category(t, F.col("predicate"), F.col("speaker"))))
    found = tags(t, F.col("category"), F.col("predicate"))
    given = F.when(F.size("tags") > 0, F.col("tags")).otherwise(found) if "tags" in df.columns else found
    return df.withColumns({"tags": given, "visit_state": filled("visit_state", visit_state(t, F.col("status"), F.col("temporality"))), "concept": filled("concept", concept(t, F.col("category"))), "cap_type": F.col("category")})


def flattened(df, evidence: str | None = None):
    """Rich propositions (prop_type, concept, source, verification, clinical_status, temporality, prop_text) as flat ones, enriched.

    speaker: the first of the evidence that has one, else the source; propositions without a text go.
    """
    named = F.get(F.filter(evidence, lambda e: safe_text(e["turn_speaker"]) != ""), F.lit(0))["turn_speaker"] if evidence else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in {"prop_type", "concept", "source", "verification", "clinical_status", "temporality", "prop_text", evidence}]
    flat = df.select(
        *kept, F.col("prop_type").alias("category"), "concept", filled(named, F.col("source")).alias("speaker"), assertion_status(F.col("verification")).alias("status"), F.col("clinical_status").alias("visit_state"), "temporality",
        safe_text("prop_text").alias("text"), F.array().cast("array<string>").alias("tags"),
    )
    return enriched(flat)


def old_verification(c) -> Column:
    f = folded(c, "[^a-z]")
    return F.when(f.isin(*W.OLD_CONFIRMED), "confirmed").when(f.isin(*W.OLD_REFUTED), "refuted").otherwise("unconfirmed")


def old_type(c, text, who: Column) -> Column:
    """The proposition type that a category of the older schema stands for, else what the text calls for."""
    f, t = folded(c, "[^a-z]"), F.lower(safe_text(text))
    return F.coalesce(
        lookup(W.OLD_CATEGORIES, f), F.when(f == "history", F.when(t.contains("allerg"), "Allergy").otherwise("ProblemHistory")),
        F.when(f == "finding", F.when(any_of(t, W.OLD_RESULT_WORDS), "TestResult").when(who == "patient", "Symptom").otherwise("ExamFinding")),
        F.when(f == "symptom", "Symptom"), F.when(f == "uncertainornoise", "Problem"), F.when(any_of(t, W.OLD_RETURN_WORDS), "FollowUp"), F.when(any_of(t, W.OLD_ORDER_WORDS), "Order"),
        F.when(any_of(t, W.OLD_DRUG_WORDS), "MedicationRequest"), F.when(any_of(t, W.OLD_SYMPTOM_WORDS), "Symptom"), F.lit("Problem"),
    )


def old_modality(c, kind: Column, who: Column, said) -> Column:
    f, p = folded(c, "[^a-z]"), folded(said, "[^a-z]")
    return (
        F.when((f == "finding") & (who == "clinician"), "exam").when(kind == "TestResult", "test_result")
        .when(kind.isin("Diagnosis", "Impression") | p.isin("diagnoses", "suspects", "notes"), "assessment")
        .when(kind.isin("MedicationRequest", "Order", "FollowUp", "Counseling") | p.isin("orders", "plans", "prescribes", "recommends", "instructs"), "plan")
        .when(kind.isin("ProblemHistory", "Demographics", "Allergy"), F.when(who.isin("clinician", "test_result"), "historical_record").otherwise("interview"))
        .when(who == "patient", "interview").otherwise("unknown")
    )


def statement_bucket(text: Column, event: Column | None = None) -> Column:
    """Where a statement of an event belongs: by the event's type, or else by its words."""
    t = normalize(text)
    by_words = F.when(any_of(t, W.CARE_WORDS), "care_context").when(any_of(t, W.ACTION_WORDS), "planned_actions").when(any_of(t, W.STATE_WORDS), "current_state").otherwise("supporting_evidence")
    return by_words if event is None else F.coalesce(lookup(W.STATEMENT_OF_EVENT, event), by_words)
