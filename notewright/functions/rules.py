"""Rule predicates over texts and propositions, as column expressions. Terms are found anywhere, not as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .normalize import any_of, lookup
from .text import n_words, normalize, safe_text


def lower(c) -> Column:
    return F.lower(safe_text(c))


def is_question(c) -> Column:
    t = lower(c)
    opens = F.lit(False)
    for q in L.QUESTION_OPENERS:
        opens = opens | t.startswith(q)
    return t.contains("?") | opens


def clinical(c) -> Column:
    return any_of(lower(c), L.CLINICAL_SIGNS)


def chatter(c) -> Column:
    t = lower(c)
    return (t == "") | (F.when(any_of(t, L.CHATTER), ~clinical(t)).otherwise(t.isin(*L.SHORT_CHATTER) | (any_of(t, L.FOOD_CHATTER) & ~clinical(t))))


def plan_like(c) -> Column:
    t = lower(c)
    return t.rlike(L.PLAN_VERBS) | t.contains("plan")


def result_like(c) -> Column:
    return any_of(lower(c), L.RESULT_WORDS)


def exam_like(c) -> Column:
    return any_of(lower(c), L.EXAM_WORDS)


def diagnosis_like(c) -> Column:
    return any_of(lower(c), L.DIAGNOSIS_WORDS)


def symptom_like(c) -> Column:
    return any_of(lower(c), L.SYMPTOM_WORDS)


def plan_type(c) -> Column:
    t = lower(c)
    return F.when(any_of(t, L.FOLLOW_UP_WORDS), "FollowUp").when(any_of(t, L.COUNSEL_WORDS), "Counseling").when(any_of(t, L.MEDICATION_WORDS), "MedicationRequest").otherwise("Order")


def retyped(kind: Column, modality: Column, source: Column, text: Column, verified: Column) -> Column:
    """The type that the text calls for: the first rule that holds, then plans."""
    open_, by_clinician = kind.isin("Problem", "Symptom"), lower(source).isin("clinician", "doctor")
    out = (
        F.when(open_ & plan_like(text), plan_type(text))
        .when(open_ & result_like(text), "TestResult")
        .when(open_ & exam_like(text) & by_clinician, "ExamFinding")
        .when((kind == "Problem") & ((lower(source) == "patient") | (lower(verified) == "refuted") | symptom_like(text)), "Symptom")
        .when(kind.isin("Problem", "Impression") & by_clinician & diagnosis_like(text), "Diagnosis")
        .otherwise(kind)
    )
    return F.when((lower(modality) == "plan") & out.isin("Problem", "Symptom"), plan_type(text)).otherwise(out)


def low_value(concept: Column, text: Column, kind: Column, spans: Column | None = None) -> Column:
    """spans: texts of the evidence; a proposition that only questions support counts little, plans excepted."""
    c, t = normalize(concept), normalize(text)
    out = (
        (c == "") | (t == "") | chatter(t) | c.isin(*L.LOW_VALUE_CONCEPTS)
        | (kind.isin("Problem", "Symptom", "ProblemHistory", "ChiefComplaint") & any_of(c, L.FOOD_CONCEPTS))
        | (any_of(t, L.SMALL_TALK) & ~clinical(t)) | any_of(t, L.LOW_VALUE_TEXTS) | (n_words(t) < 3)
    )
    if spans is not None:
        some = F.filter(spans, lambda s: safe_text(s) != "")
        out = out | ((F.size(some) > 0) & F.forall(some, is_question) & ~kind.isin(*L.PLAN_TYPES))
    return out


def protected(concept: Column, kind: Column) -> Column:
    c = normalize(concept)
    return kind.isin(*L.PROTECTED_TYPES) & (c != "") & ~c.isin(*L.LOW_VALUE_CONCEPTS) & ~any_of(c, L.FOOD_CONCEPTS)


def medication_event(kind: Column, status: Column, temporality: Column, text: Column, action: Column) -> Column:
    return F.when(
        (lower(status) == "planned") | lower(action).isin(*L.CHANGE_ACTIONS) | any_of(lower(temporality), L.CHANGE_TIMES) | any_of(lower(text), L.CHANGE_WORDS), "MedicationChange"
    ).otherwise("MedicationState")


def cluster_type(kind: Column, status: Column, temporality: Column, text: Column, action: Column) -> Column:
    return (
        F.when(kind.isin("MedicationStatement", "MedicationRequest"), medication_event(kind, status, temporality, text, action))
        .when(kind.isin("ChiefComplaint", "Symptom", "Problem", "ProblemHistory", "Diagnosis", "Impression", "Allergy"), "ProblemState")
        .when(kind.isin("Order", "Counseling"), "Plan")
        .when(safe_text(kind) == "", "Other")
        .otherwise(kind)
    )


def type_priority(kind: Column) -> Column:
    return F.coalesce(lookup(L.TYPE_PRIORITY, kind), F.lit(0))


def status_rank(status: Column) -> Column:
    return F.coalesce(lookup(L.STATUS_RANK, status), F.lit(0))
