"""Event plans with merged slots: propositions of one type and signature become one event with a title, a summary and care fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from ..functions.normalize import any_of
from ..functions.rules import lower
from ..functions.text import BEGINS, ENDS, event_tokens, once, safe_text
from .events import event_priority, event_sections, event_type

# Fixed values, in the order in which the first one counts.
MEDICATIONS = ("glimepiride", "metformin", "metoprolol", "lisinopril", "hydrochlorothiazide", "amlodipine", "atorvastatin")
SIDES = ("bilateral", "left", "right")
FREQUENCIES = ("once a day", "twice a day", "three times a day", "daily", "bid", "tid", "qhs", "every six hours", "every 6 hours", "as needed")
BODY_SITES = ("foot", "feet", "toe", "toes", "hip", "leg", "hand", "eye", "skin", "nails", "blood pressure")
ACTIONS = ("increase", "decrease", "start", "stop", "continue", "refill")
TAKING, PRESCRIBING = ("taking ", "takes ", "on "), ("prescribes", "prescribe", "new prescription")
UNITS, DOSES = ("mg", "mcg", "g", "cm", "mm", "hours?", "days?", "weeks?", "months?"), ("mg", "mcg", "g")
#: The field of an event's care that holds its statements; evidence for all other types.
CARE = {"MedicationChange": "planned_actions", "PlanOrder": "planned_actions", "FollowUp": "planned_actions", "MedicationState": "current_state", "PMH": "current_state", "PatientInstruction": "care_context"}
ALL_EVENTS, ALL_STATEMENTS = 14, 4

#: A number with a unit; a per cent sign counts where a word goes on behind it.
VALUE = rf"{BEGINS}\d+(?:\.\d+)?\s*(?:(?:{'|'.join(UNITS)}){ENDS}|%(?=[\p{{L}}\p{{N}}_]))"
DOSE = rf"{BEGINS}\d+(?:\.\d+)?\s*(?:{'|'.join(DOSES)}){ENDS}"
SLOTS = ("medication", "laterality", "dose", "frequency", "action", "temporality", "assertion")
LISTS = ("values", "body_sites", "actions")


def held(t: Column, words: tuple[str, ...]) -> Column:
    """The words a text has, in their order."""
    return F.array_compact(F.array(*(F.when(t.contains(w), F.lit(w)) for w in words)))


def slots(text: Column, temporality: Column, status: Column) -> Column:
    """What a proposition says of medication, side, dose, values (three), frequency, sites and actions; null or empty without it."""
    return once(F.struct(lower(text).alias("t"), F.regexp_extract_all(lower(text), F.lit(VALUE), F.lit(0)).alias("values")), lambda x: once(held(x["t"], ACTIONS), lambda actions: _slots(x["t"], x["values"], actions, temporality, status)))


def _slots(t: Column, values: Column, actions: Column, temporality: Column, status: Column) -> Column:
    action = F.when(F.size(actions) > 0, actions[0]).when(any_of(t, TAKING), "continue").when(any_of(t, PRESCRIBING), "prescribe")
    filled = lambda c: F.nullif(safe_text(c), F.lit(""))
    return F.struct(
        infer.first_hit(t, MEDICATIONS).alias("medication"), infer.first_hit(t, SIDES).alias("laterality"), F.get(F.filter(values, lambda v: v.contains("g")), F.lit(0)).alias("dose"), infer.first_hit(t, FREQUENCIES).alias("frequency"),
        action.alias("action"), filled(temporality).alias("temporality"), filled(status).alias("assertion"), F.slice(values, 1, 3).alias("values"), F.array_sort(held(t, BODY_SITES)).alias("body_sites"), actions.alias("actions"),
    )


def signature(kind: Column, s: Column, concept: Column, speaker: Column, predicate: Column, visit: Column, text: Column) -> Column:
    """What tells events of one type apart."""
    filled = lambda c: F.nullif(safe_text(c), F.lit(""))
    known = lambda c: F.coalesce(filled(c), F.lit("unknown"))
    none = F.array().cast("array<string>")
    more = (
        F.when(kind.isin("MedicationState", "MedicationChange"), F.array(known(speaker), known(predicate), known(visit))).when(kind.isin("PlanOrder", "FollowUp", "PatientInstruction"), F.array(known(predicate)))
        .when((kind == "SymptomCourse") & filled(visit).isNotNull(), F.array(filled(visit))).otherwise(none)
    )
    parts = F.array_compact(F.concat(F.array(filled(concept), s["medication"], s["laterality"]), *(F.slice(s[c], 1, 2) for c in ("body_sites", "actions", "values")), more))
    words = once(parts, lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.slice(event_tokens(text), 1, 4)))
    return once(F.trim(F.array_join(words, " ")), lambda joined: F.when(joined != "", joined).otherwise(F.substring(lower(text), 1, 60)))


def _summary(kind: Column, s: dict[str, Column], doses: Column, frequencies: Column, said: Column) -> Column:
    """A sentence for a medication, else the first statements."""
    med = s["medication"]
    how_often = F.when(F.size(frequencies) > 0, F.concat(F.lit(" ("), frequencies[0], F.lit(")"))).otherwise("")
    change = F.when(F.size(doses) > 1, F.format_string("The clinician plans a dosing update for %s.", med)).when(F.size(doses) == 1, F.concat(F.format_string("The clinician plans to adjust %s to ", med), doses[0], how_often, F.lit(".")))
    change = change.otherwise(F.concat(F.format_string("The clinician plans a medication change for %s", med), how_often, F.lit(".")))
    state = F.concat(F.concat_ws(" ", F.lit("The patient is currently taking"), med, s["dose"], s["frequency"]), F.lit("."))
    first = lambda n: F.array_join(F.slice(said, 1, n), "; ")
    return (
        F.when(med.isNotNull() & (kind == "MedicationChange"), change).when(med.isNotNull() & (kind == "MedicationState"), state)
        .when(kind.isin("PlanOrder", "FollowUp", "PatientInstruction", "ExamFinding", "TestResult"), first(3)).otherwise(first(2))
    )


def event_plan(props: DataFrame, k: int = ALL_EVENTS) -> DataFrame:
    """Events of each case, in the order in which they first appear, k at most, with everything a note needs of them.

    props: case_id, ord, prop_id, category, predicate, concept, prop_text, speaker, visit_state, status, temporality. Of each slot the first
    value stands; lists of several members are united and sorted. Two doses make a medication's state a change. Merging is an
    aggregate of one row for each event: arg-mins by ord for what comes first, sets for the rest.
    """
    kind = event_type(F.col("category"), F.col("predicate"), F.col("prop_text"))
    rows = props.withColumns({"event_type": kind, "s": slots(F.col("prop_text"), F.col("temporality"), F.col("status"))})
    rows = rows.withColumns({"signature": signature(F.col("event_type"), F.col("s"), F.col("concept"), F.col("speaker"), F.col("predicate"), F.col("visit_state"), F.col("prop_text")), "said": safe_text("prop_text"), "in_doses": F.regexp_extract_all(lower("prop_text"), F.lit(DOSE), F.lit(0))})
    listed = lambda c: F.when(F.size(c) > 0, c)
    united = {c: F.collect_list(listed(F.col(f"s.{c}"))) for c in LISTS}
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("ord")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("ord", c)))), lambda x: x[c])
    g = rows.groupBy("case_id", "event_type", "signature").agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("members"), *(first(F.col(f"s.{c}")).alias(c) for c in SLOTS), *(v.alias(c) for c, v in united.items()),
        F.array_sort(F.collect_set("s.dose")).alias("doses"), F.array_sort(F.collect_set("s.frequency")).alias("frequencies"), F.size(F.array_distinct(F.flatten(F.collect_list("in_doses")))).alias("n_doses"),
        F.array_distinct(in_order("said")).alias("statements"), in_order("prop_id").alias("supporting"),
        *(F.min_by(F.coalesce(safe_text(c), F.lit("")), "ord").alias(f"r_{c}") for c in ("concept", "visit_state", "status", "temporality", "speaker")),
    )
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("first_ord", "event_type", "signature"))
    # of one member's list the order stays
    one = {c: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.flatten(c)))) for c in LISTS}
    g = g.withColumn("n", n).where(F.col("n") <= k).withColumns(one)
    g = g.withColumn("event_summary", _summary(F.col("event_type"), {c: F.col(c) for c in SLOTS}, F.col("doses"), F.col("frequencies"), F.col("statements")))
    g = g.withColumn("event_type", F.when((F.col("event_type") == "MedicationState") & (F.col("n_doses") >= 2), "MedicationChange").otherwise(F.col("event_type")))
    slashed = lambda c: F.array_join(F.slice(c, 1, 2), "/")
    words = F.array_join(F.slice(event_tokens("event_summary"), 1, 4), " ")
    title = (
        F.when(F.col("medication").isNotNull() & F.col("event_type").isin("MedicationState", "MedicationChange"), F.trim(F.concat_ws(" ", "medication", slashed("actions"))))
        .when(F.size("body_sites") > 0, F.concat("event_type", F.lit(": "), slashed("body_sites"))).when(words != "", words).otherwise(F.col("event_type"))
    )
    filled = lambda c, otherwise: F.coalesce(F.nullif(F.col(c), F.lit("")), otherwise)
    g = g.withColumn("title", title)
    care = F.coalesce(*(F.when(F.col("event_type") == t, f) for t, f in CARE.items()), F.lit("supporting_evidence"))
    kept = F.array_join(F.slice("statements", 1, ALL_STATEMENTS), "|")
    out = g.withColumns({
        "event_id": F.concat(F.lit("E"), "n"), "canonical_concept": filled("r_concept", F.col("title")), "visit_state": filled("r_visit_state", infer.visit_state(F.col("event_summary"), F.col("r_status"), F.col("r_temporality"))),
        "status": filled("r_status", F.lit("affirmed")), "temporality": filled("r_temporality", F.lit("current")), "speaker_source": filled("r_speaker", F.coalesce(infer.speaker(F.col("event_summary")), F.lit("mixed"))),
        "clinical_priority": event_priority(F.col("event_type")), "render_sections": event_sections(F.col("event_type")), "several_doses": F.when((F.col("event_type") == "MedicationChange") & (F.size("doses") > 1), F.array_join("doses", "|")),
        **{f: F.when(care == f, kept) for f in ("supporting_evidence", "current_state", "planned_actions", "care_context")}, **{c: F.array_join(c, "|") for c in LISTS}, "supporting": F.array_join("supporting", ","),
    })
    return out.select(
        "case_id", "event_id", "event_type", "canonical_concept", "visit_state", "status", "temporality", "speaker_source", "clinical_priority", "title", "event_summary", "members", "supporting", "render_sections",
        "supporting_evidence", "current_state", "planned_actions", "care_context", "medication", "laterality", "dose", "frequency", "action", *LISTS,
    )
