"""Events out of flat propositions: type, signature, grouping, slots, order of rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import any_of, lookup
from ..functions.rules import lower
from ..functions.text import event_tokens, safe_text

# Fixed values.
LAB_WORDS = ("a1c", "hemoglobin", "creatinine", "lab", "blood pressure", "result")
WARNING_WORDS = ("call", "warning", "return precaution", "seek care")
TAKING_WORDS = ("taking ", "takes ", "continue ", "continues ", "is on ", "on metoprolol", "on lisinopril", "on amlodipine", "on atorvastatin")
CHANGING_WORDS = ("increase", "decrease", "start", "stop", "hold", "change", "new prescription", "refill")
RETURN_WORDS = ("follow up", "follow-up", "return in", "come back")
ADVICE_WORDS = ("call the office", "watch for", "monitor", "counsel", "avoid", "cut down")
PRIORITY = {"MedicationChange": "high", "PlanOrder": "high", "FollowUp": "high", "PatientInstruction": "high", "DiagnosisImpression": "high", "TestResult": "high", "ExamFinding": "medium", "SymptomCourse": "medium", "MedicationState": "medium"}
SECTIONS = {"ChiefComplaint": "S,Chief Complaint", "SymptomCourse": "S,History of Present Illness", "PMH": "S,History of Present Illness", "MedicationState": "S,Plan", "MedicationChange": "P,Plan", "ExamFinding": "O,Findings", "TestResult": "O,Findings", "DiagnosisImpression": "A,Assessment", "PlanOrder": "P,Plan", "FollowUp": "P,Plan", "PatientInstruction": "P,Plan"}

DOSE = r"\b(\d+(?:\.\d+)?\s*(?:mg|mcg|g|units|ml))\b"
FREQUENCY = r"\b(once daily|twice daily|twice a day|once a day|daily|nightly|weekly|as needed|every \d+ hours)\b"
SIDE = r"\b(left|right|bilateral)\b"
NUMBER = r"(\d+(?:\.\d+)?%?)"
ACTION = r"\b(increase|decrease|start|stop|continue|refill|order|refer|monitor|return)\b"


def event_type(category: Column, predicate: Column, text: Column) -> Column:
    c, p, t = lower(category), lower(predicate), lower(text)
    medication = (
        F.when(any_of(t, TAKING_WORDS), "MedicationState").when(any_of(t, CHANGING_WORDS), "MedicationChange")
        .when(p.isin("instructs", "recommends"), "PatientInstruction").when(p.isin("prescribes", "plans", "orders"), "MedicationChange").otherwise("MedicationState")
    )
    return (
        F.when(c == "chiefcomplaint", "ChiefComplaint").when(c == "symptom", "SymptomCourse").when(c.isin("history", "demographic", "allergy"), "PMH")
        .when(c == "diagnosis", "DiagnosisImpression").when(c == "finding", F.when(any_of(t, LAB_WORDS), "TestResult").otherwise("ExamFinding"))
        .when(c == "testplan", "PlanOrder").when(c == "followupplan", F.when(any_of(t, WARNING_WORDS), "PatientInstruction").otherwise("FollowUp"))
        .when(c == "medicationplan", medication).when(any_of(t, RETURN_WORDS), "FollowUp").when(any_of(t, ADVICE_WORDS), "PatientInstruction").otherwise("PMH")
    )


def event_priority(kind: Column) -> Column:
    return F.coalesce(lookup(PRIORITY, kind), F.lit("low"))


def event_sections(kind: Column) -> Column:
    return F.coalesce(lookup(SECTIONS, kind), F.lit("S,Plan"))


def slots(text: Column) -> Column:
    """Dose, frequency, side, values (three) and first action of a text."""
    t = lower(text)
    first = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    return F.struct(
        first(DOSE).alias("dose"), first(FREQUENCY).alias("frequency"),
        first(SIDE).alias("laterality"), F.array_join(F.slice(F.regexp_extract_all(t, F.lit(NUMBER)), 1, 3), ",").alias("values"),
        first(ACTION).alias("action"),
    )


def event_plan(props: DataFrame, k: int = 14) -> DataFrame:
    """Events of a case: propositions of one type and signature, in the order in which they first appear, k at most.

    A medication state with two doses is a change.
    """
    kind = event_type(F.col("category"), F.col("predicate"), F.col("prop_text"))
    sig = F.concat_ws(" ", F.coalesce(F.nullif(safe_text("concept"), F.lit("")), F.array_join(F.slice(event_tokens("prop_text"), 1, 4), " ")), slots(F.col("prop_text"))["laterality"])
    rows = props.withColumns({"event_type": kind, "signature": sig, "dose": slots(F.col("prop_text"))["dose"]})
    out = rows.groupBy("case_id", "event_type", "signature").agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("members"), F.countDistinct("dose").alias("doses"), F.min_by("concept", "ord").alias("concept"), F.min_by("prop_text", "ord").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda o: F.concat(F.lit("P"), o)), ",").alias("supporting"),
    )
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("first_ord", "event_type", "signature"))
    changed = F.when((F.col("event_type") == "MedicationState") & (F.col("doses") >= 2), "MedicationChange").otherwise(F.col("event_type"))
    out = out.withColumn("n", n).where(F.col("n") <= k).withColumn("event_type", changed)
    return out.select("case_id", F.concat(F.lit("E"), "n").alias("event_id"), "event_type", "concept", "title", "members", "supporting", event_priority(F.col("event_type")).alias("priority"), event_sections(F.col("event_type")).alias("sections"))


def gap_groups(rows: DataFrame, keys: list[str], at: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """Adds group: rows of one key follow each other with at most `gap` between them."""
    w = Window.partitionBy(*keys).orderBy(at, *(order or []))
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("new__", new).withColumn("group", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")
