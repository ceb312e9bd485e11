"""Inputs of the queries: propositions derived from the order tables, and small inline tables that reach every branch of a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import buckets, dealt, drop, once, staged

PROPS = """
select o_custkey as case_id,
       row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) as ord,
       case when l_linenumber % 2 = 0 then 'A' else 'B' end as annotator,
       case l_partkey % 15 when 0 then 'Demographics' when 1 then 'ChiefComplaint' when 2 then 'Symptom' when 3 then 'Problem' when 4 then 'ProblemHistory' when 5 then 'Allergy' when 6 then 'Diagnosis' when 7 then 'Impression' when 8 then 'ExamFinding' when 9 then 'TestResult' when 10 then 'MedicationStatement' when 11 then 'MedicationRequest' when 12 then 'Order' when 13 then 'FollowUp' else 'Counseling' end as prop_type,
       p_name as concept,
       concat('The ', case when l_suppkey % 2 = 0 then 'patient reports ' else 'clinician notes ' end, p_name, ' ', lower(p_type), ' ', cast(p_size as varchar(10)), ' mg') as prop_text,
       case l_returnflag when 'A' then 'confirmed' when 'R' then 'refuted' else 'unconfirmed' end as verification,
       case l_suppkey % 7 when 0 then 'active' when 1 then 'stable' when 2 then 'improving' when 3 then 'worsening' when 4 then 'resolved' when 5 then 'historical' else 'planned' end as clinical_status,
       case when l_linestatus = 'O' then 'current' else 'past' end as temporality,
       case when l_suppkey % 2 = 0 then 'patient' else 'clinician' end as source,
       cast(l_orderkey % 100 as int) as turn_idx
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
"""


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The propositions of a folder's order tables: many queries read them, and they take a sort of all lineitem rows, so they are derived once in a session."""
    return once(spark, "props", sf_dir, lambda: _derived(spark, sf_dir))


#: Kinds by l_partkey % 15, states by l_suppkey % 7; what is in neither is the last of them.
KINDS = ("Demographics", "ChiefComplaint", "Symptom", "Problem", "ProblemHistory", "Allergy", "Diagnosis", "Impression", "ExamFinding", "TestResult", "MedicationStatement", "MedicationRequest", "Order", "FollowUp", "Counseling")
STATES = ("active", "stable", "improving", "worsening", "resolved", "historical", "planned")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of PROPS, dealt by case. Lines are numbered within their order first, so what only tells ties apart goes no further; texts are put together where the table is read.

    What each join gives is written, so the shuffle files of one step at a time stand on the disks.
    """
    lines, orders, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]
    marks = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(0) + F.when(F.col("l_linestatus") == "O", 2).otherwise(0) + F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "R", 8).otherwise(0)
    rows = lines.select("l_orderkey", *ties, marks.cast("byte").alias("marks")).join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("o_orderkey", "o_custkey").orderBy(*ties)))
    of_orders = staged(rows.select("o_custkey", "o_orderkey", "line", "l_partkey", "marks", (F.col("l_suppkey") % 14).cast("byte").alias("s")), "lines", "zstd")
    del rows
    rows = of_orders.join(part.select("p_partkey", "p_name", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    of_parts = staged(rows.select(F.col("o_custkey").alias("case_id"), "o_orderkey", "line", (F.col("l_partkey") % 15).cast("int").alias("kind"), "marks", "s", "p_name", "p_type", "p_size"), "of_parts", "zstd")
    drop(of_orders)
    del rows, of_orders
    n = buckets(spark, lines.count())
    ord_ = F.row_number().over(Window.partitionBy("case_id").orderBy("o_orderkey", "line"))
    numbered = of_parts.repartition(n, "case_id").select("case_id", ord_.alias("ord"), (F.col("o_orderkey") % 100).cast("int").alias("turn_idx"), "kind", "marks", "s", "p_name", "p_type", "p_size")
    said = F.col("s") % 2 == 0
    one = lambda values, n: F.coalesce(F.get(F.array(*map(F.lit, values)), n), F.lit(values[-1]))
    bit = lambda n: F.col("marks").bitwiseAND(n) > 0
    out = dealt(numbered, "props", "case_id", n)
    drop(of_parts)
    return out.select(
        "case_id", "ord", F.when(bit(1), "A").otherwise("B").alias("annotator"), one(KINDS, F.col("kind")).alias("prop_type"), F.col("p_name").alias("concept"),
        F.concat(F.lit("The "), F.when(said, "patient reports ").otherwise("clinician notes "), F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg")).alias("prop_text"),
        F.when(bit(4), "confirmed").when(bit(8), "refuted").otherwise("unconfirmed").alias("verification"), one(STATES, F.col("s") % 7).alias("clinical_status"),
        F.when(bit(2), "current").otherwise("past").alias("temporality"), F.when(said, "patient").otherwise("clinician").alias("source"), "turn_idx",
    )


def _literal(x) -> str:
    if x is None:
        return "null"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


class Inline:
    """Rows that both engines read."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(f.split()[0] for f in self.schema.split(", "))
        kinds = {"long": "bigint", "int": "int", "string": "varchar", "double": "double"}
        first = "(" + ", ".join(f"cast({_literal(v)} as {kinds[f.split()[1]]})" for v, f in zip(self.rows[0], self.schema.split(", "))) + ")"
        return f"(select * from (values {', '.join([first, *('(' + ', '.join(map(_literal, r)) + ')' for r in self.rows[1:])])}) v({names}))"


TURNS = Inline("case_id long, transcript string", [
    (1, "[doctor] Good morning, how are you?\n[patient] I have chest pain and a cough.\n\n[Doctor] Any fever?\nno tag here\n[clinician] We will start lisinopril 10 mg and schedule an ultrasound, then return in two weeks."),
    (2, "[patient] She denies chest pain, shortness of breath and blurry vision but has knee pain. No fever or chills at night\n[doctor] okay"),
    (3, ""), (4, "   \n[patient]   No swelling in the left leg/numb toes\n[patient] thank you"), (5, None),
])
TEXTS = Inline("id long, kind string, modality string, source string, verified string, concept string, body string", [
    (1, "Problem", "", "patient", "confirmed", "chest pain", "The patient reports chest pain."), (2, "Problem", "", "clinician", "confirmed", "ultrasound", "The clinician will order an ultrasound."),
    (3, "Symptom", "", "doctor", "confirmed", "mri", "MRI revealed a small tear."), (4, "Problem", "", "doctor", "confirmed", "edema", "Physical exam with edema of both legs."),
    (5, "Problem", "", "doctor", "refuted", "rash", "No rash."), (6, "Impression", "", "clinician", "confirmed", "gout", "Impression likely gout."), (7, "Problem", "plan", "clinician", "confirmed", "diet", "diet and salt intake"),
    (8, "Symptom", "plan", "", "confirmed", "walk", "Walk more"), (9, "Problem", "", "clinician", "confirmed", "visit", "See you in two weeks, follow up."), (10, "Order", "", "patient", "confirmed", "", "Refill metoprolol 25 mg tablet"),
    (11, "Symptom", "", "patient", "confirmed", "club soda", "The patient drinks club soda."), (12, "Diagnosis", "", "doctor", "confirmed", "boss", "It was nice to meet you boss"), (13, "Problem", "", "patient", "confirmed", "", "okay"),
    (14, "Demographics", "", "patient", "confirmed", "age", "Is he 40?"), (15, "Problem", "", "unknown", "unconfirmed", "Müdigkeit", "Größe: 1,80 m — naïve café"), (16, "Problem", None, None, None, None, None), (17, "FollowUp", "", "doctor", "confirmed", "wine", "wine and cheeseburger with friends"),
    (18, "Problem", "", "patient", "confirmed", "doctor change", "What a change of the doctor, any day"), (19, "ChiefComplaint", "", "patient", "confirmed", "studies", "The studies with classes for bodies"), (20, "Symptom", "", "patient", "confirmed", "a1c", "A1c 7.5 % on 3/4"),
])
LABELS = Inline("id long, raw string, kind string, speaker string, time string", [
    (1, "Affirmed", "Symptom", "patient", "current"), (2, "ruled out", "ExamFinding", "doctor", "next week"), (3, "", "Diagnosis", "clinician", "3 years ago"), (4, "suspected", "Order", "patient", "history of"), (5, "gibberish", "TestResult", "unknown", "will start"),
    (6, "historical", "ProblemHistory", "clinician", "in 2020"), (7, "better", "Allergy", "patient", "2026"), (8, "worse", "Medication State", "doctor", "2030 maybe"), (9, "physical exam", "plan", "doctor", ""), (10, "planned", "followup", "patient", "follow up tomorrow"),
    (11, None, None, None, None), (12, "none", "problem/symptom", "test_result", "previous"), (13, "lab", "Medication", "clinician", "upcoming"), (14, "negative", "chief complaint", "unknown", "since 1999"), (15, "record", "social history", "clinician", "today"),
])
SPANS = Inline("id long, raw string", [(1, "4"), (2, "T6-7"), (3, "9-6"), (4, "1-60"), (5, "1,3;5/7"), (6, "3 to 5"), (7, "x12y"), (8, ""), (9, "t2|T2|1"), (10, "T3 – T5"), (11, None)])
PAYLOADS = Inline("id long, raw string", [
    (1, '{"caps": [{"a": 1}, 2, {"a": 2}]}'), (2, '{"facts": "none", "gold_caps": [{"a": 3}]}'), (3, '[{"a": 4}, "x"]'), (4, '```json\n{"seed_gold_caps": [{"a": 5},]}\n```'), (5, "not json"), (6, '{"transcript_facts": "{\\"caps\\": [{\\"a\\": 6}]}"}'),
    (7, 'Sure: {"atomic_propositions": [{"a": 7}]} done'), (8, '{"clinical_atomic_facts": []}'), (9, None),
])
JUDGMENTS = Inline("case_id long, method string, judgment string", [(1, "a", "supported"), (1, "a", "partial"), (1, "a", "low_value"), (1, "b", "low_value"), (2, "a", "missing"), (2, "a", "contradicted"), (2, "a", "supported"), (2, "b", "partial"), (2, "b", "odd"), (3, "a", None)])
FINDINGS = Inline("case_id long, kind string, type string, severity string", [(1, "hallucination", "fabrication", "major"), (1, "hallucination", "negation", "minor"), (1, "omission", "current_issues", "major"), (2, "omission", "information_plan", "minor"), (2, "omission", "pmfs_issues", "major"), (2, "hallucination", "causality", None), (3, "other", "contextual", "major")])
CHECKS = Inline("id long, factual_accuracy int, omissions int, hallucinations int, organization int, conciseness int, terminology int, attribution int, temporality int, omission string, hallucination string", [(1, 5, 4, 3, 2, 1, 5, 5, 5, "Yes", "no"), (2, 0, 6, 3, 3, 3, 3, 3, 3, "yes ", "YES"), (3, None, None, 1, 1, 1, 1, 1, 1, None, ""), (4, 5, 5, 5, 5, 5, 5, 5, 5, "No", "No")])
NOTES = Inline("case_id long, note string", [(1, "S: pain in the knee\nworse at night\nO: swollen\nnormal reflexes\nA: gout"), (2, "Chief Complaint:\ncough\nAssessment: cold\nHPI: three days\n\nPlan: rest"), (3, "no heading"), (4, "")])
INJECTIONS = Inline("case_id long, ord int, axis string, severity string, sentence string", [(1, 1, "Omission", "major", "Worse  at night"), (1, 2, "omission", "minor", "swollen"), (1, 3, "hallucination", " Major", "fever"), (2, 1, "omission", "MAJOR", "three days"), (2, 2, "omission", "minor", ""), (3, 1, "Hallucination", "minor", None)])
STATUSES = Inline("case_id long, ord int, concept_key string, status string", [(1, 1, "fever", "Unknown"), (1, 2, "fever", "Present"), (1, 3, "cough", "Unknown"), (1, 4, "", "Unknown"), (1, 5, "fever", "Absent"), (2, 1, "fever", "Unknown"), (2, 2, "rash", "Absent"), (2, 3, "rash", "Unknown"), (2, 4, "rash", "Other")])
FLAT = Inline("case_id long, ord int, category string, predicate string, concept string, prop_text string", [
    (1, 1, "Symptom", "reports", "cough", "The patient has a cough."), (1, 2, "medicationplan", "plans", "metformin", "Increase metformin to 500 mg twice daily"), (1, 3, "medicationplan", "states", "aspirin", "She is on aspirin 81 mg daily"), (1, 4, "medicationplan", "states", "aspirin", "She is on aspirin 100 mg"),
    (1, 5, "finding", "notes", "a1c", "A1c is 7.5 %"), (1, 6, "finding", "notes", "murmur", "A murmur on the left"), (1, 7, "symptom", "reports", "cough", "Cough since Monday"), (2, 1, "followupplan", "plans", "", "Return in 2 weeks"), (2, 2, "followupplan", "plans", "", "Call the office with warning signs"),
    (2, 3, "medicationplan", "recommends", "statin", "A statin each evening"), (2, 4, "medicationplan", "prescribes", "statin", "A statin each evening"), (2, 5, "other", "x", "", "avoid salt"), (2, 6, "other", "x", "", "come back soon"), (2, 7, "testplan", "orders", "mri", "MRI of the right knee"), (2, 8, "chiefcomplaint", "", "pain", "pain"), (3, 1, None, None, None, None),
])
