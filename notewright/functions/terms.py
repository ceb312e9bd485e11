"""Vocabularies of attribute inference, audits and scaffolds. Results depend on each of them."""

# Attributes of a proposition, out of its text.
RESULT_SPEAKERS = ("lab", "hemoglobin", "a1c", "creatinine")
PREDICATES = ("denies", "reports", "notes", "shows", "diagnoses", "suspects", "prescribes", "orders", "recommends", "instructs", "plans")
PLANNING_VERBS = ("start ", "increase ", "decrease ", "stop ")
HOLDING_VERBS = ("continue ", "take ")
NEGATED_WORDS = ("denies", "no ", "not ", "without ")
UNCERTAIN_WORDS = ("possible", "possibly", "suspects", "may ", "might ", "unclear", "likely")
TIMES = {"future": ("will ", "plan", "planned", "follow up", "follow-up", "return", "recheck", "start ", "increase ", "decrease "), "past": ("previously", "ago", "last time", "last week", "past ", "history of", "had "), "current": ("today", "currently", "now", "this morning", "stable", "still ")}
ALLERGY_WORDS = ("allergy", "allergic")
COMPLAINT_WORDS = ("chief complaint", "here for", "follow-up for")
PLAN_PREDICATES = ("prescribes", "plans", "orders", "recommends", "instructs")
DRUG_WORDS = ("mg", "tablet", "capsule", "medication", "metformin", "glimepiride", "atorvastatin", "amlodipine", "lisinopril", "metoprolol")
TAKING_WORDS = ("taking ", "takes ", "on metoprolol", "on lisinopril", "on amlodipine", "on atorvastatin")
ORDER_PREDICATES = ("orders", "plans")
TEST_WORDS = ("test", "blood work", "lab", "a1c", "kidney function", "cholesterol", "mri", "x-ray", "scan")
RETURN_WORDS = ("follow up", "follow-up", "return", "call the office", "return precaution")
DIAGNOSIS_PREDICATES = ("suspects", "diagnoses")
DIAGNOSIS_NAMES = ("diagnosis", "neuropathy", "hypertension", "hyperlipidemia", "diabetes")
FINDING_WORDS = ("hemoglobin", "a1c", "creatinine", "bp ", "blood pressure", "result", "lab")
SYMPTOM_NAMES = ("pain", "cough", "dizziness", "numb", "tingling", "swelling", "fatigue", "nocturia")
EXAM_NAMES = ("exam", "notes", "thickened nails", "dry skin", "sensation", "pulses", "edema")
TEMPORAL_TAG_WORDS = ("past", "current", "future", "stable", "improved", "worse", "follow up", "follow-up", "this morning")
CAUSAL_TAG_WORDS = ("because", "due to", "secondary to", "related to")
MEDICATION_TAG_WORDS = ("mg", "tablet", "dose", "medication", "glimepiride", "metformin")
PLAN_TAG_PREDICATES = ("orders", "recommends", "instructs", "plans")
SAFETY_TAG_WORDS = ("hypoglycemia", "return precaution", "call the office", "seek care", "severe")
IMPROVED_WORDS = ("improved", "got better")
ENDED_WORDS = ("resolved", "went away", "improved", "got better")
WORSE_WORDS = ("worse", "worsening", "progressive", "more severe")
SAME_WORDS = ("stable", "unchanged", "same")
CONCEPT_DRUGS = ("glimepiride", "metformin", "metoprolol", "lisinopril", "hydrochlorothiazide", "amlodipine", "atorvastatin")
CONCEPT_DIAGNOSES = ("peripheral neuropathy", "diabetes", "hypertension", "hyperlipidemia", "cataract")
CONCEPT_SITES = ("foot", "feet", "toe", "toes", "hip", "leg", "hand", "back", "knee")

# Labels of an older schema.
OLD_CONFIRMED = ("affirmed", "present", "positive")
OLD_REFUTED = ("negated", "denied", "negative", "absent")
OLD_CATEGORIES = {"demographic": "Demographics", "demographics": "Demographics", "chiefcomplaint": "ChiefComplaint", "allergy": "Allergy", "diagnosis": "Diagnosis", "medicationplan": "MedicationRequest", "testplan": "Order", "followupplan": "FollowUp"}
OLD_RESULT_WORDS = ("mri", "x-ray", "ct ", "echo", "hemoglobin", "a1c", "lab", "emg", "ncv", "ultrasound", "%")
OLD_RETURN_WORDS = ("follow up", "follow-up", "return in", "come back")
OLD_ORDER_WORDS = ("order", "referral", "schedule", "mri", "emg", "ncv", "ultrasound", "epidural")
OLD_DRUG_WORDS = ("prescribe", "start ", "continue ", "stop ", "refill", "dose", "mg")
OLD_SYMPTOM_WORDS = ("pain", "weakness", "numb", "tingl", "swelling", "dizzy", "fatigue", "denies", "no ")

# Statements of a bundle.
CARE_WORDS = ("return precaution", "return if", "go to er", "go to the er", "seek care", "call back", "monitor", "keep a log", "bp log", "blood pressure log", "hydration", "push fluids", "diet", "low salt", "counsel", "advised", "encouraged")
ACTION_WORDS = ("prescribe", "start ", "stop ", "continue ", "increase", "decrease", "adjust", "order", "refer", "referral", "follow up", "repeat", "schedule", "mri", "ct", "x ray", "ultrasound", "lab", "labs")
STATE_WORDS = ("taking ", "currently taking", "is on ", "history of", "past medical history", "allergy", "allergic")
STATEMENT_OF_EVENT = {"MedicationChange": "planned_actions", "PlanOrder": "planned_actions", "FollowUp": "planned_actions", "MedicationState": "current_state", "PMH": "current_state", "PatientInstruction": "care_context", "ExamFinding": "supporting_evidence", "TestResult": "supporting_evidence", "SymptomCourse": "supporting_evidence", "ChiefComplaint": "supporting_evidence", "DiagnosisImpression": "supporting_evidence"}

# Audit events.
AUDIT_STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "for", "with", "without", "in", "on", "at", "by", "from", "that", "this", "these", "those", "patient", "clinician", "doctor", "provider", "reports", "report", "reported", "states", "state", "stated", "has", "have", "had", "is", "are", "was", "were", "be", "being", "been", "shows", "show", "reveals", "revealed", "demonstrates", "demonstrated", "notes", "note", "noted", "advised", "advises", "recommend", "recommended", "recommends", "plans", "planned", "plan", "orders", "ordered", "order", "current", "past", "history", "today", "yesterday", "tomorrow")
SEVERE_WORDS = ("diagnosis", "diagnosed", "impression", "radiculopathy", "neuropathy", "eliquis", "apixaban", "blood thinner", "anticoagulant", "allergy", "prednisone", "gabapentin", "mri", "x-ray", "ct", "hemoglobin", "weakness", "numbness", "tingling", "referral", "follow up", "follow-up", "return precaution", "epidural", "injection", "surgery", "start", "continue", "stop")
NUMERIC_WORDS = ("mri", "x-ray", "ct", "scan", "ultrasound", "imaging", "result", "reveals", "shows", "demonstrates", "level", "dose", "mg", "cm", "mm", "g/dl", "%", "disc degeneration", "arthropathy", "nerve root", "compression", "eliquis", "gabapentin", "prednisone", "radiculopathy", "neuropathy")
MINOR_FACT_WORDS = ("pa-c", "m.d.", "md", "np", "provider", "later that evening", "went back to sleep", "2-3 hours", "2 to 3 hours", "tablet", "capsule", "review of systems", "hoffman", "sensation intact", "strength is", "reflexes", "throughout", "date of service")
AUDIT_TYPES = {"diagnosis": "DiagnosisImpression", "assessment": "DiagnosisImpression", "impression": "DiagnosisImpression", "followupplan": "FollowUpSafety", "testplan": "TestProcedurePlan", "procedure": "TestProcedurePlan", "finding": "FindingResult", "result": "FindingResult", "allergy": "MedicationState", "chiefcomplaint": "SymptomState", "symptom": "SymptomState", "demographic": "PMFSContext"}
AUDIT_DRUG_CATEGORIES = ("medicationplan", "medicationexposure", "medication")
AUDIT_PLAN_PREDICATES = ("prescribes", "orders", "recommends", "plans", "instructs")
AUDIT_SAFETY_WORDS = ("follow-up", "follow up", "return precaution")
AUDIT_DRUG_WORDS = ("allergy", "allergic", "anticoag", "eliquis", "warfarin")
AUDIT_DIAGNOSIS_WORDS = ("diagnosis", "impression", "likely", "consistent with")
AUDIT_VERBS = ("prescribe", "start ", "stop ", "continue ", "hold ", "take ")
AUDIT_RETURN_WORDS = ("refer", "follow-up", "follow up", "return", "come back", "schedule", "order")
URGENT_CATEGORIES = ("diagnosis", "medicationplan", "testplan", "followupplan", "allergy")
PRESENT_CATEGORIES = ("symptom", "finding", "chiefcomplaint")
URGENT_PREDICATES = ("diagnoses", "prescribes", "orders", "recommends", "instructs", "plans")
URGENT_TAGS = ("safety_relevant", "medication", "plan", "diagnostic", "quantitative")
AUDIT_SITES = ("chest", "back", "groin", "abdomen", "ankle", "kidney", "ureter", "hand", "leg", "urine", "shoulder", "heart", "lung")
AUDIT_ACTIONS = ("start", "stop", "continue", "hold", "increase", "decrease", "prescribe", "ordered", "order")
AUDIT_PLANS = ("follow up", "follow-up", "return", "call", "seek care", "lithotripsy", "bmp", "urinalysis", "urine culture", "echocardiogram", "lipid panel")
AUDIT_VALUES = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|cm|mm|%|hours?|days?|weeks?|months?)\b"
DOSE_CHANGE_WORDS = ("increase", "decrease", "start", "stop", "hold", "continue", "dose")
PLAN_EVENTS = ("MedicationPlan", "TestProcedurePlan", "FollowUpSafety")
ISSUE_EVENTS = ("SymptomState", "FindingResult", "DiagnosisImpression")
CONTEXT_CATEGORIES = ("history", "demographic", "allergy")
CAUSE_WORDS = ("because", "due to", "caused by", "related to", "secondary to")
CONTEXT_WORDS = ("history", "previous", "prior", "family", "past", "ago", "today", "current")
FABRICATION_EVENTS = ("MedicationPlan", "TestProcedurePlan", "FollowUpSafety", "FindingResult", "DiagnosisImpression")
SOURCE_EVENTS = ("MedicationPlan", "TestProcedurePlan", "FollowUpSafety", "FindingResult", "MedicationState")
EVENT_RANKS = {"DiagnosisImpression": 7, "MedicationPlan": 6, "MedicationState": 6, "FindingResult": 5, "TestProcedurePlan": 4, "FollowUpSafety": 4, "SymptomState": 3, "PMFSContext": 1}
QUERY_PREDICATES = ("asks", "inquires", "clarifies", "confirms")
QUERY_WORDS = ("question", "asks whether", "asks if", "clarifies whether", "let's talk", "review of systems sheet")
SALIENT_TYPES = ("drug", "problem", "test", "treatment")

# Events of problem clusters.
CLUSTER_SECTIONS = {"ChiefComplaint": "S,Chief Complaint,History of Present Illness", "PMH": "Past Medical History,History of Present Illness", "DiagnosisImpression": "A,Assessment", "ProblemState": "S,A,History of Present Illness,Assessment", "MedicationState": "S,History of Present Illness", "MedicationChange": "P,Plan", "Plan": "P,Plan", "FollowUp": "P,Plan", "TestOrResult": "O,Findings", "TestResult": "O,Findings"}
HIGH_EVENTS = ("MedicationChange", "PlanOrder", "FollowUp", "DiagnosisImpression", "TestResult", "ChiefComplaint")
HIGH_TYPES = ("Order", "MedicationRequest", "Diagnosis", "Impression")
NO_EVENT_CONCEPTS = ("sandwich", "diet", "bread consumption", "water intake", "club soda", "french fries", "bad food habits")
ANCHOR_SCORES = {"Diagnosis": 5, "Impression": 5, "Problem": 4, "ChiefComplaint": 3, "ProblemHistory": 2}
NO_ANCHOR_TEXTS = ("is taking", "takes ", "denies ", "allergy", "family history", "social history", "follow up", "referred", "ordered")
STATEMENT_ORDERS = ("increase ", "decrease ", "start ", "stop ", "switch ", "change ", "continue ", "refill ", "one pill twice a day", "new prescription")
# Times of a cluster's propositions that make it a current or a past one.
CURRENT_MARKERS = ("current", "today", "this morning", "this week", "now", "weeks", "months", "days", "active", "present", "recent")
PAST_MARKERS = ("past", "previous", "historical", "history", "prior", "last december", "during accident", "2018", "2019", "2020", "2021", "age 20", "years ago", "post-menopausal")
# Cluster and proposition types that are no anchors of a bundle.
NO_ANCHOR_CLUSTERS = ("MedicationState", "MedicationChange", "Plan", "FollowUp", "TestOrResult", "TestResult")
NO_ANCHOR_TYPES = ("ProblemHistory", "Order", "MedicationRequest", "MedicationStatement", "FollowUp", "Counseling", "ExamFinding", "TestResult", "Allergy")
ANCHOR_CLUSTERS, ANCHOR_TYPES = ("ProblemState", "Diagnosis", "DiagnosisImpression"), ("ChiefComplaint", "Problem", "Diagnosis", "Impression")

PAST_TIMES = ("past", "historical", "history")
LOW_VALUE_ANCHORS = ("allergy", "bad combination", "blood pressure cuff", "bread consumption", "cataract surgery", "chlamydia", "club soda", "cold weather", "dating her partner for three years", "diet", "ecog performance status", "er positive", "er/pr positive", "establish care", "eye prescription", "fluid intake", "french fries", "gonorrhea", "hepatitis c", "hiv", "iodine", "last pap smear", "menopausal", "new glasses", "no evidence of recurrence", "not cancerous", "pap smear history", "pap smear", "performance status", "pr positive", "smoking", "smoking cessation", "stage zero", "syphilis", "thinking about it", "trichomoniasis", "urology")
ACTION_PHRASES = ("consult", "continue ", "follow-up", "follow up", "increase ", "order ", "ordered", "recommend", "referral", "refer", "schedule", "should ", "start ", "stop ", "testing", "undergo", "will ")
#: What an assessment says of a bundle's problem that holds one of the words, in this order.
ASSESSMENTS = ((("dcis", "carcinoma", "cancer", "breast cancer"), "The patient is being followed for {} without evidence of recurrence."), (("kidney stone", "nephrolithiasis"), "Findings are consistent with {}."), (("carpal tunnel", "cubital tunnel", "neuropathy"), "Findings are concerning for {}."), (("std", "infection"), "Symptoms are concerning for {}."), (("ulcer", "wound"), "The patient has {} requiring ongoing management."))

# Scaffolds out of entities.
GENERIC_ENTITIES = ("any medicine", "medicine", "medicines", "medications", "any medical problems", "medical problems", "surgeries", "surgery", "your pain", "pain", "other injuries", "procedures", "your exam", "exam")
SOCIAL_SENTENCES = ("year old", "years old", "works as", "job", "insurance", "lives with", "smokes", "drink", "alcohol", "marijuana")
VISIT_SENTENCES = ("chief complaint", "here because", "came in", "coming in", "reason for visit")
UNSURE_SENTENCES = ("unknown", "unsure", "not sure", "don't know", "doesn't know", "unclear")
PAST_SENTENCES = ("history of", "had ", "when i was", "previous", "family history", "appendix out", "appendectomy")
POSITIVE_TYPES = ("problem", "drug", "treatment", "test", "procedure", "bodyloc", "labvalue")
TREATED_SENTENCES = ("prescribe", "start", "continue", "increase", "decrease", "follow up", "return", "refer")
TESTED_SENTENCES = ("x-ray", "mri", "ct", "normal", "lab", "result", "show")
PLANNED_SENTENCES = ("plan", "follow up", "return", "refer", "order", "prescribe", "counsel")
JUDGED_SENTENCES = ("impression", "diagnosis", "suspect", "assessment", "sprain", "kidney stone", "hypertension", "diabetes")
FINGER_PAINS = ("right index finger pain", "index finger pain", "finger pain")

# Sentence ends that are none; note headings.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "pa.", "pa-c.", "np.", "rn.", "m.d.", "d.o.", "e.g.", "i.e.")
NOTE_KEYS = {"soap": ("S", "O", "A", "P"), "sectioned": ("Chief Complaint", "History of Present Illness", "Findings", "Assessment", "Plan")}

# Lines before a note that say what it is; fixed values, matched from a line's start to its end whatever the case.
PREAMBLES = (
    r"here(?:'s|’s| is) (?:a |the )?(?:concise )?(?:clinical note|soap note|medical note|summary)(?: summarizing the (?:patient )?encounter)?(?:, based on the provided information)?[:,]?",
    r"here(?:'s|’s| is) the clinical note(?:, generated from the provided transcript and evidence units)?(?:, based on the provided (?:transcript|information|transcript and clinical atomic propositions))?[:,]?",
    r"below is (?:a |the )?(?:clinical note|soap note|summary)[:,]?",
)
# How a line after the first opens, and how it is written; the first that fits. Fixed values.
OPENERS = (
    ("The patient reports", "Reports "), ("The patient states", "States "), ("The patient denies", "Denies "), ("The patient has", "Has "), ("The patient is", "Is "), ("The patient underwent", "Underwent "), ("The patient should", "Should "),
    ("The patient will", "Will "), ("The patient can", "Can "), ("The patient's", "Patient's "), ("The doctor recommends", "Recommend "), ("The doctor orders", "Order "), ("The doctor discussed", "Discussed "),
)
