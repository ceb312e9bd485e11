"""Queries of attribute inference, audits, bundle events, units and scaffolds, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import infer, salvage
from ..functions import lexicon as L
from ..functions import terms as W
from ..functions import text as T
from ..operators import audit, bundle_events, bundles, event_plans, events, propositions, scaffolds, states, turns, units
from . import fixtures as V
from . import sql as S
from .catalog import _CT, _ETYPE, _P, ORACLES, QUERIES, assigned_of, bundled, of, query, table

# Values that stand for what a model's labels would be: a row takes one by its number.
CATEGORIES = ("Diagnosis", "MedicationPlan", "TestPlan", "FollowUpPlan", "Finding", "Allergy", "ChiefComplaint", "Symptom", "Demographic", "History", "Procedure", "Uncertain or noise", "")
PREDICATES = ("reports", "prescribes", "denies", "orders", "notes", "asks", "diagnoses")
OLD_STATUSES = ("Affirmed", "negated", "Possible", "denied", "positive", "")
EVENT_TYPES = ("MedicationChange", "PMH", "PatientInstruction", "ExamFinding", "Other", "")
ENTITY_TYPES = ("problem", "drug", "test", "treatment", "other")


def nth(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


# attributes

_l = "lower({})".format
_NEGATED = S.has("l", W.NEGATED_WORDS)


def _speaker(l: str) -> str:
    return f"case when starts_with({l}, 'the patient') or starts_with({l}, 'patient ') or contains(' ' || {l} || ' ', ' the patient ') then 'patient' when starts_with({l}, 'the clinician') or starts_with({l}, 'the doctor') or contains(' ' || {l} || ' ', ' the doctor ') then 'clinician' when {S.has(l, W.RESULT_SPEAKERS)} then 'test_result' end"


def _predicate(l: str) -> str:
    return f"coalesce({S.first_hit(l, W.PREDICATES)}, case when {S.has(l, W.PLANNING_VERBS)} then 'plans' when {S.has(l, W.HOLDING_VERBS)} then 'has' end)"


def _status(l: str) -> str:
    return f"case when {S.has(l, W.NEGATED_WORDS)} then 'negated' when {S.has(l, W.UNCERTAIN_WORDS)} then 'uncertain' else 'affirmed' end"


def _time(l: str) -> str:
    return "case " + " ".join(f"when {S.has(l, words)} then {S.q(time)}" for time, words in W.TIMES.items()) + " end"


def _category(l: str, p: str, s: str) -> str:
    p, s = f"coalesce({p}, '')", f"coalesce({s}, '')"
    return (
        f"case when {S.has(l, W.ALLERGY_WORDS)} then 'Allergy' when {S.has(l, W.COMPLAINT_WORDS)} then 'ChiefComplaint' when ({S.inside(p, W.PLAN_PREDICATES)} and {S.has(l, W.DRUG_WORDS)}) or {S.has(l, W.TAKING_WORDS)} then 'MedicationPlan'"
        f" when {S.inside(p, W.ORDER_PREDICATES)} and {S.has(l, W.TEST_WORDS)} then 'TestPlan' when {S.has(l, W.RETURN_WORDS)} then 'FollowUpPlan' when {S.inside(p, W.DIAGNOSIS_PREDICATES)} or {S.has(l, W.DIAGNOSIS_NAMES)} then 'Diagnosis'"
        f" when {s} = 'test_result' or {S.has(l, W.FINDING_WORDS)} then 'Finding' when {S.has(l, W.SYMPTOM_NAMES)} then 'Symptom' when {S.has(l, W.EXAM_NAMES)} then 'Finding' else 'History' end"
    )


def _tags(l: str, k: str, p: str) -> str:
    k, p = f"coalesce({k}, '')", f"coalesce({p}, '')"
    found = {
        "causal": S.has(l, W.CAUSAL_TAG_WORDS), "diagnostic": f"{k} = 'Diagnosis'", "exam": f"{k} = 'Finding'", "medication": f"({k} = 'MedicationPlan' or {S.has(l, W.MEDICATION_TAG_WORDS)})", "plan": f"({k} in ('TestPlan', 'FollowUpPlan') or {S.inside(p, W.PLAN_TAG_PREDICATES)})",
        "quantitative": f"regexp_matches({l}, '\\p{{Nd}}')", "safety_relevant": S.has(l, W.SAFETY_TAG_WORDS), "symptom": f"{k} = 'Symptom'", "temporal": S.has(l, W.TEMPORAL_TAG_WORDS),
    }
    return "list_filter([" + ", ".join(f"case when {c} then {S.q(n)} end" for n, c in found.items()) + "], lambda x: x is not null)"


def _visit(l: str, s: str, time: str) -> str:
    return f"case when {s} = 'negated' then 'ruled_out' when {s} = 'uncertain' then 'uncertain' when {S.has(l, W.ENDED_WORDS)} then case when {S.has(l, W.IMPROVED_WORDS)} then 'improving' else 'resolved' end when {S.has(l, W.WORSE_WORDS)} then 'worsening' when {S.has(l, W.SAME_WORDS)} then 'stable' when coalesce({time}, '') = 'past' then 'historical' else 'active' end"


def _concept(t: str, l: str, k: str) -> str:
    return (
        f"coalesce({S.first_hit(l, W.CONCEPT_DRUGS)}, {S.first_hit(l, W.CONCEPT_DIAGNOSES)}, case when contains({l}, 'blood pressure') then 'blood pressure' when contains({l}, 'kidney function') then 'kidney function test' when contains({l}, 'cholesterol') then 'cholesterol test'"
        f" when contains({l}, 'blood work') then 'blood work' when contains({l}, 'pain') then coalesce('pain:' || {S.first_hit(l, W.CONCEPT_SITES)}, 'pain') when contains({l}, 'cough') then 'cough' when {S.has(l, ('sensation', 'numb', 'tingling'))} then 'sensory change' end,"
        f" nullif(array_to_string(list_slice({S.event_tokens(t, L.EVENT_STOP_WORDS)}, 1, 4), ' '), ''), nullif({k}, ''), 'clinical_state')"
    )


@query(f"""with t as (select conv_id, turn, {S.txt('text')} as t, lower({S.txt('text')}) as l from conversations where {S.txt('text')} <> ''),
a as (select *, {_speaker('l')} as speaker, {_predicate('l')} as predicate, {_status('l')} as status, {_time('l')} as temporality from t),
b as (select *, {_category('l', 'predicate', 'speaker')} as category from a)
select conv_id, turn, speaker, predicate, status, temporality, category, array_to_string({_tags('l', 'category', 'predicate')}, ',') as tags, {_visit('l', 'status', 'temporality')} as visit_state, {_concept('t', 'l', 'category')} as concept from b""")
def inferred_attributes(spark, d):
    out = infer.enriched(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return out.select("conv_id", "turn", "speaker", "predicate", "status", "temporality", "category", F.array_join("tags", ",").alias("tags"), "visit_state", "concept")


_FLATTENED = f"""(select case_id, ord, turn_idx, prop_type as category, {S.txt('prop_text')} as t, lower({S.txt('prop_text')}) as l, concept, case when ord % 3 = 0 then 'doctor' else source end as speaker, case verification when 'confirmed' then 'affirmed' when 'refuted' then 'negated' else 'uncertain' end as status,
 clinical_status as visit_state, temporality from {_P})"""


@query(f"select case_id, cast(ord as bigint) as ord, category, concept, speaker, status, visit_state, temporality, {_predicate('l')} as predicate, array_to_string({_tags('l', 'category', _predicate('l'))}, ',') as tags from {_FLATTENED}")
def flat_reshape(spark, d):
    p = V.props(spark, d).withColumn("evidence", F.when(F.col("ord") % 3 == 0, F.array(F.struct(F.lit(" ").alias("turn_speaker")), F.struct(F.lit("doctor").alias("turn_speaker")))).otherwise(F.array(F.struct(F.lit("").alias("turn_speaker")))))
    out = infer.flattened(p.select("case_id", F.col("ord").cast("long").alias("ord"), "prop_type", "concept", "prop_text", "verification", "clinical_status", "temporality", "source", "evidence"), "evidence")
    return out.select("case_id", "ord", "category", "concept", "speaker", "status", "visit_state", "temporality", "predicate", F.array_join("tags", ",").alias("tags"))


_FOLD = "regexp_replace(lower({}), '[^a-z]', '', 'g')".format
_OLD_TYPE = (
    f"coalesce({S.pick('f', W.OLD_CATEGORIES)}, case when f = 'history' then case when contains(l, 'allerg') then 'Allergy' else 'ProblemHistory' end when f = 'finding' then case when {S.has('l', W.OLD_RESULT_WORDS)} then 'TestResult' when source = 'patient' then 'Symptom' else 'ExamFinding' end"
    f" when f = 'symptom' then 'Symptom' when f = 'uncertainornoise' then 'Problem' when {S.has('l', W.OLD_RETURN_WORDS)} then 'FollowUp' when {S.has('l', W.OLD_ORDER_WORDS)} then 'Order' when {S.has('l', W.OLD_DRUG_WORDS)} then 'MedicationRequest' when {S.has('l', W.OLD_SYMPTOM_WORDS)} then 'Symptom' else 'Problem' end)"
)
_OLD_MODALITY = (
    "case when f = 'finding' and source = 'clinician' then 'exam' when kind = 'TestResult' then 'test_result' when kind in ('Diagnosis', 'Impression') or p in ('diagnoses', 'suspects', 'notes') then 'assessment'"
    " when kind in ('MedicationRequest', 'Order', 'FollowUp', 'Counseling') or p in ('orders', 'plans', 'prescribes', 'recommends', 'instructs') then 'plan' when kind in ('ProblemHistory', 'Demographics', 'Allergy') then case when source in ('clinician', 'test_result') then 'historical_record' else 'interview' end when source = 'patient' then 'interview' else 'unknown' end"
)


@query(f"""with a as (select case_id, ord, source, lower(prop_text) as l, {_FOLD(S.nth(CATEGORIES, 'ord % 13'))} as f, {_FOLD(S.nth(PREDICATES, 'ord % 7'))} as p, {_FOLD(S.nth(OLD_STATUSES, 'ord % 6'))} as s from {_P}), b as (select *, {_OLD_TYPE} as kind from a)
select case_id, cast(ord as bigint) as ord, kind, {_OLD_MODALITY} as modality, case when {S.inside('s', W.OLD_CONFIRMED)} then 'confirmed' when {S.inside('s', W.OLD_REFUTED)} then 'refuted' else 'unconfirmed' end as verification from b""")
def legacy_inference(spark, d):
    n = F.col("ord")
    p = V.props(spark, d).withColumns({"c": nth(CATEGORIES, n % 13), "p": nth(PREDICATES, n % 7), "s": nth(OLD_STATUSES, n % 6)})
    p = p.withColumn("kind", infer.old_type("c", "prop_text", F.col("source")))
    return p.select("case_id", n.cast("long").alias("ord"), "kind", infer.old_modality("c", F.col("kind"), F.col("source"), "p").alias("modality"), infer.old_verification("s").alias("verification"))


_BUCKET = f"case when {S.has('n', W.CARE_WORDS)} then 'care_context' when {S.has('n', W.ACTION_WORDS)} then 'planned_actions' when {S.has('n', W.STATE_WORDS)} then 'current_state' else 'supporting_evidence' end"


@query(f"select conv_id, turn, {_BUCKET} as by_words, coalesce({S.pick('e', W.STATEMENT_OF_EVENT)}, {_BUCKET}) as of_event from (select conv_id, turn, {S.norm('text')} as n, {S.nth(EVENT_TYPES, 'turn % 6')} as e from conversations)")
def statement_buckets(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", infer.statement_bucket(F.col("text")).alias("by_words"), infer.statement_bucket(F.col("text"), nth(EVENT_TYPES, F.col("turn") % 6)).alias("of_event"))


# audits


def _facts(spark, d) -> DataFrame:
    n, text = F.col("ord"), F.col("prop_text")
    p = V.props(spark, d).withColumns({"category": nth(CATEGORIES, n % 13), "predicate": nth(PREDICATES, n % 7), "status": F.when(F.col("verification") == "confirmed", "affirmed").when(F.col("verification") == "refuted", "negated").otherwise("")})
    return p.select("case_id", n.cast("long").alias("ord"), "category", "predicate", "status", text.alias("text"), infer.tags(text, F.col("category"), F.col("predicate")).alias("tags"), (F.col("turn_idx") % 5).alias("source"))


_FACTS = f"""(select *, {_tags('l', 'category', 'predicate')} as tags from (select case_id, ord, {S.nth(CATEGORIES, 'ord % 13')} as category, {S.nth(PREDICATES, 'ord % 7')} as predicate, case verification when 'confirmed' then 'affirmed' when 'refuted' then 'negated' else '' end as status, prop_text as text, lower(prop_text) as l, turn_idx % 5 as source from {_P}))"""
_NUM, _SEV = S.has("l", W.NUMERIC_WORDS), S.has("l", W.SEVERE_WORDS)
_URGENT = f"len(list_intersect(tags, [{', '.join(map(S.q, W.URGENT_TAGS))}])) > 0"
_C = "lower(category)"
_FPRIO = f"(case when {S.inside(_C, W.URGENT_CATEGORIES)} then 60 when {S.inside(_C, W.PRESENT_CATEGORIES)} then 40 when {_C} = 'history' then 20 else 0 end + case when {S.inside('predicate', W.URGENT_PREDICATES)} then 25 else 0 end + case when {_URGENT} then 25 else 0 end + case when {_SEV} then 25 else 0 end + case when {_NUM} then 10 else 0 end)"
_SPRIO = f"(case when {S.inside(_C, W.URGENT_CATEGORIES)} then 70 when {S.inside(_C, W.PRESENT_CATEGORIES)} then 45 when {_C} = 'history' then 15 else 0 end + case when {_URGENT} then 30 else 0 end + case when {_SEV} then 30 else 0 end + case when {_NUM} then 10 else 0 end - case when {S.has('l', W.MINOR_FACT_WORDS)} then 35 else 0 end)"
_ATYPE = (
    f"coalesce(case when {S.inside(_C, W.AUDIT_DRUG_CATEGORIES)} then case when {S.inside('predicate', W.AUDIT_PLAN_PREDICATES)} then 'MedicationPlan' else 'MedicationState' end end, {S.pick(_C, W.AUDIT_TYPES)}, case when {S.has('l', W.AUDIT_SAFETY_WORDS)} then 'FollowUpSafety' when {S.has('l', W.AUDIT_DRUG_WORDS)} then 'MedicationState'"
    f" when {_NUM} then 'FindingResult' when {S.has('l', W.AUDIT_DIAGNOSIS_WORDS)} then 'DiagnosisImpression' when {S.has('l', W.AUDIT_VERBS)} then 'MedicationState' when {S.has('l', W.AUDIT_RETURN_WORDS)} then 'FollowUpSafety' else 'PMFSContext' end)"
)
_OMISSION = f"case when {S.inside('event_type', W.PLAN_EVENTS)} then 'Information and Plan' when {S.inside('event_type', W.ISSUE_EVENTS)} then 'Current Issues' when event_type = 'MedicationState' then case when {S.has('l', W.DOSE_CHANGE_WORDS)} then 'Information and Plan' else 'PMFS' end when event_type = 'PMFSContext' or {S.inside(_C, W.CONTEXT_CATEGORIES)} then 'PMFS' else 'Current Issues' end"
_NEG = "(status = 'negated' or contains(' ' || l || ' ', ' no ') or contains(l, 'denies'))"
_CAUSE, _CTX = S.has("l", W.CAUSE_WORDS), S.has("l", W.CONTEXT_WORDS)
_FAMILIES = f"concat_ws(',', case when {_CAUSE} then 'Causality' end, case when {_CTX} then 'Contextual' end, case when {S.inside('event_type', W.FABRICATION_EVENTS)} or not ({_NEG} or {_CAUSE} or {_CTX}) then 'Fabrication' end, case when {_NEG} then 'Negation' end)"
_LABEL = "case when {0} >= 75 then 'high' when {0} >= 40 then 'medium' else 'low' end".format
_VERIFY = f"({S.txt('text')} <> '' and not ({S.inside('predicate', W.QUERY_PREDICATES)} and status in ('', 'uncertain')) and not {S.has('l', W.QUERY_WORDS)} and {_FPRIO} >= 40)"


@query(f"select case_id, cast(ord as bigint) as ord, event_type, fact_score, note_score, {_LABEL('fact_score')} as label, case when fact_score >= 60 then 'major' else 'minor' end as severity, {_OMISSION} as omission, {_FAMILIES} as hallucination, {_VERIFY} as verify from (select *, {_ATYPE} as event_type, {_FPRIO} as fact_score, {_SPRIO} as note_score from {_FACTS})")
def fact_priorities(spark, d):
    c = {x: F.col(x) for x in ("category", "predicate", "status", "text", "tags")}
    f = _facts(spark, d).withColumns({"event_type": audit.event_type(c["category"], c["predicate"], c["text"]), "fact_score": audit.fact_priority(c["category"], c["predicate"], c["text"], c["tags"]), "note_score": audit.summary_priority(c["category"], c["text"], c["tags"])})
    return f.select(
        "case_id", "ord", "event_type", "fact_score", "note_score", audit.priority_label(F.col("fact_score")).alias("label"), audit.severity(F.col("fact_score")).alias("severity"), audit.omission_family(c["category"], F.col("event_type"), c["text"]).alias("omission"),
        audit.hallucination_families(F.col("event_type"), c["status"], c["text"]).alias("hallucination"), audit.to_verify(c["category"], c["predicate"], c["status"], c["text"], c["tags"]).alias("verify"),
    )


_KEY = S.audit_key("text", W.AUDIT_STOP_WORDS)
_PRIMARY = f"list_concat(list_concat(list_slice({S.hits('l', W.AUDIT_PLANS, 4)}, 1, 2), list_slice({S.hits('l', W.AUDIT_ACTIONS, 3)}, 1, 2)), list_concat(list_slice({S.hits('l', W.AUDIT_SITES, 3)}, 1, 2), list_slice(regexp_extract_all(l, {S.q(W.AUDIT_VALUES)}), 1, 2)))"
_MAIN = f"array_to_string(list_slice(list_sort(list_distinct(case when len({_PRIMARY}) > 0 then {_PRIMARY} else list_slice(list_filter(string_split({_KEY}, ' '), lambda w: w <> ''), 1, 3) end)), 1, 4), ' ')"


def _events(prefix: str, score: str, concept: str, keys: str) -> str:
    return f"""with f as (select *, {concept} as concept from (select *, {_ATYPE} as event_type, {score} as score from {_FACTS})),
g as (select case_id, {keys}, min(ord) as first_ord, count(*) as facts, arg_max({{'ord': ord, 'text': text, 'l': l, 'category': category, 'status': status, 'score': score}}, {{'s': score, 'o': -ord}}) as b from f group by case_id, {keys}),
n as (select case_id, event_type, concept, facts, cast(row_number() over (partition by case_id order by first_ord, event_type, concept) - 1 as int) as n, b.ord as ord, b.text as text, b.l as l, b.category as category, b.status as status, b.score as score from g)
select case_id, {S.q(prefix)} || n as event_id, n, event_type, concept, facts, cast(ord as bigint) as ord, text, score, {_LABEL('score')} as clinical_priority, case when score >= 60 then 'major' else 'minor' end as severity, {_OMISSION} as omission_family, {_FAMILIES} as hallucination_families from n"""


_RANK = "case event_type " + " ".join(f"when {S.q(k)} then {v}" for k, v in W.EVENT_RANKS.items()) + " else 0 end"


@query(f"select * exclude (n) from (select *, cast(row_number() over (partition by case_id order by case clinical_priority when 'high' then 3 when 'medium' then 2 else 1 end desc, severity = 'major' desc, {_RANK} desc, n) as int) as rank from ({_events('TE', _FPRIO, _KEY, 'event_type, concept')})) where rank <= 3")
def audit_events(spark, d):
    return audit.events(_facts(spark, d), k=3)


_SIG = f"case when {S.inside('event_type', W.SOURCE_EVENTS)} or event_type = 'SymptomState' then {_MAIN} else {_KEY} end"


@query(f"select * exclude (n) from ({_events('SE', _SPRIO, _SIG, 'event_type, concept, source')})")
def note_events(spark, d):
    return audit.events(_facts(spark, d), of_note=True)


_SIGNALS = f"(select conv_id as case_id, turn as ord, {S.nth(('problem', 'note', 'Drug', ''), 'turn % 4')} as kind, array_to_string(list_slice({S.toks('text')}, 1, 3), ' ') as text, array_to_string(list_slice({S.toks('text')}, 4, 6), ' ') as term, {S.nth(('finding', 'sign'), 'turn % 2')} as semantic from conversations where role = 'user')"
_WORDS = "list_filter(regexp_extract_all({}, '[a-z0-9]+'), lambda w: length(w) > 3)".format


def _held(words: str, text: str) -> str:
    return f"(len({words}) > 0 and len(list_filter({words}, lambda w: contains({text}, w))) >= least(2, len({words})))"


def _relevant(c: str) -> str:
    return f"((length({c}) >= 5 and contains(chunk, {c})) or {_held(_WORDS(c), 'chunk')})"


@query(f"""with s as (select *, lower({S.txt('text')}) as a, lower({S.txt('term')}) as b, row_number() over (partition by case_id, kind, text, term order by ord) as r from {_SIGNALS} where {S.has('lower(kind)', W.SALIENT_TYPES)} or {S.has("lower(concat_ws(' ', kind, text, term, semantic))", W.SEVERE_WORDS)}),
c as (select conv_id as case_id, lower(string_agg(text, chr(10) order by turn)) as chunk, coalesce(lower(string_agg(text, chr(10) order by turn) filter (role = 'assistant' and turn % 4 = 1)), '') as held from conversations group by 1),
x as (select s.*, chunk, held from s join c using (case_id) where r = 1),
u as (select * from x where ({_relevant('a')} or {_relevant('b')}) and not ((length(a) >= 4 and contains(held, a)) or (length(b) >= 4 and contains(held, b)) or {_held(_WORDS("case when b <> '' then b else a end"), 'held')}))
select case_id, ord, kind, text, term, cast(place as int) as place from (select *, row_number() over (partition by case_id order by ord) as place from u) where place <= 8""")
def uncovered_signals(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    toks, n = T.tokens("text"), F.col("turn")
    signals = c.where("role = 'user'").select("case_id", n.alias("ord"), nth(("problem", "note", "Drug", ""), n % 4).alias("kind"), F.array_join(F.slice(toks, 1, 3), " ").alias("text"), F.array_join(F.slice(toks, 4, 3), " ").alias("term"), nth(("finding", "sign"), n % 2).alias("semantic"))
    chunk = c.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    props = c.where("role = 'assistant' and turn % 4 = 1").select("case_id", n.alias("ord"), "text")
    return audit.uncovered_signals(signals, chunk, props)


_REASONS = "(select conv_id as case_id, turn as ord, trim(case when turn % 3 = 0 then 'S' || (turn - 1) || ': ' || coalesce(text, '') else coalesce(text, '') end) as reason from conversations where role = 'assistant')"


@query(f"""with ids as (select distinct conv_id as case_id, cast(turn as bigint) as id from conversations where role = 'user'),
r as (select case_id, ord, {S.txt('reason')} as reason, try_cast(nullif(regexp_extract(reason, '(?i)\\bS(\\d+)\\b', 1), '') as bigint) as id from {_REASONS} where {S.txt('reason')} <> ''),
own as (select ids.case_id, ids.id, arg_min(r.reason, r.ord) as own from ids join r using (case_id, id) group by 1, 2),
rest as (select r.case_id, r.reason as spare, row_number() over (partition by r.case_id order by r.ord) as k from r left join ids using (case_id, id) where ids.case_id is null),
n as (select ids.case_id, ids.id, own.own, row_number() over (partition by ids.case_id, own.own is null order by ids.id) as k from ids left join own using (case_id, id))
select n.case_id, n.id, coalesce(n.own, rest.spare, 'S' || n.id || ': clinically important unsupported/missing event detected.') as reason from n left join rest on rest.case_id = n.case_id and n.own is null and rest.k = n.k""")
def aligned_reasons(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("S"), F.col("turn") - 1, F.lit(": "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return audit.aligned_reasons(c.where("role = 'user'").select("case_id", F.col("turn").cast("long").alias("id")), c.where("role = 'assistant'").select("case_id", F.col("turn").alias("ord"), F.trim(said).alias("reason")), "S")


@query(f"select id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(raw, ''), ','), lambda x: try_cast(nullif(regexp_extract(trim(x), '^(?i:T)(\\d+)$', 1), '') as int)), lambda x: x is not null))), ',') as ids from {V.SPANS.sql}")
def event_label_ids(spark, d, rows=None):
    return of(V.SPANS, spark, rows).select("id", F.array_join(audit.label_ids(F.split(F.coalesce("raw", F.lit("")), ","), "T").cast("array<string>"), ",").alias("ids"))


_LISTED = "(select conv_id as case_id, turn as ord, array_to_string(list_slice({t}, 1, 2), ' ') as concept from conversations where role = '{r}')".format
_PRED, _REF = _LISTED(t=S.toks("text"), r="assistant"), _LISTED(t=S.toks("text"), r="user")


def _found(rows: str, judged: str, n: str) -> str:
    return f"(select case_id, count(*) filter (j.norm is not null) as {n}_found from (select distinct case_id, {S.norm('concept')} as norm from {rows} where {S.norm('concept')} <> '') x left join (select distinct case_id, {S.norm('concept')} as norm from {judged}) j using (case_id, norm) group by 1)"


@query(f"""with n as (select coalesce(p.case_id, r.case_id) as case_id, coalesce(n_pred, 0) as n_pred, coalesce(n_ref, 0) as n_ref from (select case_id, count(*) as n_pred from {_PRED} group by 1) p full join (select case_id, count(*) as n_ref from {_REF} group by 1) r using (case_id)),
f as (select n.*, coalesce(pred_found, 0) as pred_found, coalesce(ref_found, 0) as ref_found from n left join {_found(_PRED, _REF, 'pred')} a using (case_id) left join {_found(_REF, _PRED, 'ref')} b using (case_id)),
s as (select *, case when n_pred > 0 then pred_found / n_pred else 0.0 end as "precision", case when n_ref > 0 then ref_found / n_ref else 0.0 end as recall from f)
select *, case when "precision" + recall = 0 then 0.0 else 2 * "precision" * recall / ("precision" + recall) end as f1 from s""")
def concept_verification(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    side = lambda role: c.where(F.col("role") == role).select("case_id", F.col("turn").alias("ord"), F.array_join(F.slice(T.tokens("text"), 1, 2), " ").alias("concept"))
    pred, ref = side("assistant"), side("user")
    return audit.concept_scores(pred, ref, ref, pred)


# bundle events

from .catalog import _CLUSTERS  # noqa: E402

_CTYPE = "case when cluster_type in ('MedicationState', 'MedicationChange') then cluster_type when cluster_type = 'ProblemState' then case when primary_type = 'ChiefComplaint' then 'ChiefComplaint' when primary_type = 'ProblemHistory' then 'PMH' when primary_type in ('Diagnosis', 'Impression', 'Allergy') then 'DiagnosisImpression' else 'SymptomCourse' end when cluster_type in ('Diagnosis', 'DiagnosisImpression') then 'DiagnosisImpression' when cluster_type in ('TestOrResult', 'TestResult') then 'TestResult' when cluster_type = 'Plan' then 'PlanOrder' when cluster_type = 'FollowUp' then 'FollowUp' else 'SymptomCourse' end"


@query(f"""with c as ({_CLUSTERS}), n as (select *, 'CL' || row_number() over (partition by case_id order by place, cluster_type, cluster_concept) as cluster_id, {_CTYPE} as event_type from c)
select case_id, cluster_id, event_type, case when {S.inside('event_type', W.HIGH_EVENTS)} or {S.inside('primary_type', W.HIGH_TYPES)} or salience >= 9 then 'high' when salience >= 6 then 'medium' else 'low' end as clinical_priority,
 coalesce({S.pick("case when event_type in ('ChiefComplaint', 'PMH', 'DiagnosisImpression') then event_type else cluster_type end", W.CLUSTER_SECTIONS)}, 'Assessment') as sections from n where not {S.inside(S.norm('cluster_concept'), W.NO_EVENT_CONCEPTS)}""")
def cluster_events(spark, d):
    return bundle_events.cluster_events(states.clusters(V.props(spark, d))).select("case_id", "cluster_id", "event_type", "clinical_priority", "sections")


def _bundle_props(spark, d) -> DataFrame:
    """Flat propositions; their concepts and texts also name conditions, so that every rule has rows."""
    n = F.col("ord")
    p = V.props(spark, d).withColumns({"concept": F.concat_ws(" ", nth(CONDITIONS, n % len(CONDITIONS)), F.element_at(F.split("concept", " "), 1)), "status": F.when(F.col("verification") == "refuted", "negated").otherwise("affirmed"), "visit_state": F.col("clinical_status"), "speaker": F.when(n % 4 == 0, "doctor").otherwise(F.col("source"))})
    return bundle_events.features(p.withColumn("text", F.concat_ws(" ", nth(SAID, n % len(SAID)), "prop_text")))


CONDITIONS = ("", "blood pressure", "knee pain", "chlamydia", "diabetes", "smoking cessation", "mammogram", "kidney stone", "cough")
SAID = ("", "She is taking", "He denies", "Increase ", "continue the")
_AL = lambda c: f"array_to_string({S.align(c)}, ' ')"
_FAM = lambda t: "case when {0} = '' then '' ".format(t) + " ".join(f"when contains({t}, {S.q(a)}) or contains({S.q(a)}, {t}) then {S.q(f)}" for a, f in L.PROBLEM_FAMILIES.items()) + f" else {t} end"
_BP = f"""(select *, {S.txt('concept')} as named, {S.norm('concept')} as cn, {S.norm('text')} as tn, {_AL('concept')} as al from (select case_id, ord, prop_type, trim({S.nth(CONDITIONS, f'ord % {len(CONDITIONS)}')} || ' ' || string_split(concept, ' ')[1]) as concept, {S.nth(SAID, f'ord % {len(SAID)}')} || ' ' || prop_text as text,
 case when verification = 'refuted' then 'negated' else 'affirmed' end as status, case when ord % 4 = 0 then 'doctor' else source end as speaker, clinical_status as visit_state, temporality from {_P}))"""
_DIS = S.has("cn", L.DISEASES)
_SUR = f"(not {_DIS} and ({S.inside('cn', L.SURFACE_SYMPTOMS)} or (({' or '.join(S.has('cn', w) for w in L.SYMPTOM_FAMILIES.values())}) and {S.words('cn')} <= 4)))"
_NOISE = f"({S.inside('cn', bundle_events.LOW_NAMES)} or {S.has('cn', L.NOISE_CONTEXT)})"
_SLOT = f"case when {S.inside('prop_type', L.PLAN_TYPES)} then 'P' when prop_type in ('ExamFinding', 'TestResult') then 'O' when prop_type in ('Diagnosis', 'Impression') then 'A' when prop_type = 'MedicationStatement' then case when visit_state in ('planned', 'future') or {S.has('tn', W.STATEMENT_ORDERS)} then 'P' when speaker = 'patient' then 'S' else 'G' end when prop_type in ('ProblemHistory', 'Allergy', 'Demographics') then 'G' when prop_type in ('ChiefComplaint', 'Problem') then 'S' when status = 'negated' then 'S' else 'G' end"
_ELIG = f"(status <> 'negated' and prop_type in ('ChiefComplaint', 'Problem', 'Diagnosis', 'Impression') and not {S.has('tn', W.NO_ANCHOR_TEXTS)} and not {S.inside('(' + _FAM('al') + ')', bundle_events.LOW_FAMILIES)} and (prop_type in ('Diagnosis', 'Impression') or not ({S.inside('temporality', W.PAST_TIMES)} and prop_type <> 'ChiefComplaint') or {_DIS}))"
_NAME = f"(status <> 'negated' and named <> '' and not {_NOISE} and not {S.has('cn', L.SCREENING)} and (prop_type in ('Diagnosis', 'Impression', 'Problem', 'ChiefComplaint') or (prop_type = 'ProblemHistory' and {_DIS})))"
_ASCORE = "(case prop_type " + " ".join(f"when {S.q(k)} then {v}" for k, v in W.ANCHOR_SCORES.items()) + f" else 0 end + case when {_DIS} then 2 else 0 end - case when {_SUR} then 2 else 0 end + case when speaker = 'doctor' then 1 else 0 end)"
_BFEATS = f"select case_id, cast(ord as bigint) as ord, {_SLOT} as slot, {_ELIG} as eligible, {_NAME} as nameable, {_ASCORE} as anchor_score, turn_c from (select *, cast(ord % 10 as varchar) as turn_c from {_BP})"


@query(f"select * exclude (turn_c) from ({_BFEATS})")
def prop_bundle_features(spark, d):
    return _bundle_props(spark, d).select("case_id", F.col("ord").cast("long").alias("ord"), "slot", "eligible", "nameable", "anchor_score")


@query(f"select case_id, cluster_id, cast(arg_max(ord, {{'s': anchor_score, 'o': -ord}}) as bigint) as ord, max(anchor_score) as anchor_score from (select *, 'CL' || turn_c as cluster_id from ({_BFEATS}) where eligible and anchor_score > -1) group by 1, 2")
def anchor_props(spark, d):
    f = _bundle_props(spark, d).withColumns({"cluster_id": F.concat(F.lit("CL"), F.col("ord") % 10), "ord": F.col("ord").cast("long")})
    return bundle_events.anchor_props(f)


@query()
def bundle_notes(spark, d):
    """Problem bundles as a note shows them: assignment, routing, merging, naming, profile. Order decides in parts: held against a plain walk in the tests."""
    feats, props, n = bundled(spark, d)
    assigned, scored = assigned_of(feats, n)
    routes = bundle_events.routed(assigned, feats, props)
    return bundle_events.events(routes, bundle_events.merged(routes, feats, scored), feats, props)


# units

_PLAIN = "regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')".format
_HEAD = f"((ends_with(line, ':') and {S.words('line')} <= 6) or regexp_matches(line, {S.q(units.CAPITALS)}))"
_UNITS = f"""(select doc_id, line_no, kind, generate_subscripts(parts, 1) - 1 as pos, unnest(parts) as unit from (select *, case when kind = 'header' then [line] else list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {S.txt('x')}), lambda x: x <> '') end as parts
 from (select *, case when {_HEAD} then 'header' else 'body' end as kind from (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, {S.txt('unnest(ls)')} as line from (select doc_id, string_split({S.txt(_PLAIN('text'))}, chr(10)) as ls from documents)) where line <> '')))"""


@query(f"select doc_id, kind, count(*) as units, max(length(unit)) as longest, cast(sum(line_no * 31 + pos) as bigint) as places from {_UNITS} group by 1, 2")
def summary_units(spark, d):
    return units.units(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id", "kind").agg(F.count("*").alias("units"), F.max(F.length("unit")).cast("long").alias("longest"), F.sum(F.col("line_no") * 31 + F.col("pos")).alias("places"))


@query(f"""with u as (select *, sum(case when kind = 'header' then 1 else 0 end) over (partition by doc_id order by line_no, pos rows unbounded preceding) * 2 + case when kind = 'header' then 0 else 1 end as block from {_UNITS}),
b as (select doc_id, block, string_agg(unit, ' ' order by line_no, pos) as said from u group by 1, 2) select doc_id, md5(string_agg(said, chr(10) order by block)) as joined from b group by 1""")
def rejoined_units(spark, d):
    return units.joined(units.units(table(spark, d, "documents"), ["doc_id"]), ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("joined"))


def _masked(c: str) -> str:
    for a in sorted(W.ABBREVIATIONS, key=len, reverse=True):
        c = f"regexp_replace({c}, {S.q('(?i)' + a.replace('.', chr(92) + '.'))}, {S.q(a)}, 'g')".replace(S.q(a), "replace(" + S.q(a) + ", '.', chr(1))")
    return c


@query(f"select conv_id, turn, cast(p - 1 as int) as pos, s as sentence from (select conv_id, turn, generate_subscripts(ss, 1) as p, unnest(ss) as s from (select conv_id, turn, list_filter(list_transform(string_split(regexp_replace({_masked(S.txt('text'))}, '([.!?])\\s+([A-Z0-9•\\-])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {S.txt('replace(x, chr(1), chr(46))')}), lambda x: x <> '') as ss from conversations))")
def masked_sentences(spark, d):
    return units.masked_sentences(table(spark, d, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "pos", "sentence")


@query("select conv_id, count(*) as lines, md5(string_agg(line, chr(10) order by turn)) as block from (select *, sum(length(line) + 1) over (partition by conv_id order by turn rows unbounded preceding) as upto, row_number() over (partition by conv_id order by turn) as k from (select conv_id, turn, turn || ': [' || role || '] ' || coalesce(text, '') as line from conversations)) where upto <= 900 or k = 1 group by 1")
def turn_blocks(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return units.turn_blocks(c, ["conv_id"], 900, speaker="role").select("conv_id", "lines", F.md5(F.col("block").cast("binary")).alias("block"))


_BOLD = "replace(replace(replace(replace(coalesce({}, ''), '**S**', 'S:'), '**O**', 'O:'), '**A**', 'A:'), '**P**', 'P:')".format


@query(f"select conv_id, turn, {S.txt(_BOLD('x'))} as note from (select conv_id, turn, {S.nth(('**S**', '**O**', '**A**', '**P**', '**Plan**'), 'turn % 5')} || chr(10) || coalesce(text, '') as x from conversations)")
def template_headings(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", units.template_headings(F.concat(nth(("**S**", "**O**", "**A**", "**P**", "**Plan**"), F.col("turn") % 5), F.lit("\n"), F.coalesce("text", F.lit(""))), "soap").alias("note"))


# scaffolds

_UTT = lambda c: f"trim(regexp_replace(regexp_replace({S.txt(c)}, '^\\[[^\\]]+\\]\\s*', ''), '\\s+', ' ', 'g'))"
_ENT = f"(select conv_id as case_id, turn as ord, turn as line, array_to_string(list_slice({S.toks('text')}, 1, 2), ' ') as entity, {S.nth(ENTITY_TYPES, 'turn % 5')} as type, text as sentence from conversations)"
_PLAINC = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(entity), '\\b(this|that|these|those|a|an|the|my|your|his|her|their|some|any)\\b', ' ', 'g'), '\\b(out|before|ever|had)\\b', ' ', 'g'), '[^a-z0-9\\s/-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CONC = f"case when p in ('right index finger pain', 'index finger pain', 'finger pain') then 'finger pain' when p <> '' then p else {_concept('entity', 'lower(entity)', S.nth(('Problem', 'Drug', 'Test', 'Treatment', 'Other'), 'ord % 5'))} end"
_SCAFFOLD = f"""(with e as (select case_id, ord, line, {_UTT('entity')} as entity, type, {_UTT('sentence')} as sentence from {_ENT}), f as (select *, {S.norm('sentence')} as s, {S.norm('entity')} as en, case when line % 4 = 0 then 1 else 0 end as negated from e where entity <> '' and sentence <> ''),
g as (select * from f where not ({S.inside('en', W.GENERIC_ENTITIES)} and (contains(sentence, '?') or starts_with(s, 'have you') or starts_with(s, 'do you') or starts_with(s, 'and what')))),
h as (select *, case when q = 'appendix' or contains(q, 'appendix out') then 'appendectomy' else q end as p from (select *, regexp_replace(regexp_replace({_PLAINC}, ' stones$', ' stone'), ' injuries$', ' injury') as q from g))
select case_id, ord, line, sentence, {_CONC} as concept,
 case when {S.has('s', W.UNSURE_SENTENCES)} then 'Pertinent Unknowns' when negated = 1 or starts_with(s, 'no ') or contains(' ' || s || ' ', ' denies ') or contains(' ' || s || ' ', ' no ') then 'Pertinent Negatives' when {S.has('s', ('uncertain', 'possible'))} then 'Pertinent Unknowns' when {S.has('s', W.PAST_SENTENCES)} then 'Medical History' when {S.inside('type', W.POSITIVE_TYPES)} then 'Pertinent Positives' else 'Medical History' end as bucket,
 case when {S.has('s', W.SOCIAL_SENTENCES)} then 'Demographics and Social Determinants of Health' when type in ('problem', 'bodyloc') and {S.has('s', W.VISIT_SENTENCES)} then 'Patient Intent' else '' end as planning,
 case when type in ('treatment', 'drug') and {S.has('s', W.TREATED_SENTENCES)} then 'Plan' when type in ('test', 'labvalue') or {S.has('s', W.TESTED_SENTENCES)} then 'Findings' when {S.has('s', W.PLANNED_SENTENCES)} then 'Plan' when {S.has('s', W.JUDGED_SENTENCES)} then 'Assessment' else 'History of Present Illness' end as section from h)"""


def _scaffold(spark, d) -> DataFrame:
    c, n = table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id"), F.col("turn")
    rows = c.select("case_id", n.alias("ord"), n.alias("line"), F.array_join(F.slice(T.tokens("text"), 1, 2), " ").alias("entity"), nth(ENTITY_TYPES, n % 5).alias("type"), F.col("text").alias("sentence"))
    relations = c.where(n % 4 == 0).select("case_id", n.alias("line"), F.lit("Negation").alias("relation"))
    return scaffolds.entities(rows, relations)


@query(f"select case_id, ord, concept, bucket, planning, section from {_SCAFFOLD}")
def entity_scaffold(spark, d):
    return _scaffold(spark, d).select("case_id", "ord", "concept", "bucket", "planning", "section")


@query(f"""with x as {_SCAFFOLD}, y as (select *, row_number() over (partition by case_id, bucket, concept, sentence order by ord) as r from x), z as (select case_id, bucket, concept, min(line) as first_line, array_to_string(list_slice(list(sentence order by ord), 1, 3), ' || ') as evidence from y where r = 1 group by 1, 2, 3)
select case_id, bucket, concept, first_line, evidence from (select *, max(case when bucket in ('Pertinent Positives', 'Pertinent Negatives') then 1 else 0 end) over (partition by case_id, concept) as settled from z) where not (bucket = 'Pertinent Unknowns' and settled = 1)""")
def resolved_scaffold(spark, d):
    return scaffolds.resolved(_scaffold(spark, d))


# negations that no proposition has

_NEGTURNS = f"(select conv_id as case_id, turn as turn_idx, {S.nth(('patient', 'doctor', 'unknown'), 'turn % 3')} as speaker, {S.nth(('She denies ', 'no ', 'He denied '), 'turn % 3')} || 'chest pain and ' || coalesce(text, '') as said from conversations)"
_NEGPIECES = "list_transform(flatten(list_transform(list_transform(list_concat(regexp_extract_all(l, '\\b(?:deny|denies|denied)\\b\\s+([^.;]+)', 1), case when starts_with(l, 'no ') then [substr(l, 4)] else [] end), lambda p: regexp_split_to_array(p, '\\bbut\\b|\\bexcept\\b')[1]), lambda p: regexp_split_to_array(p, ',|/| and | or '))), lambda p: regexp_replace(p, '^[ .:;]+|[ .:;]+$', '', 'g'))"
_NEGATIONS = f"""select case_id, turn_idx, pos, concept, norm from (select *, row_number() over (partition by case_id, turn_idx order by pos) as r2 from (select *, {S.norm('concept')} as norm, row_number() over (partition by case_id, turn_idx, {S.norm('concept')} order by pos) as r from
 (select case_id, turn_idx, generate_subscripts(ps, 1) - 1 as pos, unnest(ps) as concept from (select case_id, turn_idx, list_filter({_NEGPIECES}, lambda p: {S.words('p')} >= 2 and not {S.inside('p', L.NEGATION_STOPS)} and {S.has('lower(p)', L.CLINICAL_SIGNS)}) as ps from (select *, lower({S.txt('said')}) as l from {_NEGTURNS} where speaker in ('patient', 'unknown')))) ) where r = 1) where r2 <= 4"""


@query(f"""with n as ({_NEGATIONS}), held as (select distinct conv_id as case_id, 'chest pain' as norm from conversations where conv_id % 2 = 0),
f as (select n.*, row_number() over (partition by n.case_id, n.norm order by turn_idx, pos) as r from n left join held using (case_id, norm) where held.case_id is null)
select case_id, turn_idx, concept, cast(place as int) as place from (select *, row_number() over (partition by case_id order by turn_idx, pos) as place from f where r = 1) where place <= 8""")
def negation_synthesis(spark, d):
    c, n = table(spark, d, "conversations"), F.col("turn")
    t = c.select(F.col("conv_id").alias("case_id"), n.alias("turn_idx"), nth(("patient", "doctor", "unknown"), n % 3).alias("speaker"), F.concat(nth(("She denies ", "no ", "He denied "), n % 3), F.lit("chest pain and "), F.coalesce("text", F.lit(""))).alias("said"))
    held = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("case_id"), F.lit("Chest pain").alias("concept"), F.lit("refuted").alias("verification")).distinct()
    return turns.new_negations(t, held).select("case_id", "turn_idx", "concept", "place")


# facts


@query("""with r as (select conv_id, turn, '- ' || coalesce(text, '') || chr(10) || chr(10) || ' -second of ' || turn || ' - ' as raw from conversations),
l as (select conv_id, turn, list_filter(list_transform(list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(regexp_replace(x, '^[\\- ]+|[\\- ]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from r where turn % 3 <> 0)
select conv_id, turn, cast(generate_subscripts(ls, 1) - 1 as int) as pos, unnest(ls) as fact_text from l
union all select conv_id, turn, 0, trim(text) from conversations where turn % 3 = 0 and trim(text) <> '' union all select conv_id, turn, 1, 'two' from conversations where turn % 3 = 0""")
def fact_records(spark, d):
    c = table(spark, d, "conversations")
    json = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("fact_text")), F.struct(F.lit("two").alias("fact_text"))).alias("atomic_propositions")))
    plain = F.concat(F.lit("- "), F.coalesce("text", F.lit("")), F.lit("\n\n -second of "), F.col("turn"), F.lit(" - "))
    return audit.fact_records(c.withColumn("raw", F.when(F.col("turn") % 3 == 0, json).otherwise(plain)), ["conv_id", "turn"]).drop("item")


# oracles of queries of the catalogue that stand on the pieces above

from ..operators import align  # noqa: E402
from .catalog import _BPAIRS, _CANON  # noqa: E402

_ROLE = f"case when {S.norm('c_type')} = 'medicationstatement' then 'state' when {S.norm('c_type')} in ('medicationrequest', 'order', 'followup', 'counseling') or c_state = 'planned' then 'plan' else 'none' end"
_EVAL_CC = f"cc as (select case_id, ord, annotator, c_type, {S.toks('c_concept')} as ct, {S.toks('prop_text')} as pt, c_verification, c_state, c_time, {_ROLE} as c_role, turn_idx from {_CANON})"
_RATE = "case when {1} > 0 then {0} / {1} else {2} end".format
ORACLES["benchmark_evaluation"] = S.greedy(f"select * from ({_BPAIRS}) where score >= 0.45").replace("with recursive ", f"with recursive {_EVAL_CC}, ") + f""",
m as (select w.case_id, a.c_verification = b.c_verification as v, a.c_state = b.c_state as s, a.c_time = b.c_time as t, a.c_role = b.c_role as r, a.c_role <> 'none' or b.c_role <> 'none' as role, a.turn_idx = b.turn_idx as u from walk w join cc a on a.case_id = w.case_id and a.annotator = 'A' and a.ord = w.i join cc b on b.case_id = w.case_id and b.annotator = 'B' and b.ord = w.j where w.taken),
p as (select case_id, count(*) as matched, count(*) filter (v) as n_v, count(*) filter (s) as n_s, count(*) filter (t) as n_t, count(*) filter (v and s and t) as n_full, count(*) filter (role) as n_role, count(*) filter (role and r) as n_right, count(*) as n_prov, count(*) filter (u) as n_hit, sum(case when u then 1.0e0 else 0.0e0 end) as jac from m group by 1),
z as (select pred.case_id, pred_n, gold_n, coalesce(matched, 0) as matched, coalesce(n_v, 0) as n_v, coalesce(n_s, 0) as n_s, coalesce(n_t, 0) as n_t, coalesce(n_full, 0) as n_full, coalesce(n_role, 0) as n_role, coalesce(n_right, 0) as n_right, coalesce(n_prov, 0) as n_prov, coalesce(n_hit, 0) as n_hit, coalesce(jac, 0.0e0) as jac
 from (select case_id, count(*) as pred_n from cc where annotator = 'A' group by 1) pred join (select case_id, count(*) as gold_n from cc where annotator = 'B' group by 1) gold using (case_id) left join p using (case_id))
select case_id, pred_n, gold_n, matched, pred_n - matched as unsupported, gold_n - matched as missing, matched / pred_n as concept_precision, matched / gold_n as concept_recall, case when matched = 0 then 0.0 else 2 * (matched / pred_n) * (matched / gold_n) / (matched / pred_n + matched / gold_n) end as concept_f1,
 n_full / pred_n as state_precision, n_full / gold_n as state_recall, case when n_full = 0 then 0.0 else 2 * (n_full / pred_n) * (n_full / gold_n) / (n_full / pred_n + n_full / gold_n) end as state_f1, {_RATE('n_v', 'matched', '0.0')} as verification_acc, {_RATE('n_s', 'matched', '0.0')} as state_acc, {_RATE('n_t', 'matched', '0.0')} as temporality_acc,
 {_RATE('n_right', 'n_role', 'null')} as role_acc, n_prov as provenance_n, {_RATE('n_hit', 'n_prov', 'null')} as provenance_hit, {_RATE('n_hit', 'n_prov', 'null')} as provenance_exact, {_RATE('jac', 'n_prov', 'null')} as provenance_jaccard from z"""

_PFIELDS = {"category": "prop_type", "status": "verification", "visit_state": "clinical_status", "temporality": "temporality", "speaker": "source", "predicate": "'states'"}
_FIRST = f"case when {S.txt('concept')} <> '' then {S.txt('concept')} else {S.txt('prop_text')} end"
_PP = f"pp as (select case_id, ord, annotator, {S.toks('prop_text')} as tt, {S.align(_FIRST)} as aa, " + ", ".join(f"{S.low(c)} as {n}" for n, c in _PFIELDS.items()) + f" from {_P})"
_HOLD = "case when array_to_string(a.aa, ' ') <> '' and array_to_string(b.aa, ' ') <> '' and (contains(array_to_string(a.aa, ' '), array_to_string(b.aa, ' ')) or contains(array_to_string(b.aa, ' '), array_to_string(a.aa, ' '))) then 0.14 else 0.0 end"
_FULL = "cast(0.45 as double) * t + cast(0.35 as double) * r + cast(hold as double)" + "".join(f" + cast({n} as double)" for n in align.BONUS)
_PPAIRS = f"""select case_id, i, j, greatest(least({_FULL}, 1.0), t, r) as score from (select a.case_id, a.ord as i, b.ord as j, {S.f1('a.tt', 'b.tt')} as t, {S.f1('a.aa', 'b.aa')} as r, {_HOLD} as hold, {', '.join(f"case when a.{n} <> '' and a.{n} = b.{n} then {v} else 0.0 end as {n}" for n, v in align.BONUS.items())}
 from pp a join pp b on a.case_id = b.case_id and a.annotator = 'A' and b.annotator = 'B') where least({_FULL}, 1.0) >= 0.58 or t >= 0.72 or r >= 0.72"""
ORACLES["proposition_match"] = S.greedy(_PPAIRS).replace("with recursive ", f"with recursive {_PP}, ") + " select case_id, cast(i as int) as i, cast(j as int) as j, score from walk where taken"

_LISTS = lambda c, d: "list_filter([" + ", ".join(f"case when {S.has(c, w)} then {S.q(n)} end" for n, w in d.items()) + "], lambda x: x is not null)"
_PICKS = lambda c, d: "case " + " ".join(f"when {S.has(c, w)} then {S.q(n)}" for n, w in d.items()) + " end"
_HINTS = "list_distinct(flatten([" + ", ".join(f"case when contains(norm, {S.q(m)}) then [{', '.join(map(S.q, h))}] else [] end" for m, h in L.MEDICATION_HINTS.items()) + "]))"
_PROFILE = f"""profile as (select case_id, cluster_type, cluster_concept, bool_or({_ELIG} and {_ASCORE} > -1) as has_anchor, list_distinct(list(tm) filter (tm <> '')) as times
 from (select *, {S.norm('concept')} as cn, {S.norm('prop_text')} as tn, {_AL('concept')} as al, {S.norm('temporality')} as tm, source as speaker, case when verification = 'refuted' then 'negated' else 'affirmed' end as status, lower({S.txt('concept')}) as cluster_concept from (select * replace (case when turn_idx % 3 = 0 then 'future' else temporality end as temporality), {_CT} as cluster_type from {_P})) group by 1, 2, 3)"""
_PAST = f"(len(times) > 0 and len(list_filter(times, lambda t: {S.inside('t', W.CURRENT_MARKERS)})) = 0 and len(list_filter(times, lambda t: not ({S.inside('t', W.PAST_MARKERS)} or regexp_matches(t, '\\b(19|20)\\d{{2}}\\b')))) = 0)"
_FUTURE = "(len(times) > 0 and len(list_filter(times, lambda t: t <> 'future')) = 0)"
_FEATS = f"""{_PROFILE}, f0 as (select *, concat_ws(' ', cluster_concept, summary) as text from ({ORACLES['cluster_states']}) join profile using (case_id, cluster_type, cluster_concept)),
f1 as (select *, {S.norm('text')} as norm, {S.norm('summary')} as sn, {S.norm('cluster_concept')} as nn, {S.align('text')} as tokens, {S.align('cluster_concept')} as ctoks from f0),
f2 as (select *, array_to_string(ctoks, ' ') as cnorm, array_to_string(tokens, ' ') as tnorm, {S.has('norm', L.DISEASES)} as disease, final_verification = 'refuted' as negated, {_PAST} as past, {_FUTURE} as future from f1),
f as (select *, {_FAM('cnorm')} as family, {_FAM('tnorm')} as tfamily, {_PICKS('norm', L.BODY_REGIONS)} as region, {_PICKS('norm', L.SYMPTOM_FAMILIES)} as symptom, {_LISTS('norm', L.PROBLEM_DOMAINS)} as domains, {_HINTS} as hints,
 case when cluster_type in ('Plan', 'FollowUp', 'MedicationChange') or primary_type in ('Order', 'MedicationRequest', 'FollowUp', 'Counseling') then 'P' when cluster_type = 'TestResult' or primary_type in ('ExamFinding', 'TestResult') then 'O' when primary_type in ('Diagnosis', 'Impression') then 'A'
  when cluster_type = 'MedicationState' or primary_type = 'MedicationStatement' then case when {S.has('sn', L.MEDICATION_ORDERS)} then 'P' else 'S' end when primary_type = 'ProblemHistory' then case when past then 'G' else 'S' end when negated then 'S' when contains(sources, 'patient') or primary_type in ('ChiefComplaint', 'Problem') then 'S' else 'A' end as slot,
 case when primary_type in ('Diagnosis', 'Impression') then 5 when disease then 4 when primary_type in ('ChiefComplaint', 'Problem') then 3 when primary_type = 'ProblemHistory' then 1 else 0 end as pref,
 not negated and not {S.inside('nn', L.LOW_VALUE_CONCEPTS)} and not {S.has('nn', L.SCREENING)} and not {S.has('sn', L.NOT_ANCHOR_TEXTS)} and has_anchor and not {S.inside('cluster_type', W.NO_ANCHOR_CLUSTERS)} and not {S.inside('primary_type', W.NO_ANCHOR_TYPES)} and (primary_type in ('Diagnosis', 'Impression') or (sources <> 'clinician' and not future)) and ({S.inside('cluster_type', W.ANCHOR_CLUSTERS)} or {S.inside('primary_type', W.ANCHOR_TYPES)}) as is_anchor,
 case when final_status in ('planned', 'future') or future then 'future' when past or {S.has('sn', L.HISTORY_TEXTS)} then 'history' else 'current' end as layer, {S.has('norm', L.CHRONIC)} as chronic, {S.has('norm', L.NOISE_CONTEXT)} as noise, {S.has('norm', L.SCREENING)} as screening,
 not disease and cluster_type = 'ProblemState' and primary_type in ('ChiefComplaint', 'Problem') as symptom_like from f2)"""
_REG, _SYM = "(a.region is not null and coalesce(a.region = b.region, false))", "(a.symptom is not null and coalesce(a.symptom = b.symptom, false))"
_HINTED = "(len(list_filter(b.hints, lambda h: contains(a.tfamily, h))) > 0)"
_ANCHORED = [w for x, _ in L.RELATED_FACTORS for w in x]
_FACTOR = "(case " + " ".join(f"when {S.has('a.norm', x)} then {S.has('b.norm', y)}" for x, y in L.RELATED_FACTORS) + f" else false end or (b.chronic and {S.has('a.norm', L.CHRONIC_ANCHORS)} and not {S.has('a.norm', _ANCHORED)}))"
_FAMS = "(a.tfamily <> '' and b.tfamily <> '')"
_RELATION = (
    f"case when {_FAMS} and a.tfamily = b.tfamily then 'direct' when {S.f1('a.tokens', 'b.tokens')} >= 0.55 then 'direct' when {_REG} and ({_SYM} or b.slot in ('O', 'P')) then 'direct' when {_HINTED} then 'direct' when {_FACTOR} then 'related_factor' when a.disease and b.disease and b.chronic and {_FAMS} then 'related_factor'"
    f" when len(a.domains) > 0 and len(b.domains) > 0 and len(list_intersect(a.domains, b.domains)) = 0 then 'unrelated' when len(a.domains) > 0 and len(b.domains) = 0 and a.pref >= 4 and (b.slot = 'G' or (b.primary_type = 'ProblemHistory' and b.region is null)) then 'unrelated' when b.pref >= 4 and {_FAMS} then 'unrelated' else 'weak' end"
)


def _w(cond: str, points: float) -> str:
    return f"case when {cond} then {points}e0 else 0.0e0 end"


_MEDIC = f"case when len(b.hints) > 0 then case when {_HINTED} then 3.0e0 when b.slot = 'P' and a.pref <= 3 then -1.0e0 else 0.0e0 end else " + _w(f"b.slot = 'P' and a.pref <= 3 and not {_REG}", -0.75) + " end"
_RAW = " + ".join([
    f"2.5e0 * {S.f1('a.ctoks', 'b.ctoks')}", _w("a.cnorm <> '' and b.cnorm <> '' and (contains(a.cnorm, b.cnorm) or contains(b.cnorm, a.cnorm))", 1.5), _w("a.family <> '' and a.family = b.family", 1.5),
    "case when gap = 0 then 1.5e0 when gap <= 2 then 1.0e0 when gap <= 6 then 0.5e0 else 0.0e0 end", "case when b.slot in ('O', 'P') then 0.75e0 when b.slot = 'S' then 0.25e0 else 0.0e0 end", _w(_REG, 0.75), _w(_SYM, 0.5),
    _w("a.pref >= 5 and b.slot = 'S' and gap <= 4", 1.0), _MEDIC, _w("a.pref >= 4 and b.slot in ('O', 'P')", 0.5),
]) + " - " + _w("b.slot = 'G'", 0.25)

def _pairs(j: str, s: str, of: str) -> str:
    """Two common table expressions: pairs j of clusters a (those of the condition) and others b of their case, and s with relation and score."""
    return f"""{j} as (select a.case_id, a, b, greatest(0, greatest(a.first_turn, b.first_turn) - least(a.last_turn, b.last_turn)) as gap from f a join f b on a.case_id = b.case_id and {of} and a.cluster_id <> b.cluster_id),
{s}0 as (select case_id, a.cluster_id as aid, b.cluster_id as bid, {_RELATION} as relation, {_RAW} as raw, gap, b.slot as b_slot, b.layer as b_layer, {_REG} as same_region, len(list_intersect(a.domains, b.domains)) > 0 as same_domain, {_SYM} as same_symptom, b.noise as noise, b.screening as screening, b.pref as bp, a.pref as ap, b.symptom_like as sl from {j}),
{s} as materialized (select case_id, aid as a, bid as b, relation, raw + case relation when 'direct' then 0.75e0 when 'related_factor' then 0.15e0 when 'weak' then -0.1e0 else -4.0e0 end as score, gap, b_slot, b_layer, same_region, same_domain,
 noise or (screening and bp <= 1) or relation = 'unrelated' or (relation = 'weak' and b_slot = 'G') or (relation = 'weak' and ap >= 4 and sl and not same_region and not same_domain and not same_symptom) as dropped from {s}0)"""


ORACLES["bundle_pairs"] = f"with {_FEATS}, {_pairs('j', 's', 'a.is_anchor')} select * from s"

_SURFACE = f"(not {S.has('nn', L.DISEASES)} and ({S.inside('nn', L.SURFACE_SYMPTOMS)} or ({_PICKS('nn', L.SYMPTOM_FAMILIES)} is not null and {S.words('cluster_concept')} <= 4)))"
_AW = {k: f"{float(v)}e0" for k, v in L.ANCHOR_WEIGHTS.items()}
_DECISION = (
    f"{_AW['preference']} * pref + {_AW['plan_link']} * least(plan_links, 3) + {_AW['non_subjective_support']} * objective + {_AW['support_score']} * support + {_AW['salience']} * least(salience, 10)"
    f" + {_w('disease', 3.0)} + {_w('len(domains) > 0', 0.5)} - {_w(_SURFACE, 3.5)} - {_w('noise or screening', 5.0)} - {_w(chr(40) + 'layer = ' + S.q('history') + chr(41) + ' and pref < 5', 2.0)}"
)
_WEAK = "(decision < 3 or (symptom_like and (decision < 6 or (plan_links = 0 and objective = 0))) or (pref <= 3 and plan_links = 0 and support < 1.5))"
_FIRST = (
    "case when cluster_type in ('MedicationChange', 'Plan', 'FollowUp', 'Diagnosis', 'DiagnosisImpression', 'TestOrResult', 'TestResult') or primary_type in ('Order', 'MedicationRequest', 'Diagnosis', 'Impression')"
    " or (cluster_type = 'ProblemState' and primary_type in ('ChiefComplaint', 'Allergy')) or salience >= 9 then 2 when salience >= 6 then 1 else 0 end"
)
#: Steps through each case's candidates; each is an anchor if none of its rivals is one.
_ASSIGNED = f"""{_FEATS}, {_pairs('j', 's', 'a.is_anchor')},
per as (select case_id, a as cluster_id, count(*) filter (b_slot = 'P') as plan_links, sum(case b_slot when 'P' then 2.5e0 when 'O' then 1.5e0 when 'A' then 2.0e0 when 'S' then 0.5e0 else 0.0e0 end) as support, count(*) filter (b_slot in ('O', 'A', 'P') or relation = 'related_factor') as objective
 from s where score >= case when b_slot in ('O', 'P') then 0.4e0 else 1.0e0 end group by 1, 2),
d0 as (select f.*, coalesce(plan_links, 0) as plan_links, coalesce(support, 0) as support, coalesce(objective, 0) as objective from (select *, {_SURFACE} as surface from f where is_anchor) f left join per using (case_id, cluster_id)),
d1 as materialized (select *, {_DECISION} as decision from d0),
d2 as (select *, row_number() over (partition by case_id order by decision desc, pref desc, plan_links desc, support desc, salience desc, first_turn, cluster_id) as rank, bool_or(decision >= 8 or pref >= 4 or plan_links > 0) over (partition by case_id) as strong from d1),
d3 as (select *, exists (select 1 from s join d1 o on o.case_id = s.case_id and o.cluster_id = s.a and o.pref >= 4 where s.case_id = d2.case_id and s.b = d2.cluster_id and s.relation <> 'unrelated' and s.score >= 0.25e0) as over from d2 where not (strong and {_WEAK})),
d4 as materialized (select *, row_number() over (partition by case_id order by rank) as k from d3 where not (symptom_like and (over or (strong and surface and plan_links = 0)))),
rivals as materialized (select y.case_id, y.k, list(x.cluster_id) as rs from s join d4 x on x.case_id = s.case_id and x.cluster_id = s.a join d4 y on y.case_id = s.case_id and y.cluster_id = s.b where x.k < y.k
 and case when y.symptom_like then s.score >= case when x.symptom_like then 1.0e0 when same_region or same_domain then 0.25e0 else 0.75e0 end else not x.symptom_like and (s.score >= 2.0e0 or s.gap <= 2) end group by 1, 2),
walk as (select case_id, cast(0 as bigint) as k, cast([] as varchar[]) as taken from (select distinct case_id from d4)
 union all
 select w.case_id, d4.k, case when len(list_intersect(w.taken, coalesce(rs, []))) = 0 then list_append(w.taken, d4.cluster_id) else w.taken end from walk w join d4 on d4.case_id = w.case_id and d4.k = w.k + 1 left join rivals on rivals.case_id = d4.case_id and rivals.k = d4.k),
anchors as (select case_id, unnest(taken) as cluster_id from (select case_id, arg_max(taken, k) as taken from walk group by 1)),
instead as (select case_id, cluster_id from (select *, row_number() over (partition by case_id order by {_FIRST} desc, coalesce(salience, 0) desc, members desc, try_cast(substr(cluster_id, 3) as bigint), cluster_id) as place from f where case_id not in (select case_id from anchors)) where place <= 3 and {S.txt('cluster_concept')} <> '' and {S.txt('summary')} <> ''),
{_pairs('ji', 'si', '(a.case_id, a.cluster_id) in (select case_id, cluster_id from instead)')},
chosen as (select * from anchors union all select * from instead),
p as (select q.* from (select * from s union all select * from si) q where (q.case_id, q.a) in (select case_id, cluster_id from chosen) and (q.case_id, q.b) not in (select case_id, cluster_id from chosen)),
best as (select case_id, b, unnest(arg_max(struct_pack(a := a, score := score, relation := relation, dropped := dropped, b_slot := b_slot, b_layer := b_layer), struct_pack(s := score, a := a))) from p group by 1, 2),
limits as (select *, case relation when 'related_factor' then 0.2e0 when 'weak' then greatest(case when b_slot in ('O', 'P') then 0.4e0 else 0.75e0 end, case when b_slot = 'G' then 2.5e0 else 1.5e0 end) when 'unrelated' then 10.0e0 else case when b_slot in ('O', 'P') then 0.4e0 else 0.75e0 end end as least0 from best),
assigned as materialized (select case_id, cluster_id, cluster_id as bundle, cast(null as double) as score, 'anchor' as relation from chosen union all
 select case_id, b, a, score, relation from limits where not dropped and score >= case when b_layer = 'history' and relation <> 'related_factor' then greatest(least0, 1.75e0) else least0 end)"""
ORACLES["bundle_assignment"] = f"with recursive {_ASSIGNED} select * from assigned"

# notes of bundles: propositions to lists, merges one bundle after the other, names, what is shown

_HIGH = f"case when {S.inside('event_type', W.HIGH_EVENTS)} or {S.inside('primary_type', W.HIGH_TYPES)} or salience >= 9 then 'high' when salience >= 6 then 'medium' else 'low' end"
_LEVEL = f"case {_HIGH} when 'high' then 2 when 'medium' then 1 else 0 end"
_BSURFACE = lambda n: f"({n} <> '' and not {S.has(n, L.DISEASES)} and ({S.inside(n, L.SURFACE_SYMPTOMS)} or ({_PICKS(n, L.SYMPTOM_FAMILIES)} is not null and {S.words(n)} <= 4)))"
_NUMBER = "try_cast(substr({}, 3) as bigint)".format
_LISTS_OF = ("S", "O", "A", "P", "global", "history", "related")
_ACTS = lambda x: f"list_filter({x}, lambda t: {S.has(S.norm('t'), W.ACTION_PHRASES)})"
_SAYS = "case " + " ".join(f"when {S.has(S.norm('problem'), words)} then replace({S.q(said)}, '{{}}', problem)" for words, said in W.ASSESSMENTS) + f" when {S.has(S.norm('problem'), L.DISEASES)} then 'The patient has ' || problem || '.' end"
_NSCORE = (
    "cast(case prop_type " + " ".join(f"when {S.q(k)} then {v}" for k, v in W.ANCHOR_SCORES.items()) + f" else 0 end as double) + {_w(S.has('cn', L.DISEASES), 3.0)} - {_w(_BSURFACE('cn'), 2.5)} - {_w('prop_type = ' + S.q('ProblemHistory'), 1.0)} + {_w('speaker = ' + S.q('doctor'), 0.5)}"
    f" + {_w('len(list_intersect(bundle_domains, ' + _LISTS('cn', L.PROBLEM_DOMAINS) + ')) > 0', 1.0)} + {_w('(' + _FAM('al') + ') = bundle_family', 0.5)}"
)
ORACLES["bundle_notes"] = f"""with recursive {_ASSIGNED},
pf as materialized (select m.cluster_id, q.case_id, q.ord, q.prop_type, q.speaker, q.named, q.cn, q.al, q.prop_text as text, {_SLOT} as slot, {_NAME} as nameable from (select *, cast(ord as bigint) as o, {S.txt('concept')} as named, {S.norm('concept')} as cn, {S.norm('prop_text')} as tn, {_AL('concept')} as al, source as speaker, clinical_status as visit_state, case when verification = 'refuted' then 'negated' else 'affirmed' end as status
  from (select * replace (case when turn_idx % 3 = 0 then 'future' else temporality end as temporality) from {_P})) q join ({ORACLES['cluster_members']}) m on m.case_id = q.case_id and m.ord = q.o),
r0 as (select a.*, f.layer, f.summary, f.members, f.salience, f.cluster_type, f.primary_type, f.slot as cluster_slot, {_CTYPE.replace('cluster_type', 'f.cluster_type').replace('primary_type', 'f.primary_type')} as event_type from assigned a join f using (case_id, cluster_id) where relation <> 'unrelated' and {S.txt('f.summary')} <> ''),
r1 as (select *, row_number() over (partition by case_id, bundle order by relation = 'anchor' desc, {_LEVEL} desc, salience desc, members desc, {_NUMBER('cluster_id')}, cluster_id) as place from r0),
r2 as (select r1.case_id, r1.bundle, r1.cluster_id, r1.place, r1.relation, r1.layer, pf.ord, coalesce(pf.slot, r1.cluster_slot) as slot, coalesce(pf.text, r1.summary) as text from r1 left join pf using (case_id, cluster_id)),
routes as materialized (select case_id, bundle, cluster_id, place, ord, text, case when relation = 'related_factor' and slot = 'P' then 'P' when relation = 'related_factor' then 'related' when relation = 'weak' and slot in ('G', 'S') and layer <> 'current' then 'related' when layer = 'history' and slot <> 'P' then 'history' when slot in ('S', 'O', 'A', 'P') then slot else 'global' end as list from r2),
heads as (select case_id, cluster_id as bundle, pref as preference, {_BSURFACE('nn')} as surface, {_PICKS('nn', L.BODY_REGIONS)} as region, {_PICKS('nn', L.SYMPTOM_FAMILIES)} as symptom, {_LISTS('nn', L.PROBLEM_DOMAINS)} as domains from f),
b0 as (select case_id, bundle, count(*) filter (list in ('O', 'A')) as found, coalesce(list(distinct {S.norm('text')}) filter (list = 'P'), []) as plans from routes group by 1, 2),
b1 as materialized (select b0.*, heads.* exclude (case_id, bundle), row_number() over (partition by case_id order by {_NUMBER('bundle')}, bundle) as k from b0 join heads using (case_id, bundle)),
moves as materialized (select s.case_id, s.b as bundle, list(s.a order by s.score desc, t.k) as targets from (select * from s where relation <> 'unrelated' and score > -1) s join b1 x on x.case_id = s.case_id and x.bundle = s.b join b1 t on t.case_id = s.case_id and t.bundle = s.a and t.preference >= 4
 where coalesce(t.region = x.region, false) or coalesce(t.symptom = x.symptom, false) or len(list_intersect(t.domains, x.domains)) > 0 or s.score >= 0.25e0 group by 1, 2),
steps as (select case_id, cast(0 as bigint) as k, list(struct_pack(b := bundle, p := plans, l := [bundle], gone := false) order by b1.k) as st from b1 group by 1
 union all
 select case_id, k, case when target is null then st else list_transform(st, lambda x, i: case when i = k then struct_pack(b := x.b, p := x.p, l := x.l, gone := true) when x.b = target then struct_pack(b := x.b, p := list_distinct(list_concat(x.p, st[k].p)), l := list_concat(x.l, st[k].l), gone := x.gone) else x end) end
 from (select w.case_id, b1.k, w.st, case when b1.surface and b1.found = 0 and len(w.st[b1.k].p) <= 1 then list_filter(targets, lambda a: len(list_filter(w.st, lambda x: x.b = a and x.gone)) = 0)[1] end as target from steps w join b1 on b1.case_id = w.case_id and b1.k = w.k + 1 left join moves m on m.case_id = b1.case_id and m.bundle = b1.bundle)),
ends as (select case_id, unnest(arg_max(st, k)) as x from steps group by 1),
moved as (select case_id, x.b as target, generate_subscripts(x.l, 1) - 1 as pos, unnest(x.l) as own from ends where not x.gone),
rows as materialized (select r.case_id, m.target as bundle, m.own, m.pos, r.cluster_id, r.place, r.ord, r.list, r.text from routes r join moved m on m.case_id = r.case_id and m.own = r.bundle),
texts as (select * from rows where {S.norm('text')} <> '' qualify row_number() over (partition by case_id, bundle, list, {S.norm('text')} order by pos, place, ord nulls first) = 1),
pl as (select case_id, bundle, {', '.join(f"coalesce(list(text order by pos, place, ord nulls first) filter (list = {S.q(x)}), []) as l_{x}" for x in _LISTS_OF)} from texts group by 1, 2),
counts as (select case_id, bundle, count(ord) as support, count(*) filter (list = 'A' and ord is not null) as a_ids from rows group by 1, 2),
concepts as (select case_id, bundle, string_agg(cluster_concept, '; ' order by pos, place, cluster_concept) as concepts from (select distinct r.case_id, r.bundle, r.pos, r.place, f.cluster_concept from rows r join f using (case_id, cluster_id)) group by 1, 2),
about as materialized (select p.*, c.support, c.a_ids, k.concepts, f.cluster_concept, f.cluster_type, f.primary_type, f.salience, f.pref as preference, {_CTYPE} as event_type, {_LISTS(S.norm("concat_ws(' ', k.concepts, array_to_string(l_history, ' '), array_to_string(l_related, ' '))"), L.PROBLEM_DOMAINS)} as bundle_domains, {_FAM(_AL('f.cluster_concept'))} as bundle_family
 from pl p join counts c using (case_id, bundle) join concepts k using (case_id, bundle) join f on f.case_id = p.case_id and f.cluster_id = p.bundle),
scored as (select a.case_id, a.bundle, pf.named, {_NSCORE} as score, case r.list when 'A' then 0 when 'S' then 1 when 'history' then 2 else 3 end as lp, r.pos, r.place, r.ord from rows r join pf on pf.case_id = r.case_id and pf.ord = r.ord and pf.nameable join about a on a.case_id = r.case_id and a.bundle = r.bundle where r.ord is not null and r.list in ('A', 'S', 'history', 'related')),
names as (select case_id, bundle, named as promoted from scored where score > -1 qualify row_number() over (partition by case_id, bundle order by score desc, lp, pos, place, ord) = 1),
g as (select a.*, coalesce(promoted, cluster_concept) as problem, len(l_related) + len(l_history) as more from about a left join names using (case_id, bundle)),
h as (select *, len(l_P) > 0 or len(l_A) > 0 or len({_ACTS('l_related')}) > 0 or (preference >= 4 and (len(l_O) > 0 or more > 0)) or ({S.has(S.norm('problem'), L.DISEASES)} and support >= 2) as visit_primary, len(l_S) <= 1 and len(l_O) = 0 and len(l_A) = 0 and len(l_P) = 0 and more = 0 as incidental,
 case when a_ids = 0 and {S.has(S.norm('problem'), L.DISEASES)} then {_SAYS} when a_ids = 0 then case when {' or '.join(S.has(S.norm('problem'), w) for w, _ in W.ASSESSMENTS)} then {_SAYS} end end as assessment, case when len(l_P) > 0 then list_slice(l_P, 1, 5) else list_slice({_ACTS('list_concat(l_related, l_global)')}, 1, 5) end as planned, {_HIGH} as clinical_priority from g),
i as (select *, visit_primary and not incidental as render, row_number() over (partition by case_id order by {_LEVEL} desc, salience desc, support desc, {_NUMBER('bundle')}) as rank from h where len(l_S) + len(l_O) + len(l_A) + len(l_P) > 0),
jj as (select *, bool_or(render) over (partition by case_id) as any_shown from i where rank <= 14)
select case_id, bundle as event_id, problem, clinical_priority, support, visit_primary, render, assessment, concepts, cast(rank as int) as rank, array_to_string(list_slice(list_concat(list_concat(l_S, l_O), l_A), 1, 6), '|') as supporting_evidence, array_to_string(list_slice(list_concat(l_A, l_S), 1, 5), '|') as current_state, array_to_string(planned, '|') as planned_actions,
 array_to_string(list_slice(list_filter(list_concat(list_concat(l_history, l_related), l_global), lambda t: not list_contains(planned, t)), 1, 6), '|') as care_context from jj where render or not any_shown"""


BROKEN = V.Inline("id long, raw string", [(1, '{"S": "pain", "O": ["swollen", "red"], "A": "gout" "P": "rest'), (2, "S: pain\nO: swollen\nA - gout\nP: rest"), (3, None), (4, "nothing of it"), (5, '{"s" : "“quoted”"}')])


@query()
def section_salvage(spark, d):
    m = salvage.sections(F.col("raw"), "soap")
    return BROKEN.df(spark).withColumn("m", m).select("id", *(F.col("m")[k].alias(k) for k in W.NOTE_KEYS["soap"]))


_W5 = f"(select conv_id, turn, (conv_id + turn) % 5 as form, list_transform([1, 2, 3, 4, 5], lambda k: 'w' || coalesce({S.toks('text')}[k], 'x')) as w from conversations)"
_FOURTH = "case form when 0 then '' when 1 then w[5] when 2 then w[5] when 3 then w[5] end"


@query(f"""select conv_id, turn, case when form <> 4 then w[1] end as "S", case form when 0 then w[2] || ' ' || w[3] when 3 then w[2] || ' ' || w[3] when 1 then w[2] when 2 then '' end as "O", case when form <> 4 then w[4] end as "A", {_FOURTH} as "P" from {_W5}""")
def section_salvage_table(spark, d):
    """Answers broken in several ways, made of the words of each turn: a lost comma and end, headings, a lost quote, a list after prose, nothing of it."""
    w = F.transform(F.array(*map(F.lit, range(5))), lambda k: F.concat(F.lit("w"), F.coalesce(F.get(T.tokens("text"), k), F.lit("x"))))  # no word is a section's name
    forms = (
        '{"S": "%1$s", "O": ["%2$s", "%3$s"], "A": "%4$s" "P": "%5$s', "S: %1$s\nO: %2$s\n- A - %4$s\n\tP: %5$s;", '{"S": "%1$s", "O": "%2$s, "A": "%4$s", "p" : "%5$s"}',
        'Sure: {"S" : "%1$s", "O": {"%2$s": "%3$s"}, "A": "%4$s", "P": "%5$s"', "123 4567 %%",
    )
    rows = table(spark, d, "conversations").withColumns({"w": w, "form": (F.col("conv_id") + F.col("turn")) % 5})
    raw = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        raw = F.when(F.col("form") == k, F.format_string(form, *(F.col("w")[n] for n in range(5)))).otherwise(raw)
    m = salvage.sections(F.col("raw"), "soap")
    return rows.withColumn("raw", raw).withColumn("m", m).select("conv_id", "turn", *(F.col("m")[k].alias(k) for k in W.NOTE_KEYS["soap"]))


# event plans

PLANNED = (
    "", "She is taking metformin 500 mg daily for the left foot.", "Increase lisinopril to 20 mg twice a day", "Refill metformin 250 mg and 1000 mg as needed", "start a 5 %x cream on both feet, toes and skin, bilateral",
    "continue", "follow up in 2 weeks", "call the office about blood pressure of 3.5 cm", "The doctor prescribes rest for the right hip", "He is on metoprolol", "metformin 500 mg and 850 mg, taking bid",
)
EVENT_CONCEPTS = ("", "gout", "knee pain", "")
_ECATS, _EPREDS = ("MedicationPlan", "symptom", "FollowUpPlan", "TestPlan", "finding", "", "medicationplan", "Diagnosis"), ("", "plans", "reports", "recommends")


def _planned(spark, d) -> DataFrame:
    """Flat propositions of a few concepts, each with a phrase of a plan before its text."""
    n = F.col("ord")
    return V.props(spark, d).select(
        "case_id", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("CAP"), n).alias("prop_id"), nth(_ECATS, n % len(_ECATS)).alias("category"), nth(_EPREDS, n % len(_EPREDS)).alias("predicate"), nth(EVENT_CONCEPTS, n % len(EVENT_CONCEPTS)).alias("concept"),
        F.concat_ws(" ", nth(PLANNED, n % len(PLANNED)), F.when(n % 3 == 0, F.col("prop_text")).otherwise("")).alias("prop_text"), F.when(n % 5 < 3, F.col("source")).otherwise("").alias("speaker"), F.when(n % 4 == 0, F.col("clinical_status")).otherwise("").alias("visit_state"),
        F.when(n % 2 == 0, F.when(F.col("verification") == "refuted", "negated").otherwise("affirmed")).otherwise("").alias("status"), F.when(n % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("temporality")).alias("temporality"),
    )


_VALUE_SQL = r"'\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|cm|mm|%|hours?|days?|weeks?|months?)\b'"
_DOSE_SQL = r"'\b\d+(?:\.\d+)?\s*(?:mg|mcg|g)\b'"
_HELD = lambda words: "list_filter([" + ", ".join(f"case when contains(t, {S.q(w)}) then {S.q(w)} end" for w in words) + "], lambda x: x is not null)"
_FILLED = lambda c: f"nullif({S.txt(c)}, '')"
_KNOWN = lambda c: f"coalesce({_FILLED(c)}, 'unknown')"
_UNITED = lambda c: f"case when count(*) filter (len({c}) > 0) = 1 then any_value({c}) filter (len({c}) > 0) else coalesce(list_sort(list_distinct(flatten(list({c}) filter (len({c}) > 0)))), []) end as {c}"
_FIRSTS = lambda c: f"arg_min({c}, ord) filter ({c} is not null) as {c}"
_SAID = lambda n: f"array_to_string(list_slice(statements, 1, {n}), '; ')"
_OFTEN = "case when len(frequencies) > 0 then ' (' || frequencies[1] || ')' else '' end"
_MEDICATION = "case when event_type = 'MedicationChange' then case when len(doses) > 1 then 'The clinician plans a dosing update for ' || medication || '.' when len(doses) = 1 then 'The clinician plans to adjust ' || medication || ' to ' || doses[1] || " + _OFTEN + " || '.' else 'The clinician plans a medication change for ' || medication || " + _OFTEN + " || '.' end else concat_ws(' ', 'The patient is currently taking', medication, dose, frequency) || '.' end"
_ETOKS = S.event_tokens("event_summary", L.EVENT_STOP_WORDS)
_VISIT = (
    f"case when lower(r_status) = 'negated' then 'ruled_out' when lower(r_status) = 'uncertain' then 'uncertain' when {S.has('lower(event_summary)', W.ENDED_WORDS)} then case when {S.has('lower(event_summary)', W.IMPROVED_WORDS)} then 'improving' else 'resolved' end"
    f" when {S.has('lower(event_summary)', W.WORSE_WORDS)} then 'worsening' when {S.has('lower(event_summary)', W.SAME_WORDS)} then 'stable' when lower(r_temporality) = 'past' then 'historical' else 'active' end"
)
_SPOKE = f"case when starts_with(lower(event_summary), 'the patient') or starts_with(lower(event_summary), 'patient ') or contains(' ' || lower(event_summary) || ' ', ' the patient ') then 'patient' when starts_with(lower(event_summary), 'the clinician') or starts_with(lower(event_summary), 'the doctor') or contains(' ' || lower(event_summary) || ' ', ' the doctor ') then 'clinician' when {S.has('lower(event_summary)', W.RESULT_SPEAKERS)} then 'test_result' else 'mixed' end"
_CARE = lambda f: f"case when coalesce({S.pick('event_type', event_plans.CARE)}, 'supporting_evidence') = {S.q(f)} then array_to_string(list_slice(statements, 1, 4), '|') end as {f}"


@query(f"""with p as (select case_id, cast(ord as bigint) as ord, 'CAP' || ord as prop_id, {S.nth(_ECATS, f'ord % {len(_ECATS)}')} as category, {S.nth(_EPREDS, f'ord % {len(_EPREDS)}')} as predicate, {S.nth(EVENT_CONCEPTS, f'ord % {len(EVENT_CONCEPTS)}')} as concept,
 {S.nth(PLANNED, f'ord % {len(PLANNED)}')} || ' ' || case when ord % 3 = 0 then prop_text else '' end as prop_text, case when ord % 5 < 3 then source else '' end as speaker, case when ord % 4 = 0 then clinical_status else '' end as visit_state, case when ord % 2 = 0 then case when verification = 'refuted' then 'negated' else 'affirmed' end else '' end as status, case when ord % 7 = 0 then null else temporality end as temporality from {_P}),
a as (select *, {_ETYPE} as event_type, {S.low('prop_text')} as t from p),
b as (select *, {S.first_hit('t', event_plans.MEDICATIONS)} as medication, {S.first_hit('t', event_plans.SIDES)} as laterality, regexp_extract_all(t, {_VALUE_SQL}) as found, {S.first_hit('t', event_plans.FREQUENCIES)} as frequency, list_sort({_HELD(event_plans.BODY_SITES)}) as body_sites, {_HELD(event_plans.ACTIONS)} as actions, regexp_extract_all(t, {_DOSE_SQL}) as in_doses from a),
c as (select *, list_filter(found, lambda v: contains(v, 'g'))[1] as dose, list_slice(found, 1, 3) as "values", case when len(actions) > 0 then actions[1] when {S.has('t', event_plans.TAKING)} then 'continue' when {S.has('t', event_plans.PRESCRIBING)} then 'prescribe' end as action from b),
d as (select *, list_filter(flatten([[{_FILLED('concept')}, medication, laterality], list_slice(body_sites, 1, 2), list_slice(actions, 1, 2), list_slice("values", 1, 2), case when event_type in ('MedicationState', 'MedicationChange') then [{_KNOWN('speaker')}, {_KNOWN('predicate')}, {_KNOWN('visit_state')}] when event_type in ('PlanOrder', 'FollowUp', 'PatientInstruction') then [{_KNOWN('predicate')}] when event_type = 'SymptomCourse' then [{_FILLED('visit_state')}] else [] end]), lambda x: x is not null) as parts from c),
e as (select *, trim(array_to_string(case when len(parts) > 0 then parts else list_slice({S.event_tokens('prop_text', L.EVENT_STOP_WORDS)}, 1, 4) end, ' ')) as sig0 from d),
f as (select *, case when sig0 <> '' then sig0 else substr(t, 1, 60) end as signature, {S.txt('prop_text')} as said from e),
g as (select case_id, event_type, signature, min(ord) as first_ord, count(*) as members, {', '.join(map(_FIRSTS, ('medication', 'laterality', 'dose', 'frequency', 'action')))}, {_UNITED('"values"')}, {_UNITED('body_sites')}, {_UNITED('actions')},
 list_sort(list_distinct(list(dose) filter (dose is not null))) as doses, list_sort(list_distinct(list(frequency) filter (frequency is not null))) as frequencies, len(list_distinct(flatten(list(in_doses)))) as n_doses, string_agg(prop_id, ',' order by ord) as supporting,
 {', '.join(f"arg_min({S.txt(x)}, ord) as r_{x}" for x in ('concept', 'visit_state', 'status', 'temporality', 'speaker'))} from f group by 1, 2, 3),
st as (select case_id, event_type, signature, list(said order by o) as statements from (select case_id, event_type, signature, said, min(ord) as o from f where said <> '' group by 1, 2, 3, 4) group by 1, 2, 3),
h as (select g.*, coalesce(st.statements, []) as statements, row_number() over (partition by g.case_id order by first_ord, g.event_type, g.signature) as n from g left join st using (case_id, event_type, signature)),
i as (select *, case when medication is not null and event_type in ('MedicationChange', 'MedicationState') then {_MEDICATION} when event_type in ('PlanOrder', 'FollowUp', 'PatientInstruction', 'ExamFinding', 'TestResult') then {_SAID(3)} else {_SAID(2)} end as event_summary from h where n <= 14),
j as (select * replace (case when event_type = 'MedicationState' and n_doses >= 2 then 'MedicationChange' else event_type end as event_type) from i),
k as (select *, array_to_string(list_slice({_ETOKS}, 1, 4), ' ') as words from j),
l as (select *, case when medication is not null and event_type in ('MedicationState', 'MedicationChange') then trim(medication || ' ' || array_to_string(list_slice(actions, 1, 2), '/')) when len(body_sites) > 0 then event_type || ': ' || array_to_string(list_slice(body_sites, 1, 2), '/') when words <> '' then words else event_type end as title from k)
select case_id, 'E' || n as event_id, event_type, coalesce(nullif(r_concept, ''), title) as canonical_concept, coalesce(nullif(r_visit_state, ''), {_VISIT}) as visit_state, coalesce(nullif(r_status, ''), 'affirmed') as status, coalesce(nullif(r_temporality, ''), 'current') as temporality, coalesce(nullif(r_speaker, ''), {_SPOKE}) as speaker_source,
 coalesce({S.pick('event_type', events.PRIORITY)}, 'low') as clinical_priority, title, event_summary, members, supporting, coalesce({S.pick('event_type', events.SECTIONS)}, 'S,Plan') as render_sections, {', '.join(map(_CARE, ('supporting_evidence', 'current_state', 'planned_actions', 'care_context')))},
 medication, laterality, dose, frequency, action, array_to_string("values", '|') as "values", array_to_string(body_sites, '|') as body_sites, array_to_string(actions, '|') as actions from l""")
def event_plan_slots(spark, d):
    """Event plans with merged slots, titles, summaries and care fields."""
    return event_plans.event_plan(_planned(spark, d))


# the rules of inline rows over whole tables

_N = "(conv_id * 31 + turn)"
_KINDS, _RAWS = tuple(r[1] for r in V.TEXTS.rows), tuple(r[1] or "" for r in V.LABELS.rows)
_SPEAKERS, _WHENS, _LKINDS = tuple(r[3] or "" for r in V.LABELS.rows), tuple(r[4] or "" for r in V.LABELS.rows), tuple(r[2] or "" for r in V.LABELS.rows)
_SOURCES, _VERIFIED = ("patient", "clinician", "doctor", "", "unknown"), ("confirmed", "refuted", "unconfirmed")
_FCATS, _FPREDS = tuple(dict.fromkeys(r[2] or "" for r in V.FLAT.rows)), tuple(dict.fromkeys(r[3] or "" for r in V.FLAT.rows))


def _texts(spark, d) -> DataFrame:
    n = F.col("conv_id") * 31 + F.col("turn")
    return table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), nth(_KINDS, n % len(_KINDS)).alias("kind"), nth(("", "plan"), n % 2).alias("modality"), nth(_SOURCES, n % 5).alias("source"), nth(_VERIFIED, n % 3).alias("verified"), F.array_join(F.slice(T.tokens("text"), 1, 3), " ").alias("concept"), F.col("text").alias("body"))


def _labels(spark, d) -> DataFrame:
    a, b = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select((a * 100_000 + b).alias("id"), nth(_RAWS, (a * 7 + b) % 15).alias("raw"), nth(_LKINDS, (a * 3 + b) % 15).alias("kind"), nth(_SPEAKERS, (a + b) % 15).alias("speaker"), nth(_WHENS, (a * 11 + b) % 15).alias("time"))


def _flat(spark, d) -> DataFrame:
    n = F.col("ord")
    return V.props(spark, d).select("case_id", n, nth(_FCATS, n % len(_FCATS)).alias("category"), nth(_FPREDS, n % len(_FPREDS)).alias("predicate"), "concept", "prop_text")


def _transcripts(spark, d) -> DataFrame:
    said = F.concat(nth(("[doctor] ", "[patient] He denies chest pain, ", "", "[Clinician] We will start it and check "), F.col("turn") % 4), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "\n").alias("transcript"))


def _notes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.concat(F.lit("HPI:\n"), F.coalesce("text", F.lit("")), F.lit("\nPlan: rest\nlast")).alias("note"))


_OF = {
    V.TEXTS: (_texts, f"(select conv_id * 100000 + turn as id, {S.nth(_KINDS, f'{_N} % {len(_KINDS)}')} as kind, {S.nth(('', 'plan'), f'{_N} % 2')} as modality, {S.nth(_SOURCES, f'{_N} % 5')} as source, {S.nth(_VERIFIED, f'{_N} % 3')} as verified, array_to_string(list_slice({S.toks('text')}, 1, 3), ' ') as concept, text as body from conversations)", "event_concepts concept_from_text text_rules retype_cascade low_value_filter"),
    V.LABELS: (_labels, f"(select conv_id * 100000 + turn as id, {S.nth(_RAWS, '(conv_id * 7 + turn) % 15')} as raw, {S.nth(_LKINDS, '(conv_id * 3 + turn) % 15')} as kind, {S.nth(_SPEAKERS, '(conv_id + turn) % 15')} as speaker, {S.nth(_WHENS, '(conv_id * 11 + turn) % 15')} as time from conversations)", "norm_labels benchmark_labels seed_labels"),
    V.FLAT: (_flat, f"(select case_id, cast(ord as int) as ord, {S.nth(_FCATS, f'ord % {len(_FCATS)}')} as category, {S.nth(_FPREDS, f'ord % {len(_FPREDS)}')} as predicate, concept, prop_text from {_P})", "event_types event_slots event_plan"),
    V.TURNS: (_transcripts, f"(select conv_id as case_id, string_agg({S.nth(('[doctor] ', '[patient] He denies chest pain, ', '', '[Clinician] We will start it and check '), 'turn % 4')} || replace(coalesce(text, ''), chr(10), ' '), chr(10) order by turn) as transcript from conversations group by 1)", "turns_parse negation_props plan_clauses marked_turns"),
    V.NOTES: (_notes, "(select doc_id as case_id, 'HPI:' || chr(10) || coalesce(text, '') || chr(10) || 'Plan: rest' || chr(10) || 'last' as note from documents)", "header_sections subjective_view"),
}


def _over_table(name: str, inline, rows, sql: str) -> None:
    """Registers a query of inline rows again, over a whole table."""
    inner = QUERIES[name]

    def run(spark, d):
        return inner(spark, d, rows(spark, d))

    run.__name__, run.__doc__ = f"{name}_table", f"{name} over a whole table."
    query(ORACLES[name].replace(inline.sql, sql))(run)


for _inline, (_rows, _sql, _names) in _OF.items():
    for _name in _names.split():
        _over_table(_name, _inline, _rows, _sql)


# more of them: inputs made of the keys of a table's rows, the same on both sides

_SPAN_FORMS = ("{a}", "T{a}-{b}", "{b}-{a}", "{a}-60", "{a},{b};5/7", "{a} to {b}", "x{a}y", "", "t{a}|T{a}|1, T{b}", "T{a} – T{b}", "T{b},odd, t{a} ")
_JUDGED = ("supported", "partial", "low_value", "missing", "contradicted", "odd")
_FINDS, _FIND_TYPES, _SEVERITIES = ("hallucination", "omission", "other"), ("fabrication", "negation", "contextual", "causality", "current_issues", "pmfs_issues", "information_plan"), ("major", "minor", "")
_SCORES = ("factual_accuracy", "omissions", "hallucinations", "organization", "conciseness", "terminology", "attribution", "temporality")
_KEYS, _STATES = ("fever", "cough", "", "rash"), ("Unknown", "Present", "Unknown", "Absent", "Other")


def _spans(spark, d) -> DataFrame:
    n = F.col("conv_id") * 31 + F.col("turn")
    raw = F.replace(F.replace(nth(_SPAN_FORMS, n % len(_SPAN_FORMS)), F.lit("{a}"), (F.col("conv_id") % 20).cast("string")), F.lit("{b}"), (F.col("turn") + 5).cast("string"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), raw.alias("raw"))


def _statuses(spark, d) -> DataFrame:
    a, b = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select(a.alias("case_id"), b.cast("int").alias("ord"), nth(_KEYS, (a + b * 7) % 4).alias("concept_key"), nth(_STATES, (a * 3 + b) % 5).alias("status"))


def _judgments(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("method"), nth(_JUDGED, F.col("event_id") % 6).alias("judgment"))


def _findings(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), nth(_FINDS, e % 3).alias("kind"), nth(_FIND_TYPES, e % 7).alias("type"), nth(_SEVERITIES, e % 11 % 3).alias("severity"))


def _checks(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), *(((e * (k + 3) + k) % 8).cast("int").alias(c) for k, c in enumerate(_SCORES)), nth(("Yes", "no", "yes ", ""), e % 4).alias("omission"), nth(("YES", "No", ""), e % 3).alias("hallucination"))


_MORE = {
    V.SPANS: (_spans, f"(select conv_id * 100000 + turn as id, replace(replace({S.nth(_SPAN_FORMS, f'{_N} % {len(_SPAN_FORMS)}')}, '{{a}}', cast(conv_id % 20 as varchar)), '{{b}}', cast(turn + 5 as varchar)) as raw from conversations)", "turn_span_parse seed_provenance event_label_ids"),
    V.STATUSES: (_statuses, f"(select conv_id as case_id, cast(turn as int) as ord, {S.nth(_KEYS, '(conv_id + turn * 7) % 4')} as concept_key, {S.nth(_STATES, '(conv_id * 3 + turn) % 5')} as status from conversations)", "latest_status"),
    V.JUDGMENTS: (_judgments, f"(select user_id as case_id, event_type as method, {S.nth(_JUDGED, 'event_id % 6')} as judgment from events)", "semantic_support"),
    V.FINDINGS: (_findings, f"(select user_id as case_id, {S.nth(_FINDS, 'event_id % 3')} as kind, {S.nth(_FIND_TYPES, 'event_id % 7')} as type, {S.nth(_SEVERITIES, 'event_id % 11 % 3')} as severity from events)", "safety_counts"),
    V.CHECKS: (_checks, f"(select event_id as id, {', '.join(f'cast((event_id * {k + 3} + {k}) % 8 as int) as {c}' for k, c in enumerate(_SCORES))}, {S.nth(('Yes', 'no', 'yes ', ''), 'event_id % 4')} as omission, {S.nth(('YES', 'No', ''), 'event_id % 3')} as hallucination from events)", "checklist_means"),
}
for _inline, (_rows, _sql, _names) in _MORE.items():
    for _name in _names.split():
        _over_table(_name, _inline, _rows, _sql)


def _injections(spark, d) -> DataFrame:
    """Sentences of each note and others, two of each document."""
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "text", k.alias("ord"))
    n = F.col("case_id") + F.col("ord")
    return rows.select("case_id", "ord", nth(("Omission", "omission ", "hallucination"), n % 3).alias("axis"), nth(("major", "minor", " Major"), n % 5 % 3).alias("severity"), F.when(n % 4 == 0, "not there at all").otherwise(F.substring(F.coalesce("text", F.lit("")), 3, 20)).alias("sentence"))


_INJECTED = "(select case_id, ord, [{a}][(case_id + ord) % 3 + 1] as axis, [{s}][(case_id + ord) % 5 % 3 + 1] as severity, case when (case_id + ord) % 4 = 0 then 'not there at all' else substr(coalesce(text, ''), 3, 20) end as sentence from (select doc_id as case_id, text, unnest([1, 2]) as ord from documents))".format(a="'Omission', 'omission ', 'hallucination'", s="'major', 'minor', ' Major'")


@query(ORACLES["stress_subsets"].replace(V.INJECTIONS.sql, _INJECTED).replace(ORACLES["subjective_view"], ORACLES["subjective_view_table"]))
def stress_subsets_table(spark, d):
    """stress_subsets over a whole table."""
    return QUERIES["stress_subsets"](spark, d, _injections(spark, d), _notes(spark, d))


@query(ORACLES["doubtful_output"].replace(ORACLES["turns_parse"], ORACLES["turns_parse_table"]).replace(V.FLAT.sql, _OF[V.FLAT][1].replace("concept, prop_text from", "case when ord % 9 = 0 and case_id % 5 = 0 then '' else concept end as concept, prop_text from")))
def doubtful_output_table(spark, d):
    """doubtful_output over a whole table; some propositions lack a concept."""
    blank = (F.col("ord") % 9 == 0) & (F.col("case_id") % 5 == 0)
    return QUERIES["doubtful_output"](spark, d, _flat(spark, d).withColumn("concept", F.when(blank, "").otherwise(F.col("concept"))), _transcripts(spark, d))


#: Answers with a list of objects, and what is read of each: (pos, item).
_PAYLOADS = (
    ('{"caps": [{"a": #a}, 2, {"a": #b}]}', ((0, '{"a":#a}'), (2, '{"a":#b}'))), ('{"facts": "none", "gold_caps": [{"a": #b}]}', ((0, '{"a":#b}'),)), ('[{"a": #a}, "x"]', ((0, '{"a":#a}'),)), ('```json\n{"seed_gold_caps": [{"a": #b},]}\n```', ((0, '{"a":#b}'),)),
    ("not json #a", ()), ('{"transcript_facts": "{\\"caps\\": [{\\"a\\": #a}]}"}', ((0, '{"a":#a}'),)), ('Sure: {"atomic_propositions": ["x", {"a": #b, "b": [#a]}]} done', ((1, '{"a":#b,"b":[#a]}'),)), ('{"clinical_atomic_facts": []}', ()),
)
_PAYLOAD = " union all ".join(f"select conv_id * 100000 + turn as id, {pos} as pos, replace(replace({S.q(item)}, '#a', cast(conv_id as varchar)), '#b', cast(turn as varchar)) as item from conversations where {_N} % {len(_PAYLOADS)} = {k}" for k, (_, found) in enumerate(_PAYLOADS) for pos, item in found)


@query(_PAYLOAD)
def payload_probe_table(spark, d):
    """Lists of objects in answers made of each turn's keys."""
    n = F.col("conv_id") * 31 + F.col("turn")
    raw = F.replace(F.replace(nth([x for x, _ in _PAYLOADS], n % len(_PAYLOADS)), F.lit("#a"), F.col("conv_id").cast("string")), F.lit("#b"), F.col("turn").cast("string"))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), raw.alias("raw"))
    return propositions.payload(rows).select("id", "pos", "item")
