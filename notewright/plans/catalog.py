"""All registered queries over whole tables or inline rows, each with its oracle where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import normalize as N
from ..functions import rules as R
from ..functions import terms as W
from ..functions import text as T
from ..operators import align, bundle_events, bundles, events, evidence, extraction, metrics, notes, propositions, states, stress, turns
from ..sources.stage import buckets, dealt, told
from . import fixtures as V
from . import sql as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def of(inline, spark, rows):
    """The rows given, or else the inline ones."""
    return inline.df(spark) if rows is None else rows


# text


@query(f"select doc_id, {S.norm('text')} as norm, cast(len({S.toks('text')}) as int) as n_tokens from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("norm"), F.size(T.tokens("text")).alias("n_tokens"))


@query(f"select conv_id, turn, array_to_string({S.align('text')}, ' ') as aligned from conversations")
def align_normalize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.alignment_text("text").alias("aligned"))


_EVENT = "list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(body, '')), '\\b\\d+(?:\\.\\d+)?\\b', ' ', 'g'), '[^a-z0-9%/+\\-]+', ' ', 'g'), ' '), lambda t: length(t) > 2 and t not in (" + ", ".join(map(S.q, L.EVENT_STOP_WORDS)) + "))"


@query(f"select id, array_to_string({_EVENT}, ' ') as event_tokens, {S.audit_key('body', W.AUDIT_STOP_WORDS)} as concept_key from {V.TEXTS.sql}")
def event_concepts(spark, d, rows=None):
    return of(V.TEXTS, spark, rows).select("id", F.array_join(T.event_tokens("body"), " ").alias("event_tokens"), T.audit_key("body").alias("concept_key"))


_LEAD = r"regexp_replace(regexp_replace(lower(%s), '^(the patient|patient|she|he|they)\s+(reports|denies|has|states|notes|describes)\s+', ''), '^(the clinician|clinician|doctor|provider)\s+(notes|states|assesses|diagnoses|suspects|plans|orders|recommends|prescribes)\s+', '')" % S.txt("body")


#: Auxiliaries between anything but letters, digits and underscores; twice, as neighbours share what is between them.
_AUX = r"regexp_replace(%s, '(^|[^\p{L}\p{N}_])(will|is|are|was|were|be|being|been)([^\p{L}\p{N}_]|$)', '\1 \3', 'g')"


@query(rf"select id, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace({_AUX % (_AUX % _LEAD)}, '[^a-z0-9%/+\- ]', ' ', 'g'), '\s+', ' ', 'g')), ' '), 1, 8), ' ') as concept from {V.TEXTS.sql}")
def concept_from_text(spark, d, rows=None):
    return of(V.TEXTS, spark, rows).select("id", T.concept_from_text("body").alias("concept"))


_ADJ = "(select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations)"


def _adjacent(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")


@query(f"select conv_id, turn, {S.f1('x', 'y')} as f1 from (select conv_id, turn, {S.toks('a')} as x, {S.toks('b')} as y from {_ADJ} where b is not null)")
def token_f1_adjacent(spark, d):
    both = _adjacent(spark, d).select("conv_id", "turn", T.tokens("a").alias("x"), T.tokens("b").alias("y"))
    return both.select("conv_id", "turn", T.token_f1(F.col("x"), F.col("y")).alias("f1"))


@query(f"select conv_id, turn, {S.f1('x', 'y')} as f1 from (select conv_id, turn, {S.align('a')} as x, {S.align('b')} as y from {_ADJ} where b is not null)")
def relaxed_f1_adjacent(spark, d):
    both = _adjacent(spark, d).select("conv_id", "turn", T.alignment_tokens("a").alias("x"), T.alignment_tokens("b").alias("y"))
    return both.select("conv_id", "turn", T.token_f1(F.col("x"), F.col("y")).alias("f1"))


@query()
def rouge_l_adjacent(spark, d):
    both = _adjacent(spark, d).select("conv_id", "turn", T.tokens("a").alias("x"), T.tokens("b").alias("y"))
    return both.select("conv_id", "turn", F.round(T.rouge_l_long(F.col("x"), F.col("y")), 4).alias("rouge_l"))


# turns and notes


@query(rf"""with l as (select case_id, unnest(string_split({S.txt('transcript')}, chr(10))) as line, generate_subscripts(string_split({S.txt('transcript')}, chr(10)), 1) - 1 as n from {V.TURNS.sql}),
c as (select *, coalesce(sum(length(line) + 1) over (partition by case_id order by n rows between unbounded preceding and 1 preceding), 0) as cur, lower(regexp_extract(trim(line), '(?i)^\[(doctor|patient|clinician)\]\s*(.*)$', 1)) as who from l),
t as (select case_id, n, line, cur, case when who <> '' then who else 'unknown' end as speaker, case when who <> '' then trim(regexp_extract(trim(line), '(?i)^\[(doctor|patient|clinician)\]\s*(.*)$', 2)) else trim(line) end as said from c where trim(line) <> '')
select case_id, 'T' || n as turn_id, cast(n as int) as turn_idx, speaker, said, cast(cur + greatest(instr(line, said) - 1, 0) as bigint) as start_char, cast(cur + greatest(instr(line, said) - 1, 0) + length(said) as bigint) as end_char from t""")
def turns_parse(spark, d, rows=None):
    return turns.turns(of(V.TURNS, spark, rows), ["case_id"], "transcript")


@query(f"select conv_id, turn, 'S' || (generate_subscripts(u, 1) - 1) as turn_id, unnest(u) as unit from (select conv_id, turn, list_filter(list_transform(string_split({S.txt('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as u from conversations)")
def note_units(spark, d):
    return turns.note_units(table(spark, d, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "turn_id", "unit")


@query("""with recursive t as (select conv_id, turn, length(coalesce(text, '')) as len, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
e as (select conv_id, i as s, i as last, len as c, n from t union all select e.conv_id, e.s, t.i, e.c + 1 + t.len, e.n from e join t on t.conv_id = e.conv_id and t.i = e.last + 1 where e.last - e.s + 1 < 3 and e.c + 1 + t.len <= 1500),
ends as (select conv_id, s, max(last) + 1 as e, any_value(n) as n from e group by all),
w as (select conv_id, 0 as chunk, s, e, n from ends where s = 0 and n > 4 union all select w.conv_id, w.chunk + 1, x.s, x.e, w.n from w join ends x on x.conv_id = w.conv_id and x.s = greatest(w.e - 1, w.s + 1) where w.e < w.n)
select conv_id, cast(chunk as int) as chunk, cast(s as int) as from_turn, cast(e as int) as until_turn from w union all select conv_id, 0, 0, cast(n as int) from ends where s = 0 and n <= 4""")
def chunk_turns(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return turns.turn_chunks(rows, "conv_id", "turn", "text", size=3, overlap=1, max_chars=1500, short=4)


@query(f"""with recursive u as (select conv_id, turn, list_filter(list_transform(string_split({S.txt('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as us from conversations),
w as (select conv_id, turn, us, 1 as p, 0 as c, 1 as n, length(us[1]) as s from u where len(us) > 0
 union all select conv_id, turn, us, p + 1, c + cast(n >= 3 or s + 1 + length(us[p + 1]) > 200 as int), case when n >= 3 or s + 1 + length(us[p + 1]) > 200 then 1 else n + 1 end, case when n >= 3 or s + 1 + length(us[p + 1]) > 200 then length(us[p + 1]) else s + 1 + length(us[p + 1]) end from w where p < len(us))
select conv_id, turn, cast(p - 1 as int) as pos, us[p] as unit, cast(c as int) as chunk from w""")
def pack_lines(spark, d):
    kept = F.filter(F.transform(F.split(T.safe_text("text"), turns.LINE_BREAK), lambda x: F.trim(x)), lambda x: x != "")
    return turns.packed(table(spark, d, "conversations").select("conv_id", "turn", kept.alias("us")), ["conv_id", "turn"], "us", 200, 3)


@query(f"select doc_id, cast(count(*) as bigint) as sentences, cast(max(length(s)) as int) as longest from (select doc_id, unnest(string_split(regexp_replace({S.txt('text')}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as s from documents) where trim(s) <> '' group by doc_id")
def sentence_split(spark, d):
    return turns.sentences(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


_NOTE_LINES = f"(select case_id, unnest(string_split(note, chr(10))) as line, generate_subscripts(string_split(note, chr(10)), 1) - 1 as line_no from {V.NOTES.sql})"


@query(f"select case_id, cast(line_no as int) as line_no, line, cast(sum(case when trim(line) like '%:' and length(trim(line)) <= 80 and length(regexp_replace(trim(line), '[^:]', '', 'g')) = 1 and not regexp_matches(trim(line), '^[-*•]') then 1 else 0 end) over (partition by case_id order by line_no) as bigint) as section from {_NOTE_LINES}")
def header_sections(spark, d, rows=None):
    return turns.sections(turns.lines(of(V.NOTES, spark, rows), "note"), ["case_id"]).select("case_id", "line_no", "line", "section")


@query(f"""select case_id, cast(line_no as int) as line_no, line from (select *, last_value(m ignore nulls) over (partition by case_id order by line_no rows between unbounded preceding and current row) as v from
(select *, case when regexp_matches(trim(line), {S.q(turns.SUBJECTIVE)}) then 1 when regexp_matches(trim(line), {S.q(turns.OTHER_SECTION)}) then 0 end as m from {_NOTE_LINES})) where v = 1""")
def subjective_view(spark, d, rows=None):
    return turns.subjective(turns.lines(of(V.NOTES, spark, rows), "note"), ["case_id"]).select("case_id", "line_no", "line")


_PIECES = "list_transform(flatten(list_transform(list_transform(list_concat(regexp_extract_all(l, '\\b(?:deny|denies|denied)\\b\\s+([^.;]+)', 1), case when starts_with(l, 'no ') then [substr(l, 4)] else [] end), lambda p: regexp_split_to_array(p, '\\bbut\\b|\\bexcept\\b')[1]), lambda p: regexp_split_to_array(p, ',|/| and | or '))), lambda p: regexp_replace(p, '^[ .:;]+|[ .:;]+$', '', 'g'))"
_DENIED = f"""select case_id, turn_idx, cast(pos as int) as pos, concept, 'The patient denies ' || concept || '.' as prop_text from (select *, row_number() over (partition by case_id, turn_idx order by pos) as r2 from (select *, row_number() over (partition by case_id, turn_idx, {S.norm('concept')} order by pos) as r from
 (select case_id, turn_idx, generate_subscripts(ps, 1) - 1 as pos, unnest(ps) as concept from (select case_id, turn_idx, list_filter({_PIECES}, lambda p: {S.words('p')} >= 2 and not {S.inside('p', L.NEGATION_STOPS)} and {S.clinical('p')}) as ps from (select *, lower({S.txt('said')}) as l from ({ORACLES['turns_parse']}) where speaker in ('patient', 'unknown'))))) where r = 1) where r2 <= 4"""


@query(_DENIED)
def negation_props(spark, d, rows=None):
    return turns.negations(turns.turns(of(V.TURNS, spark, rows), ["case_id"], "transcript"), ["case_id", "turn_idx"])


_VERB = "(?i)" + L.PLAN_VERBS
_EDGES = "regexp_replace({}, '^[ ,;.]+|[ ,;.]+$', '', 'g')".format
_CLAUSE = "'The clinician will ' || " + _EDGES("regexp_replace(" + _EDGES("p") + ", '(?i)\\b(and|then)\\s*$', '')") + " || '.'"


@query(f"""select case_id, turn_idx, cast(pos as int) as pos, clause from (select *, row_number() over (partition by case_id, turn_idx order by pos) as r2 from (select *, row_number() over (partition by case_id, turn_idx, {S.norm('clause')} order by pos) as r from
 (select case_id, turn_idx, generate_subscripts(cs, 1) - 1 as pos, unnest(cs) as clause from (select case_id, turn_idx, list_filter(list_transform(list_filter(string_split(regexp_replace(said, {S.q(_VERB)}, chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, {S.q('(?i)^' + L.PLAN_VERBS)})), lambda p: {_CLAUSE}), lambda c: {S.words('c')} >= 5) as cs from ({ORACLES['turns_parse']})))) where r = 1) where r2 <= 4""")
def plan_clauses(spark, d, rows=None):
    return turns.action_clauses(turns.turns(of(V.TURNS, spark, rows), ["case_id"], "transcript"), ["case_id", "turn_idx"], "said")


@query("select conv_id, turn, cast(floor((row_number() over (partition by conv_id order by turn) - 1) / 3) as int) as chunk from conversations")
def fixed_chunks(spark, d):
    return turns.fixed_chunks(table(spark, d, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "chunk")


# rules and normalisers


@query(f"select id, {S.question('body')} as question, {S.clinical('body')} as clinical, {S.chatter('body')} as chatter, {S.plan_like('body')} as plan, {S.has(S.low('body'), L.RESULT_WORDS)} as result, {S.has(S.low('body'), L.EXAM_WORDS)} as exam, {S.has(S.low('body'), L.DIAGNOSIS_WORDS)} as diagnosis, {S.has(S.low('body'), L.SYMPTOM_WORDS)} as symptom, {S.plan_type('body')} as plan_type from {V.TEXTS.sql}")
def text_rules(spark, d, rows=None):
    b = F.col("body")
    return of(V.TEXTS, spark, rows).select("id", R.is_question(b).alias("question"), R.clinical(b).alias("clinical"), R.chatter(b).alias("chatter"), R.plan_like(b).alias("plan"), R.result_like(b).alias("result"), R.exam_like(b).alias("exam"), R.diagnosis_like(b).alias("diagnosis"), R.symptom_like(b).alias("symptom"), R.plan_type(b).alias("plan_type"))


_SRC = S.low("source")
_RETYPED = (
    f"case when kind in ('Problem', 'Symptom') and {S.plan_like('body')} then {S.plan_type('body')} when kind in ('Problem', 'Symptom') and {S.has(S.low('body'), L.RESULT_WORDS)} then 'TestResult'"
    f" when kind in ('Problem', 'Symptom') and {S.has(S.low('body'), L.EXAM_WORDS)} and {_SRC} in ('clinician', 'doctor') then 'ExamFinding' when kind = 'Problem' and ({_SRC} = 'patient' or {S.low('verified')} = 'refuted' or {S.has(S.low('body'), L.SYMPTOM_WORDS)}) then 'Symptom'"
    f" when kind in ('Problem', 'Impression') and {_SRC} in ('clinician', 'doctor') and {S.has(S.low('body'), L.DIAGNOSIS_WORDS)} then 'Diagnosis' else kind end"
)


@query(f"select id, case when {S.low('modality')} = 'plan' and t in ('Problem', 'Symptom') then {S.plan_type('body')} else t end as retyped from (select *, {_RETYPED} as t from {V.TEXTS.sql})")
def retype_cascade(spark, d, rows=None):
    return of(V.TEXTS, spark, rows).select("id", R.retyped(F.col("kind"), F.col("modality"), F.col("source"), F.col("body"), F.col("verified")).alias("retyped"))


@query(f"select id, {S.low_value('concept', 'body', 'kind')} as low, {S.protected('concept', 'kind')} as protected from {V.TEXTS.sql}")
def low_value_filter(spark, d, rows=None):
    return of(V.TEXTS, spark, rows).select("id", R.low_value(F.col("concept"), F.col("body"), F.col("kind")).alias("low"), R.protected(F.col("concept"), F.col("kind")).alias("protected"))


def _fold(c: str, keep: str = "[^a-z_]") -> str:
    return f"regexp_replace({S.low(c)}, '{keep}', '', 'g')"


_VER = f"coalesce({S.pick(_fold('raw'), L.VERIFICATION_ALIASES)}, {_fold('raw')})"
_STA = f"coalesce({S.pick(_fold('raw'), L.STATUS_ALIASES)}, {_fold('raw')})"
_TYPE = f"case when {S.inside(S.txt('kind'), L.PROPOSITION_TYPES)} then {S.txt('kind')} else {S.pick(_fold('kind', '[^a-z]'), L.TYPE_ALIASES)} end"
_WHEN = S.low("time")


@query(f"""with a as (select *, {_TYPE} as prop_type, case when {S.inside(_VER, L.VERIFICATION)} then {_VER} else 'confirmed' end as verification from {V.LABELS.sql}),
b as (select *, case when {S.inside(_STA, L.CLINICAL_STATUS)} then {_STA} when {S.has(_WHEN, ('follow', 'next', 'will'))} then 'planned' when verification = 'refuted' then 'resolved' when {S.has(_WHEN, ('history', 'previous', 'ago'))} then 'historical' else 'active' end as clinical_status from a)
select id, prop_type, verification, clinical_status, coalesce({S.pick(_fold('raw'), L.MODALITY_ALIASES)}, case when prop_type = 'ExamFinding' then 'exam' when prop_type = 'TestResult' then 'test_result' when {S.inside('prop_type', L.PLAN_TYPES)} then 'plan' when prop_type in ('Diagnosis', 'Impression') then 'assessment'
 when prop_type = 'Symptom' then case when speaker in ('patient', 'unknown') then 'interview' else 'exam' end when prop_type in ('ProblemHistory', 'Demographics', 'Allergy') then case when speaker in ('clinician', 'test_result') then 'historical_record' else 'interview' end when speaker = 'patient' then 'interview' else 'unknown' end) as modality,
 case when clinical_status = 'historical' then 'historical' when clinical_status = 'planned' then 'hypothetical' when verification = 'confirmed' then 'present' when verification = 'refuted' then 'absent' else 'uncertain' end as assertion from b""")
def norm_labels(spark, d, rows=None):
    v = of(V.LABELS, spark, rows).withColumns({"prop_type": N.proposition_type("kind"), "verification": N.verification("raw")})
    v = v.withColumn("clinical_status", N.clinical_status("raw", F.col("verification"), "time"))
    return v.select("id", "prop_type", "verification", "clinical_status", N.modality("raw", F.col("prop_type"), F.col("speaker")).alias("modality"), N.assertion(F.col("verification"), F.col("clinical_status")).alias("assertion"))


_LBL = f"coalesce(nullif({S.norm('raw')}, ''), '')"
_BST = f"case when {S.norm('raw')} in ('planned', 'plan') then 'planned' when {S.norm('raw')} in ('historical', 'history', 'past') then 'historical' when {S.norm('raw')} = 'resolved' then 'resolved' when {S.norm('raw')} in ('active', 'stable', 'improving', 'worsening') then 'active' when contains({S.norm('time')}, 'future') then 'planned' when contains({S.norm('time')}, 'past') then 'historical' else 'active' end"
_BTY = f"coalesce({S.pick(S.norm('kind'), L.BENCHMARK_TYPES)}, nullif({S.txt('kind')}, ''), 'Unknown')"


@query(f"""select *, case when c_type_n = 'medicationstatement' then 'state' when c_type_n in ('medicationrequest', 'order', 'followup', 'counseling') or c_state = 'planned' then 'plan' else 'none' end as c_role from (
select id, {_BTY} as c_type, case when {S.inside(_LBL, L.BENCHMARK_CONFIRMED[:5])} then 'confirmed' when {S.inside(_LBL, L.BENCHMARK_REFUTED)} then 'refuted' when {S.inside(_LBL, L.BENCHMARK_CONFIRMED[5:])} then 'confirmed' when {S.has(S.norm('time'), L.NEGATION_WORDS)} then 'refuted' when {S.norm('speaker')} in ('high', 'medium', 'low') then 'confirmed' else 'unconfirmed' end as c_verification,
 {_BST} as c_state, {S.bucket('time')} as c_time, {S.norm(_BTY)} as c_type_n from {V.LABELS.sql})""")
def benchmark_labels(spark, d, rows=None):
    v = of(V.LABELS, spark, rows).select("id", N.benchmark_type("kind").alias("c_type"), N.benchmark_verification("raw", F.lit(""), F.lit(""), "speaker", "time").alias("c_verification"), N.benchmark_state("raw", "time").alias("c_state"), N.temporality_bucket("time").alias("c_time"))
    return v.withColumns({"c_type_n": T.normalize("c_type"), "c_role": N.medication_role(F.col("c_type"), F.col("c_state"))})


_SPAN = "replace(replace(replace(replace(replace(" + S.txt("raw") + ", '–', '-'), '—', '-'), '~', '-'), ' to ', '-'), 'TO', '-')"


@query(rf"""with p as (select id, trim(unnest(regexp_split_to_array({_SPAN}, '[,;/|]+'))) as p from {V.SPANS.sql}),
r as (select id, p, try_cast(nullif(regexp_extract(p, '^[Tt]?(\d+)\s*-\s*[Tt]?(\d+)$', 1), '') as int) as a, try_cast(nullif(regexp_extract(p, '^[Tt]?(\d+)\s*-\s*[Tt]?(\d+)$', 2), '') as int) as b from p),
x as (select id, unnest(case when a is null then list_transform(regexp_extract_all(p, '(\d+)', 1), lambda s: try_cast(s as bigint)) when abs(b - a) <= 50 then range(least(a, b), greatest(a, b) + 1) else [cast(least(a, b) as bigint), cast(greatest(a, b) as bigint)] end) as t from r)
select s.id, coalesce(string_agg(cast(t as varchar), ',' order by t), '') as turns from {V.SPANS.sql} s left join (select distinct id, t from x) y on s.id = y.id group by s.id""")
def turn_span_parse(spark, d, rows=None):
    return of(V.SPANS, spark, rows).select("id", F.array_join(N.turn_span("raw").cast("array<string>"), ",").alias("turns"))


@query()
def payload_probe(spark, d):
    return propositions.payload(V.PAYLOADS.df(spark)).select("id", "pos", "item")


# propositions


_P = f"({V.PROPS})"


@query(f"select case_id, ord, 'CAP' || row_number() over (partition by case_id order by ord) as prop_id from (select *, row_number() over (partition by case_id, prop_type, {S.norm('concept')}, {S.norm('prop_text')}, verification, {S.norm('temporality')} order by ord) as r from {_P} where {S.norm('concept')} <> '' and {S.norm('prop_text')} <> '') where r = 1")
def props_dedup(spark, d):
    return propositions.sanitized(V.props(spark, d)).select("case_id", F.col("ord").cast("long").alias("ord"), "prop_id")


_PRIO = S.pick("prop_type", L.TYPE_PRIORITY).replace("'", "")
_PRIO = "case prop_type " + " ".join(f"when {S.q(k)} then {v}" for k, v in L.TYPE_PRIORITY.items()) + " else 0 end"
_BEST = f"{_PRIO} desc, {S.words('prop_text')} desc, ord"


@query(f"select case_id, cast(ord as bigint) as ord, cast(k as int) as rank from (select *, row_number() over (partition by case_id order by {_BEST}) as k from (select *, row_number() over (partition by case_id, lower(prop_type), {S.norm('prop_text')}, lower(verification), lower(clinical_status), {S.norm('temporality')} order by {_BEST}) as r from {_P}) where r = 1) where k <= 12")
def props_top(spark, d):
    return propositions.merged_top(V.props(spark, d), 12).select("case_id", F.col("ord").cast("long").alias("ord"), "rank")


_C = f"(select *, {S.pick(S.norm('prop_type'), L.BENCHMARK_TYPES)} as bt, {S.bucket('temporality')} as c_time from {_P})"
_CANON = f"(select *, coalesce(bt, prop_type) as c_type, {S.norm('concept')} as c_concept, case when {S.has(S.norm('prop_text'), L.NEGATION_WORDS)} then 'refuted' else verification end as v0, verification as c_verification, case clinical_status when 'planned' then 'planned' when 'historical' then 'historical' when 'resolved' then 'resolved' else 'active' end as c_state from {_C})"
_CANON = _CANON.replace("verification as c_verification", f"case verification when 'confirmed' then 'confirmed' when 'refuted' then 'refuted' else case when {S.has(S.norm('prop_text'), L.NEGATION_WORDS)} then 'refuted' else 'unconfirmed' end end as c_verification")
_GKEY = f"case_id, {S.norm('c_type')} as m_type, {S.norm('c_concept')} as m_concept, c_verification, c_time"


@query(f"select {_GKEY}, count(distinct annotator) as annotators, arg_min(prop_text, {{'a': annotator, 'o': ord}}) as prop_text from {_CANON} group by all")
def gold_union(spark, d):
    return propositions.gold(N.canonical(V.props(spark, d)), "union")


@query(f"with g as (select {_GKEY}, count(distinct annotator) as annotators, arg_min(prop_text, {{'a': annotator, 'o': ord}}) as prop_text from {_CANON} group by all), n as (select case_id, count(distinct annotator) as needed from {_P} group by 1) select g.* from g join n using (case_id) where annotators >= needed")
def gold_intersection(spark, d):
    return propositions.gold(N.canonical(V.props(spark, d)), "intersection")


@query(f"select cast(case_id as varchar) || '@@' || annotator as case_key, count(*) as props from {_P} group by 1")
def gold_per_annotator(spark, d):
    return propositions.gold(N.canonical(V.props(spark, d)), "per_annotator").groupBy("case_key").agg(F.count("*").alias("props"))


@query(f"""with s as (select case_id, annotator, string_agg(distinct s, chr(10) order by s) as sig from (select case_id, annotator, {S.norm('c_type')} || '|' || {S.norm('c_concept')} || '|' || {S.norm('prop_text')} || '|' || c_verification || '|' || c_state || '|' || c_time as s from {_CANON}) group by 1, 2),
p as (select case_id, count(distinct annotator) as annotators, count(distinct sig) as kinds from s group by 1) select case_id, annotators, case when annotators < 2 then 'single' else 'identical' end as finding from p where annotators < 2 or kinds = 1""")
def annotator_health(spark, d):
    return propositions.annotator_health(N.canonical(V.props(spark, d)))


# joins


def _sides(spark, d):
    c = table(spark, d, "conversations")
    side = lambda role, n: c.where(F.col("role") == role).select(F.col("conv_id").alias("case_id"), F.col("turn").cast("int").alias(n), "text")
    return side("user", "i"), side("assistant", "j")


_TPAIRS = f"""select case_id, i, j, greatest({S.f1('ta', 'tb')}, {S.f1('aa', 'ba')}) as score from (select u.conv_id as case_id, u.turn as i, a.turn as j, {S.toks('u.text')} as ta, {S.toks('a.text')} as tb, {S.align('u.text')} as aa, {S.align('a.text')} as ba
 from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant')"""


@query(S.greedy(f"select * from ({_TPAIRS}) where score >= 0.2") + """
select u.conv_id as case_id, coalesce(m.matched, 0) as matched, u.n as pred_n, a.n as gold_n, case when u.n > 0 then coalesce(m.matched, 0) / u.n else 0.0 end as "precision", case when a.n > 0 then coalesce(m.matched, 0) / a.n else 0.0 end as recall, case when coalesce(m.matched, 0) = 0 then 0.0 else 2.0 * m.matched / (u.n + a.n) end as f1
from (select conv_id, count(*) filter (role = 'user') as n from conversations group by 1) u join (select conv_id, count(*) filter (role = 'assistant') as n from conversations group by 1) a using (conv_id)
left join (select case_id, count(*) filter (taken) as matched from walk group by 1) m on m.case_id = u.conv_id""")
def prop_alignment(spark, d):
    left, right = _sides(spark, d)
    m = align.text_alignment(left, right, 0.2).groupBy("case_id").agg(F.count("*").alias("matched"))
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.count_if(F.col("role") == "user").alias("pred_n"), F.count_if(F.col("role") == "assistant").alias("gold_n"))
    return align.prf(n.join(m, "case_id", "left").na.fill(0, ["matched"]), "matched", "pred_n", "gold_n")


_BPAIRS = f"""select case_id, i, j, 0.55 * {S.f1('ac', 'bc')} + 0.35 * {S.f1('ta', 'tb')} + 0.10 * case when a_type = b_type then 1.0 else 0.0 end as score from (select a.case_id, a.ord as i, b.ord as j, a.c_type as a_type, b.c_type as b_type, a.ct as ac, b.ct as bc, a.pt as ta, b.pt as tb from cc a join cc b on a.case_id = b.case_id and a.annotator = 'A' and b.annotator = 'B')"""
_CC = f"cc as (select case_id, ord, annotator, c_type, {S.toks('c_concept')} as ct, {S.toks('prop_text')} as pt from {_CANON})"


@query(S.greedy(f"select * from ({_BPAIRS}) where score >= 0.45").replace("with recursive ", f"with recursive {_CC}, ") + " select case_id, cast(i as int) as i, cast(j as int) as j, score from walk where taken")
def benchmark_match(spark, d):
    c = N.canonical(V.props(spark, d)).withColumn("ord", F.col("ord").cast("int"))
    return align.benchmark_matches(c.where("annotator = 'A'").withColumnRenamed("ord", "i"), c.where("annotator = 'B'").withColumnRenamed("ord", "j"))


@query()
def benchmark_evaluation(spark, d):
    c = N.canonical(V.props(spark, d)).withColumns({"ord": F.col("ord").cast("int"), "turns": F.array("turn_idx")})
    a, b = c.where("annotator = 'A'").withColumnRenamed("ord", "i"), c.where("annotator = 'B'").withColumnRenamed("ord", "j")
    return align.evaluate(a, b, align.benchmark_matches(a, b))


@query()
def proposition_match(spark, d):
    """Propositions of two annotators by the weighted score of seven fields."""
    p = F.struct(F.col("concept").alias("canonical_concept"), F.col("prop_text").alias("proposition_text"), F.col("prop_type").alias("category"), F.col("verification").alias("status"), F.col("clinical_status").alias("visit_state"), "temporality", F.col("source").alias("speaker"), F.lit("states").alias("predicate"))
    c = V.props(spark, d).select("case_id", "annotator", F.col("ord").cast("int").alias("ord"), p.alias("p"))
    return align.proposition_alignment(c.where("annotator = 'A'").withColumnRenamed("ord", "i"), c.where("annotator = 'B'").withColumnRenamed("ord", "j"))


_EV = f"0.55 * {S.f1('ct', 'st')} + 0.45 * {S.f1('pt', 'st')} + case when concept <> '' and contains(lower(said), lower(concept)) then 0.2 else 0.0 end - case when {S.question('said')} then 0.45 else 0.0 end + case when speaker = 'patient' then 0.14 else 0.0 end - case when {S.chatter('said')} then 0.2 else 0.0 end"


@query(f"""with t as (select conv_id as case_id, turn, case role when 'user' then 'patient' when 'assistant' then 'doctor' else 'unknown' end as speaker, text as said, {S.toks('text')} as st from conversations),
p as (select case_id, turn as ord, array_to_string(list_slice(st, 1, 3), ' ') as concept, said as prop_text, st as pt, list_slice(st, 1, 3) as ct from t where speaker = 'doctor'),
s as (select p.case_id, p.ord, t.turn, {_EV} as score from p join t on p.case_id = t.case_id and t.turn <> p.ord)
select case_id, cast(ord as int) as ord, cast(arg_max(turn, {{'s': score, 't': -turn}}) as int) as turn_idx, max(score) as score from s where score > 0 group by 1, 2""")
def evidence_argmax(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").cast("int").alias("turn_idx"), F.when(F.col("role") == "user", "patient").when(F.col("role") == "assistant", "doctor").otherwise("unknown").alias("speaker"), F.col("text").alias("said"))
    p = t.where("speaker = 'doctor'").select("case_id", F.col("turn_idx").alias("ord"), F.array_join(F.slice(T.tokens("said"), 1, 3), " ").alias("concept"), F.col("said").alias("prop_text"), F.lit("Symptom").alias("prop_type"), F.lit("confirmed").alias("verification"))
    return evidence.scored_turns(p, t).where("turn_idx <> ord and score > 0").groupBy("case_id", "ord").agg(F.max_by("turn_idx", F.struct("score", -F.col("turn_idx"))).alias("turn_idx"), F.max("score").alias("score"))


# states


_MED = f"case when clinical_status = 'planned' or {S.has('lower(temporality)', L.CHANGE_TIMES)} or {S.has('lower(prop_text)', L.CHANGE_WORDS)} then 'MedicationChange' else 'MedicationState' end"
_CT = f"case when prop_type in ('MedicationStatement', 'MedicationRequest') then {_MED} when prop_type in ('ChiefComplaint', 'Symptom', 'Problem', 'ProblemHistory', 'Diagnosis', 'Impression', 'Allergy') then 'ProblemState' when prop_type in ('Order', 'Counseling') then 'Plan' else prop_type end"
_RANK = "case clinical_status " + " ".join(f"when {S.q(k)} then {v}" for k, v in L.STATUS_RANK.items()) + " else 0 end"
_MEM = f"{{'p': {_PRIO} - case when {S.low_value('concept', 'prop_text', 'prop_type')} and not {S.protected('concept', 'prop_type')} then 4 else 0 end, 'c': {S.words('concept')}, 't': {S.words('prop_text')}, 'u': -turn_idx, 'o': -ord}}"
_CLUSTERS = f"""select case_id, cluster_type, cluster_concept, count(*) as members, min(turn_idx) as first_turn, max(turn_idx) as last_turn, arg_max(verification, {{'t': turn_idx, 'o': ord}}) as final_verification, arg_max(clinical_status, {{'r': {_RANK}, 't': turn_idx, 'o': ord}}) as final_status,
 arg_max(prop_text, {_MEM}) as summary, arg_max(prop_type, {_MEM}) as primary_type, cast(max({_PRIO}) as int) as salience, string_agg(distinct source, ',' order by source) as sources, string_agg(distinct prop_type, ',' order by prop_type) as types, string_agg(distinct 'T' || turn_idx, ',' order by 'T' || turn_idx) as turns, min(turn_idx * 1000000 + ord) as place
 from (select *, {_CT} as cluster_type, lower({S.txt('concept')}) as cluster_concept from {_P}) group by 1, 2, 3"""


@query(f"select * exclude (place), 'CL' || row_number() over (partition by case_id order by place, cluster_type, cluster_concept) as cluster_id, case when final_status = 'historical' then 'historical' when final_status = 'planned' then 'hypothetical' when final_verification = 'confirmed' then 'present' when final_verification = 'refuted' then 'absent' else 'uncertain' end as final_assertion from ({_CLUSTERS})")
def cluster_states(spark, d):
    return states.clusters(V.props(spark, d))


@query(f"with c as ({_CLUSTERS}), n as (select *, 'CL' || row_number() over (partition by case_id order by place, cluster_type, cluster_concept) as cluster_id from c) select p.case_id, cast(p.ord as bigint) as ord, n.cluster_id from (select *, {_CT} as cluster_type, lower({S.txt('concept')}) as cluster_concept from {_P}) p join n using (case_id, cluster_type, cluster_concept)")
def cluster_members(spark, d):
    p = V.props(spark, d)
    return states.cluster_of(p, states.clusters(p)).select("case_id", F.col("ord").cast("long").alias("ord"), "cluster_id")


_SETS = f"select distinct case_id, annotator, {_CT} as cluster_type, lower(concept) as cluster_concept from {_P}"


@query(f"""with s as ({_SETS}), b as (select coalesce(a.case_id, g.case_id) as case_id, count(a.case_id) as n_pred, count(g.case_id) as n_gold, count(case when a.case_id is not null and g.case_id is not null then 1 end) as n_both
 from (select * from s where annotator = 'A') a full join (select * from s where annotator = 'B') g on a.case_id = g.case_id and a.cluster_type = g.cluster_type and a.cluster_concept = g.cluster_concept group by 1)
select *, case when n_pred > 0 then n_both / n_pred else 0.0 end as "precision", case when n_gold > 0 then n_both / n_gold else 0.0 end as recall, case when n_both = 0 then 0.0 else 2 * (n_both / n_pred) * (n_both / n_gold) / (n_both / n_pred + n_both / n_gold) end as f1 from b""")
def cluster_prf(spark, d):
    c = states.clustered(V.props(spark, d))
    return states.set_prf(c.where("annotator = 'A'"), c.where("annotator = 'B'"), ["cluster_type", "cluster_concept"])


_FITS = "g.c <> '' and r.c <> '' and g.t = r.t and (g.c = r.c or (greatest(0, greatest(g.f, r.f) - least(g.l, r.l)) <= 2 and (contains(g.c, r.c) or contains(r.c, g.c))))"
_BETTER = "(r.s > g.s or (r.s = g.s and r.w > g.w))"


@query(f"""with recursive r0 as (select case_id, cluster_type as t, cluster_concept as c, first_turn as f, last_turn as l, salience as s, {S.words('cluster_concept')} as w, members as n, row_number() over (partition by case_id order by first_turn, cluster_type, cluster_concept) as k from ({_CLUSTERS})),
walk as (select case_id, cast(0 as bigint) as k, cast([] as struct(t varchar, c varchar, f int, l int, s int, w bigint, n bigint)[]) as gs, cast(null as bigint) as home, cast(null as varchar) as t, cast(null as varchar) as c from (select distinct case_id from r0)
 union all
 select case_id, k, case when home is null then list_append(gs, struct_pack(t := t, c := c, f := f, l := l, s := s, w := w, n := n)) else list_transform(gs, lambda g, i: case when i <> home then g else
   struct_pack(t := g.t, c := case when {_BETTER.replace('r.', '')} then c else g.c end, f := least(g.f, f), l := greatest(g.l, l), s := case when {_BETTER.replace('r.', '')} then s else g.s end, w := case when {_BETTER.replace('r.', '')} then w else g.w end, n := g.n + n) end) end, coalesce(home, len(gs) + 1), t, c
 from (select w.case_id, w.gs, r.k, r.t, r.c, r.f, r.l, r.s, r.w, r.n, list_position(list_transform(w.gs, lambda g: {_FITS}), true) as home from walk w join r0 r on r.case_id = w.case_id and r.k = w.k + 1))
select a.case_id, a.t as cluster_type, a.c as cluster_concept, cast(a.home - 1 as int) as merged_id, z.gs[a.home].c as merged_concept, z.gs[a.home].n as merged_members from walk a join (select case_id, arg_max(gs, k) as gs from walk group by 1) z using (case_id) where a.k > 0""")
def cluster_merge(spark, d):
    return states.merged_clusters(states.clusters(V.props(spark, d)))


@query(f"""select case_id, ord, concept_key, status, arg_max(status, ord) filter (status in ('Present', 'Absent')) over (partition by case_id, concept_key) as resolved from {V.STATUSES.sql} s where not (status = 'Unknown' and concept_key <> '' and exists (select 1 from {V.STATUSES.sql} t where t.case_id = s.case_id and t.concept_key = s.concept_key and t.status in ('Present', 'Absent')))""")
def latest_status(spark, d, rows=None):
    return states.latest_status(of(V.STATUSES, spark, rows))


def bundled(spark, d):
    """Features of clusters and those of their propositions, both dealt by case; what turns on texts alone is worked out once for each different one."""
    p = V.props(spark, d)
    n = buckets(spark, p.count())
    p = states.clustered(told(p, states.TEXTS, lambda t: t.withColumns(states.by_text() | bundle_events.by_text("source", "prop_text"))))
    props = bundle_events.features(p.withColumns({
        "status": F.when(F.col("verification") == "refuted", "negated").otherwise("affirmed"), "visit_state": F.col("clinical_status"), "speaker": F.col("source"), "text": F.col("prop_text"),
        "temporality": F.when(F.col("turn_idx") % 3 == 0, "future").otherwise(F.col("temporality")),
    }))
    groups = states.clusters(props, bundle_events.profile()).drop("types", "turns")
    groups = dealt(groups.repartition(n, "case_id"), "clusters", "case_id", n)
    return bundles.features(groups), states.cluster_of(props, groups), n


@query()
def bundle_pairs(spark, d):
    return bundles.pairs(bundled(spark, d)[0])


@query()
def bundle_assignment(spark, d):
    feats, _, n = bundled(spark, d)
    return assigned_of(feats, n)[0]


def assigned_of(feats, n: int):
    """Assignments and the scored pairs they stand on, which lie in n buckets by case."""
    scored = dealt(bundles.pairs(feats).repartition(n, "case_id"), "pairs", "case_id", n)
    return bundles.assignments(feats, scored, bundles.anchors(bundles.decisions(feats, scored), scored, n), n), scored


# events


_ELOW = S.low("prop_text")
_ETYPE = (
    f"case when {S.low('category')} = 'chiefcomplaint' then 'ChiefComplaint' when {S.low('category')} = 'symptom' then 'SymptomCourse' when {S.low('category')} in ('history', 'demographic', 'allergy') then 'PMH' when {S.low('category')} = 'diagnosis' then 'DiagnosisImpression'"
    f" when {S.low('category')} = 'finding' then case when {S.has(_ELOW, events.LAB_WORDS)} then 'TestResult' else 'ExamFinding' end when {S.low('category')} = 'testplan' then 'PlanOrder' when {S.low('category')} = 'followupplan' then case when {S.has(_ELOW, events.WARNING_WORDS)} then 'PatientInstruction' else 'FollowUp' end"
    f" when {S.low('category')} = 'medicationplan' then case when {S.has(_ELOW, events.TAKING_WORDS)} then 'MedicationState' when {S.has(_ELOW, events.CHANGING_WORDS)} then 'MedicationChange' when {S.low('predicate')} in ('instructs', 'recommends') then 'PatientInstruction' when {S.low('predicate')} in ('prescribes', 'plans', 'orders') then 'MedicationChange' else 'MedicationState' end"
    f" when {S.has(_ELOW, events.RETURN_WORDS)} then 'FollowUp' when {S.has(_ELOW, events.ADVICE_WORDS)} then 'PatientInstruction' else 'PMH' end"
)


@query(f"select case_id, ord, e as event_type, coalesce({S.pick('e', events.PRIORITY)}, 'low') as priority, coalesce({S.pick('e', events.SECTIONS)}, 'S,Plan') as sections from (select *, {_ETYPE} as e from {V.FLAT.sql})")
def event_types(spark, d, rows=None):
    e = of(V.FLAT, spark, rows).withColumn("event_type", events.event_type(F.col("category"), F.col("predicate"), F.col("prop_text")))
    return e.select("case_id", "ord", "event_type", events.event_priority(F.col("event_type")).alias("priority"), events.event_sections(F.col("event_type")).alias("sections"))


@query(rf"""select case_id, ord, nullif(regexp_extract(t, '\b(\d+(?:\.\d+)?\s*(?:mg|mcg|g|units|ml))\b', 1), '') as dose, nullif(regexp_extract(t, '\b(once daily|twice daily|twice a day|once a day|daily|nightly|weekly|as needed|every \d+ hours)\b', 1), '') as frequency, nullif(regexp_extract(t, '\b(left|right|bilateral)\b', 1), '') as laterality,
 array_to_string(list_slice(regexp_extract_all(t, '(\d+(?:\.\d+)?%?)', 1), 1, 3), ',') as "values", nullif(regexp_extract(t, '\b(increase|decrease|start|stop|continue|refill|order|refer|monitor|return)\b', 1), '') as action from (select *, {_ELOW} as t from {V.FLAT.sql})""")
def event_slots(spark, d, rows=None):
    return of(V.FLAT, spark, rows).select("case_id", "ord", events.slots(F.col("prop_text")).alias("s")).select("case_id", "ord", "s.*")


_SIDE = f"nullif(regexp_extract({_ELOW}, {S.q(events.SIDE)}, 1), '')"
_EVENT_PLAN = f"""with r as (select case_id, ord, concept, prop_text, e as event_type, concat_ws(' ', coalesce(nullif({S.txt('concept')}, ''), array_to_string(list_slice({S.event_tokens('prop_text', L.EVENT_STOP_WORDS)}, 1, 4), ' ')), {_SIDE}) as signature, nullif(regexp_extract({_ELOW}, {S.q(events.DOSE)}, 1), '') as dose from (select *, {_ETYPE} as e from {V.FLAT.sql})),
g as (select case_id, event_type, signature, min(ord) as first_ord, count(*) as members, count(distinct dose) as doses, arg_min_null(concept, ord) as concept, arg_min_null(prop_text, ord) as title, string_agg('P' || ord, ',' order by ord) as supporting from r group by 1, 2, 3),
n as (select *, row_number() over (partition by case_id order by first_ord, event_type, signature) as n from g), t as (select * replace (case when event_type = 'MedicationState' and doses >= 2 then 'MedicationChange' else event_type end as event_type) from n where n <= 14)
select case_id, 'E' || n as event_id, event_type, concept, title, members, supporting, coalesce({S.pick('event_type', events.PRIORITY)}, 'low') as priority, coalesce({S.pick('event_type', events.SECTIONS)}, 'S,Plan') as sections from t"""


@query(_EVENT_PLAN)
def event_plan(spark, d, rows=None):
    return events.event_plan(of(V.FLAT, spark, rows))


@query("select user_id, \"group\", count(*) as events, sum(value) as total from (select *, cast(sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as \"group\" from (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 3600000000 then 1 else 0 end as n from events)) group by 1, 2")
def gap_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return events.gap_groups(e, ["user_id"], "at", 3_600_000_000, ["event_id"]).groupBy("user_id", "group").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


# scores


@query(f"select case_id, method, count(*) filter (judgment = 'supported') as supported, count(*) filter (judgment = 'partial') as partial, count(*) filter (judgment = 'low_value') as low_value, count(*) filter (judgment = 'missing') as missing, count(*) filter (judgment = 'contradicted') as contradicted, count(*) - count(*) filter (judgment = 'low_value') as denominator, case when count(*) - count(*) filter (judgment = 'low_value') > 0 then (count(*) filter (judgment = 'supported') + 0.5 * count(*) filter (judgment = 'partial')) / (count(*) - count(*) filter (judgment = 'low_value')) else 0.0 end as score from {V.JUDGMENTS.sql} group by 1, 2")
def semantic_support(spark, d, rows=None):
    return metrics.support(of(V.JUDGMENTS, spark, rows), ["case_id", "method"])


_N = "count(*) filter ({})".format


@query("select case_id, " + ", ".join(f"{_N(c)} as {n}" for n, c in {"hallucinations": "kind = 'hallucination'", "major_hallucinations": "kind = 'hallucination' and severity = 'major'", "omissions": "kind = 'omission'", "major_omissions": "kind = 'omission' and severity = 'major'", **{t: f"kind = 'hallucination' and type = '{t}'" for t in ("fabrication", "negation", "contextual", "causality")}, **{t: f"kind = 'omission' and type = '{t}'" for t in ("current_issues", "pmfs_issues", "information_plan")}}.items()) + f" from {V.FINDINGS.sql} group by 1")
def safety_counts(spark, d, rows=None):
    return metrics.safety(of(V.FINDINGS, spark, rows), ["case_id"])


def _mean(names) -> str:
    return "(" + " + ".join(f"cast(case when {n} between 1 and 5 then {n} else 1 end as double)" for n in names) + ")"


_ALL = [n for v in metrics.CHECKLIST.values() for n in v]


@query("select *, " + ", ".join(f"{_mean(v)} / {len(v)} as {k}_mean" for k, v in metrics.CHECKLIST.items()) + f", {_mean(_ALL)} / {len(_ALL)} as abc_mean, cast({_mean(_ALL)} as int) as total, case when lower(trim(coalesce(omission, ''))) = 'yes' then 1 else 0 end as omission_yes, case when lower(trim(coalesce(hallucination, ''))) = 'yes' then 1 else 0 end as hallucination_yes from {V.CHECKS.sql}")
def checklist_means(spark, d, rows=None):
    return metrics.checklist(of(V.CHECKS, spark, rows))


@query("select lang, count(*) as documents, count(quality) as judged, avg(quality) as quality, avg(toxic) as toxic from documents left join labels using (doc_id) group by 1")
def label_rollup(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("judged"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


_GRID = "(select m.*, t.* from (values ('click'), ('view'), ('never')) m(event_type), (values (0), (1)) t(template))"


@query(f"select g.event_type, g.template, count(e.event_id) as n_cases, avg(e.value) as value_mean, stddev_samp(e.value) as value_stdev from {_GRID} g left join events e on e.event_type = g.event_type and e.user_id % 2 = g.template group by 1, 2")
def method_summary(spark, d):
    grid = spark.createDataFrame([("click",), ("view",), ("never",)], "event_type string").crossJoin(spark.createDataFrame([(0,), (1,)], "template int"))
    e = table(spark, d, "events").withColumn("template", (F.col("user_id") % 2).cast("int"))
    return metrics.grid_summary(e, grid, ["event_type", "template"], ["value"])


_VIEW = f"(select case_id, string_agg(line, chr(10) order by line_no) as v from ({ORACLES['subjective_view']}) group by 1)"
_FLAT = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))".format


@query(f"""select case_id, count(*) filter (lower(trim(axis)) = 'omission' and iv) as s_only, count(*) filter (lower(trim(axis)) = 'hallucination' and lower(trim(severity)) = 'major') as major_hallucinations, count(*) filter (lower(trim(axis)) = 'omission' and lower(trim(severity)) = 'major') as major_omissions, count(*) as injections
 from (select i.*, {_FLAT('i.sentence')} <> '' and coalesce(contains({_FLAT('v.v')}, {_FLAT('i.sentence')}), false) as iv from {V.INJECTIONS.sql} i left join {_VIEW} v on v.case_id = i.case_id) group by 1""")
def stress_subsets(spark, d, rows=None, notes=None):
    view = subjective_view(spark, d, notes).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("view"))
    return stress.subsets(stress.visible(of(V.INJECTIONS, spark, rows), view))


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_antijoin(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("select c_custkey, count(*) as cases from customer where c_custkey in (select o_custkey from orders where o_orderkey % 3 = 0) group by 1")
def id_semi_filter(spark, d):
    ids = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(ids, "c_custkey", "left_semi").groupBy("c_custkey").agg(F.count("*").alias("cases"))


@query("select r_name, t.template, m.method from region, (values ('soap'), ('sectioned')) t(template), (values ('direct'), ('event')) m(method)")
def method_grid(spark, d):
    t = spark.createDataFrame([("soap",), ("sectioned",)], "template string")
    return table(spark, d, "region").select("r_name").crossJoin(t).crossJoin(spark.createDataFrame([("direct",), ("event",)], "method string"))


# notes and reports


_REPORT = "coalesce(string_agg('- ' || cluster_id || ' ' || cluster_concept || ' [' || final_verification || ', ' || final_status || '] ' || summary, chr(10) order by first_turn, cluster_id) filter (kind = '{}'), '- None')".format


@query(f"select case_id, 'Active:' || chr(10) || {_REPORT('active')} || chr(10) || 'Planned:' || chr(10) || {_REPORT('planned')} || chr(10) || 'Past:' || chr(10) || {_REPORT('past')} as report from (select *, case when final_status = 'planned' then 'planned' when final_status in ('historical', 'resolved') then 'past' else 'active' end as kind from ({ORACLES['cluster_states']})) group by 1")
def state_reports(spark, d):
    return notes.state_report(states.clusters(V.props(spark, d)))


@query("select conv_id, norm_dups > 0 as repeats from (select conv_id, count(*) filter (times >= 2) as norm_dups from (select conv_id, norm, count(*) as times from (select conv_id, " + S.norm("s") + " as norm from (select conv_id, unnest(string_split(regexp_replace(" + S.txt("text") + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s from conversations)) where norm <> '' group by 1, 2) group by 1) where norm_dups > 0")
def repeated_sentences(spark, d):
    return notes.repeats(table(spark, d, "conversations"), ["conv_id"], "text", 2).withColumn("repeats", F.lit(True))


_STYLE = r"regexp_replace(regexp_replace(trim(x), '^[\s,;:.\-]+', ''), '(?i)^(and|but|so|then)\s+', '')"


@query(rf"""with s as (select conv_id, case role when 'user' then 'S' when 'assistant' then 'P' else 'O' end as section, string_agg('- ' || text, chr(10) order by turn) as lines from conversations group by 1, 2),
n as (select c.conv_id, string_agg(h.section || ':' || chr(10) || coalesce(s.lines, '- None'), chr(10) order by h.place) as note from (select distinct conv_id from conversations) c, (values (0, 'S'), (1, 'O'), (2, 'A'), (3, 'P')) h(place, section) left join s on s.conv_id = c.conv_id and s.section = h.section group by 1),
l as (select conv_id, generate_subscripts(ls, 1) as k, unnest(ls) as line from (select conv_id, list_filter(list_transform(list_transform(string_split(regexp_replace({S.txt('note')}, '^```[A-Za-z]*\s*\n?|\n?\s*```$', '', 'g'), chr(10)), lambda x: {_STYLE}), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), lambda x: x <> '') as ls from n)),
f as (select *, row_number() over (partition by conv_id, {S.norm('line')} order by k) as r from l)
select n.conv_id, coalesce((select string_agg(line, chr(10) order by k) from f where f.conv_id = n.conv_id and r = 1), '') as note, """ + " and ".join(rf"regexp_matches(n.note, '(?m)^\s*{h}:\s*$')" for h in notes.SOAP_HEADINGS) + " as matches from n")
def template_notes(spark, d):
    s = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", "S").when(F.col("role") == "assistant", "P").otherwise("O").alias("section"), F.col("turn").alias("ord"), "text")
    n = notes.template_note(s, ["conv_id"])
    return n.select("conv_id", notes.clean_lines("note").alias("note"), notes.matches_template("note", "soap").alias("matches"))


_MARK = "(?i)\\[(doctor|patient)\\]"


@query(f"""with x as (select case_id, {S.txt('transcript')} as t from {V.TURNS.sql}), p as (select case_id, list_filter(list_filter(list_transform(string_split(case when regexp_matches(t, {S.q(_MARK)}) then regexp_replace(t, {S.q(_MARK)}, chr(1) || '[\\1]', 'g') else replace(t, chr(10), chr(1)) end, chr(1)), lambda z: trim(z)), lambda z: z <> ''), lambda z: trim(regexp_replace(z, {S.q('(?i)^' + _MARK[4:])}, '')) <> '') as ps from x),
r as (select case_id, generate_subscripts(ps, 1) - 1 as turn, unnest(ps) as part from p) select case_id, cast(turn as int) as turn, coalesce(nullif(lower(regexp_extract(part, {S.q('(?i)^' + _MARK[4:])}, 1)), ''), 'unknown') as speaker, trim(regexp_replace(part, {S.q('(?i)^' + _MARK[4:])}, '')) as said from r""")
def marked_turns(spark, d, rows=None):
    return notes.marked_turns(of(V.TURNS, spark, rows), ["case_id"], "transcript")


@query("""select user_id, cast(g as bigint) as "group", min(ts_s) as first_line, count(*) as n from (select *, sum(n) over (partition by user_id order by ts_s, event_id rows unbounded preceding) as g from (select *, case when ts_s - lag(ts_s) over w > 1800 or event_type <> lag(event_type) over w then 1 else 0 end as n from (select *, cast(floor(epoch_us(ts) / 1000000) as bigint) as ts_s from events) window w as (partition by user_id order by ts_s, event_id))) group by 1, 2""")
def entity_groups(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("section"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("line"), F.format_string("%012d", "event_id").alias("entity"))
    g = notes.line_groups(e, ["user_id"], 1800)
    return g.select("user_id", "group", "first_line", F.size(F.split("entities", "; ")).cast("long").alias("n"))


# extraction


@query(f"select id, case {S.norm('kind')} " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in ({n.lower(): n for n in L.SEED_CATEGORIES} | L.SEED_ALIASES).items()) + f" else 'Finding' end as category, case when {S.norm('speaker')} in ('patient', 'pt') then 'patient' when {S.norm('speaker')} in ('clinician', 'doctor', 'provider', 'physician') then 'clinician' else 'unknown' end as speaker, coalesce({S.pick(S.norm('time'), L.SEED_TIMES)}, 'unknown') as temporality, case when {S.norm('raw')} in ('high', 'medium', 'low') then {S.norm('raw')} else 'medium' end as certainty from {V.LABELS.sql}")
def seed_labels(spark, d, rows=None):
    return of(V.LABELS, spark, rows).select("id", extraction.seed_category("kind").alias("category"), extraction.seed_speaker("speaker").alias("speaker"), extraction.seed_temporality("time").alias("temporality"), extraction.seed_certainty("raw").alias("certainty"))


@query(f"select id, substr(regexp_replace(replace(replace(replace(replace({S.txt('raw')}, '–', '-'), '—', '-'), '~', '-'), ' to ', '-'), '[^0-9,\\-]', '', 'g'), 1, 64) as provenance from {V.SPANS.sql}")
def seed_provenance(spark, d, rows=None):
    return of(V.SPANS, spark, rows).select("id", extraction.provenance("raw").alias("provenance"))


_FACT_PREFIXES = ("", "[Chief Complaint] [present] ", "- [x] no ", "[pmh][unknown] ", "* [allergy] ", "[odd] [negated] ", "Patient denies ")
_FACT = rf"""with r as (select conv_id, turn, {S.txt(S.nth(_FACT_PREFIXES, "turn % 7") + " || coalesce(text, '')")} as t from conversations),
f as (select conv_id, turn, lower(trim(regexp_extract(t, '^\s*[-*]?\s*\[([^\]]*)\]', 1))) as c, lower(trim(regexp_extract(t, '^\s*[-*]?\s*\[[^\]]*\]\s*\[([^\]]*)\]', 1))) as hint, trim(regexp_replace(t, '^\s*[-*]?\s*(\[[^\]]*\]\s*){{0,2}}', '')) as fact from r),
s as (select *, lower(fact) as low, case when hint in ('present', 'positive', 'affirmed') then 'Present' when hint in ('absent', 'negative', 'negated') then 'Absent' when hint in ('unknown', 'uncertain', 'unsure') then 'Unknown' when {S.has('lower(fact)', L.UNSURE_WORDS)} then 'Unknown' when starts_with(lower(fact), 'no ') or {S.has("' ' || lower(fact) || ' '", (' denies ', ' denied '))} then 'Absent' else 'Present' end as status from f)
select conv_id, turn, status, coalesce({S.pick('c', L.FACT_CATEGORIES)}, case when {S.has('low', L.SOCIAL_WORDS)} then 'Demographics and Social Determinants of Health' when {S.has('low', L.INTENT_WORDS)} then 'Patient Intent' when {S.has('low', L.PAST_FACT_WORDS)} then 'Medical History' when status = 'Absent' then 'Pertinent Negatives' when status = 'Unknown' then 'Pertinent Unknowns' else 'Pertinent Positives' end) as category, fact from s"""


@query(_FACT)
def fact_lines(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.element_at(F.array(*map(F.lit, _FACT_PREFIXES)), (F.col("turn") % 7 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return c.withColumn("raw", raw).select("conv_id", "turn", extraction.fact_line("raw").alias("f")).select("conv_id", "turn", "f.*")


@query("select p.case_id, p.turns, coalesce(q.props, 0) as props, coalesce(q.high, 0) as high from (select o_custkey as case_id, count(*) as turns from lineitem join orders on l_orderkey = o_orderkey group by 1) p left join (select o_custkey as case_id, count(*) as props, count(*) filter (o_orderkey % 7 = 0) as high from orders where o_orderkey % 3 = 0 group by 1) q using (case_id) where coalesce(props, 0) = 0 or (turns > 20 and props < 8) or (turns > 12 and coalesce(high, 0) = 0)")
def rescue_cases(spark, d):
    o = table(spark, d, "orders")
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"))
    p = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 7 == 0, "Problem").otherwise("Other").alias("prop_type"))
    return extraction.rescue(p, t)


@query(f"""with t as ({ORACLES['turns_parse']}), s as (select case_id, count(*) as turns, bool_or({S.clinical('said')}) or count(*) filter ({S.words('said')} >= 5) >= 3 as signal from t group by 1),
p as (select case_id, bool_or({S.txt('prop_text')} = '' or {S.txt('concept')} = '' or length({S.txt('prop_text')}) > 500) as bad from {V.FLAT.sql} group by 1) select s.case_id, turns, signal, coalesce(bad, signal) as doubtful from s left join p using (case_id)""")
def doubtful_output(spark, d, rows=None, said=None):
    t = turns.turns(of(V.TURNS, spark, said), ["case_id"], "transcript")
    p = of(V.FLAT, spark, rows)
    return extraction.doubtful(p, extraction.turn_signal(t, ["case_id"]), ["case_id"])
