"""Pieces of SQL for the oracles (DuckDB)."""

from __future__ import annotations

from ..functions import lexicon as L


def q(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def txt(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def toks(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda t: t <> '')"


def align(c: str) -> str:
    stop = ", ".join(map(q, L.ALIGNMENT_STOP_WORDS))
    return f"list_transform(list_filter({toks(c)}, lambda t: t not in ({stop})), lambda t: case when length(t) > 4 and t like '%ies' then t[:-4] || 'y' when length(t) > 4 and t like '%s' and t not like '%ss' then t[:-2] else t end)"


def shared(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda t: least(len(list_filter({a}, lambda x: x = t)), len(list_filter({b}, lambda x: x = t))))), 0)"


def f1(a: str, b: str) -> str:
    s = f"cast({shared(a, b)} as double)"
    return f"case when len({a}) = 0 or len({b}) = 0 or {s} = 0 then 0.0 else 2 * ({s} / len({a})) * ({s} / len({b})) / ({s} / len({a}) + {s} / len({b})) end"


def has(c: str, parts) -> str:
    return "(" + " or ".join(f"contains({c}, {q(p)})" for p in parts) + ")"


def inside(c: str, values) -> str:
    return f"{c} in ({', '.join(map(q, values))})"


def pick(c: str, table: dict) -> str:
    return f"case {c} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + " end"


def low(c: str) -> str:
    return f"lower({txt(c)})"


def question(c: str) -> str:
    return "(" + f"contains({low(c)}, '?') or " + " or ".join(f"starts_with({low(c)}, {q(x)})" for x in L.QUESTION_OPENERS) + ")"


def clinical(c: str) -> str:
    return has(low(c), L.CLINICAL_SIGNS)


def chatter(c: str) -> str:
    t = low(c)
    return f"({t} = '' or case when {has(t, L.CHATTER)} then not {clinical(c)} else {inside(t, L.SHORT_CHATTER)} or ({has(t, L.FOOD_CHATTER)} and not {clinical(c)}) end)"


def plan_like(c: str) -> str:
    return f"(regexp_matches({low(c)}, {q(L.PLAN_VERBS)}) or contains({low(c)}, 'plan'))"


def plan_type(c: str) -> str:
    return f"case when {has(low(c), L.FOLLOW_UP_WORDS)} then 'FollowUp' when {has(low(c), L.COUNSEL_WORDS)} then 'Counseling' when {has(low(c), L.MEDICATION_WORDS)} then 'MedicationRequest' else 'Order' end"


def words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({txt(c)}, '\\s+'), lambda t: t <> ''))"


def low_value(concept: str, text: str, kind: str) -> str:
    c, t = norm(concept), norm(text)
    return (
        f"({c} = '' or {t} = '' or {chatter(t)} or {inside(c, L.LOW_VALUE_CONCEPTS)} or ({inside(kind, ('Problem', 'Symptom', 'ProblemHistory', 'ChiefComplaint'))} and {has(c, L.FOOD_CONCEPTS)})"
        f" or ({has(t, L.SMALL_TALK)} and not {clinical(t)}) or {has(t, L.LOW_VALUE_TEXTS)} or {words(t)} < 3)"
    )


def protected(concept: str, kind: str) -> str:
    c = norm(concept)
    return f"({inside(kind, L.PROTECTED_TYPES)} and {c} <> '' and not {inside(c, L.LOW_VALUE_CONCEPTS)} and not {has(c, L.FOOD_CONCEPTS)})"


def bucket(c: str) -> str:
    t = norm(c)
    year = f"try_cast(nullif(regexp_extract({t}, '\\b((19|20)\\d{{2}})\\b', 1), '') as int)"
    return (
        f"case when {t} = '' then 'unknown' when {has(t, L.FUTURE_WORDS)} then 'future' when {has(t, L.CURRENT_WORDS)} then 'current' when {has(t, L.PAST_WORDS)} then 'past'"
        f" when {year} < {L.CURRENT_YEAR} then 'past' when {year} > {L.CURRENT_YEAR} then 'future' when {year} = {L.CURRENT_YEAR} then 'current' else 'unknown' end"
    )


def greedy(pairs: str) -> str:
    """Steps through each case's pairs by falling (score, i, j): rows (case_id, i, j, score) of those taken."""
    return f"""with recursive pairs as ({pairs}),
ranked as (select *, row_number() over (partition by case_id order by score desc, i desc, j desc) as k from pairs),
walk as (select case_id, cast(0 as bigint) as k, cast([] as bigint[]) as ui, cast([] as bigint[]) as uj, false as taken, cast(null as bigint) as i, cast(null as bigint) as j, cast(null as double) as score from (select distinct case_id from pairs)
 union all
 select w.case_id, r.k, case when not list_contains(w.ui, r.i) and not list_contains(w.uj, r.j) then list_append(w.ui, r.i) else w.ui end, case when not list_contains(w.ui, r.i) and not list_contains(w.uj, r.j) then list_append(w.uj, r.j) else w.uj end,
        not list_contains(w.ui, r.i) and not list_contains(w.uj, r.j), r.i, r.j, r.score from walk w join ranked r on r.case_id = w.case_id and r.k = w.k + 1)"""


def first_hit(c: str, words) -> str:
    return "case " + " ".join(f"when contains({c}, {q(w)}) then {q(w)}" for w in words) + " end"


def hits(c: str, words, n: int) -> str:
    return "list_slice(list_filter([" + ", ".join(f"case when contains({c}, {q(w)}) then {q(w)} end" for w in words) + f"], lambda x: x is not null), 1, {n})"


def nth(values, n: str) -> str:
    """The value at place n (from 0) of a list of fixed ones."""
    return "[" + ", ".join(map(q, values)) + f"][cast({n} as bigint) + 1]"


def event_tokens(c: str, stop) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\b\\d+(?:\\.\\d+)?\\b', ' ', 'g'), '[^a-z0-9%/+\\-]+', ' ', 'g'), ' '), lambda t: length(t) > 2 and t not in ({', '.join(map(q, stop))}))"


def audit_key(c: str, stop) -> str:
    toks = event_tokens(c, stop)
    return f"case when len({toks}) > 0 then array_to_string(list_slice({toks}, 1, 5), ' ') else substr(trim(regexp_replace(lower({txt(c)}), '\\s+', ' ', 'g')), 1, 80) end"
