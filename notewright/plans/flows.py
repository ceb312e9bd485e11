"""Queries of scans by line, walks of nested objects and flows of model calls, over whole tables. Answers come from functions of the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions import text as T
from ..operators import extraction, flows, judging, walks
from ..sources import readers
from ..sources.stage import new_path
from . import sql as S
from .catalog import query, table

# lines

_LINES = 4


@query(f"""with l as (select *, conv_id % {_LINES} as shard, (conv_id * 31 + turn) % 9 as form from conversations), n as (select *, row_number() over (partition by shard order by conv_id, turn) as line from l)
select shard, line, form in (4, 7) as bad, case when form not in (4, 7) then conv_id end as conv_id, case when form not in (4, 7) then turn end as turn, case when form not in (4, 7) then role end as role from n where form <> 2""")
def scan_lines(spark, d):
    """Turns written as JSON lines, some blank or broken, and read with their places."""
    c = table(spark, d, "conversations").withColumns({"shard": F.col("conv_id") % _LINES, "form": (F.col("conv_id") * 31 + F.col("turn")) % 9})
    said = F.to_json(F.struct("conv_id", "turn", "role"))
    value = F.when(F.col("form") == 2, F.lit("  ")).when(F.col("form") == 4, F.concat(F.substring(said, 1, 12))).when(F.col("form") == 7, F.lit("no json")).otherwise(said)
    lines = c.select("shard", "conv_id", "turn", value.alias("value")).repartition(_LINES, "shard").sortWithinPartitions("shard", "conv_id", "turn")
    at = new_path(spark, "lines")
    lines.select("shard", "value").write.partitionBy("shard").text(at)
    found = readers.scan_jsonl(spark, f"{at}/*", "conv_id long, turn long, role string", strict=False)
    return found.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("long").alias("shard"), "line", "bad", "conv_id", "turn", "role")


# nested objects

_W = lambda k: f"coalesce({S.toks('text')}[{k}], 'x')"
_LIMITS = {"caps": 2, "evidence": 3, "events": 1}


@query(f"""with c as (select conv_id * 100000 + turn as id, conv_id, turn, {_W(1)} as a, {_W(2)} as b, {_W(3)} as c from conversations where turn % 5 <> 4),
caps as (select id, unnest([0, 1, 2]) as place, a, b, c, turn from c), kept as (select * from caps where place <= turn % 4)
select id, 'caps' as kind, cast(place as int) as place, [a, b, c][place + 1] as w from kept where place < 2
union all select id, 'evidence', cast(row_number() over (partition by id order by place, k) - 1 as int), w from (select id, place, k, [a, b][k + 1] as w from (select *, unnest([0, 1]) as k from kept)) qualify row_number() over (partition by id order by place, k) <= 3
union all select id, 'events', 0, c from c""")
def object_walk(spark, d):
    """Propositions, their evidence and events of nested answers made of each turn's words; the limits are of each kind in an answer."""
    w = lambda k: F.coalesce(F.get(T.tokens("text"), F.lit(k)), F.lit("x"))
    word = lambda c: F.struct(c.alias("w"))
    cap = lambda k: F.struct(w(k).alias("w"), F.array(word(w(0)), word(w(1))).alias("evidence"))
    caps = F.slice(F.array(cap(0), cap(1), cap(2)), 1, (F.col("turn") % 4 + 1).cast("int"))
    answer = F.to_json(F.struct(F.struct(caps.alias("caps"), F.lit("caps").alias("note")).alias("of"), F.array(word(w(2)), word(w(0))).alias("events"), F.array(F.lit("caps")).alias("other")))
    raw = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("none: "), F.substring(answer, 1, 9))).otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), raw.alias("raw"))
    return walks.objects(rows, _LIMITS).select("id", "kind", F.col("place").cast("int").alias("place"), F.get_json_object("item", "$.w").alias("w"))


# extraction

GOOD, NONE = '{"caps": [{"cap_type": "Problem", "canonical_concept": "c", "proposition_text": "t"}]}', '{"caps": []}'


def _model():
    """Answers by the number that ends a prompt's first line: at once, when asked again, when asked for more, broken, in the old form alone, never."""

    def ask(prompt: str) -> str:
        kind = int(prompt.split("\n")[0].rsplit("#", 1)[1])
        again, more, legacy = "AGAIN" in prompt, "MORE" in prompt, prompt.startswith("legacy")
        if kind == 2 and not more:
            raise RuntimeError("no answer")
        if kind == 3:
            return "{broken"
        good = kind in (0, 2) or (kind == 1 and again) or (kind == 4 and legacy)
        return GOOD if good else NONE

    return ask


def _mender():
    """Mends every broken answer."""
    return lambda prompt: GOOD


def _rescuer():
    return lambda prompt: '{"caps": [{"cap_type": "Order", "canonical_concept": "d", "proposition_text": "u"}, {"cap_type": "Order", "canonical_concept": "e", "proposition_text": "v"}]}'


_SIGNALS = f"(select conv_id * 10 + turn // 4 as chunk_id, conv_id as case_id, bool_or({S.clinical('text')}) or count(*) filter ({S.words('text')} >= 5) >= 3 as signal from conversations group by 1, 2)"


@query(f"""with s as (select *, (case_id * 7 + chunk_id % 10) % 6 as k from {_SIGNALS}),
o as (select *, case when k = 2 then 'insist' when k in (0, 3) or not signal then 'ask' when k = 1 then 'again' else 'legacy' end as step, not (k = 5 and signal) as accepted, case when k = 2 then 3 when k in (0, 3) or not signal then 1 when k = 1 then 2 else 4 end as tries, case when k = 2 then 2 else 0 end as failures,
 case when k in (0, 2, 3) or (signal and k in (1, 4)) then 1 else 0 end as props from s),
thin as (select case_id from o group by 1 having sum(props) = 0)
select chunk_id, case_id, case when t.case_id is null then step else 'rescue' end as step, t.case_id is not null or accepted as accepted, cast(case when t.case_id is null then tries else 1 end as bigint) as tries, cast(case when t.case_id is null then failures else 0 end as int) as failures, cast(case when t.case_id is null then props else 2 end as bigint) as props, t.case_id is not null as rescued from o left join thin t using (case_id)""")
def extraction_flow(spark, d):
    """Extraction of chunks of four turns: ask, ask again, insist, the old form; then a rescue of cases without a proposition."""
    c = table(spark, d, "conversations").withColumns({"chunk_id": F.col("conv_id") * 10 + F.floor(F.col("turn") / 4), "case_id": F.col("conv_id")})
    signals = extraction.turn_signal(c, ["chunk_id"], "text")
    kind = (F.col("case_id") * 7 + F.col("chunk_id") % 10) % 6
    chunks = c.select("chunk_id", "case_id").distinct().withColumns({"prompt": F.concat(F.lit("chunk #"), kind), "old": F.concat(F.lit("legacy #"), kind)})

    def doubtful(answers: DataFrame) -> DataFrame:
        return extraction.doubtful(flows.items(answers, "chunk_id"), signals.join(answers, "chunk_id", "left_semi"), ["chunk_id"]).select("chunk_id", "doubtful")

    steps = flows.insisting("prompt", "AGAIN", "MORE", _model, _mender, lambda: F.col("old"))
    out = flows.extracted(chunks, steps, [flows.Step("rescue", lambda: F.col("prompt"), _rescuer)], c.select("case_id"), doubtful)
    n = flows.items(out, "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("props"))
    return out.join(n, "chunk_id", "left").select("chunk_id", "case_id", "step", "accepted", "tries", F.size("errors").alias("failures"), F.coalesce("props", F.lit(0)).alias("props"), "rescued")


# audits

_ETYPES, _ELEVELS = (*W.EVENT_RANKS, "Other"), ("high", "medium", "low", "")
#: Judges' answers: a ranking with ids that there are none of, verdicts, reasons alone, nothing that can be read.
_ANSWERS = (
    '{"ranked_missing_major_event_ids": ["te3", "TE1", "TE99", "S2", "TE3"], "omission_reasons": ["TE1: said", "other"]}',
    '{"event_verifications": [{"event_id": "TE0", "verdict": " MissingMajor"}, {"event_id": "TE2", "verdict": "Present"}, {"event_id": "TE1", "verdict": "missingmajor"}], "omission_reasons": []}',
    'fine: {"omission_reasons": ["TE2 is missing", "nothing else", "see TE0"]}', "broken",
)
_DEFAULT = ": clinically important unsupported/missing event detected."


@query(f"""with e as (select conv_id as case_id, turn as n, {S.nth(_ETYPES, f'turn % {len(_ETYPES)}')} as event_type, {S.nth(_ELEVELS, '(conv_id + turn) % 4')} as level, case when turn % 2 = 0 then 'major' else 'minor' end as severity from conversations),
said as (select * from (values (0, 1, 'TE1: said'), (0, 3, 'other'), (1, 0, 'TE0{_DEFAULT}'), (1, 1, 'TE1{_DEFAULT}'), (2, 2, 'TE2 is missing'), (2, 0, 'see TE0')) v(form, n, reason)),
f as (select e.*, said.reason from e join said on said.n = e.n and said.form = e.case_id % 4)
select case_id, cast(n as bigint) as n, 'TE' || n as event_id, event_type, reason, cast(row_number() over (partition by case_id order by case level when 'high' then 3 when 'medium' then 2 else 1 end desc, severity = 'major' desc, coalesce(try_cast({S.pick('event_type', W.EVENT_RANKS)} as int), 0) desc, n) as int) as place from f""")
def audit_findings(spark, d):
    """Events of each conversation that a judge's answer names, by rank and with reasons; its ranking counts, else its verdicts, else its reasons."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    events = c.select(
        "case_id", F.concat(F.lit("TE"), "turn").alias("event_id"), pick(_ETYPES, F.col("turn") % len(_ETYPES)).alias("event_type"), pick(_ELEVELS, (F.col("case_id") + F.col("turn")) % 4).alias("clinical_priority"),
        F.when(F.col("turn") % 2 == 0, "major").otherwise("minor").alias("severity"), F.col("text"),
    )
    prompts = c.select("case_id").distinct().withColumn("prompt", F.concat(F.lit("form "), F.col("case_id") % 4))
    judged = judging.answered(prompts, lambda: lambda p: _ANSWERS[int(p.split()[1])])
    return judging.findings(judged, events, "TE").select("case_id", "n", "event_id", "event_type", "reason", F.col("place").cast("int").alias("place"))
