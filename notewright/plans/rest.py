"""Queries of note sections, messages, chunks and scores over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import terms as W
from ..functions import text as T
from ..operators import align, extraction, judging, metrics, notes, units
from . import sql as S
from .catalog import ORACLES, query, table
from .inferred import nth

_N = "(conv_id * 31 + turn)"


def _k() -> Column:
    return F.col("conv_id") * 31 + F.col("turn")


# sections

_LEADS = ("", "Here is the clinical note:\n\nBelow is a summary,\n - ", "```text\nThe patient reports ", "* and  the patient denies ", "; THE PATIENT'S ", "S: The doctor recommends ", "**S**\n- the patient is ", "the patient can")


def _tidy(c: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(regexp_replace({S.txt(c)}, '^[,;:]+\\s*', ''), '(?i)^(?:and|but|also)\\s+', ''), '\\s+', ' ', 'g'))"
    return f"(upper({t}[1]) || {t}[2:])"


_OPENED = "case " + " ".join(f"when regexp_matches(line, {S.q(lead)}) then regexp_replace(line, {S.q(lead)}, {S.q(instead)})" for lead, instead in ((rf"(?i)^\s*{w}\s+", i) for w, i in W.OPENERS)) + " else line end"
_RAW = f"{S.nth(_LEADS, _N + ' % 8')} || coalesce(text, '') || case when turn % 3 = 0 then chr(10) || '- ' || coalesce(text, '') else '' end"
_UNFENCED = f"case when starts_with(raw, '```') then regexp_replace(regexp_replace(raw, '(?i)^```(?:text|markdown)?\\s*', ''), '\\s*```$', '') else raw end"
_BARE = f"regexp_replace({_UNFENCED}, {S.q('(?i)^(?:[ \\t]*(?:' + '|'.join(W.PREAMBLES) + ')[ \\t]*(?:\\n|$)\\s*)+')}, '')"


@query(f"""with i as (select conv_id, turn, {S.txt(_RAW)} as raw from conversations), b as (select conv_id, turn, {S.txt(_BARE)} as t from i),
h as (select conv_id, turn, string_split(regexp_replace(regexp_replace(t, '(?m)^[ \\t]*\\*\\*(.+?)\\*\\*[ \\t]*$', '\\1', 'g'), '(?i)^\\s*S\\s*:?\\s*', ''), chr(10)) as ls from b),
l as (select conv_id, turn, generate_subscripts(ls, 1) as k, unnest(list_transform(ls, lambda x: regexp_replace(x, '^\\s*[*\\-•]+\\s*', ''))) as x from h),
d as (select conv_id, turn, k, {_tidy('x')} as line from l), n as (select *, {S.norm('line')} as norm from d where {S.norm('line')} <> ''),
f as (select * from n qualify row_number() over (partition by conv_id, norm order by turn, k) = 1), o as (select *, row_number() over (partition by conv_id order by turn, k) as place from f),
s as (select *, case when place = 1 then line else {_OPENED} end as said from o)
select conv_id, count(s.conv_id) as lines, coalesce(string_agg({_tidy('said')}, chr(10) order by place), '') as section from (select distinct conv_id from conversations) c left join s using (conv_id) group by 1""")
def section_texts(spark, d):
    """A section of each conversation: turns as items, with fences, preambles, bullets, headings, repeats and openers."""
    raw = F.concat(nth(_LEADS, _k() % 8), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n- "), F.coalesce("text", F.lit("")))).otherwise(""))
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", raw.alias("raw")))), lambda x: x["raw"])
    c = table(spark, d, "conversations").groupBy("conv_id").agg(items.alias("items")).withColumn("section", notes.section_text(F.col("items"), "S"))
    return c.select("conv_id", F.when(F.col("section") == "", F.lit(0)).otherwise(F.size(F.split("section", "\n"))).cast("long").alias("lines"), "section")


# messages

@query(f"""select conv_id, turn, case {_N} % 5 when 0 then a || ' ' || b when 1 then a || chr(10) || b when 2 then a when 3 then '' end as said from (select *, coalesce({S.toks('text')}[1], 'x') as a, coalesce({S.toks('text')}[2], 'x') as b from conversations)""")
def message_texts(spark, d):
    """Messages of several shapes: a text, parts, parts without texts, no content, no choices."""
    w = lambda k: F.coalesce(F.get(T.tokens("text"), F.lit(k)), F.lit("x"))
    shapes = ('{"choices": [{"message": {"content": "  %1$s %2$s\\n"}}]}', '{"choices": [{"message": {"content": [{"text": "%1$s"}, 5, {"text": ""}, "%2$s"]}}]}', '{"choices": [{"message": {"content": [{"kind": "x"}, {"text": "%1$s"}]}}]}', '{"choices": [{"message": {"content": null}}]}', '{"choices": [], "x": "%1$s"}')
    raw = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        raw = F.when(_k() % 5 == k, F.format_string(shape, w(0), w(1))).otherwise(raw)
    return table(spark, d, "conversations").select("conv_id", "turn", judging.message_text(raw).alias("said"))


@query(f"""select conv_id, turn, coalesce(translate(text || '“–”', '‘’“”–—', '''''""--'), '') as plain, case when {S.low("text")} = '' then 'missing' else case {_N} % 4 when 0 then 'supported' when 1 then 'partial' when 2 then 'low_value' else 'missing' end end as judgment from conversations""")
def judgment_labels(spark, d):
    """Judges' labels by their aliases, and plain quotes."""
    said = F.when(T.safe_text("text") == "", "").otherwise(nth(("Supported", "Partially  supported", "LOW-value", "odd"), _k() % 4))
    label = N.judgment(said, ("supported", "partial", "low_value", "missing"), {"partially_supported": "partial"}, "missing")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(T.plain_quotes(F.concat("text", F.lit("“–”"))), F.lit("")).alias("plain"), label.alias("judgment"))


# chunks and sets

@query("select conv_id, chunk, ord, row_number() over (partition by conv_id order by chunk, ord) as place, role from (select conv_id, case role when 'user' then 0 when 'assistant' then 1 else 2 end as chunk, turn as ord, role from conversations)")
def ordered_chunks(spark, d):
    """Chunks of each conversation (by role) one after the other."""
    c = table(spark, d, "conversations").withColumn("ord", F.col("turn"))
    parts = [c.where(f).select("conv_id", "ord", "role") for f in ("role = 'user'", "role = 'assistant'", "role is null or role not in ('user', 'assistant')")]
    out = units.ordered_union(*parts)
    return out.select("conv_id", "chunk", "ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("place")).alias("place"), "role")


@query("select conv_id, turn, role from conversations where role in ('user', 'assistant') and turn % 2 = 0 and (conv_id, turn) not in (select conv_id, turn from conversations where turn % 4 = 0)")
def unmatched_turns(spark, d):
    """Turns of one side that no match has."""
    c = table(spark, d, "conversations").withColumnRenamed("turn", "i")
    rows = c.where("role in ('user', 'assistant') and i % 2 = 0").select("conv_id", "i", "role")
    return align.unmatched(rows, c.where("i % 4 = 0").select("conv_id", "i"), "i", "conv_id").withColumnRenamed("i", "turn")


@query("""with n as (select user_id, event_type, count(*) filter (event_id % 3 = 0) as pred_n, count(*) filter (event_id % 5 = 0) as gold_n, count(*) filter (event_id % 15 = 0) as both_n from events group by 1, 2),
f as (select *, case when both_n = 0 then 0.0 else 2 * (both_n / pred_n) * (both_n / gold_n) / (both_n / pred_n + both_n / gold_n) end as f1 from n) select user_id, coalesce(avg(f1) filter (pred_n > 0 or gold_n > 0), 0.0) as macro_f1 from f group by 1""")
def category_macro_f1(spark, d):
    """Mean F1 of a user's categories that have an event on either side."""
    n = lambda k: F.count_if(F.col("event_id") % k == 0)
    per = align.prf(table(spark, d, "events").groupBy("user_id", "event_type").agg(n(3).alias("pred_n"), n(5).alias("gold_n"), n(15).alias("both_n")), "both_n", "pred_n", "gold_n")
    return extraction.macro_f1(per, ["user_id"])


@query("select event_id, case when event_id % 7 = 0 then 0.0 else least(greatest((event_id % 31) / 10.0 - 1, 0.0), 1.0) end as score, cast((event_id % 2 = 0)::int + (event_id % 6 = 0)::int as int) as major, cast((event_id % 3 = 0)::int as int) as minor from events")
def section_scores(spark, d):
    """Section judgments: scores within 0 and 1, issues by severity."""
    e = F.col("event_id")
    issue = lambda k, s: F.when(e % k == 0, F.lit(s))
    rows = table(spark, d, "events").select("event_id", F.when(e % 7 != 0, (e % 31) / 10.0 - 1).alias("score"), F.array_compact(F.array(issue(2, "major"), issue(3, "minor"), issue(6, "major"), issue(5, "none"))).alias("issues"))
    return metrics.section_score(rows).select("event_id", "score", "major", "minor")


@query("select conv_id, turn, 'E' || conv_id || ': {\"turn\":' || turn || case when role is not null and turn % 2 = 0 then ',\"role\":\"' || role || '\"' else '' end || '}' as line, 'c' || conv_id || '_t' || turn as stem from conversations")
def indexed_lines(spark, d):
    """Records as indexed JSON lines, and stems of output names."""
    role = F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role")
    return table(spark, d, "conversations").select("conv_id", "turn", units.indexed_json(F.concat(F.lit("E"), "conv_id"), "turn", role).alias("line"), units.output_stem(F.concat(F.lit("c"), "conv_id"), F.concat(F.lit("t"), "turn")).alias("stem"))


# longest common subsequences, token by token of one side

ORACLES["rouge_l_adjacent"] = f"""with recursive p as (select conv_id, turn, {S.toks('a')} as x, {S.toks('b')} as y from (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations) where b is not null),
walk as (select conv_id, turn, 0 as i, list_transform(range(0, len(y) + 1), lambda j: cast(0 as bigint)) as r from p
 union all
 select w.conv_id, w.turn, w.i + 1, list_reduce(list_transform(range(1, len(p.y) + 1), lambda j: [j]), lambda acc, j: list_append(acc, case when p.x[w.i + 1] = p.y[j[1]] then w.r[j[1]] + 1 else greatest(w.r[j[1] + 1], acc[len(acc)]) end), [cast(0 as bigint)])
 from walk w join p using (conv_id, turn) where w.i < len(p.x)),
n as (select p.conv_id, p.turn, len(x) as nx, len(y) as ny, w.r[len(w.r)] as l from p join walk w on w.conv_id = p.conv_id and w.turn = p.turn and w.i = len(p.x))
select conv_id, turn, round(case when nx = 0 or ny = 0 or l = 0 then 0.0 else 2 * (l / nx) * (l / ny) / (l / nx + l / ny) end, 4) as rouge_l from n"""
