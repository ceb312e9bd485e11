"""What stands around a model's call: choice of prompts, answers that are tried again or mended, judgments brought to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions.normalize import lookup
from ..functions.text import safe_text
from .audit import aligned_reasons, label_ids
from .backend import Backend, generate, stub
from .propositions import json_text

#: Scores that show that a case was evaluated. Fixed values.
EVALUATED = ("cap_precision", "cap_recall", "cap_f1", "semantic_cap_precision", "semantic_cap_recall", "semantic_cap_f1", "hallucination_count", "pdsqi_core_mean", "llm_checklist_mean")
AXES = ("hallucination", "omission")


def choices(values: Iterable[str], supported: Iterable[str], label: str, aliases: Mapping[str, str] | None = None) -> list[str]:
    """Canonical names in their order, each once; an error for an unknown one or for none."""
    known, out = set(supported), []
    for value in values:
        key = str(value).strip()
        if key not in known:
            raise ValueError(f"Unsupported {label}: {value}")
        if (name := (aliases or {}).get(key, key)) not in out:
            out.append(name)
    if not out:
        raise ValueError(f"No {label} selected.")
    return out


def axes(values: Iterable[str] | None) -> list[str]:
    """The axes of an audit, in lower case, each once; all of them if none is named."""
    named = [v for x in values or () if (v := str(x).strip().lower())]
    return choices(named, AXES, "axis") if named else list(AXES)


def endpoint(explicit: str | None, provider: str, urls: Mapping[str, str]) -> str:
    """The address given, or that of the provider (quotes and a comment after # go)."""
    if explicit:
        return explicit.rstrip("/")
    name = provider.split("#", 1)[0].strip().strip("'\"").strip().lower()
    if name not in urls:
        raise RuntimeError(f"Unsupported provider: {name}")
    return urls[name].rstrip("/")


class Prompts:
    """Prompt templates by (method, kind); what a method lacks comes from its alias, then from the default."""

    def __init__(self, templates: Mapping[tuple[str, str], str], aliases: Mapping[str, str] | None = None, default: str = "default"):
        self.templates, self.aliases, self.default = dict(templates), dict(aliases or {}), default

    def get(self, method: str, kind: str) -> str:
        for name in (method, self.aliases.get(method), self.default):
            if (name, kind) in self.templates:
                return self.templates[name, kind]
        raise KeyError((method, kind))

    def methods(self) -> list[str]:
        return list(dict.fromkeys(m for m, _ in self.templates))

    def column(self, method: str, kind: str, /, **fields) -> Column:
        """The template with its {fields} out of columns."""
        out = F.lit(self.get(method, kind))
        for name, c in fields.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
        return out


def laddered(ask: Callable[[str, str | None], str], formats: Sequence[str | None]) -> Backend:
    """A backend that asks with one response format after the other until one is taken; the last error is raised."""

    def run(prompt: str) -> str:
        for k, f in enumerate(formats):
            try:
                return ask(prompt, f)
            except Exception:
                if k == len(formats) - 1:
                    raise
        raise ValueError("no format")

    return run


def until_enough(ask: Callable[[str, float], str], count: Callable[[str], int], least: int, tries: int = 3, step: float = 0.1, warmest: float = 0.3) -> Backend:
    """A backend that asks again, warmer each time, while an answer has fewer than `least` items; the best answer stays."""

    def run(prompt: str) -> str:
        best, most = "", -1
        for k in range(tries):
            answer = ask(prompt, min(warmest, k * step))
            if (n := count(answer)) > most:
                best, most = answer, n
            if n >= least:
                break
        return best

    return run


def bounded(df: DataFrame, workers: int) -> DataFrame:
    """At most so many tasks at once."""
    return df.repartition(max(1, workers))


def answered(df: DataFrame, make: Callable[[], Backend] = stub, *, key: str = "case_id", prompt: str = "prompt", repair: Callable[[], Backend] | None = None, repair_prompt: str = "Return this as valid JSON only:\n") -> DataFrame:
    """(key, json, status, error): each prompt's answer as JSON text. What can't be read is sent to `repair` once, and then is an error."""
    out = generate(df, make, key=key, prompt=prompt).withColumn("json", json_text(F.col("response")))
    ok = F.try_parse_json("json").isNotNull()
    if repair is not None:
        broken = out.where(~ok & F.col("response").isNotNull()).select(key, F.concat(F.lit(repair_prompt), "response").alias(prompt))
        mended = generate(broken, repair, key=key, prompt=prompt).select(key, json_text(F.col("response")).alias("mended"))
        out = out.join(mended, key, "left").withColumn("json", F.when(ok, F.col("json")).otherwise(F.coalesce("mended", "json"))).drop("mended")
    read = F.try_parse_json("json").isNotNull()
    return out.select(key, F.when(read, F.col("json")).alias("json"), F.when(read, "ok").otherwise("error").alias("status"), F.when(~read, F.coalesce("error", F.lit("no JSON"))).otherwise("").alias("error"))


def missing_ids(judged: DataFrame, events: DataFrame, prefix: str, *, ranked: str, reasons: str, verdict: str = "missingmajor") -> DataFrame:
    """(case_id, n): numbers of the events that a judge names: by its ranked list, else by verdicts, else by the reasons; only those there are.

    judged: (case_id, json) with the ranked ids, "event_verifications" (event_id, verdict) and the reasons.
    """
    v = F.try_parse_json("json")
    texts = lambda path: F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
    told = F.coalesce(F.try_variant_get(v, "$.event_verifications", "array<struct<event_id:string,verdict:string>>"), F.array().cast("array<struct<event_id:string,verdict:string>>"))
    by_verdict = F.transform(F.filter(told, lambda x: F.lower(F.trim(x["verdict"])) == verdict), lambda x: x["event_id"])
    by_reason = F.transform(texts(f"$.{reasons}"), lambda r: F.regexp_extract(r, f"(?i)\\b({prefix}\\d+)\\b", 1))
    lists = [label_ids(c, prefix) for c in (texts(f"$.{ranked}"), by_verdict, by_reason)]
    found = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists[:-1]), lists[-1])
    return judged.select("case_id", F.explode(found).alias("n")).select("case_id", F.col("n").cast("long").alias("n")).distinct().join(events.select("case_id", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long").alias("n")), ["case_id", "n"], "left_semi")


def findings(judged: DataFrame, events: DataFrame, prefix: str, *, ranked: str = "ranked_missing_major_event_ids", reasons: str = "omission_reasons") -> DataFrame:
    """(case_id, n, event_id, event_type, text, reason, place): the events a judge finds missing or unsupported, by rank, each with its reason."""
    ids = missing_ids(judged, events, prefix, ranked=ranked, reasons=reasons)
    said = judged.select("case_id", F.posexplode(F.coalesce(F.try_variant_get(F.try_parse_json("json"), f"$.{reasons}", "array<string>"), F.array().cast("array<string>"))).alias("ord", "reason"))
    aligned = aligned_reasons(ids.select("case_id", F.col("n").alias("id")), said, prefix).withColumnRenamed("id", "n")
    rows = events.withColumn("n", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long")).join(aligned, ["case_id", "n"])
    level = F.when(F.col("clinical_priority") == "high", 3).when(F.col("clinical_priority") == "medium", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(level.desc(), (F.col("severity") == "major").desc(), F.coalesce(lookup(W.EVENT_RANKS, F.col("event_type")), F.lit(0)).desc(), "n"))
    return rows.withColumn("place", place).select("case_id", "n", "event_id", "event_type", "text", "reason", "place")


def detected(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: count, ids by rank, the first and the first three; cases without a finding have none."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"])
    per = found.groupBy("case_id").agg(F.count("*").alias("total"), ids.alias("ids"))
    out = cases.select("case_id").distinct().join(per, "case_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "ids": F.coalesce("ids", F.array().cast("array<string>"))})
    return out.withColumns({"top1": F.slice("ids", 1, 1), "top3": F.slice("ids", 1, 3)})


def evaluated(df: DataFrame) -> Column:
    """Whether a row has any score of an evaluation."""
    out = F.lit(False)
    for c in EVALUATED:
        if c in df.columns:
            out = out | F.col(c).isNotNull()
    return out


def uses_bundles(slots: Column) -> Column:
    """Whether any of the events' key slots (an array of maps) tells of problem bundles."""
    return F.coalesce(F.exists(slots, lambda s: safe_text(F.try_element_at(s, F.lit("bundle_design"))) == "problem_oriented_note_bundle"), F.lit(False))


def as_text(c: Column) -> Column:
    """An output as JSON text, a string as it is."""
    return F.to_json(c)


def message_text(c: Column) -> Column:
    """The text of a model's message (JSON): its content, or the texts of the parts of its content, by line; null without choices."""
    v = F.try_parse_json(c)
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    kind = F.coalesce(F.schema_of_variant(content), F.lit("VOID"))
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.when(F.schema_of_variant(p).startswith("OBJECT"), F.nullif(F.try_variant_get(p, "$.text", "string"), F.lit(""))).when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))
    said = F.when(kind.startswith("ARRAY"), F.array_join(F.array_compact(parts), "\n")).when(kind == "VOID", "").otherwise(F.try_variant_get(content, "$", "string"))
    return F.when(F.try_variant_get(v, "$.choices[0]", "variant").isNotNull(), safe_text(said))
