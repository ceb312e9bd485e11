"""Flows of model calls: steps that each ask only for what no step before them answered well, so that a run can stop and go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import resume
from ..sources.stage import staged
from ..sources.writers import _read
from .backend import Backend, stub
from .extraction import rescue
from .judging import answered
from .propositions import payload


@dataclass(frozen=True)
class Step:
    """One way to ask: its prompt out of a row's columns, and its backend; a legacy step asks in another form."""

    name: str
    prompt: Callable[[], Column]
    backend: Callable[[], Backend] = stub
    repair: Callable[[], Backend] | None = None


def insisting(prompt: str, suffix: str, more: str, backend: Callable[[], Backend], repair: Callable[[], Backend] | None = None, legacy: Callable[[], Column] | None = None) -> list[Step]:
    """The usual steps: ask, ask again with a suffix, ask with more, and, where there is one, the legacy prompt."""
    at = lambda *parts: lambda: F.concat_ws("\n\n", F.col(prompt), *(F.lit(x) for x in parts))
    steps = [Step("ask", at(), backend, repair), Step("again", at(suffix), backend, repair), Step("insist", at(f"{suffix}\n{more}"), backend, repair)]
    return steps + ([Step("legacy", legacy, backend, repair)] if legacy else [])


def asked(rows: DataFrame, steps: Sequence[Step], doubtful: Callable[[DataFrame], DataFrame], key: str, path: str | None = None) -> DataFrame:
    """(key, json, step, accepted, tries, errors): what each row's steps came to.

    doubtful: from (key, json) of read answers, (key, doubtful). The first answer that isn't doubtful is accepted and ends a row's steps; else
    the last that could be read stays. Every step's answers are written before the next step, under `path` if given: a run that
    finds them there asks only for rows that are missing.
    """
    left, tried = rows, []
    for n, step in enumerate(steps):
        todo = left.withColumn("ask__", step.prompt()).select(key, F.col("ask__").alias("prompt"))
        if path is None:
            got = staged(answered(todo, step.backend, key=key, repair=step.repair), step.name)
        else:
            at = f"{path.rstrip('/')}/{n:02d}-{step.name}"
            done = _read(rows.sparkSession, at)
            answered(todo if done is None else resume(todo, done, [key]), step.backend, key=key, repair=step.repair).write.mode("append").parquet(at)
            got = rows.sparkSession.read.parquet(at).join(left.select(key), key, "left_semi")
        judged = doubtful(got.where("status = 'ok'").select(key, "json"))
        got = staged(got.join(judged, key, "left").withColumns({"accepted": (F.col("status") == "ok") & ~F.coalesce("doubtful", F.lit(True)), "n": F.lit(n), "step": F.lit(step.name)}), step.name)
        tried.append(got)
        left = staged(left.join(got.where("accepted").select(key), key, "left_anti"), "left")
        if left.isEmpty():
            break
    every = tried[0]
    for t in tried[1:]:
        every = every.unionByName(t)
    last = F.max_by(F.struct("json", "step"), F.when(F.col("status") == "ok", F.col("n")))
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.struct("n", F.concat_ws(": ", "step", "error").alias("e"))))), lambda x: x["e"])
    per = every.groupBy(key).agg(last.alias("l"), F.max("accepted").alias("accepted"), F.count("*").alias("tries"), errors.alias("errors"))
    return per.select(key, "l.json", "l.step", "accepted", "tries", "errors")


def items(answers: DataFrame, key: str) -> DataFrame:
    """(key, pos, prop_type, concept, prop_text) of answers that hold lists of propositions."""
    item = lambda *names: F.coalesce(*(F.get_json_object("item", f"$.{n}") for n in names))
    return payload(answers.withColumnRenamed("json", "raw")).select(key, "pos", item("cap_type", "category").alias("prop_type"), item("canonical_concept").alias("concept"), item("proposition_text").alias("prop_text"))


def extracted(chunks: DataFrame, steps: Sequence[Step], rescuing: Sequence[Step], turns: DataFrame, doubtful: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """(chunk_id, case_id, json, step, accepted, tries, errors, rescued): extraction of all chunks, and once more of cases whose output is too thin.

    chunks: (chunk_id, case_id, prompt, ...); turns: a row for each turn of a case. Cases to rescue are told by all their chunks
    together (extraction.rescue); the rescue's answers stand where they hold more propositions than the first ones.
    """
    part = lambda name: None if path is None else f"{path.rstrip('/')}/{name}"
    names = chunks.select("chunk_id", "case_id")
    first = staged(asked(chunks, steps, doubtful, "chunk_id", part("first")).join(names, "chunk_id"), "first")
    thin = staged(rescue(items(first, "chunk_id").join(names, "chunk_id"), turns).select("case_id"), "thin")
    again = chunks.join(thin, "case_id", "left_semi")
    if again.isEmpty():
        return first.withColumn("rescued", F.lit(False))
    second = staged(asked(again, rescuing, doubtful, "chunk_id", part("rescue")).join(names, "chunk_id"), "second")
    n = lambda df, name: items(df, "chunk_id").groupBy("chunk_id").agg(F.count("*").alias(name)).join(names, "chunk_id").groupBy("case_id").agg(F.sum(name).alias(name))
    better = n(second, "now").join(n(first, "then"), "case_id", "left").where("now > coalesce(then, 0)").select("case_id")
    better = staged(better, "better")
    kept = first.join(better, "case_id", "left_anti").withColumn("rescued", F.lit(False))
    return kept.unionByName(second.join(better, "case_id", "left_semi").withColumn("rescued", F.lit(True)))
