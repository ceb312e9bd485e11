"""Flows of model calls, and objects out of nested answers."""

import json

from pyspark.sql import functions as F

from notewright.operators import flows, walks


def _counting(path):
    """A model that writes down each prompt; it answers well when asked again, and never for what ends in x."""

    def make():
        def ask(prompt):
            with open(path, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            if prompt.startswith("stop"):
                raise RuntimeError("stopped")
            return '{"caps": []}' if "AGAIN" not in prompt or prompt.split()[0].endswith("x") else '{"caps": [{"proposition_text": "t", "canonical_concept": "c", "cap_type": "Problem"}]}'

        return ask

    return make


def _empty(answers):
    n = flows.items(answers, "id").groupBy("id").agg(F.count("*").alias("n"))
    return answers.join(n, "id", "left").select("id", F.col("n").isNull().alias("doubtful"))


def test_a_flow_goes_on_where_it_stopped(spark, tmp_path):
    """Rows that a step answered aren't asked again; new ones are."""
    log, at = tmp_path / "log", str(tmp_path / "state")
    steps = lambda: flows.insisting("prompt", "AGAIN", "MORE", _counting(str(log)))
    rows = spark.createDataFrame([(1, "one"), (2, "twox"), (3, "stop")], "id long, prompt string")
    got = {r["id"]: (r["step"], r["accepted"], r["tries"], len(r["errors"])) for r in flows.asked(rows, steps(), _empty, "id", at).collect()}
    assert got == {1: ("again", True, 2, 0), 2: ("insist", False, 3, 0), 3: (None, False, 3, 3)}
    calls = len(log.read_text().splitlines())
    assert calls == 2 + 3 + 3 * 3  # a failing one is tried three times by the backend
    more = rows.union(spark.createDataFrame([(4, "four")], rows.schema))
    again = {r["id"]: (r["step"], r["accepted"]) for r in flows.asked(more, steps(), _empty, "id", at).collect()}
    assert again == {k: v[:2] for k, v in got.items()} | {4: ("again", True)}
    assert len(log.read_text().splitlines()) == calls + 2


def test_objects_by_kind_and_depth(spark):
    """Limits count in the order of the lists, wherever they stand; what can't be read, scalars and unnamed lists give nothing."""
    deep = {"caps": [{"n": 1, "evidence": [{"n": "a"}, {"n": "b"}]}, 5, {"n": 2, "evidence": [{"n": "c"}]}, {"n": 3}], "of": {"caps": [{"n": 4}], "note": "caps"}, "events": []}
    rows = [(1, json.dumps(deep)), (2, "broken {"), (3, None), (4, '[{"n": 9}]'), (5, "```json\n" + json.dumps({"events": [[{"n": 7}], {"n": 8}]}) + "\n```")]
    df = spark.createDataFrame(rows, "id long, raw string")
    got = sorted((r["id"], r["kind"], r["place"], json.loads(r["item"])["n"]) for r in walks.objects(df, {"caps": 3, "evidence": 2, "events": 5}).collect())
    assert got == [(1, "caps", 0, 1), (1, "caps", 1, 2), (1, "caps", 2, 3), (1, "evidence", 0, "a"), (1, "evidence", 1, "b"), (5, "events", 0, 7), (5, "events", 1, 8)]
    assert walks.objects(df.where("id = 2"), {"caps": 1}).count() == 0 and walks.objects(df.limit(0), {"caps": 1}).count() == 0
    assert [r["n"] for r in walks.objects(df, {"caps": 3}, depth=2).select(F.get_json_object("item", "$.n").alias("n")).collect()] == ["1", "2", "3"]
