"""Scans with places, choice of format, and the metric sink."""

import glob
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notewright.sources import readers, writers


def test_scan_names_path_and_line(spark, tmp_path):
    """Over many splits of several files, with blank and broken lines."""
    good = [f'{{"id": {k}, "text": "{"x" * (k % 40)}"}}' for k in range(400)]
    for name, at in (("a", None), ("b", 137)):
        lines = list(good)
        lines[5] = "   "
        if at is not None:
            lines[at] = '{"id": 9, "text'
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.scan_jsonl(spark, str(tmp_path), "id long, text string", strict=False)
        assert got.rdd.getNumPartitions() > 4
        rows = [(r["file"].rsplit("/", 1)[1], r["line"], r["id"], r["bad"]) for r in got.collect()]
        want = [(f"{n}.jsonl", k + 1, None if (n, k) == ("b", 137) else k, (n, k) == ("b", 137)) for n in "ab" for k in range(400) if k != 5]
        assert sorted(rows, key=str) == sorted(want, key=str)
        with pytest.raises(PySparkException, match=r"b\.jsonl:138: not a JSON object"):
            readers.scan_jsonl(spark, str(tmp_path), "id long, text string").collect()
        assert readers.scan_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, text string").agg(F.sum("id")).first()[0] == sum(range(400)) - 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_chooses_the_format(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"uid": "u", "id": "i", "summary_gt_note": "s"}\n')
    (tmp_path / "x.csv").write_text('case_id,summary_draft\nc,"two\nlines"\n')
    (tmp_path / "odd").write_text('\n {"file": "f", "summary": "z"}\n')
    (tmp_path / "plain").write_text("encounter_id,note\ne,n\n")
    (tmp_path / "none.jsonl").write_text("\n")
    got = lambda n: [tuple(r) for r in readers.load(spark, str(tmp_path / n)).select("file", *(["summary"] if n != "plain" else [])).collect()]
    assert got("x.jsonl") == [("i", "s")] and got("x.csv") == [("c", "two\nlines")] and got("odd") == [("f", "z")] and got("plain") == [("e",)]
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "none.jsonl"))


def test_keyed_lists_drop_blank_cases(spark):
    df = spark.createDataFrame([("a", " ", "r1"), (" ", "x", "r2"), (None, "x", "r3"), ("b", "x", None), ("c", None, None)], "case_id string, annotator string, rater string")
    assert sorted((r["case_id"], r["annotator"]) for r in readers.keyed(df).collect()) == [("a", "r1"), ("b", "x"), ("c", "unknown")]
    assert readers.keyed(df.select("case_id")).first()["annotator"] == "unknown"


def test_metrics_are_replaced_by_case(spark, tmp_path):
    """One pass over the rows; a second run of one case changes its part alone, and the summary."""
    fields = ["case_id", "score", "drawn"]
    at = str(tmp_path / "m")
    rows = spark.createDataFrame([(f"c{k}", float(k), "left out") for k in range(200)], "case_id string, score double, more string").withColumn("drawn", F.rand())
    summarize = lambda df: df.agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    writers.flush_metrics(rows, at, fields, summarize)
    table = {r["case_id"]: r["drawn"] for r in spark.read.parquet(f"{at}/case_metrics.parquet").collect()}
    lines = {r["case_id"]: r["drawn"] for r in spark.read.json(f"{at}/case_metrics.jsonl").collect()}
    cells = {r["case_id"]: float(r["drawn"]) for r in spark.read.option("header", True).csv(f"{at}/case_metrics.csv").collect()}
    assert len(table) == 200 and table == lines and all(abs(cells[k] - v) < 1e-9 for k, v in table.items())
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/case_metrics.*/part=*/part-*")}
    before = files()
    writers.flush_metrics(spark.createDataFrame([("c7", -1.0)], "case_id string, score double"), at, fields, summarize)
    after = files()
    parts = lambda x: {os.path.basename(os.path.dirname(f)) for f in x}
    assert len(parts(set(before) ^ set(after))) == 1
    got = {r["case_id"]: (r["score"], r["drawn"]) for r in spark.read.parquet(f"{at}/case_metrics.parquet").collect()}
    assert got["c7"] == (-1.0, None) and {k: v[1] for k, v in got.items() if k != "c7"} == {k: v for k, v in table.items() if k != "c7"}
    assert [tuple(r) for r in spark.read.json(f"{at}/aggregate_metrics.json").select("n", "score").collect()] == [(200, sum(range(200)) - 8.0)]


def test_what_is_derived_once_is_derived_again_after_cleaning(spark):
    from notewright.sources import stage

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert stage.once(spark, "x", "a", make).count() == stage.once(spark, "x", "a", make).count() == 3 and len(made) == 1
    stage.clean(spark)
    assert stage.once(spark, "x", "a", make).count() == 3 and len(made) == 2


def test_derivation_keeps_one_step_on_the_disks(spark, monkeypatch):
    """What the joins of the propositions give is written step by step, and gone once the table of the cases stands."""
    import os

    from notewright.plans import fixtures
    from notewright.sources import stage

    steps, staged = [], stage.staged
    monkeypatch.setattr(fixtures, "staged", lambda df, name, *a: (steps.append(name), staged(df, name, *a))[1])
    before = set(stage.WRITTEN)
    out = fixtures._derived(spark, "/root/testdata/sf0.001")
    left = [p for p in stage.WRITTEN if p not in before]
    assert steps == ["lines", "of_parts"] and len(left) == 1 and "stage-props" in left[0]
    assert not [f for f in os.listdir(os.path.dirname(left[0].removeprefix("file:"))) if "stage-lines" in f or "stage-of_parts" in f]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
