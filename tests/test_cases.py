"""Cases matched whole in a task, against the pairs over all tasks."""

import random

from pyspark.sql import functions as F

from notewright.operators import align
from notewright.sources import stage


def _rows(spark, x, seed, n=60):
    rng = random.Random(seed)
    words = ["pain", "pains", "knee", "left", "the", "", "Hot  bolt", "studies"]
    say = lambda k: rng.choice([None, " ".join(rng.choice(words) for _ in range(k))])
    return spark.createDataFrame([(k % 4, k, rng.choice([None, "A", "B"]), say(2), say(5)) for k in range(n)], f"case_id long, {x} int, c_type string, c_concept string, prop_text string")


def _struct(df):
    return df.withColumn("p", F.struct(F.col("c_concept").alias("canonical_concept"), F.col("prop_text").alias("proposition_text"), *(F.col("c_type").alias(f) for f in align.BONUS))).select("case_id", *[c for c in df.columns if c in "ij"], "p")


def test_matches_do_not_turn_on_where_a_case_is_scored(spark, monkeypatch):
    a, b = _rows(spark, "i", 1), _rows(spark, "j", 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(align.benchmark_matches(a, b)), rows(align.proposition_alignment(_struct(a), _struct(b)))
    assert whole[0] == rows(align.greedy(align.benchmark_pairs(a, b))) and len(whole[0]) > 10 and len(whole[1]) > 5
    monkeypatch.setattr(align, "WHOLE", 0)
    assert whole == (rows(align.benchmark_matches(a, b)), rows(align.proposition_alignment(_struct(a), _struct(b))))


def test_small_cases_write_no_pairs(spark):
    before = len(stage.WRITTEN)
    assert align.benchmark_matches(_rows(spark, "i", 1), _rows(spark, "j", 2)).count()
    assert not [x for x in stage.WRITTEN[before:] if "stage-pairs" in x]


def test_kindred_concepts_of_short_lists_and_by_grams(spark, monkeypatch):
    from notewright.operators import states

    names = ["knee", "knee pain", "left knee pain", "ee", "hot", "shot", ""]
    df = spark.createDataFrame([(c, t, n) for c in (1, None) for t in ("P", "Q") for n in names[: 7 if t == "P" else 2]], "case_id long, cluster_type string, cluster_concept string")
    rows = lambda: sorted((str(r[0]), r[1], r[2], sorted(r[3])) for r in states.holding(df.where("case_id = 1")).collect())
    lists = rows()
    assert lists and "_met" in dir(states)
    monkeypatch.setattr(states, "COMPARED", 0)
    assert rows() == lists


def test_words_are_counted_once_for_evidence(spark):
    from notewright.functions import text as T
    from notewright.operators import evidence

    df = spark.createDataFrame([("a b a", "a a a c"), ("", "x"), ("b a", "a b"), (None, None)], "x string, y string")
    both = F.size(F.array_intersect(evidence.counted(T.tokens("x")), evidence.counted(T.tokens("y"))))
    assert [r[0] for r in df.select(both).collect()] == [2, 0, 2, 0]


def test_bundle_pairs_write_no_clusters(spark):
    from notewright.plans import catalog

    before = len(stage.WRITTEN)
    catalog.bundle_pairs(spark, "/root/testdata/sf0.001")
    path = next(x for x in stage.WRITTEN[before:] if "stage-pairs" in x)
    assert not [f.name for f in spark.read.parquet(path).schema if "struct" in f.dataType.simpleString()]
