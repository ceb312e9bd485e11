"""Propositions dealt by case."""

import datetime

import pytest
from pyspark.sql import functions as F

from notewright.operators import states
from notewright.plans import fixtures as V
from notewright.sources import stage


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Orders that occur twice, lines that differ in their price alone, nulls and negative keys."""
    day = datetime.datetime(1995, 1, 1)
    line = lambda o, n, p, s, price: (o, p, s, n, 1.0, price, 0.0, 0.0, ("A", "R", "N", None)[(n or 0) % 4], ("O", "F", None)[(n or 0) % 3], day)
    lines = [line(o, *x) for o in (1, 2, 103) for x in ((1, 5, 3, 9.0), (1, 5, 3, 7.0), (2, 20, None, 1.0), (3, 5, -3, 1.0), (None, 20, 27, 1.0))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (2, 8), (103, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "hot bolt", "LARGE", 3), (20, "cold ring", None, 4)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_propositions_are_those_of_the_sql(spark, odd_tables):
    got = V.props(spark, odd_tables)
    for t in ("lineitem", "orders", "part"):
        spark.read.parquet(f"{odd_tables}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(V.PROPS)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() == 20
    stage.clean(spark)


def test_groups_of_a_case_move_no_rows(spark, odd_tables):
    p = V.props(spark, odd_tables)
    plan = states.cluster_of(p, states.clusters(p))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    stage.clean(spark)


def test_texts_of_bundles_are_worked_out_once_and_pairs_move_no_rows(spark, monkeypatch):
    """Features stand on the different texts alone, and pairs are joined in the buckets that clusters lie in."""
    from notewright.operators import bundles
    from notewright.plans import catalog

    seen, of = [], bundles._by_text
    monkeypatch.setattr(bundles, "_by_text", lambda texts: seen.append(texts.columns) or of(texts))
    feats, _, n = catalog.bundled(spark, "/root/testdata/sf0.001")
    assert seen == [["cluster_concept", "summary"]] and n >= 1
    plan = bundles.pairs(feats)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(case_id" not in plan and "regexp_replace" not in plan and "array_intersect" in plan
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, "b", 3), ("a", "b", 4)], "x string, y string, k int")
    from notewright.sources.stage import told

    got = told(rows, ["x", "y"], lambda t: t.withColumn("z", F.concat_ws("-", "x", "y")))
    assert sorted((r["k"], r["z"]) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "a-b")] and got.columns == ["x", "y", "k", "z"]


def test_shared_tokens_count_repeats(spark):
    """Numbers of tokens tell a second word of a kind from the first, so they share what token_f1 counts."""
    from notewright.functions.text import alignment_tokens, overlap
    from notewright.operators import bundles

    texts = [("pain pain knee", "knee pain knee"), ("pain", "pain pain pain"), ("", "mg"), ("knees", "pain of the knee, pain")]
    d = bundles._by_text(spark.createDataFrame(texts, "cluster_concept string, summary string")).withColumn("toks", alignment_tokens(F.concat_ws(" ", "cluster_concept", "summary")))
    both = d.select(F.struct("text_numbers", "toks").alias("a")).crossJoin(d.select(F.struct("text_numbers", "toks").alias("b")))
    got = both.select(F.size(F.array_intersect("a.text_numbers", "b.text_numbers")).alias("n"), overlap(F.col("a.toks"), F.col("b.toks")).alias("want")).collect()
    assert len(got) == 16 and all(r["n"] == r["want"] for r in got) and max(r["n"] for r in got) == 6


def test_assignments_of_dealt_pairs_move_none(spark):
    """Pairs that lie in buckets by case are read where they lie, with the same assignments as from plain tables."""
    from notewright.operators import bundles
    from notewright.plans import catalog

    feats, _, n = catalog.bundled(spark, "/root/testdata/sf0.001")
    got, scored = catalog.assigned_of(feats, n)
    assert "Exchange" not in scored.groupBy("case_id", "a").count()._jdf.queryExecution().executedPlan().toString()
    plain = bundles.pairs(feats)
    want = bundles.assignments(feats, plain, bundles.anchors(bundles.decisions(feats, plain), plain))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) != []
    stage.clean(spark)
