"""Distributed connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def stars(u, v) -> tuple[np.ndarray, np.ndarray]:
    """The components of these edges by union-find: each node but the smallest of its component, and that smallest."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:  # hooking of each root under the smallest neighbouring root, then pointer jumping
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _local(batches, most: int = 1_000_000):
    """Replaces a task's edges by stars of the same components, at most `most` edges at a time."""
    held, n = [], 0

    def out():
        u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n > most:
            yield (made := out())
            held, n = [], 0
    if held:
        yield out()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v), longs: root is the smallest node that links reach.

    Each task first contracts its own edges to stars; then large-star and small-star steps alternate, each
    round's edges written to the shared folder, until a round changes nothing. A hub's edges are never
    gathered: its smallest neighbour is found with partial aggregation and joined back. Loops and repeated
    edges do no harm; no edges give no rows.
    """

    spark, paths = edges.sparkSession, []

    def write(df):
        """df in the shared folder, in place of the round before."""
        paths.append(write_table(df, "edges"))
        out = spark.read.schema(df.schema).parquet(paths[-1])
        if len(paths) > 1:
            drop_table(spark, paths.pop(0))
        return out, out.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(k), "u", "v") % 1_000_000_007) for k in range(2))).first()

    now, was = write(edges.where("u <> v").mapInArrow(_local, "u long, v long").distinct())
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge now goes from a larger to a smaller node: u > v
        large = large.where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        joined = large.join(low, large["u"] == low["k"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m")).where("u <> v")
        now, got = write(small.distinct())
        if got == was:
            break
        was = got
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())
