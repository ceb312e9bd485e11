"""Source divergence audit: how the term distributions of a language's sources differ, with ranks by radix selection."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER, as_bytes, cut, free_memory, partitions, write_table

#: Runs of anything but ASCII characters that aren't letters, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
ONE = 1_000_000_000
#: A table of one row for each group is broadcast up to so many rows (under 100 bytes each).
SMALL = 500_000
_DOC = 1 << 40


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (key, source, n, d) of (lang, source, text): a task's occurrences of a term and its documents. A key is a language, a zero byte and a term."""

    def run(batches):
        counts: dict = defaultdict(Counter)

        def out():
            for (lang, source), c in counts.items():
                lead, terms = lang.encode() + b"\0", sorted(c)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    both = np.array([c[t] for t in some], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lead + t for t in some], pa.binary()).cast(pa.string()), pa.array([source] * len(some), pa.string()), pa.array(both % _DOC), pa.array(both // _DOC)], names=["key", "source", "n", "d"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if text:
                    c = counts[lang, source]
                    for t, n in Counter(TERM.findall(text.translate(LOWER))).items():
                        c[t] += n + _DOC
            if sum(map(len, counts.values())) > 2_000_000:
                yield from out()
        yield from out()
        free_memory()

    return docs.mapInArrow(run, "key string, source string, n long, d long")


def share(n, total, terms):
    """1 + floor(1e9 (n + 1) / (total + terms)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.when(terms > 0, 1 + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * big(n + 1), big(total + terms)))


def gap(p, q):
    """floor((p - q)^2 / q); both are at most 1e9 + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shared_terms(rows: DataFrame) -> DataFrame:
    """Rows (g, h, value): over the terms that both groups have, what the value of a pair differs by from taking either one's share as that of an absent term.

    rows: (row, gid, p, p0), a term's rows next to each other in a task. Pairs are summed in arrays, never emitted one by one."""

    def corrections(row, gid, p, p0):
        """Codes of pairs and their values, some million at a time."""
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sizes = np.diff(np.append(begins, len(row)))
        for m in np.unique(sizes[sizes > 1]).tolist():
            at = begins[sizes == m]
            step, width = max(1, 2_000_000 // (m * m)), max(1, 2_000_000 // m)
            for a in range(0, len(at), step):
                i = at[a : a + step, None] + np.arange(m)
                for b in range(0, m, width):
                    j = i[:, b : b + width]
                    P, Q, P0, Q0 = p[j][:, :, None], p[i][:, None, :], p0[j][:, :, None], p0[i][:, None, :]
                    value = _gap(P, Q) - _gap(P, Q0) - _gap(P0, Q) + _gap(P0, Q0)
                    g, h = np.broadcast_to(gid[j][:, :, None], value.shape), np.broadcast_to(gid[i][:, None, :], value.shape)
                    other = g != h
                    yield g[other], h[other], value[other]

    def run(batches):
        held = np.zeros((4, 0), np.int64)
        sums: dict[tuple[int, int], int] = {}

        def add(block):
            for g, h, value in corrections(*block):
                order = np.lexsort((h, g))
                g, h, value = g[order], h[order], value[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])) if len(g) else np.zeros(0, np.int64)
                if len(first):
                    for x, y, v in zip(g[first].tolist(), h[first].tolist(), np.add.reduceat(value, first).tolist()):
                        sums[x, y] = sums.get((x, y), 0) + v
                if len(sums) > 500_000:
                    yield out()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["g", "h", "value"])
            sums.clear()
            return batch

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(4)])], 1)
            if held.shape[1] > 200_000:
                changes = np.flatnonzero(held[0, 1:] != held[0, :-1])
                if len(changes):  # the last term may go on
                    last = int(changes[-1]) + 1
                    yield from add(held[:, :last])
                    held = held[:, last:]
        if held.shape[1]:
            yield from add(held)
        yield out()
        free_memory()

    return rows.mapInArrow(run, "g long, h long, value long")


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, *, bits: int = 16, slack: int = 1000) -> DataFrame:
    """The k rows of each group with the highest value (long, not negative), ties to the smaller item by UTF-8 bytes.

    Round by round, each group's histogram over the next `bits` bits of the values that can still hold its kth one tells the bucket
    it lies in. Where more rows than `slack` share the kth value itself, further rounds go by two bytes of the item after what
    all of them begin with. Only rows above the bucket, and those in it, are ranked in the end: at most k + slack for a group.
    Items of a group should differ; of equal rows any stays. The histograms are counted in tasks before they are shuffled, and a
    group's state is one row.
    """
    spark = rows.sparkSession
    n_groups = rows.select(*group).distinct().count()
    top = rows.agg(F.max(value)).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(0))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    names = [F.col(g).alias(f"_{g}") for g in group]
    shift = -(-max(int(top).bit_length(), 1) // bits) * bits
    state = cut(rows.select(*group).distinct().select(*names, F.lit(0).cast("long").alias("_high"), F.lit(k).cast("long").alias("_need"), F.lit(1 << 62).alias("_size")), "radix")

    def joined(state):
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return rows.join(small(state, n_groups), cond)

    def chosen(active: DataFrame, digit, order):
        """Of each group, the digit whose bucket holds the row still needed, what is needed of it, and its size."""
        hist = active.withColumn("_digit", digit).groupBy(*[f"_{g}" for g in group], *keep, "_need", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*[f"_{g}" for g in group]).orderBy(order)
        hist = hist.withColumn("_sum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*[f"_{g}" for g in group])))
        return hist.where((F.col("_sum") - F.col("_n") < F.least("_need", "_all")) & (F.col("_sum") >= F.least("_need", "_all")))

    keep = ["_high"]
    while shift > 0:
        shift -= bits
        active = joined(state)
        if shift + bits < 64:  # shifts count modulo 64; in the first round all rows are active
            active = active.where(F.shiftright(value, shift + bits) == F.col("_high"))
        got = chosen(active, F.shiftright(value, shift).bitwiseAND((1 << bits) - 1), F.desc("_digit"))
        state = cut(got.select(*[f"_{g}" for g in group], (F.col("_high") * (1 << bits) + F.col("_digit")).alias("_high"), (F.col("_need") - F.col("_sum") + F.col("_n")).alias("_need"), F.col("_n").alias("_size")), "radix")
        if not state.where(F.col("_size") > F.greatest(F.lit(slack), F.col("_need"))).take(1):
            break
    high = F.shiftright(value, shift)
    if shift == 0 and state.where(F.col("_size") > F.greatest(F.lit(slack), F.col("_need"))).take(1):
        # equal values: bytes of the items
        bytes_ = F.col(item).cast("binary")
        state = cut(state.withColumn("_lead", F.lit(b"")), "radix")
        keep = ["_high", "_lead"]
        while True:
            within = (high == F.col("_high")) & (F.substring(bytes_, F.lit(1), F.length("_lead")) == F.col("_lead"))
            open_ = state.where(F.col("_size") > F.greatest(F.lit(slack), F.col("_need")))
            if not open_.take(1):
                break
            ends = joined(open_).where(within).groupBy(*[f"_{g}" for g in group], "_high", "_need", "_size").agg(F.min(bytes_).alias("_a"), F.max(bytes_).alias("_b"))
            ends = cut(ends.select(*[f"_{g}" for g in group], "_high", "_need", "_size", _common("_a", "_b").alias("_lead")), "radix")
            got = chosen(joined(ends).where(within), F.hex(F.substring(bytes_, F.length("_lead") + 1, F.lit(2))), F.asc("_digit"))
            moved = got.select(*[f"_{g}" for g in group], "_high", (F.col("_need") - F.col("_sum") + F.col("_n")).alias("_need"), F.col("_n").alias("_size"), F.concat("_lead", F.unhex("_digit")).alias("_lead"))
            # a lead that is the whole item stands for that one
            state = cut(state.where(F.col("_size") <= F.greatest(F.lit(slack), F.col("_need"))).unionByName(moved), "radix")
        inside = (high > F.col("_high")) | ((high == F.col("_high")) & ((bytes_ < F.col("_lead")) | (F.substring(bytes_, F.lit(1), F.length("_lead")) == F.col("_lead"))))
    else:
        inside = high >= F.col("_high")
    order = Window.partitionBy(*group).orderBy(F.desc(value), F.col(item).asc())
    return joined(state).where(inside).select(*rows.columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@F.pandas_udf(T.BinaryType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """What both begin with; a row for each group."""

    def one(x: bytes, y: bytes) -> bytes:
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return bytes(x[:k])

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, bits: int = 16, slack: int = 1000) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): of each source its distance to each other one of its language, and its most typical terms.

    Null texts, languages and sources are empty. Terms are TERM's matches with A-Z lower-cased; a language keeps those of min_docs of
    its documents or more (V of them). A group's share of a term is p = 1 + floor(1e9 (count + 1) / (N + V)), and against a share q
    the term has floor((p - q)^2 / q). Part 'pair' sums that over all kept terms for each other source. Part 'term': kept
    terms the group has and that have a greater share in it than in the language, the first `top`.

    Sums over all terms start from the value of a term that neither group has, times V; each group's histogram of counts corrects
    it for the terms it has, and the terms that two groups share correct both (`shared_terms`). So work follows the terms that
    occur, not V times the pairs. Repeated rows count again; ids are not read; an empty table gives no rows; texts are
    read one at a time.
    """
    spark = docs.sparkSession
    ready = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    by_term = term_counts(ready).repartition(partitions(spark), "key").groupBy("key", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    packed = by_term.groupBy("key").agg(F.sum("d").alias("d"), F.sum("n").alias("c"), F.collect_list(F.struct("source", "n")).alias("of")).where(F.col("d") >= min_docs)
    cut_at = F.expr("length(key) - locate('\\0', reverse(key))")
    kept_at = write_table(packed.select(F.substring("key", F.lit(1), cut_at).alias("lang"), F.substring("key", cut_at + 2, F.length("key")).alias("term"), "c", "of"), "kept")
    kept = spark.read.schema("lang string, term string, c long, of array<struct<source: string, n: long>>").parquet(kept_at)
    # numbered before rows are taken apart
    flat = kept.withColumn("row", F.monotonically_increasing_id()).select("lang", "c", "term", "row", F.explode("of").alias("x")).select("lang", "c", "term", "row", "x.source", "x.n")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("lang_total"))
    sums = cut(flat.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")), "histogram")
    own = sums.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    groups = ready.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    stats = cut(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))).withColumn("gid", F.monotonically_increasing_id()), "groups")
    n_groups = stats.count()

    # part term
    shares = flat.join(small(stats, n_groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    q = share(F.col("c"), F.col("lang_total"), F.col("terms"))
    typical = cut(shares.withColumn("q", q).where(F.col("p") > F.col("q")).select("gid", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")), "typical")
    best = radix_top(typical, ["gid"], "value", "item", top, bits=bits, slack=slack).join(small(stats.select("gid", "lang", "source"), n_groups), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # part pair
    told = shares.select("row", "gid", "p", "p0")
    if n_groups > SMALL:
        told = told.repartition(partitions(spark), "row").sortWithinPartitions("row")
    both = shared_terms(told)
    a = stats.where("terms > 0").select("lang", F.col("gid").alias("g"), F.col("p0").alias("pa"), "terms")
    b = stats.where("terms > 0").select("lang", F.col("gid").alias("h"), F.col("p0").alias("pb"))
    other = F.col("g") != F.col("h")
    absent = gap(F.col("pa"), F.col("pb"))
    neither = a.join(small(b, n_groups), "lang").where(other).select("g", "h", (F.col("terms") * absent).alias("value"))
    hist = sums.join(small(stats, n_groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).select("lang", "gid", "p", "p0", "times")
    first = hist.select("lang", F.col("gid").alias("g"), "p", F.col("p0").alias("pa"), "times").join(small(b, n_groups), "lang").where(other).select("g", "h", (F.col("times") * (gap(F.col("p"), F.col("pb")) - absent)).alias("value"))
    second = hist.select("lang", F.col("gid").alias("h"), "p", F.col("p0").alias("pb"), "times").join(small(a, n_groups), "lang").where(other).select("g", "h", (F.col("times") * (gap(F.col("pa"), F.col("p")) - absent)).alias("value"))
    values = neither.unionByName(first).unionByName(second).unionByName(both).groupBy("g", "h").agg(F.sum("value").alias("value"))
    names = stats.select("lang", "source", F.col("gid").alias("g"))
    # groups of a language without terms have pairs, too
    pairs = names.join(small(stats.select("lang", F.col("source").alias("item"), F.col("gid").alias("h")), n_groups), "lang").where(other)
    valued = pairs.join(values, ["g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).unionByName(best)
