"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .graph import components, stars

#: A bucket of more rows is cut into blocks; every two of them meet in a task of their own.
BLOCK = 8192
#: Buckets hold about so many rows where vectors lie evenly; hyperplanes follow the number of rows.
BUCKET = 512
#: Products in single precision are off by less; nearer ones to the threshold are worked out in double.
MARGIN = 1e-5


def units(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of components: which vectors of it have a direction, and these as unit vectors in double precision."""
    sizes: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        if v is not None and len(v) and all(x is not None for x in v):
            sizes.setdefault(len(v), []).append(k)
    out = {}
    for n, where in sizes.items():
        where, m = np.array(where), np.array([vectors[k] for k in where], np.float64)
        finite = np.isfinite(m).all(1)
        where, m = where[finite], m[finite]
        scale = np.abs(m).max(1, initial=0)  # first to a largest component of 1: no overflow
        where, m = where[scale > 0], m[scale > 0] / scale[scale > 0, None]
        out[n] = where, m / np.sqrt((m * m).sum(1, keepdims=True))
    return out


def plan(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Hyperplanes a table and tables, so that buckets hold about BUCKET of so many rows and a pair at the cosine is found with this probability."""
    bits = int(min(30, max(4, np.ceil(np.log2(max(1, rows / BUCKET))))))
    one = (1 - np.arccos(min(1.0, cosine)) / np.pi) ** bits
    return bits, int(max(1, np.ceil(np.log(1 - recall) / np.log(1 - min(one, 1 - 1e-12)))))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.998, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Vectors in one bucket of one of the tables are compared exactly, in single precision and, near the threshold, in
    double. At cosine c two vectors agree on a hyperplane's side with 1 - arccos(c)/pi; `recall` is the probability
    with which a pair just at the threshold meets in a table, closer ones with more. A pair that meets in several
    tables counts in the first. Equal vectors are one node with their number as weight. A bucket of more than BLOCK
    nodes is dealt to the pairs of its blocks, and a task returns a row for each of its vectors, not for each pair.
    Vectors of different numbers of components don't link; those without a direction (null, zero, with null or non-finite
    components) link with nothing; repeated rows are other vectors with the same id; an empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    bits, tables = plan(rows.count(), cosine, recall)

    def prepare(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                key, code = [None] * part.num_rows, [None] * part.num_rows
                for n, (where, m) in units(part.column(1).to_pylist()).items():
                    if n not in planes:
                        planes[n] = np.random.default_rng([seed, n]).standard_normal((n, bits * tables))
                    codes = ((m @ planes[n]).reshape(len(m), tables, bits) > 0) @ (1 << np.arange(bits))
                    for k, x, c in zip(where.tolist(), m, codes.astype("<i4")):
                        key[k], code[k] = x.astype("<f8").tobytes(), c.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.binary()), pa.array(code, pa.binary())], names=["vec_id", "unit", "codes"])

    ready = cut(rows.mapInArrow(prepare, "vec_id long, unit binary, codes binary"), "vectors")
    nodes = cut(ready.where("unit is not null").groupBy("unit", "codes").agg(F.min("vec_id").alias("least"), F.count("*").alias("w")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def single(batches):
        """Vectors in single precision: what travels to the buckets."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([np.frombuffer(u, "<f8").astype("<f4").tobytes() for u in batch.column(3).to_pylist()], pa.binary())], names=["node", "w", "codes", "vector"])

    at = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    code = F.concat(F.hex(F.expr("substring(codes, t * 4 + 1, 4)")), F.lit(":"), F.octet_length("codes"), F.lit(":"), F.octet_length("vector"))
    coded = nodes.select("node", "w", "codes", "unit").mapInArrow(single, "node long, w long, codes binary, vector binary").select("node", "w", "codes", "vector", at.alias("t")).withColumn("code", code)
    places = nodes.select(at.alias("t"), "codes", F.octet_length("unit").alias("size")).select("t", F.concat(F.hex(F.expr("substring(codes, t * 4 + 1, 4)")), F.lit(":"), F.octet_length("codes"), F.lit(":"), F.expr("size div 2")).alias("code"))
    counts = places.groupBy("t", "code").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").select(F.col("t").alias("t_"), F.col("code").alias("code_"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = coded.join(counts, (coded["t"] == counts["t_"]) & (coded["code"] == counts["code_"]), "left").select("node", "w", "codes", "vector", "t", "code", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    keyed = dealt.select("t", "code", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "node", "w", "vector", "codes")
    keyed = keyed.repartition(partitions(spark), "t", "code", "b1", "b2").sortWithinPartitions("t", "code", "b1", "b2", "mine", "node")

    def compare(batches):
        """Rows (u, v, links): of a node its number of links here and a node it is linked to; links null: a pair to be looked at in double."""
        held, name = [], None

        def judged():
            if len(held) < 2:
                return
            t, b1, b2 = name[0], name[2], name[3]
            mine, node, w = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
            v = np.frombuffer(b"".join(h[3] for h in held), "<f4").reshape(len(held), -1)
            codes = np.frombuffer(b"".join(h[4] for h in held), "<i4").reshape(len(held), -1)
            links, us, vs = np.zeros(len(held), np.int64), [], []
            for a in range(0, len(held), 512):
                product = v[a : a + 512] @ v.T
                i, j = np.nonzero(product >= cosine - MARGIN)
                sure = product[i, j] >= cosine + MARGIN
                i = i + a
                ok = i < j if b1 == b2 else (mine[i] == b1) & (mine[j] == b2)
                i, j, sure = i[ok], j[ok], sure[ok]
                for c in range(0, len(i), 100_000):
                    x, y, s = i[c : c + 100_000], j[c : c + 100_000], sure[c : c + 100_000]
                    first = ~(codes[x, :t] == codes[y, :t]).any(1)
                    if (first & ~s).any():
                        p, q = x[first & ~s], y[first & ~s]
                        yield pa.RecordBatch.from_arrays([pa.array(node[p]), pa.array(node[q]), pa.nulls(len(p), pa.int64())], names=["u", "v", "links"])
                    x, y = x[first & s], y[first & s]
                    np.add.at(links, x, w[y])
                    np.add.at(links, y, w[x])
                    u, r = stars(node[x], node[y])  # a star for each part: as many rows as nodes
                    us.append(u)
                    vs.append(r)
            if links.any():
                u, r = stars(np.concatenate(us), np.concatenate(vs))
                root = dict(zip(u.tolist(), r.tolist()))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array([root.get(n, n) for n in node[hit].tolist()], pa.int64()), pa.array(links[hit])], names=["u", "v", "links"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                if row[:4] != name:
                    yield from judged()
                    held, name = [], row[:4]
                held.append(row[4:])
        yield from judged()

    def doubled(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist())) for k in (2, 3))
            size = [len(x) // 8 for x in batch.column(2).to_pylist()]
            ok = np.add.reduceat(a * b, np.cumsum([0, *size[:-1]])) >= cosine if size else np.empty(0, bool)
            yield batch.filter(pa.array(ok)).select([0, 1, 4, 5])

    found = cut(keyed.mapInArrow(compare, "u long, v long, links long"), "links")
    a, b = (nodes.select(F.col("node").alias(f"{x}n"), F.col("unit").alias(f"{x}u"), F.col("w").alias(f"{x}w")) for x in "ab")
    close = found.where("links is null").join(a, F.col("u") == F.col("an")).join(b, F.col("v") == F.col("bn")).select("u", "v", "au", "bu", "aw", "bw")
    close = cut(close.mapInArrow(doubled, "u long, v long, aw long, bw long"), "close")
    linked = found.where("links is not null").union(close.select("u", "v", F.col("bw").alias("links"))).union(close.select("v", "u", "aw"))
    sums = linked.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(linked.select("u", "v"))
    named = nodes.select("node", "unit", "least", "w").join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy(F.col("root").alias("sr")).agg(F.min("least").alias("component_id"))
    of = named.join(smallest, named["root"] == smallest["sr"]).join(sums, named["node"] == sums["u"], "left").select(F.col("unit").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = ready.join(of, ready["unit"] == of["key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
