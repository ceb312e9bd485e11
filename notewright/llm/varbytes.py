"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, free_shuffles, partitions, text_slices, write_table
from .tokens import encoder

#: By control byte: the bytes of its four values, where each begins, and all together.
_LEN = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], 1)
_AT = np.cumsum(_LEN, 1) - _LEN
_ALL = _LEN.sum(1)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its bytes less one) and data bytes (little-endian) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n - 1
    c = code.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by lookup of each control byte in tables."""
    c = np.frombuffer(control, np.uint8)
    at = np.cumsum(_ALL[c]) - _ALL[c]
    where = (at[:, None] + _AT[c]).reshape(-1)[:count]
    raw = np.frombuffer(data + bytes(8), np.uint8)
    four = raw[where].astype(np.uint32) | raw[where + 1].astype(np.uint32) << 8 | raw[where + 2].astype(np.uint32) << 16 | raw[where + 3].astype(np.uint32) << 24
    return four & _MASK[_LEN[c].reshape(-1)[:count]]


BLOCK = "part int, start long, doc_ids binary, lengths binary, n_tokens long, control binary, data binary"
BACK = "doc_id long, start long, n_tokens long, ids binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_tokens: int = 1 << 18) -> tuple[str, list[int]]:
    """Writes all documents' ids in ascending order of id; returns the path and the ids by falling frequency.

    The files are Parquet of blocks (BLOCK): control and data bytes of about block_tokens ranks, with the
    documents' ids (signed 64-bit, delta from the one before) and lengths (unsigned 32-bit). The ranks count
    every token of every document; their table has as many entries as the tokenizer, so the driver can hold it.
    A null or empty text is the end id alone; null document ids come first; a repeated row is written again.
    """
    spark = docs.sparkSession
    wide = "<u4"
    small = encoder(tokenizer, end_id).tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16
    n_planes = 2 if small else 4

    def tokens(batches):
        """A row for each document (its ids in planes of bytes, which compress better), and of each slice how often each id occurs."""
        enc, shifts = encoder(tokenizer, end_id), [8 * k for k in range(n_planes)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, 2_000_000):
                ids, ends = enc.encode(texts[a:b])
                planes = np.stack([(ids >> s).astype(np.uint8) for s in shifts])
                times = np.bincount(ids)
                seen = np.flatnonzero(times)
                rows = [planes[:, x:y].tobytes() for x, y in zip(ends.tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([False] * (b - a) + [True]), pa.concat_arrays([batch.column(0).slice(a, b - a), pa.nulls(1, pa.int64())]), pa.array([*rows, seen.astype(wide).tobytes()], pa.binary()),
                    pa.concat_arrays([pa.nulls(b - a, pa.binary()), pa.array([times[seen].astype(wide).tobytes()], pa.binary())]),
                ], names=["counted", "doc_id", "ids", "times"])

    encoded = "counted boolean, doc_id long, ids binary, times binary"
    ready = write_table(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tokens, encoded), "ids")
    rows = spark.read.schema(encoded).parquet(ready)

    def counts(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for seen, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = np.frombuffer(seen, wide)
                if len(seen) and seen[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total), np.int64)])
                total[seen] += np.frombuffer(times, wide)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    by_n = rows.where("counted").select("ids", "times").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ranked = by_n.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def blocks(batches):
        part, start, docs_held, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            n = np.array([len(x) // n_planes for x in held], wide)
            ids = np.concatenate([sum(p.astype(np.uint32) << 8 * s for s, p in enumerate(np.frombuffer(x, np.uint8).reshape(n_planes, -1))) for x in held])
            control, data = encode(shared.value[ids])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([np.array(docs_held, "<i8").tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], names=["part", "start", "doc_ids", "lengths", "n_tokens", "control", "data"])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_held.append(-(1 << 63) if doc is None else doc)
                held.append(x)
                size += len(x) // n_planes
                if size >= block_tokens:
                    yield out()
                    start, docs_held, held, size = start + size, [], [], 0
        if held:
            yield out()

    order = F.col("doc_id").asc_nulls_first()
    ordered = rows.where("not counted").select("doc_id", "ids").repartitionByRange(partitions(spark), order).sortWithinPartitions(order, "ids")
    out = ordered.mapInArrow(blocks, BLOCK)
    if path is None:
        path = write_table(out, "varbytes")
    else:
        out.write.option("compression", "zstd").parquet(path)
    del out, ordered, rows
    drop_table(spark, ready)
    free_shuffles(spark)
    return path, ranked.tolist()


def read_ids(spark: SparkSession, path: str, ranked: list[int]) -> DataFrame:
    """Rows of BACK from the files: a document's ids (little-endian unsigned 32-bit) and how many come before it."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")  # a row for each writing task
    before = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist()))
    shared = spark.sparkContext.broadcast((before, np.array(ranked, "<u4")))

    def back(batches):
        before, ids_of = shared.value
        for batch in batches:
            got = batch.to_pydict()
            for k in range(batch.num_rows):
                n = np.frombuffer(got["lengths"][k], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                ids = ids_of[decode(got["control"][k], got["data"][k], int(ends[-1]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(got["doc_ids"][k], "<i8")), pa.array(before[got["part"][k]] + got["start"][k] + ends - n), pa.array(n),
                    pa.array([ids[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist())], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    out = files.select("part", "start", "doc_ids", "lengths", "control", "data").mapInArrow(back, BACK)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
