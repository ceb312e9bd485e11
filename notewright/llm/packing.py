"""Packing: token sequences of bounded length and balanced attention cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_slices
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(n, linear: float = 1.0, quadratic: float = 1.0 / 2048):
    """Estimated attention cost of a piece of n tokens: a linear and a quadratic part."""
    return linear * n + quadratic * n * n


def pack(lengths: np.ndarray, size: int = 2048) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that hold every token of documents of these lengths once.

    Descending documents go to the sequence of the lowest cost that has room for them; one with no such
    sequence is cut over those of the lowest cost. Parts of `size` tokens of longer documents are sequences of
    their own. All sequences are full; the last tokens fill sequences of the powers of two that their number
    is the sum of, so nothing is padded.
    """
    pieces, seq = [], 0
    for d in np.flatnonzero(lengths >= size):
        for s in range(0, int(lengths[d]) - size + 1, size):
            pieces.append((d, s, size, seq, 0))
            seq += 1
    rest = lengths % size
    total = int(rest.sum())
    room = np.array([size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if total % size >> b & 1], np.int64)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    for d in np.argsort(-rest, kind="stable"):
        n, s = int(rest[d]), int(lengths[d] - rest[d])
        if not n:
            break
        fits = room >= n
        if fits.any():
            where = [int(np.where(fits, spent, np.inf).argmin())]
        else:
            where = np.flatnonzero(room)
            where = where[np.argsort(spent[where], kind="stable")]
        for q in where:
            m = min(n, int(room[q]))
            pieces.append((d, s, m, seq + q, used[q]))
            room[q] -= m
            used[q] += m
            spent[q] += cost(m)
            n, s = n - m, s + m
            if not n:
                break
    return np.array(pieces, np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = 2048, tokens_at_once: int = 1 << 20) -> DataFrame:
    """Rows of SCHEMA, one per piece; ids are little-endian unsigned 32-bit integers.

    Each task packs its documents by itself, about tokens_at_once tokens at a time, so nothing is shuffled
    and memory has a bound (one document's ids beside it). sequence_id: the task's number and a count.
    A null or empty text is the end id alone; a null id stays null; a repeated row is packed again; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches):
        enc, task, made = encoder(tokenizer, end_id), TaskContext.get().partitionId() << 36, 0
        held, n_held = [], 0

        def packed():
            nonlocal made
            lengths = np.array([len(x) for _, x in held], np.int64)
            p = pack(lengths, size)
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            out = pa.RecordBatch.from_arrays([
                pa.array([held[d][0] for d in p[:, 0]], pa.int64()), pa.array(p[:, 1]), pa.array(p[:, 2]),
                pa.array([held[d][1][s : s + n].tobytes() for d, s, n in p[:, :3].tolist()], pa.binary()),
                pa.array(lengths[p[:, 0]]), pa.array(task + made + p[:, 3]), pa.array(p[:, 4]),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            made += int(p[:, 3].max()) + 1
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                ids, ends = enc.encode(texts[a:b])
                for k in range(b - a):
                    held.append((doc_ids[a + k], ids[ends[k] : ends[k + 1]].astype("<u4")))
                    n_held += len(held[-1][1])
                    if n_held >= tokens_at_once:
                        yield packed()
                        held, n_held = [], 0
        if held:
            yield packed()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
