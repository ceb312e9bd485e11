"""Removal of byte strings that occur elsewhere: suffixes sorted one bucket at a time, long ties by difference-cover ranks."""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import HIT, SOME, Bytes, repeated


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues of which every residue modulo v is a difference; chosen greedily, with 0."""
    cover, left = [0], set(range(1, v))
    while left:
        gain = lambda r: len(left & {x for c in cover for x in ((r - c) % v, (c - r) % v)})
        best = max((r for r in range(v) if r not in cover), key=lambda r: (gain(r), -r))
        left -= {x for c in cover for x in ((best - c) % v, (c - best) % v)}
        cover.append(best)
    return tuple(sorted(cover))


class CoverRanks:
    """Ranks, to `depth` bytes, of the suffixes of a block that start at residues of the cover.

    residues: those of the cover that comparisons will need (all, if not given). Memory: a few integers for
    each sampled position. v is a power of two and at least 8.
    """

    def __init__(self, text: np.ndarray, v: int, depth: int, residues=None):
        self.v, self.residues = v, sorted(difference_cover(v) if residues is None else residues)
        n = len(text) // v + 2
        padded = np.zeros((n + 1) * v, np.uint8)
        padded[: len(text)] = text
        self.row = {r: k for k, r in enumerate(self.residues)}
        rank = np.zeros((len(self.residues), n), np.int64)
        for part in range(v // 8):  # a rank for the first v bytes, 8 at a time
            word = np.stack([padded[r + 8 * part : r + 8 * part + n * v].reshape(n, v)[:, :8].copy().view(">u8")[:, 0] if r + 8 * part + n * v <= len(padded) else self._tail(padded, r + 8 * part, n, v) for r in self.residues])
            rank = self._renamed(rank, self._renamed(word.astype(np.uint64), None))
        step = 1
        while step * v < depth:
            later = np.zeros_like(rank)
            later[:, :-step] = rank[:, step:] + 1
            rank = self._renamed(rank, later)
            step *= 2
        self.rank = rank

    @staticmethod
    def _tail(padded, at, n, v):
        more = np.concatenate([padded, np.zeros(2 * v, np.uint8)])
        return more[at : at + n * v].reshape(n, v)[:, :8].copy().view(">u8")[:, 0]

    @staticmethod
    def _renamed(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        key = a.reshape(-1) if b is None else a.reshape(-1) * (int(b.max(initial=0)) + 1) + b.reshape(-1)
        return np.unique(key, return_inverse=True)[1].reshape(a.shape)

    @property
    def by_position(self) -> np.ndarray:
        """The rank of each position, -1 where it isn't sampled."""
        out = np.full(self.rank.shape[1] * self.v, -1, np.int64)
        for r, k in self.row.items():
            out[r :: self.v] = self.rank[k]
        return out

    def shifts(self) -> list[list[int]]:
        """For each two residues the least d by which positions of both are moved to sampled ones."""
        have = set(self.residues)
        return [[next(d for d in range(self.v) if (r + d) % self.v in have and (s + d) % self.v in have) for s in range(self.v)] for r in range(self.v)]


def bucket_sorter(text: np.ndarray, ranks: CoverRanks):
    """A function that sorts the positions of one bucket by suffix: by bytes as far as the next common sampled position, then by its rank."""
    v, data, rank, shifts = ranks.v, text.tobytes() + bytes(2 * ranks.v), ranks.by_position, ranks.shifts()

    def compare(i: int, j: int) -> int:
        d = shifts[i % v][j % v]
        a, b = data[i : i + d], data[j : j + d]
        if a != b:
            return -1 if a < b else 1
        return int(rank[i + d] - rank[j + d])

    key = cmp_to_key(compare)
    return lambda positions: sorted(positions, key=key)


def suffix_array(text: bytes, v: int = 16, prefix: int = 2):
    """The suffixes of a block in order (zero bytes follow its end), yielded one bucket (of equal first `prefix` bytes) at a time."""
    t = np.frombuffer(text, np.uint8)
    sort = bucket_sorter(t, CoverRanks(t, v, len(t) + v))
    padded = np.concatenate([t, np.zeros(prefix, np.uint8)]).astype(np.int64)
    bucket = sum(padded[k : k + len(t)] << 8 * (prefix - 1 - k) for k in range(prefix))
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(t) else np.zeros(1, np.int64)
    for a, b in zip(edges, edges[1:]):
        yield sort(order[a:b].tolist())


def _ordered(block: np.ndarray, positions: np.ndarray, group: np.ndarray, depth: int, v: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at these positions, one bucket (group, ascending) after the other, and what each has in common with
    the one before it, to the depth (-1: another bucket)."""
    sort = bucket_sorter(block, CoverRanks(block, v, depth + v))
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    index = {p: k for k, p in enumerate(positions.tolist())}
    order = np.array([index[p] for a, b in zip(edges.tolist(), edges[1:].tolist()) for p in sort(positions[a:b].tolist())], np.int64)
    padded = np.concatenate([block, np.zeros(depth, np.uint8)])
    common = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 4096):  # a bounded number at a time
        at = positions[order[a - 1 : a + 4096]]
        wide = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
        same = wide[1:] == wide[:-1]
        common[a : a + 4096] = np.where(same.all(1), depth, same.argmin(1))
    common[edges[:-1]] = -1
    return order, common


def mark(contexts: list[bytes], group: np.ndarray, at: np.ndarray, windows: np.ndarray, times: np.ndarray, unit=Bytes) -> np.ndarray:
    """marks[i, j]: SOME if window j of context i occurs more than once among the contexts of its group, HIT if the string of
    `reach` bytes that starts there does (groups ascend); else 0.

    Equal windows have the anchor at the same place, x bytes after their start: they agree on x bytes before it
    and window - x from it on. The contexts lie one after the other in a block; a bucket is the suffixes that begin
    with one anchor, and those of the reversed block from it on backwards. Agreement to a depth is a run of neighbours in
    their order.
    """
    window, reach, k = unit.window, unit.reach, unit.k
    size = np.array([len(c) for c in contexts], np.int64)
    block, place = np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(size) - size + at
    right, common_right = _ordered(block, place, group, reach)
    left, common_left = _ordered(block[::-1], len(block) - place, group, window - k)
    marks = np.zeros((len(contexts), window - k + 1), np.uint8)
    names = [np.empty(len(contexts), np.int64) for _ in range(2)]
    for x in range(window - k + 1):
        some = np.flatnonzero((at - windows + 1 <= x) & (x <= at))
        names[1][left] = np.cumsum(common_left < x)
        for length, level in ((window, SOME), (reach, HIT)):
            if length > window:
                some = some[at[some] - x + length <= size[some]]
            if len(some) < 1:
                break
            names[0][right] = np.cumsum(common_right < length - x)
            _, same = np.unique(names[0][some] * (len(contexts) + 1) + names[1][some], return_inverse=True)
            some = some[np.bincount(same, weights=times[some])[same] > 1]
            marks[some, at[some] - x] = level
    return marks


def _judge(unit=Bytes, block: int = 3_000_000):
    """Buckets of anchors, in blocks of about `block` bytes of different contexts; a context that many rows share stands there once."""

    def run(batches):
        held, rows, size, name, number = [], [], 0, None, 0  # held: (context, at, windows, times, bucket); rows: (doc, key, start, its place in held)
        group: list = []  # of one anchor: [context, at, windows, times, rows]

        def out():
            if not held:
                return None
            contexts, at, windows, times, bucket = zip(*held)
            marks = mark(list(contexts), *(np.array(c, np.int64) for c in (bucket, at, windows, times)), unit)
            hit = marks.any(1)
            told = [(d, key, s, np.maximum(marks[i, : windows[i]], 48).tobytes()) for d, key, s, i in rows if hit[i]]
            return told

        def close():
            nonlocal size, number
            if len(group) > 1:
                for context, at, windows, times, members in group:
                    rows.extend((*m, len(held)) for m in members)
                    held.append((context, at, windows, times, number))
                    size += len(context)
                number += 1
            elif group and group[0][3] > 1:  # one context, several times: all its windows
                full = unit.full(group[0][0], group[0][2])
                alone.extend((*m, bytes([HIT]) * full + bytes([SOME]) * (group[0][2] - full)) for m in group[0][4])
            group.clear()

        def batch_of(told):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc", "key", "start", "marks"])

        alone: list = []
        for batch in batches:
            got = batch.to_pydict()
            for h, doc, key, start, at, windows, n, context in zip(*(got[x] for x in ("hash", "doc", "key", "start", "at", "windows", "n", "context"))):
                if h != name:
                    close()
                    name = h
                    if size > block or len(alone) > 20_000:
                        if told := [*(out() or []), *alone]:
                            yield batch_of(told)
                        held, rows, size, number, alone = [], [], 0, 0, []
                if group and group[-1][0] == context and group[-1][2] == windows:
                    group[-1][3] += n
                    group[-1][4].append((doc, key, start))
                else:
                    group.append([context, at, windows, n, [(doc, key, start)]])
        close()
        if told := [*(out() or []), *alone]:
            yield batch_of(told)

    return run


def _runs(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n bytes strings of the length that start there cover."""
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1))[:-1] > 0


def _number(covered: np.ndarray) -> int:
    return int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())


def _without(reach: int):
    def remove(text: bytes, at: np.ndarray, some: np.ndarray, whole: bool) -> tuple:
        n = len(text)
        if whole and n >= reach:
            return n, n, 1, b""
        if not len(at):
            return n, 0, 0, text
        gone = _runs(at, reach, n)
        return n, int(gone.sum()), _number(gone), np.frombuffer(text, np.uint8)[~gone].tobytes()

    return remove


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row for each row of docs; kept: the remaining bytes.

    A byte goes if a 400-byte string that covers it also starts anywhere else, in the same document or another.
    Buckets of suffixes are those that begin with one anchor; only anchors that occur more than once have one. A bucket is
    sorted by bytes as far as the next sampled position of a difference cover that two suffixes share, then by ranks of
    the samples of its block, so a comparison looks at 32 bytes at most; a block's size bounds the memory: a hot anchor is dealt out until
    a key is a whole 400-byte string, and equal ones are one row.
    A null text is empty; null ids stay; repeated rows are copies of each other, so 400 bytes or more of them
    go altogether; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return repeated(rows, Bytes, _judge(), _without(Bytes.reach), "n_bytes long, n_removed long, n_spans long, kept binary", False, kinds)
