"""Where texts repeat: minimizers of windows find, without loss, the places at which two windows can be equal.

A window is `window` units (words or bytes) of one document; contexts also hold what a string of `reach` units needs that
starts where a window does. A window's anchor is the k-gram of the least hash in it,
the leftmost one. Equal windows have equal anchors at equal places, so a window that repeats has an anchor
that occurs more than once. Around each such anchor lies a context: the windows whose anchor it is. Contexts
with one anchor meet in one task, which judges their windows exactly.

Copies of a whole text are one class: its first document stands for it (key: the text's hash). A task first
settles what it can tell by itself, so an anchor or a context takes one row for each batch to the shuffle,
however many documents hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, as_bytes, cut, drop_table, free_shuffles, partitions, text_slices, unzipped, write_table, zipped

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = (1 << 24) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _M[4]
    h ^= h >> np.uint64(29)
    return h


class Words:
    """Units are words of a text; a context's text joins them by one space."""

    window, reach, k = 13, 13, 5

    @staticmethod
    def units(texts: list):
        """The hashes of all units one after the other, and each text's bounds; the texts' units themselves."""
        words = [WORDS.findall(t) if t else [] for t in texts]
        h = np.frombuffer(b"".join(xxhash.xxh64_digest(w) for x in words for w in x), ">u8").astype(np.uint64)
        return h, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64), words

    @classmethod
    def grams(cls, h: np.ndarray) -> np.ndarray:
        out = h[: len(h) - cls.k + 1].copy()
        for j in range(1, cls.k):
            out *= _M[0]
            out += h[j : len(h) - cls.k + 1 + j]
        return _mixed(out)

    @staticmethod
    def context(units: list, a: int, b: int) -> bytes:
        return b" ".join(units[a:b])

    @staticmethod
    def full(context: bytes, windows: int) -> int:
        """How many windows of a context have `reach` units."""
        return windows

    #: How many neighbouring windows of a hot anchor stay together, round by round.
    widths = (1,)

    @classmethod
    def parts(cls, context: bytes, at: int, n: int, width: int):
        """(key, first window, windows, text): each window by itself."""
        w = context.split(b" ")
        for j in range(n):
            text = b" ".join(w[j : j + cls.window])
            yield text, j, 1, text


class Bytes:
    """Units are the bytes of a text."""

    window, reach, k = 400, 400, 32

    @staticmethod
    def units(texts: list):
        data = b"".join(t or b"" for t in texts)
        return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t or b"") for t in texts])]).astype(np.int64), [t or b"" for t in texts]

    @classmethod
    def grams(cls, b: np.ndarray) -> np.ndarray:
        h, n = _BYTES[b], 1
        for level in range(5):  # 32 bytes by doubling
            h = h[: len(h) - n] * _M[level] + h[n:]
            n *= 2
        return _mixed(h)

    @staticmethod
    def context(units: bytes, a: int, b: int) -> bytes:
        return units[a:b]

    @classmethod
    def full(cls, context: bytes, windows: int) -> int:
        """How many windows of a context have `reach` units."""
        return min(windows, max(0, len(context) - cls.reach + 1))

    widths = (48, 7, 1)

    @classmethod
    def parts(cls, context: bytes, at: int, n: int, width: int):
        """(key, first window, windows, text) for each run of windows whose anchor lies within `width` places.

        key: the run of places and the bytes that every window of it holds. Equal windows have their anchor at one
        place, so they fall to one key; windows that differ in those bytes don't."""
        for run in range(max(0, at - n + 1) // width, at // width + 1):
            a, b = max(0, at - (run + 1) * width + 1), min(n - 1, at - run * width)  # its windows here
            first, last = at - run * width, at - (run + 1) * width + 1 + cls.window
            yield b"%d:%d:" % (width, run) + context[max(0, first) : last], a, b - a + 1, context[a : b + cls.reach]


def runs(unit, h: np.ndarray, bounds: np.ndarray, most: int = 1 << 21):
    """For units with these bounds of documents: (document, anchor's hash, first and last window start, anchor's place), by document.

    `most` windows are looked at together; a run of windows across two such parts is told as two."""
    parts = [_runs(unit, h[a : a + most + unit.window - 1], bounds, a) for a in range(0, max(1, len(h) - unit.window + 1), most)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(unit, h: np.ndarray, bounds: np.ndarray, shift: int):
    w = unit.window - unit.k + 1
    none = (np.empty(0, np.int64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    if len(h) < unit.window:
        return none
    g = unit.grams(h)
    low = (g & ~np.uint64(_PLACE)) | np.arange(len(g), dtype=np.uint64)
    n = 1
    while 2 * n <= w:
        low = np.minimum(low[: len(low) - n], low[n:])
        n *= 2
    if n < w:
        low = np.minimum(low[: len(low) - (w - n)], low[w - n :])
    place = (low & np.uint64(_PLACE)).astype(np.int64)
    at = np.arange(shift, shift + len(place))
    doc = np.searchsorted(bounds, at, "right") - 1
    ok = at + unit.window <= bounds[doc + 1]
    p, d, at = place[ok], doc[ok], at[ok]
    if not len(at):
        return none
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return d[new], g[p[new]], at[new], at[last], p[new] + shift


ANCHORS = "hash long, doc long, key long, kind int"


def _found(unit):
    """Rows of ANCHORS. kind 0: the only one in this batch; 1: shared in this batch; 2: tells others that it is (no document)."""

    def run(batches):
        for batch in batches:
            doc, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = as_bytes(batch.column(2))
            hs, rs = [], []
            for a, b in text_slices(texts, 2_000_000):
                h, bounds, _ = unit.units(texts[a:b])
                d, g, *_ = runs(unit, h, bounds)
                hs.append(g)
                rs.append(d + a)
            h, r = np.concatenate([np.empty(0, np.uint64), *hs]).view(np.int64), np.concatenate([np.empty(0, np.int64), *rs])
            order = np.lexsort((r, key[r], h))
            h, r = h[order], r[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(h)]]))
            many = np.repeat(size > 1, size)
            # the same document may hold an anchor often: once is enough
            once = new | np.concatenate([[True], r[1:] != r[:-1]]) if len(h) else new
            kind = np.where(many, 1, 0)
            told = h[first[size > 1]]
            zero = np.zeros(len(told), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((h[once], told), (doc[r[once]], zero), (key[r[once]], zero), (kind[once].astype(np.int32), np.full(len(told), 2, np.int32)))], names=["hash", "doc", "key", "kind"])

    return run


def _shared(batches):
    """Over rows (hash, doc, key, kind) sorted by hash: those of kind 0 whose hash has another row."""
    held, known = [np.empty(0, np.int64)] * 4, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, d, k, kind = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        shared = (size > 1) | (kind[first] == 2)
        if known is not None and h[0] == known:
            shared[0] = True
        out = np.repeat(shared, size) & (kind == 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (d, k, h)], names=["doc", "key", "hash"])
        if shared[-1]:
            known, held = h[-1], [np.empty(0, np.int64)] * 4
        else:
            known, held = None, [x[-1:] for x in (h, d, k, kind)]


CONTEXT = "hash long, doc long, key long, start long, windows int, at int, context binary, n int"


#: Marks of a window: it repeats, and so does the string of `reach` units that starts with it.
SOME, HIT = 49, 50


class _Combined:
    """Rows of CONTEXT of one batch. Of equal contexts one stays (n: how many); the others are settled: hash null, all windows
    repeat (n: how many of them have `reach` units). keep_first: a row is settled only by one with a smaller id; else any equal
    one settles it."""

    def __init__(self, unit, keep_first: bool):
        self.unit, self.keep_first, self.rows, self.done = unit, keep_first, {}, []

    def add(self, row: tuple, n: int = 1) -> None:
        at = (row[0], row[6], row[4])
        was = self.rows.get(at)
        if was is None:
            self.rows[at] = [row, n]
            return
        was[1] += n
        if row[1] < was[0][1]:
            row, was[0] = was[0], row
        if not self.keep_first or row[1] > was[0][1]:
            self.done.append(row)
        else:
            self.rows[(at, len(self.rows))] = [row, n]

    def batches(self, most: int = 50_000):
        out = [(*r, n) for r, n in self.rows.values()] + [(None, *r[1:6], None, self.unit.full(r[6], r[4])) for r in self.done]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        for b in range(0, len(out), most):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[b : b + most]), kinds)], names=["hash", "doc", "key", "start", "windows", "at", "context", "n"])


def _contexts(unit, keep_first: bool):
    """Rows of CONTEXT for a class's text and the hashes of its shared anchors."""

    def run(batches):
        for batch in batches:
            doc, key, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = unzipped(batch.column(2))
            found = _Combined(unit, keep_first)
            for a, b in text_slices(texts, 2_000_000):
                h, bounds, units = unit.units(texts[a:b])
                d, g, s1, s2, p = runs(unit, h, bounds)
                g = g.view(np.int64)
                for i in range(b - a):
                    lo, hi = np.searchsorted(d, [i, i + 1])
                    mine = lo + np.flatnonzero(np.isin(g[lo:hi], np.array(shared[a + i], np.int64)))
                    for j in mine.tolist():
                        x, y = int(s1[j] - bounds[i]), int(s2[j] - bounds[i])
                        found.add((int(g[j]), doc[a + i], key[a + i], x, y - x + 1, int(p[j] - s1[j]), unit.context(units[i], x, y + unit.reach)))
            yield from found.batches()

    return run


#: An anchor of more contexts than this is dealt out anew, by what its windows hold.
HOT = 2_000
#: So many hot anchors at most are broadcast; more are joined.
BROADCAST_ROWS = 1_000_000


def _refined(unit, width: int, keep_first: bool):
    """Contexts of hot anchors by unit.parts: a few rows each, of which equal ones are combined."""

    def run(batches):
        for batch in batches:
            found = _Combined(unit, keep_first)
            cols = [c.to_pylist() for c in batch.columns]
            for _, doc, key, start, windows, at, context, n in zip(*cols):
                for name, j, m, text in unit.parts(context, at, windows, width):
                    found.add((xxhash.xxh64_intdigest(name, 3) - (1 << 63), doc, key, start + j, m, at - j, text), n)
            yield from found.batches()

    return run


def _marked(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (start, marks): the row, the start and the mark of each window that has one."""
    per_row = np.nan_to_num(pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = spans.flatten()
    start, marks = flat.field(0).to_numpy(), flat.field(1)
    size = pa.compute.binary_length(marks).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(marks.to_pylist()), np.uint8)
    within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    hit = data >= SOME
    return np.repeat(np.repeat(np.arange(len(per_row)), per_row), size)[hit], (np.repeat(start, size) + within)[hit], data[hit]


SPANS = "doc long, key long, start long, marks binary"


def repeated(docs: DataFrame, unit, judge, remove, schema: str, keep_first: bool, empty) -> DataFrame:
    """Rows of `schema` for all rows of docs (doc_id, text): what is left of each text.

    judge: over contexts sorted by (hash, context, doc), gives rows of SPANS (a mark for each window).
    remove: (text, starts of the strings that go, starts of the windows that repeat, whole) to a row of the schema; whole: the class has an earlier copy, or
    a copy at all unless keep_first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("key"), "text")
    copies = rows.select("doc", "key", F.unhex(F.md5(text.cast("binary"))).alias("md5"), F.octet_length(text).alias("size"))
    classes = cut(copies.groupBy("md5", "size").agg(F.min(F.struct("doc", "key")).alias("first"), F.count("*").alias("copies")).select("md5", "size", F.col("first.doc").alias("first"), F.col("first.key").alias("ck"), "copies"), "classes")
    packed = zipped(rows, "text")

    held = [write_table(rows.select("doc", "key", "text").mapInArrow(_found(unit), ANCHORS), "anchors")]
    anchors = spark.read.schema(ANCHORS).parquet(held[0])
    here = anchors.where("kind <> 1").repartition(n, "hash").sortWithinPartitions("hash").mapInArrow(_shared, "doc long, key long, hash long")
    lists = here.union(anchors.where("kind = 1").select("doc", "key", "hash")).groupBy("doc", "key").agg(F.collect_set("hash").alias("hashes"))
    lists = lists.join(classes.select("ck", "first"), (F.col("key") == F.col("ck")) & (F.col("doc") == F.col("first")), "left_semi")
    lists = cut(lists.select(F.col("doc").alias("ld"), F.col("key").alias("lk"), "hashes"), "lists")
    del here
    drop_table(spark, held.pop())  # the lists are written: nothing reads it again
    free_shuffles(spark)
    with_text = packed.join(lists, (packed["doc"] == lists["ld"]) & (packed["key"] == lists["lk"]))
    held.append(write_table(with_text.select("doc", "key", "text", "hashes").mapInArrow(_contexts(unit, keep_first), CONTEXT), "contexts"))
    contexts = spark.read.schema(CONTEXT).parquet(held[-1])
    del with_text
    free_shuffles(spark)
    open_, cold, told = contexts.where("hash is not null"), [], [contexts.where("hash is null")]
    for width in unit.widths:
        hot = cut(open_.groupBy("hash").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select(F.col("hash").alias("hot")), "hot")
        n_hot = hot.count()
        if not n_hot:
            break
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        held.append(write_table(open_.join(hot, F.col("hash") == F.col("hot"), "left_semi").mapInArrow(_refined(unit, width, keep_first), CONTEXT), "refined"))
        refined = spark.read.schema(CONTEXT).parquet(held[-1])
        cold.append(open_.join(hot, F.col("hash") == F.col("hot"), "left_anti"))
        told.append(refined.where("hash is null"))
        open_ = refined.where("hash is not null")
    for more in cold:
        open_ = open_.union(more)
    spans = open_.repartition(n, "hash").sortWithinPartitions("hash", "context", "doc").mapInArrow(judge, SPANS)
    settled = told[0]
    for more in told[1:]:
        settled = settled.union(more)
    settled = settled.select("doc", "key", "start", F.expr(f"cast(concat(repeat('{chr(HIT)}', n), repeat('{chr(SOME)}', windows - n)) as binary)").alias("marks"))
    spans = cut(spans.union(settled).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "marks")).alias("spans")).select(F.col("doc").alias("sd"), F.col("key").alias("sk"), "spans"), "spans")
    del open_, settled, cold, told
    for path in held:
        drop_table(spark, path)
    free_shuffles(spark)

    few = classes.where("copies > 1").select(F.col("md5").alias("cm"), F.col("size").alias("cs"), "first")
    marked = copies.join(few, (copies["md5"] == few["cm"]) & (copies["size"] == few["cs"]))  # copies: all but the first, or all
    whole = (marked.where("doc <> first") if keep_first else marked).select(F.col("doc").alias("wd"), F.col("key").alias("wk"), F.lit(True).alias("whole")).distinct()
    info = spans.join(whole, (F.col("sd") == F.col("wd")) & (F.col("sk") == F.col("wk")), "full").select(F.coalesce("sd", "wd").alias("id"), F.coalesce("sk", "wk").alias("ik"), "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    info = cut(info, "info")
    return cleaned(packed, info, remove, schema, empty)


def cleaned(packed: DataFrame, info: DataFrame, remove, schema: str, empty) -> DataFrame:
    """remove() over each text (doc_id, doc, key, zipped text) with its spans and whether all of it goes (id, ik, spans, whole)."""
    joined = packed.join(info, (packed["doc"] == info["id"]) & (packed["key"] == info["ik"]), "left").select("doc_id", "text", "spans", "whole")

    def last(batches):
        for batch in batches:
            texts = unzipped(batch.column(1))
            spans, whole = batch.column(2), batch.column(3).to_pylist()
            docs, at, mark = _marked(spans)
            edges = np.searchsorted(docs, np.arange(len(texts) + 1))
            got = []
            for i, t in enumerate(texts):
                some = at[edges[i] : edges[i + 1]]
                got.append(remove(t or b"", some[mark[edges[i] : edges[i + 1]] == HIT], some, bool(whole[i])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*got), empty))] if got else [batch.column(0), *(pa.array([], t) for t in empty)], names=["doc_id", *(f.split()[0] for f in schema.split(", "))])

    return joined.mapInArrow(last, f"doc_id {dict(packed.dtypes)['doc_id']}, {schema}")
