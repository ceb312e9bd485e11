"""Removal of passages that an earlier document holds: matching statistics of suffix automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import HIT, SPANS, Words, cleaned, repeated
from .common import WORDS, as_bytes, cut, zipped

#: An automaton takes so many words of reference contexts; more make further shards, each of which all contexts pass.
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """Of several word sequences, each with a document's id: every state knows the smallest id it occurs in."""

    def __init__(self):
        self.next, self.link, self.length, self.least = [{}], [-1], [0], [None]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                clone = None
                if q is not None:
                    clone = self._copy(q, length[last] + 1)
                    p = last
                    while p != -1 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = clone
                    last = clone
                else:
                    cur = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    least.append(None)
                    p = last
                    while p != -1 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    if p != -1:
                        q = nxt[p][w]
                        if length[p] + 1 == length[q]:
                            link[cur] = q
                        else:
                            c = self._copy(q, length[p] + 1)
                            while p != -1 and nxt[p].get(w) == q:
                                nxt[p][w] = c
                                p = link[p]
                            link[q] = link[cur] = c
                    last = cur
            if least[last] is None or doc < least[last]:
                least[last] = doc

    def _copy(self, q: int, n: int) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(n)
        self.link.append(self.link[q])
        self.least.append(self.least[q])
        return len(self.next) - 1

    def finish(self) -> SuffixAutomaton:
        """Hands each state's smallest id on to its suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p, d = self.link[s], self.least[s]
            if p > 0 and d is not None and (self.least[p] is None or d < self.least[p]):
                self.least[p] = d
        return self

    def statistics(self, words: list, window: int) -> list:
        """For each start of a window of so many words: the smallest id of a sequence that holds it, or None."""
        out, s, n = [None] * max(0, len(words) - window + 1), 0, 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            while n > window and length[link[s]] >= window:
                s = link[s]
                n = length[s]
            if n >= window:
                out[i - window + 1] = self.least[s]
        return out


def judged(contexts: list[bytes], docs: list[int], window: int) -> list[list]:
    """For each distinct context (docs: its smallest id): per window the smallest id over all contexts."""
    words = [c.split(b" ") for c in contexts]
    best: list = [[None] * max(0, len(w) - window + 1) for w in words]
    a = 0
    while a < len(words):
        shard, n = SuffixAutomaton(), 0
        while a < len(words) and (n == 0 or n + len(words[a]) <= SHARD_WORDS):
            shard.add(words[a], docs[a])
            n += len(words[a])
            a += 1
        shard.finish()
        for have, w in zip(best, words):
            for j, d in enumerate(shard.statistics(w, window)):
                if d is not None and (have[j] is None or d < have[j]):
                    have[j] = d
    return best


def _judge(window: int):
    def run(batches):
        group, name = [], None  # rows (context, doc, key, start, windows) of one anchor

        def out():
            contexts, docs, rows = [], [], []
            for c, d, k, s, n in group:
                if not contexts or contexts[-1] != c:
                    contexts.append(c)
                    docs.append(d)
                rows.append((d, k, s, n, len(contexts) - 1))
            best = judged(contexts, docs, window) if len(contexts) > 1 else [[docs[0]] * group[0][4]]
            return [(d, k, s, bytes(HIT if best[i][j] < d else 48 for j in range(n))) for d, k, s, n, i in rows]

        done = []
        for batch in batches:
            got = batch.to_pydict()
            for h, d, k, s, n, c in zip(*(got[x] for x in ("hash", "doc", "key", "start", "windows", "context"))):
                if h != name:
                    if len(group) > 1:
                        done += out()
                    group, name = [], h
                group.append((c, d, k, s, n))
            if len(done) > 20_000:
                yield _batch(done)
                done = []
        if len(group) > 1:
            done += out()
        if done:
            yield _batch(done)

    return run


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc", "key", "start", "marks"])


def _without(window: int):
    def remove(text: bytes, at: np.ndarray, some: np.ndarray, whole: bool) -> tuple:
        words = WORDS.findall(text)
        cover = np.zeros(len(words) + 1, np.int64)
        if whole and len(words) >= window:
            cover[0], cover[-1] = 1, -1
        cover += np.bincount(at, minlength=len(cover))
        cover -= np.bincount(at + window, minlength=len(cover))
        gone = np.cumsum(cover)[:-1] > 0
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if len(words) else b""
        return len(words), int(gone.sum()), kept

    return remove


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row for each row of docs; kept: the remaining words joined by one space.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id. References
    are not broadcast whole, which no bound would allow: contexts of equal anchors meet in one task, which builds
    their suffix automaton by shards of a bounded size and streams each context through it. A null text has no words; a null id
    counts as larger than all others and comes out as null; of rows with equal ids none is smaller; repeated rows
    stay as they are unless a smaller id holds them; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return repeated(rows, Words, _judge(Words.window), _without(Words.window), "n_words long, n_removed long, kept binary", True, kinds).withColumn("kept", F.col("kept").cast("string"))


def deduplicate_by_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 200_000) -> DataFrame:
    """The same rows as deduplicate() by whole reference shards: each shard's automaton is broadcast, and every text with an id
    not below the shard's is streamed through it.

    Shards are ranges of ids of about shard_words words; one that holds more is cut into halves before it is collected, but
    for rows of one id. Work grows with the square of the number of documents, so this is for small tables and tests.
    """
    spark, window = docs.sparkSession, Words.window
    none = (1 << 63) - 1
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = cut(rows.select("doc_id", F.coalesce("doc_id", F.lit(none)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    size = F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))
    todo = [rows.agg(F.min("doc"), F.max("doc")).first()]
    found = spark.createDataFrame([], SPANS)
    while todo:
        low, high = todo.pop()
        if low is None or low == none:  # a null id is no reference
            continue
        shard = rows.where((F.col("doc") >= low) & (F.col("doc") <= high) & (F.col("doc") < none))
        if low < high and (shard.agg(size).first()[0] or 0) > shard_words:
            todo += [(low, (low + high) // 2), ((low + high) // 2 + 1, high)]
            continue
        automaton = SuffixAutomaton()
        for r in shard.select("doc", "text").toLocalIterator():
            automaton.add(WORDS.findall(r["text"].encode()), r["doc"])
        shared = spark.sparkContext.broadcast(automaton.finish())

        def stream(batches, shared=shared):
            for batch in batches:
                out = []
                for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                    marks = bytes(HIT if d is not None and d < doc else 48 for d in shared.value.statistics(WORDS.findall(text), window))
                    if HIT in marks:
                        out.append((doc, key, 0, marks))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc", "key", "start", "marks"])

        found = found.union(cut(rows.where(F.col("doc") >= low).select("doc", "key", "text").mapInArrow(stream, SPANS), "streamed"))
    info = found.distinct().groupBy(F.col("doc").alias("id"), F.col("key").alias("ik")).agg(F.collect_list(F.struct("start", "marks")).alias("spans")).withColumn("whole", F.lit(False))
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return cleaned(zipped(rows, "text"), info, _without(window), "n_words long, n_removed long, kept binary", kinds).withColumn("kept", F.col("kept").cast("string"))
