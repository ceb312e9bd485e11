"""Language-model scoring with classes of words found by exchange clustering."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORDS, as_bytes, cut, partitions, text_slices

END = b" "  # no word holds a space


def exchange(bigrams: np.ndarray, classes: int, passes: int = 6) -> np.ndarray:
    """Assigns units to classes: each in turn moves to the class that most raises the bigram likelihood.

    bigrams: counts of one unit after another (square). The start deals units by falling frequency in turn;
    the last unit keeps a class of its own (the last). Ties go to the lower class.
    """
    n, free = len(bigrams), classes - 1
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    order = order[order != n - 1]
    of = np.empty(n, np.int64)
    of[order] = np.arange(len(order)) % free
    of[n - 1] = free
    one = np.eye(classes)[of]
    joint = one.T @ bigrams @ one
    left, right = bigrams.T @ one, bigrams @ one  # counts of classes before and after each unit
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    own = np.diag(bigrams)
    for _ in range(passes):
        moved = 0
        for u in order:
            c, s = of[u], own[u]
            if not left[u].any() and not right[u].any():
                continue
            before, after = left[u].copy(), right[u].copy()
            before[c] -= s
            after[c] -= s
            # take the unit out of its class
            joint[:, c] -= before
            joint[c, :] -= after
            joint[c, c] -= s
            row, col, logs = joint.sum(1) + before, joint.sum(0) + after, xlogx(joint)  # the unit as a neighbour counts wherever it goes
            gain_col = (xlogx(joint + before[:, None]) - logs).sum(0)[:free]
            gain_row = (xlogx(joint + after[None, :]) - logs).sum(1)[:free]
            d = np.arange(free)
            jd = joint[d, d]
            gain = gain_col + gain_row - (xlogx(jd + before[d]) - xlogx(jd)) - (xlogx(jd + after[d]) - xlogx(jd)) + xlogx(jd + before[d] + after[d] + s) - xlogx(jd)
            gain -= xlogx(row[:free] + after.sum() + s) - xlogx(row[:free]) + xlogx(col[:free] + before.sum() + s) - xlogx(col[:free])
            best = int(gain.argmax())
            joint[:, best] += before
            joint[best, :] += after
            joint[best, best] += s
            if best != c:
                of[u] = best
                left[:, c] -= bigrams[u]
                left[:, best] += bigrams[u]
                right[:, c] -= bigrams[:, u]
                right[:, best] += bigrams[:, u]
                moved += 1
        if not moved:
            break
    return of


#: So many counts are looked at together: the driver's memory beside the counts themselves.
CELLS = 8_192


def moved(left: np.ndarray, right: np.ndarray, of: np.ndarray, classes: int, words: np.ndarray) -> np.ndarray:
    """The exchange for many words at once: each of them goes to the class that most raises the likelihood while the others stay.

    left, right: counts of classes before and after each unit (rows). Only a unit's own cells are looked at, so the time
    is in proportion to them. The last class is the end's. Ties go to the lower class.
    """
    f = lambda x: x * np.log(np.maximum(x, 1))
    free, out = classes - 1, of.copy()
    joint = np.zeros((classes, classes))
    np.add.at(joint.T, of, left)  # joint[a, b]: a before b
    gain = np.zeros((len(words), free))
    for counts, table in ((left, joint), (right, joint.T)):  # table[a]: what stands with class a, by the unit's class
        own = counts[words]
        row, a = np.nonzero(own)
        n = own[row, a].astype(float)
        for k in range(0, len(row), CELLS):
            part = slice(k, k + CELLS)
            base = table[a[part], :free]
            more = f(base + n[part, None]) - f(base)
            here = of[words[row[part]]]
            at = np.flatnonzero(here < free)
            held = table[a[part][at], here[at]]
            more[at, here[at]] = f(held) - f(held - n[part][at])  # its own class holds it already
            np.add.at(gain, row[part], more)
        size, mine = table.sum(0), own.sum(1).astype(float)
        del own, row, a, n
        for k in range(0, len(words), CELLS):
            here, m = of[words[k : k + CELLS]], mine[k : k + CELLS]
            cost = f(size[None, :free] + m[:, None]) - f(size[None, :free])
            at = np.flatnonzero(here < free)
            cost[at, here[at]] = f(size[here[at]]) - f(size[here[at]] - m[at])
            gain[k : k + CELLS] -= cost
    some = left[words].any(1) | right[words].any(1)
    out[words[some]] = gain[some].argmax(1)
    return out


def group_of(word: bytes, groups: int) -> int:
    """The group of a word that is no unit of its own: by its last two bytes, and whether it has others than letters."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7 + (not word.isalpha()) * 13 + (len(word) > 9) * 101) % groups


class Units:
    """Word to unit: known words have units of their own, others that of their group, the end the last one."""

    def __init__(self, words: list[bytes], groups: int):
        self.index = {w: k for k, w in enumerate(words)}
        self.own, self.groups = len(words), groups
        self.size = self.own + groups + 1

    def __call__(self, word: bytes) -> int:
        k = self.index.get(word)
        return self.own + group_of(word, self.groups) if k is None else k


def _words(batch, k: int = 0):
    """Lists of the documents' lower-cased words, some documents at a time, and where these begin."""
    texts = as_bytes(batch.column(k))
    for a, b in text_slices(texts):
        yield a, [WORDS.findall(t.translate(LOWER)) if t else [] for t in texts[a:b]]


def count_tokens(docs: DataFrame, text_col: str = "text", flush: int = 400_000) -> DataFrame:
    """(token, c) over all whole texts; the end token (a space) counts the documents."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for _, docs_words in _words(batch):
                for w in docs_words:
                    seen.update(w)
                seen[END] += len(docs_words)
                if len(seen) > flush:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    return docs.select(text_col).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


CODED = "row_key long, doc_id long, learn boolean, ids binary, token binary, times long"


def coded(docs: DataFrame, units) -> DataFrame:
    """docs (row_key, text, doc_id, learn) as rows of CODED: a row for each with its units (signed 32-bit), and one for each
    different word in it that has no unit of its own, with its times."""

    def run(batches):
        units = shared.value
        memo: dict[bytes, int] = {}
        for batch in batches:
            keys, names, learn = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for a, docs_words in _words(batch, 1):
                if len(memo) > 300_000:
                    memo.clear()
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for d, w in enumerate(docs_words):
                    ids = []
                    for x in w:
                        k = memo.get(x)
                        if k is None:
                            k = memo[x] = units(x)
                        ids.append(k)
                    ids = np.array(ids, "<i4")
                    for c, v in zip(cols, (keys[a + d], names[a + d], learn[a + d], ids.tobytes(), None, 0)):
                        c.append(v)
                    for x, n in Counter([w[k] for k in np.flatnonzero(ids >= units.own).tolist()]).items():
                        for c, v in zip(cols, (keys[a + d], None, None, None, x, n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()))], names=["row_key", "doc_id", "learn", "ids", "token", "times"])

    shared = docs.sparkSession.sparkContext.broadcast(units)
    return docs.select("row_key", "text", "doc_id", "learn").mapInArrow(run, CODED)


def _chains(batches, end: int, most: int = 1 << 21):
    """Units of whole documents one after the other, each between two ends, about `most` at a time."""
    held, n = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held += [x, end.to_bytes(4, "little")]
            n += len(x) // 4 + 1
            if n > most:
                yield np.frombuffer(end.to_bytes(4, "little") + b"".join(held), "<i4").astype(np.int64)
                held, n = [], 0
    if held:
        yield np.frombuffer(end.to_bytes(4, "little") + b"".join(held), "<i4").astype(np.int64)


def count_cells(rows: DataFrame, n: int, cells, end: int) -> np.ndarray:
    """Sums over all documents (ids) of counts in n cells: cells(chain of units) gives the first cell, and the numbers from it on, of some to count.

    A task sums up in one array and sends it in pieces of 65 536 cells, packed; pieces are added up in tasks of their own,
    so the driver gets n counts once, however many tasks there are.
    """
    import zstandard

    size = 1 << 16

    def run(batches):
        total = np.zeros(-(-n // size) * size, np.int32)
        for chain in _chains(batches, end):
            for first, numbers in cells(chain):
                found = np.bincount(numbers)
                total[first : first + len(found)] += found.astype(np.int32)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        some = [k for k in range(len(total) // size) if total[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zip_(total[k * size : (k + 1) * size].astype("<i8").tobytes()) for k in some], pa.binary())], names=["piece", "counts"])

    def add(batches):
        unzip, zip_, total, name = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress, None, None
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(unzip(z), "<i8")
                if k == name:
                    total = total + x
                    continue
                if name is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([zip_(total.tobytes())], pa.binary())], names=["piece", "counts"])
                name, total = k, x
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([zip_(total.tobytes())], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    parts = rows.select("ids").mapInArrow(run, schema).repartition(partitions(rows.sparkSession), "piece").sortWithinPartitions("piece").mapInArrow(add, schema)
    out, unzip = np.zeros(-(-n // size) * size, np.int64), zstandard.ZstdDecompressor().decompress
    for k, x in zip(*(c.to_pylist() for c in parts.toArrow().columns)):
        out[k * size : (k + 1) * size] = np.frombuffer(unzip(x), "<i8")
    return out[:n]


def learned(rows: DataFrame, units: Units, *, most: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each unit, counts of one class after another, and of each unit.

    The `most` frequent words and the groups are exchanged one by one over their bigram counts; then all other known words
    move at once to their best classes, `rounds` times, over the counts of classes before and after each.
    """
    spark, end, size = rows.sparkSession, units.size - 1, units.size
    few = min(most, units.own)
    small = few + units.groups + 1  # the frequent words, the groups (rarer known words stand for theirs) and the end
    fold = np.concatenate([np.arange(few), np.fromiter((few + group_of(w, units.groups) for w in list(units.index)[few:]), np.int64, units.own - few), few + np.arange(units.groups + 1)])
    shared, left = spark.sparkContext.broadcast(fold), None

    def pairs(chain):
        x = shared.value[chain]
        return [(0, x[:-1] * small + x[1:])]

    of = exchange(count_cells(rows, small * small, pairs, end).reshape(small, small).astype(float), classes)[fold]
    rest = np.arange(few, units.own)
    for k in range(rounds + 1):
        now = spark.sparkContext.broadcast(of)

        def beside(chain, now=now):
            c = now.value[chain]
            return [(0, chain[1:] * classes + c[:-1]), (size * classes, chain[:-1] * classes + c[1:])]

        left = right = None  # the counts of the round before
        left, right = count_cells(rows, 2 * size * classes, beside, end).reshape(2, size, classes)
        now.unpersist()
        if k == rounds or not len(rest):
            break
        of = moved(left, right, of, classes, rest)
    joint = np.zeros((classes, classes))
    np.add.at(joint.T, of, left)
    return of, joint, left.sum(1)


def score(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", own_units: int = 1000, groups: int = 509, classes: int = 48, rounds: int = 2, known_words: int = 65_536, alpha: float = 0.1, mix: float = 0.02) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one per row of docs, over whole texts.

    training: the documents to learn from, as a condition on docs or a table of their own; all their tokens are counted.
    base_score: add-alpha unigrams. score: log10 of the product over tokens of P(class | class before) * P(unit | class) *
    P(word | unit): the known_words most frequent words are units, others share one of `groups` units by their spelling, and
    exchange clustering assigns the units to classes (learned(): the own_units most frequent one by one, the others all at
    once). Transitions mix in the classes' frequency (mix), words within a group have add-alpha probabilities with a share
    for words not seen. known_words bounds what is broadcast and what the driver holds (its square nowhere: classes times
    words, and own_units + groups squared); the counts of all other words are joined by word.
    A null or empty text is the end token alone; null ids and repeated rows stay; with no training rows every
    count is 0; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    apart = isinstance(training, DataFrame)
    plain = lambda df, learn: df.select(F.monotonically_increasing_id().alias("row_key"), df[text_col].alias("text"), df[id_col].cast("long").alias("doc_id"), learn.alias("learn"))
    counts = cut(count_tokens(training if apart else docs.where(training), text_col), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(known_words).toArrow()
    top = list(zip(found.column("token").to_pylist(), found.column("c").to_pylist()))
    del found
    ends = counts.where(F.col("token") == F.lit(END)).first()
    ends = ends[1] if ends else 0
    units = Units([w for w, _ in top], groups)
    first = cut(coded(plain(docs, F.lit(False) if apart else F.coalesce(training, F.lit(False))), units), "coded")
    rows = cut(coded(plain(training, F.lit(True)), units), "training") if apart else first
    of, joint, unit_n = learned(rows.where("learn").select("ids"), units, most=own_units, classes=classes, rounds=rounds)

    # probabilities, in log10
    into = joint.sum(0)
    here = (into + alpha) / (into + alpha).sum()
    step = (1 - mix) * (joint + alpha * here) / (joint.sum(1, keepdims=True) + alpha) + mix * here
    log_step, log_emit = np.log10(step), np.log10((unit_n + alpha) / np.bincount(of, weights=unit_n + alpha, minlength=classes)[of])
    # distinct words of each group, for the share of words not seen
    grouped = np.zeros(groups, np.int64)
    shared_units = spark.sparkContext.broadcast(units)

    def kinds(batches):
        units = shared_units.value
        n = np.zeros(units.groups, np.int64)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                if w != END and w not in units.index:
                    n[group_of(w, units.groups)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(units.groups, dtype=np.int32)), pa.array(n)], names=["g", "n"])

    for g, n in counts.select("token").mapInArrow(kinds, "g int, n long").groupBy("g").agg(F.sum("n")).collect():
        grouped[g] = n
    log_base = math.log10(total + alpha * (vocabulary + 1))
    c = np.array([n for _, n in top], float)
    # what each unit adds: to the base, and to the model beside its class (a group's words add log10(count + alpha) to both by the join)
    base = np.concatenate([np.log10(c + alpha), np.zeros(groups), [math.log10(ends + alpha)]]) - log_base
    word = log_emit + np.concatenate([np.zeros(len(c)), -np.log10(unit_n[units.own : units.own + groups] + alpha * (grouped + 1)), [0.0]])
    shared = spark.sparkContext.broadcast((units.own, units.size - 1, of, log_step, base, word, ends))

    def run(batches):
        own, last, of, log_step, base, word, ends = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = np.zeros((4, len(texts)))
            for a, b in text_slices(texts, 8_000_000):
                n = np.array([len(x) // 4 + 1 for x in texts[a:b]], np.int64)
                chain = np.frombuffer(b"".join(x + last.to_bytes(4, "little") for x in texts[a:b]), "<i4")
                begin = np.cumsum(n) - n
                cls = of[chain]
                before = np.concatenate([[of[last]], cls[:-1]])  # each document's first unit follows an end
                told = log_step[before, cls] + word[chain]
                hit = (chain < own) | ((chain == last) & (ends > 0))
                out[:, a:b] = n, np.add.reduceat(hit.astype(float), begin), np.add.reduceat(base[chain], begin), np.add.reduceat(told, begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])], names=["row_key", "doc_id", "n_tokens", "n_known", "s_base", "s_model"])

    partial = "row_key long, doc_id long, n_tokens long, n_known long, s_base double, s_model double"
    told = first.where("ids is not null").select("row_key", "doc_id", "ids").mapInArrow(run, partial)
    rest = first.where("token is not null").select("row_key", "token", "times")
    of_word = counts.select(F.col("token").alias("t"), "c")
    seen = rest.join(of_word, rest["token"] == of_word["t"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_c = F.col("times") * F.log10(F.col("c") + alpha)
    more = seen.select("row_key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), log_c.alias("s_base"), log_c.alias("s_model"))
    sums = told.union(more).groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("s_base").alias("base_score"), F.sum("s_model").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
