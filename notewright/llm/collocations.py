"""Phrase collocation mining: phrases counted level by level through minimal perfect hashes of safe candidates."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, cut, drop_table, free_memory, free_shuffles, partitions, write_table

#: A byte that UTF-8 never holds stands for what ends a piece: these characters, and the end of a document.
BREAK = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
UNKNOWN = "und"
#: Text is read in stretches of so many bytes, cut at the end of a piece.
STRETCH = 4_000_000
#: Slots in one row of counts.
CHUNK = 1 << 16


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct unsigned 64-bit keys, with the keys by slot.

    At each level the keys left are hashed into twice as many places; a key alone at its place stays there, the others go
    on to the next level. Slots number the taken places in order."""

    def __init__(self, keys: np.ndarray):
        left, self.sizes, places = np.asarray(keys, np.uint64), [], []
        while len(left):
            size = 2 * len(left)
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            places.append(alone)
            left = left[~alone[at]]
        taken = np.concatenate(places) if places else np.zeros(0, bool)
        self.slots = np.where(taken, np.cumsum(taken) - 1, -1).astype(np.int32)
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self.place(np.asarray(keys, np.uint64))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((_mixed(keys, level) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that is in, any slot or -1 for others."""
        out, left, begins = np.full(len(keys), -1, np.int32), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            got = self.slots[begins + self._place(keys[left], level, size)]
            out[left] = got
            left, begins = left[got < 0], begins + size
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that aren't in: the stored key decides."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self.place(keys)
        slot[self.keys[slot] != keys] = -1
        return slot


CODED = "kind int, lang string, block long, codes binary, words binary, word binary, n long"


def code(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a stretch of one language's texts as places in its own list of words (place 0 ends a piece). Of kind 1: a task's count of a word."""

    def run(batches):
        block, counts = TaskContext.get().partitionId() << 32, defaultdict(Counter)

        def row(kind, lang, block, codes, words, word, n):
            return pa.RecordBatch.from_arrays([
                pa.array(kind, pa.int32()), pa.array(lang, pa.string()), pa.array(block, pa.int64()), pa.array(codes, pa.binary()), pa.array(words, pa.binary()), pa.array(word, pa.binary()), pa.array(n, pa.int64()),
            ], names=["kind", "lang", "block", "codes", "words", "word", "n"])

        def counted():
            for lang, c in counts.items():
                words = list(c)
                for a in range(0, len(words), 50_000):
                    some = words[a : a + 50_000]
                    nothing = [None] * len(some)
                    yield row([1] * len(some), [lang] * len(some), nothing, nothing, nothing, some, [c[w] for w in some])
            counts.clear()

        for batch in batches:
            by = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if text:
                    by[lang].append(text)
            for lang, texts in by.items():
                blob, a = BREAK.join(texts).translate(_TABLE), 0
                while a < len(blob):
                    b = blob.find(BREAK, a + STRETCH)
                    b = len(blob) if b < 0 else b
                    places = defaultdict()
                    places.default_factory = places.__len__
                    _ = places[BREAK]
                    codes = np.fromiter(map(places.__getitem__, blob[a:b].replace(BREAK, b" \xff ").split()), np.int32)
                    a = b + 1
                    words = list(places)[1:]
                    times = np.bincount(codes, minlength=len(places))[1:].tolist()
                    counts[lang].update(dict(zip(words, times)))
                    yield row([0], [lang], [block], [codes.astype("<i4").tobytes()], [BREAK.join(words)], [None], [len(words)])
                    block += 1
            if sum(map(len, counts.values())) > 1_000_000:
                yield from counted()
        yield from counted()
        free_memory()

    return docs.mapInArrow(run, CODED)


IDS = "block long, pos binary, ids binary"


class Words:
    """The slots of words of a language: a perfect hash of their XXH64, and the words themselves to tell them from others."""

    def __init__(self, names: list[bytes]):
        self.seed = 0
        while True:  # equal hashes of different words: another seed
            keys = np.array([xxhash.xxh64_intdigest(x, self.seed) for x in names], np.uint64)
            if len(np.unique(keys)) == len(keys):
                break
            self.seed += 1
        self.hash = PerfectHash(keys)
        self.names = np.empty(len(names), object)
        self.names[self.hash.place(keys)] = names

    def find(self, names: list[bytes]) -> np.ndarray:
        if not names or not len(self.hash):
            return np.full(len(names), -1, np.int32)
        slot = self.hash.find(np.array([xxhash.xxh64_intdigest(x, self.seed) for x in names], np.uint64))
        asked = np.empty(len(names), object)
        asked[:] = names
        slot[self.names[slot] != asked] = -1
        return slot


def _name(lang: str, word: bytes) -> bytes:
    return lang.encode() + BREAK + word


def _rows(batches):
    """(block, positions, ids) of rows of IDS. Without positions, ids stand for all places in turn, -1 where there is none."""
    for batch in batches:
        for block, pos, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids = np.frombuffer(ids, "<i4")
            if pos is None:
                pos = np.flatnonzero(ids >= 0).astype(np.int32)
                ids = ids[pos]
            else:
                pos = np.frombuffer(pos, "<i4")
            yield block, pos, ids


def _pairs(pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of phrases that begin one word before another one, and keys of both."""
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return pos[at], ids[at].astype(np.uint64) << np.uint64(32) | ids[at + 1].astype(np.uint64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times[:0]


def _packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys as steps, with their counts, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").reshape(-1)


def candidates(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows (bucket, n, keys): pairs of neighbouring phrases, both counted at least `least` times themselves, that can occur so often, too.

    Tasks send each pair once with its count up to `least`; a pair whose sum stays below that is dropped, and no other is."""

    def local(batches):
        keys, times, size = [], [], 0

        def merged():
            k, t = _summed(np.concatenate(keys), np.concatenate(times))
            return k, np.minimum(t, least)

        def out():
            if not size:
                return
            k, t = merged()
            bucket = (_mixed(k, 77) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                some = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[some[0]])], pa.int64()), pa.array([_packed(k[some], t[some])], pa.binary())], names=["bucket", "packed"])

        for _, pos, ids in _rows(batches):
            k = np.sort(_pairs(pos, ids)[1])
            k, t = np.unique(k, return_counts=True)
            keys.append(k)
            times.append(np.minimum(t, least))
            size += len(k)
            if size > 4_000_000:
                k, t = merged()
                keys, times, size = [k], [t], len(k)
                if size > 2_000_000:
                    yield from out()
                    keys, times, size = [], [], 0
        yield from out()
        free_memory()

    def total(batches):
        now, keys, times = None, [], []

        def out():
            if now is not None:
                k, t = _summed(np.concatenate(keys), np.concatenate(times))
                k = k[t >= least]
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(k)], pa.int64()), pa.array([k.astype("<u8").tobytes()], pa.binary())], names=["bucket", "n", "keys"])

        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    yield from out()
                    now, keys, times = bucket, [], []
                k, t = _unpacked(packed)
                keys.append(k)
                times.append(t.astype(np.int64))
        yield from out()
        free_memory()

    sent = rows.mapInArrow(local, "bucket long, packed binary")
    return sent.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(total, "bucket long, n long, keys binary")


def tree_sum(parts: DataFrame, fan: int = 32) -> DataFrame:
    """Rows (chunk, part, counts): arrays of one chunk added up, `fan` at a time, until one is left."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("chunk", "part").applyInArrow(add, "chunk long, part long, counts binary")
        left = -(-left // fan)
        if left == 1:
            return parts


COUNTED = "kind int, block long, pos binary, ids binary, chunk long, part long, counts binary"


def count(rows: DataFrame, table, offset: int) -> DataFrame:
    """Rows of kind 0: where the candidates of the perfect hash stand in a block, by number. Of kind 1: a task's counts of them, by slot."""

    def run(batches):
        hashed, part = table.value, TaskContext.get().partitionId()
        total = np.zeros(len(hashed), np.int64)

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "block", "pos", "ids", "chunk", "part", "counts"])

        for block, pos, ids in _rows(batches):
            pos, keys = _pairs(pos, ids)
            slot = hashed.find(keys)
            found = slot >= 0
            pos, slot = pos[found], slot[found]
            total += np.bincount(slot, minlength=len(total))
            if len(pos):
                yield row(0, block, pos.astype("<i4").tobytes(), (slot + offset).astype("<i4").tobytes(), None, None, None)
        for c in range(0, len(total), CHUNK):
            if total[c : c + CHUNK].any():
                yield row(1, None, None, None, c // CHUNK, part, total[c : c + CHUNK].astype("<i8").tobytes())
        free_memory()

    return rows.mapInArrow(run, COUNTED)


def by_block(rows: DataFrame) -> DataFrame:
    """Rows of IDS of several rounds as one for each block."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [(p, i) for _, p, i in _rows(table.select(["block", "pos", "ids"]).to_batches())]
        pos = np.concatenate([p for p, _ in parts])
        order = np.argsort(pos, kind="stable")
        return pa.table({"block": table.column("block").slice(0, 1), "pos": pa.array([pos[order].astype("<i4").tobytes()], pa.binary()), "ids": pa.array([np.concatenate([i for _, i in parts])[order].astype("<i4").tobytes()], pa.binary())})

    return rows.groupBy("block").applyInArrow(merge, IDS)


def _rounds(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Buckets in groups of `most` keys at most, but for a bucket larger than that, which stands alone."""
    out, size = [], most + 1
    for bucket, n in sorted(sizes):
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(bucket)
        size += n
    return out


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, shard: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words within pieces that occur min_count times or more in a language, and how many words each language has.

    First: lang, words, a, pre (counts of its first 1, 2, ... words), suf (of its last ones), longer (the highest count of a phrase of one
    more word around it, null without one). Second: lang, n. See `collocations`.

    A phrase can only be so frequent if both phrases of one word less are. So each level's candidates are pairs of neighbouring
    ones of the level before; their perfect hash goes to all tasks, `shard` candidates at a time (more take more rounds over the
    coded text), which count into arrays by slot; the arrays are added up in a tree. What a driver or a worker holds
    is bounded by `shard`, and a stretch of text.
    """
    spark = docs.sparkSession
    ready = docs.select(F.coalesce(docs[lang_col], F.lit(UNKNOWN)).alias("lang"), docs[text_col].alias("text"))
    coded_at = write_table(code(ready), "coded")
    coded = spark.read.schema(CODED).parquet(coded_at)
    words = coded.where("kind = 1").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = cut(words, "words")
    sizes = cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    often = words.where(F.col("f") >= min_count)
    n_words, n_often = (sizes.agg(F.sum("n")).first()[0] or 0), often.count()
    rounds = max(1, -(-n_often // shard))
    level, rows, offset = [], [], 0
    for k in range(rounds):
        mine = often.where(F.pmod(F.xxhash64("lang", "word"), F.lit(rounds)) == k)
        known = Words([_name(r["lang"], bytes(r["word"])) for r in mine.select("lang", "word").collect()])
        shared = spark.sparkContext.broadcast(known)

        def numbered(batches, shared=shared, offset=offset):
            for batch in batches:
                got = batch.to_pydict()
                slot = shared.value.find([_name(x, w) for x, w in zip(got["lang"], got["word"])])
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64) + offset), batch.column(0), pa.array([w.decode() for w in got["word"]], pa.string()), batch.column(2)], names=["id", "lang", "word", "f"])

        def placed(batches, shared=shared, offset=offset):
            for batch in batches:
                for lang, block, codes, text, n in zip(*(batch.column(c).to_pylist() for c in range(5))):
                    slot = shared.value.find([_name(lang, w) for w in text.split(BREAK)] if n else [])
                    ids = np.concatenate([[-1], np.where(slot >= 0, slot + offset, -1)]).astype("<i4")[np.frombuffer(codes, "<i4")]
                    pos = np.flatnonzero(ids >= 0).astype("<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([None if rounds == 1 else pos.tobytes()], pa.binary()), pa.array([(ids if rounds == 1 else ids[pos]).tobytes()], pa.binary())], names=["block", "pos", "ids"])
            free_memory()

        level.append(cut(mine.select("lang", "word", "f").mapInArrow(numbered, "id long, lang string, word string, f long"), "level"))
        rows.append(write_table(coded.where("kind = 0").select("lang", "block", "codes", "words", "n").mapInArrow(placed, IDS), "ids"))
        offset += len(known.hash)
    drop_table(spark, coded_at)
    levels = [_union(level).select("id", "lang", F.array("word").alias("words"), F.col("f").alias("a"), F.array("f").alias("pre"), F.array("f").alias("suf"))]
    current = spark.read.schema(IDS).parquet(*rows) if rounds == 1 else by_block(spark.read.schema(IDS).parquet(*rows))
    links = []
    for _ in range(2, longest + 1):
        found = cut(candidates(current, min_count, max(4 * partitions(spark), n_words // 1_000_000)), "candidates")
        groups = _rounds([(r["bucket"], r["n"]) for r in found.select("bucket", "n").collect()], shard)
        paths, tables, offset = [], [], 0
        for group in groups:
            mine = found.where(F.col("bucket").isin(group)) if len(groups) > 1 else found
            hashed = PerfectHash(np.concatenate([np.frombuffer(bytes(r["keys"]), "<u8") for r in mine.select("keys").collect()]))
            path = write_table(count(current, spark.sparkContext.broadcast(hashed), offset), "counted")
            summed = tree_sum(spark.read.schema(COUNTED).parquet(path).where("kind = 1").select("chunk", "part", "counts"))
            counts = np.zeros(len(hashed), np.int64)
            for r in summed.collect():
                part = np.frombuffer(bytes(r["counts"]), "<i8")
                counts[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
            shared = spark.sparkContext.broadcast((hashed, counts))

            def read(batches, shared=shared, offset=offset):
                hashed, counts = shared.value
                for batch in batches:
                    for keys in batch.column(0).to_pylist():
                        keys = np.frombuffer(keys, "<u8")
                        slot = hashed.find(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64) + offset), pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts[slot])], names=["id", "prefix", "suffix", "f"])

            tables.append(cut(mine.select("keys").mapInArrow(read, "id long, prefix long, suffix long, f long").where(F.col("f") >= min_count), "level"))
            paths.append(path)
            offset += len(hashed)
        for path in rows:
            drop_table(spark, path)
        free_shuffles(spark)
        if not groups:
            rows = []
            break
        rows = paths
        current = spark.read.schema(COUNTED).parquet(*paths).where("kind = 0").select("block", "pos", "ids")
        current = current if len(groups) == 1 else by_block(current)
        link, below = _union(tables), levels[-1]
        left = below.select(F.col("id").alias("prefix"), "lang", F.col("words").alias("_words"), F.col("pre").alias("_pre"))
        right = below.select(F.col("id").alias("suffix"), F.element_at("words", -1).alias("_last"), F.col("suf").alias("_suf"))
        joined = link.join(left, "prefix").join(right, "suffix")
        links.append(link)
        levels.append(cut(joined.select("id", "lang", F.concat("_words", F.array("_last")).alias("words"), F.col("f").alias("a"), F.concat("_pre", F.array("f")).alias("pre"), F.concat("_suf", F.array("f")).alias("suf")), "phrases"))
    for path in rows:
        drop_table(spark, path)
    out = []
    for k, level in enumerate(levels):
        if k < len(links):
            around = links[k].select(F.explode(F.array("prefix", "suffix")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            level = level.join(around, "id", "left")
        else:
            level = level.withColumn("longer", F.lit(None).cast("long"))
        out.append(level.drop("id"))
    return _union(out), sizes


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, shard: int = 2_000_000) -> DataFrame:
    """The first `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at `. , ; : ! ?` and line ends, and into words at spaces and tabs. A phrase of
    2 to `longest` words that occurs a >= min_count times within pieces of a language is a candidate. A cut after its first
    k words scores floor(1000 a n / (l r)), with l and r the counts of both parts and n that of all words; the lowest cut counts, ties to the
    smallest k. Candidates inside a longer one with 100 f(longer) >= percent * a are left out. Products are decimals of 38
    digits. Ties in score: higher a, then the phrase in byte order. A null language is 'und', a null text empty; repeated rows
    count again; ids are not read; an empty table gives no rows. A piece without an end is read whole, so a text of one endless
    piece has to fit in a worker.
    """
    found, sizes = phrases(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, longest=longest, shard=shard)
    big = lambda c: c.cast("decimal(19,0)")
    kept = found.where(F.size("words") > 1).where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    kept = kept.withColumn("above", big(1000 * F.col("a")) * big(F.col("n")))
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(k.alias("k"), F.element_at("pre", k).alias("l"), F.element_at("suf", F.size("words") - k).alias("r")),
    )
    scored = F.expr("transform(cuts, c -> struct(above div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))) as score, c.k as k, c.l as l, c.r as r))")
    best = kept.withColumn("cuts", cuts).withColumn("best", F.array_min(scored)).select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
