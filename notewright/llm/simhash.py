"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORDS, as_bytes, batches_of, cut, drop_table, free_memory, free_shuffles, partitions, write_table
from .graph import components

#: Buckets of more fingerprints are linked through balls() instead of pair by pair.
BUCKET = 64


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of so many lower-cased words, repeats included; of the whole sequence if it is shorter."""
    w = WORDS.findall((text or b"").translate(LOWER))
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), 42)], np.uint64)
    return np.array([h(s, 42) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; none: zero."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): a signed long whose bits are the fingerprint's. A null text counts as empty."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def variants(fps: DataFrame, segments: int) -> DataFrame:
    """(key, fp): for each segment and each of its positions the segment with that bit as a wildcard.

    With s segments, fingerprints that differ in at most 2 s - 1 bits have a segment that differs in at most
    one, and so share a key. key: the segment's value without the bit, the position and the segment.
    """
    width = 64 // segments
    every = F.explode(F.expr(f"sequence(0, {64 - 1})")).alias("bit")
    rows = fps.select("fp", every)
    return rows.select(F.expr(f"((shiftrightunsigned(fp, cast(bit div {width} as int) * {width}) & {(1 << width) - 1 if width < 64 else -1}L) & ~shiftleft(1L, cast(bit % {width} as int))) * 64 + bit").alias("key"), "fp")


def _pairs(radius: int, segments: int, bucket: int):
    """Over rows sorted by (key, fp): links within small buckets, and the members (hot) of larger ones.

    A pair that meets in several buckets is told only in one: the first segment that differs in at most one
    bit, at the position of that bit, or at the segment's first if none differs.
    """
    width = 64 // segments
    mask = np.uint64((1 << width) - 1)

    def told(key, a, b):
        bit = key & 63
        diff = a ^ b
        near = _bits(diff) <= radius
        key, a, b, bit, diff = key[near], a[near], b[near], bit[near], diff[near].view(np.uint64)
        seg, first = bit // width, np.full(len(bit), -1)
        for s in reversed(range(segments)):
            part = diff >> np.uint64(s * width) & mask
            n = np.bitwise_count(part)
            at = np.where(n == 1, np.bitwise_count(part - np.uint64(1)), 0)
            first = np.where(n <= 1, s * width + at, first)
        mine = first == bit
        return a[mine], b[mine]

    def judge(keys, fps):
        """Links, and hot members as (fp, fp), of rows whose runs are complete."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        big = np.repeat(sizes > bucket, sizes)
        hot = fps[big]
        k, f = keys[~big], fps[~big]
        us, vs = [], []
        for d in range(1, bucket):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            a, b = told(k[same], f[same], f[same + d])
            us.append(a)
            vs.append(b)
        return np.concatenate([*us, hot]) if us or len(hot) else np.empty(0, np.int64), np.concatenate([*vs, hot]) if vs or len(hot) else np.empty(0, np.int64)

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    def run(batches):
        keep_k, keep_f, long_run = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in batches:
            k = np.concatenate([keep_k, batch.column(0).to_numpy()])
            f = np.concatenate([keep_f, batch.column(1).to_numpy()])
            if not len(k):
                continue
            last = len(k) - int((k == k[-1]).sum())
            if long_run and k[0] == keep_k[0]:  # more of a run whose first members were told as hot
                end = int(np.searchsorted(k, k[0], "right"))
                yield out(f[1:end], f[1:end])
                if end == len(k):
                    keep_k, keep_f = k[:1], f[:1]
                    continue
                k, f, last, long_run = k[end:], f[end:], last - end, False
            elif long_run:
                k, f, last, long_run = k[1:], f[1:], last - 1, False
            yield out(*judge(k[:last], f[:last]))
            keep_k, keep_f = k[last:], f[last:]
            if len(keep_k) > bucket:
                yield out(keep_f, keep_f)
                keep_k, keep_f, long_run = keep_k[:1], keep_f[:1], True
        if len(keep_k) and not long_run:
            yield out(*judge(keep_k, keep_f))
        free_memory()

    return run


def balls(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join what differs in at most two bits, without a pair for each.

    A fingerprint is listed under itself and under each of the 64 that differ from it in one bit. Those listed
    under the same value are within two bits of each other, so a star of each list links them all; and whatever
    is within two bits shares a list. A list holds 65 fingerprints at most.
    """
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    listed = fps.select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return listed.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between different fingerprints: the same components as all pairs within radius bits.

    radius 2 or less keeps to two segments of 32 bits.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2")
    rows = variants(fps, 2).repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    found = cut(rows.mapInArrow(_pairs(radius, 2, BUCKET), "u long, v long"), "links")
    near = found.where("u <> v")
    hot = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    return near.union(balls(hot) if radius == 2 else balls(hot).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id: the smallest id reachable over fingerprints that differ in at most radius bits. Equal
    fingerprints are one node, so copies make no pairs. Null and empty texts, and texts without words, have
    fingerprint zero and are linked like any other. A null id stays null and does not become a component's id
    unless all of it are null; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    found = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    of = named.join(smallest, named["root"] == smallest["r"]).select(F.col("fp").alias("f"), "component_id")
    return found.join(of, found["fp"] == of["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: groups(): shingles of about so many documents are counted to tell the frequent ones ...
SAMPLE = 20_000
#: ... of which at most so many are known by name; a choice of order alone, which changes no result.
FREQUENT = 200_000
#: Buckets of more texts are dealt to pairs of blocks of about so many.
BLOCK = 4096
#: Keys of so many texts or fewer that the same texts share are one.
ALIKE = 64
#: Before all pairs of a bucket of more texts than this are looked at, it is dealt at random into parts of about so many, whose pairs come first.
PARTS = (64, 512, 4096)
#: Bits of parities() at most.
WIDEST = 4096
#: Rows with texts or whole sets of shingles that a worker gets at once.
WIDE_ROWS = 1000


def frequent(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and the rank of each by frequency, out of a sample of the different texts."""

    def run(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["h"])
        free_memory()

    every = max(1, docs.count() // SAMPLE)
    texts = docs.select(docs[text_col].alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    with batches_of(docs.sparkSession, WIDE_ROWS):
        top = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)[::-1]
    order = np.argsort(h)
    return h[order], order


def prefix(h: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the different sorted hashes h, frequent ones last: sets of this Jaccard similarity share one of them."""
    least = int(np.ceil(similarity * len(h) - 1e-9))  # so many of h the other set has too
    names, ranks = known
    if len(names):
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        hot = names[at] == h
        h = np.concatenate([h[~hot], h[hot][np.argsort(ranks[at[hot]])]])
    return h[: len(h) - least + 1] if len(h) else h


def parities(h: np.ndarray) -> bytes:
    """Bits (about as many as hashes, 256 to WIDEST): whether an odd number of the hashes falls on each. Sets differ in as many elements at least as these in bits."""
    n = min(max(256, 1 << (len(h) - 1).bit_length() if len(h) else 256), WIDEST)
    return np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def folded(odd: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of parities(), a row each: the bits at full width and at half of it (as 64-bit numbers, padded with zeros), at 256 bits, and the width.

    A half is the exclusive or of both halves, which is what parities() of half the width gives.
    """
    words = np.array([len(x) // 8 for x in odd], np.int64)
    full = np.zeros((len(odd), WIDEST // 64), np.uint64)
    half, least = full.copy(), np.zeros((len(odd), 4), np.uint64)
    for n in np.unique(words):
        at = np.flatnonzero(words == n)
        x = np.frombuffer(b"".join(odd[k] for k in at), np.uint64).reshape(-1, n)
        full[at, :n] = x
        if n > 4:
            half[at, : n // 2] = x[:, : n // 2] ^ x[:, n // 2 :]
        while x.shape[1] > 4:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        least[at] = x
    return full, half, least, words


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words: int, similarity: float) -> tuple[str, DataFrame, DataFrame]:
    """The path of two tables, and these: (row, doc_id, md5, size, fp, shingles, odd), with fingerprint(), the number and sorted 32-bit hashes of the different shingles, parities(); and (row, size, prefix), with prefix() in full."""
    import hashlib

    spark = docs.sparkSession
    known = frequent(docs, text_col, words)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            md5, size, fp, sh, pre, odd = [], [], [], [], [], []
            for t in as_bytes(batch.column(2)):
                md5.append(hashlib.md5(t or b"").digest())
                every = shingle_hashes(t, words)
                fp.append(fingerprint(every))
                h = np.unique(every)
                size.append(len(h))
                sh.append(np.unique(h >> np.uint64(32)).astype("<u4").tobytes())
                pre.append(prefix(h, known, similarity).tobytes())
                odd.append(parities(h))
            row, doc, size = batch.column(0), batch.column(1), pa.array(size, pa.int32())
            none = pa.nulls(n, pa.binary())
            names = ["first", "row", "doc_id", "md5", "size", "fp", "shingles", "odd", "prefix"]
            yield pa.RecordBatch.from_arrays([pa.array([False] * n), row, doc, pa.array(md5, pa.binary()), size, pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sh, pa.binary()), pa.array(odd, pa.binary()), none], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([True] * n), row, pa.nulls(n, pa.int64()), none, size, pa.nulls(n, pa.int64()), none, none, pa.array(pre, pa.binary())], names=names)
        free_memory()

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    made = keyed.mapInArrow(run, "first boolean, row long, doc_id long, md5 binary, size int, fp long, shingles binary, odd binary, prefix binary")
    with batches_of(spark, WIDE_ROWS):
        path = write_table(made, "signatures", parts=["first"])
    read = lambda first, columns: spark.read.schema(columns).parquet(f"{path}/first={first}")
    if docs.isEmpty():
        return path, *(spark.createDataFrame([], c) for c in (SIGNATURE, PREFIX))
    return path, read("false", SIGNATURE), read("true", PREFIX)


SIGNATURE, PREFIX = "row long, doc_id long, md5 binary, size int, fp long, shingles binary, odd binary", "row long, size int, prefix binary"


def _keys(batches):
    """A row (key, node, size, place) for each hash of a node's prefix."""
    for whole in batches:
        for at in range(0, whole.num_rows, WIDE_ROWS):
            batch = whole.slice(at, WIDE_ROWS)
            node, size, pre = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            n = np.array([len(p) // 8 for p in pre], np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.frombuffer(b"".join(pre), np.int64), np.repeat(node, n), np.repeat(size, n).astype(np.int32), place.astype(np.int32))], names=["key", "node", "size", "place"])
    free_memory()


def _reach(similarity: float, na, ia, nb, ib) -> np.ndarray:
    """Whether sets of na and nb elements whose first common one has the places ia and ib can be so similar."""
    return np.minimum(na - ia, nb - ib) >= similarity / (1 + similarity) * (na + nb) - 1e-9


def _shared(similarity: float):
    """Over rows sorted by (key, node): those whose key has several, and lead, the key's first node, or -1 if the two can't be similar here."""

    def run(batches):
        held, first = np.empty((4, 0), np.int64), None  # the last row, and the first of its key if that is out already

        def out(rows, lead):
            a = (similarity, rows[2], rows[3], lead[2], lead[3])
            ok = (rows[1] != lead[1]) & _reach(*a)
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(rows[3].astype(np.int32)), pa.array(np.where(ok, lead[1], -1))], names=["key", "node", "size", "place", "lead"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            n = rows.shape[1]
            if not n:
                continue
            again = np.concatenate([[False], rows[0, 1:] == rows[0, :-1]])
            start = np.maximum.accumulate(np.where(again, 0, np.arange(n)))
            lead = rows[:, start]
            if first is not None:
                lead[:, start == 0] = first[:, None]
                again[0] = True
            keep = np.flatnonzero((again | np.concatenate([again[1:], [False]]))[:-1])
            yield out(rows[:, keep], lead[:, keep])
            held, first = rows[:, -1:], lead[:, -1] if again[-1] else None
        if first is not None:
            yield out(held, first[:, None])
        free_memory()

    return run


def _across(similarity: float, most: int = 500_000):
    """Over rows sorted by (key, lo, hi, size): pairs of different groups that can reach the similarity.

    Lossless: similar sets pass by size, by the places of their first common shingle, and by parities.
    """

    def run(batches):
        held, bits = None, ()

        def out(us, vs):
            pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["u", "v"])

        def near(a, b, size, odd):
            """Which pairs (a smaller than b) the parities leave: those of 256 bits, then those of a's whole width, which is b's or half of it."""
            full, half, least, words = odd
            most = (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-9
            ok = np.flatnonzero(np.bitwise_count(least[a] ^ least[b]).sum(1, dtype=np.int64) <= most)
            out = np.zeros(len(a), bool)
            for x in range(0, len(ok), 1 << 12):
                k = ok[x : x + (1 << 12)]
                same, fold = words[a[k]] == words[b[k]], 2 * words[a[k]] == words[b[k]]
                other = np.where(same[:, None], full[b[k]], half[b[k]])
                out[k] = ~(same | fold) | (np.bitwise_count(full[a[k]] ^ other).sum(1, dtype=np.int64) <= most[k])
            return out

        def judge(r, odd):
            key, lo, hi, block, node, root, size, place = r
            us, vs, n, live, d = [], [], 0, np.arange(len(key)), 0
            while len(live):
                d += 1
                live = live[live + d < len(key)]
                a, b = live, live + d
                same = (key[a] == key[b]) & (lo[a] == lo[b]) & (hi[a] == hi[b]) & (size[a] >= similarity * size[b] - 1e-9)
                live = live[same]
                a, b = live, live + d
                ok = (root[a] != root[b]) & ((lo[a] == hi[a]) | (block[a] != block[b])) & _reach(similarity, size[a], place[a], size[b], place[b])
                a, b = a[ok], b[ok]
                ok = near(a, b, size, odd)
                a, b = node[a[ok]], node[b[ok]]
                us.append(np.minimum(a, b))
                vs.append(np.maximum(a, b))
                n += len(a)
                if n > most:
                    yield out(us, vs)
                    us, vs, n = [], [], 0
            yield out(us, vs)

        for batch in batches:
            if not batch.num_rows:
                continue
            r, odd = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:8]]), folded(batch.column(8).to_pylist())
            if held is not None:
                r, odd = np.concatenate([held, r], axis=1), tuple(map(np.concatenate, zip(bits, odd)))
            new = np.flatnonzero((r[:3, 1:] != r[:3, :-1]).any(0))
            end = int(new[-1]) + 1 if len(new) else 0
            if end:
                yield from judge(r[:, :end], tuple(x[:end] for x in odd))
            held, bits = r[:, end:], tuple(x[end:] for x in odd)
        if held is not None and held.shape[1]:
            yield from judge(held, bits)
        held, bits = None, ()
        free_memory()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity at least."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) and bool(both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])
        free_memory()

    a, b = (texts.select(F.col("node").alias(f"{x}n"), F.col("shingles").alias(f"{x}s")) for x in "ab")
    return pairs.join(a, pairs["u"] == a["an"]).join(b, F.col("v") == b["bn"]).select("u", "v", "as", "bs").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, md5, group, kept): near-duplicate groups by verified links; kept marks the smallest id of each.

    Candidates are links() of the fingerprints of shingles, verified. These alone lose pairs at this similarity, so the
    rest is found in an exact way: the groups are those of all pairs whose sets of shingles have the Jaccard similarity.
    Every such pair shares a shingle of its prefixes (the first fifth of a set at similarity 0.8, in one order for all
    texts). Each text is looked at first with the first ones of its buckets; then all pairs of each bucket whose groups
    still differ; keys that the same few texts share are one bucket, that of the first of them. Copies are one node. Null is the empty text; texts without
    words are grouped as copies alone; the smallest id is kept, null ids last, and of repeated rows the first.
    """
    spark = docs.sparkSession
    path, sig, first = signatures(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    nodes = cut(sig.groupBy("md5").agg(F.min("row").alias("node")), "nodes")
    of_node = nodes.select("node").join(sig.drop("md5", "doc_id"), F.col("node") == F.col("row"))
    texts = of_node.select("node", "shingles")

    held: dict[str, list[str]] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        """As cut(); done(name) removes the table."""
        held.setdefault(name, []).append(write_table(df, name))
        return spark.read.schema(df.schema).parquet(held[name][-1])

    def done(*names: str) -> None:
        for name in names:
            for path in held.pop(name, []):
                drop_table(spark, path)
        free_shuffles(spark)

    rows = nodes.select("node").join(first, F.col("node") == F.col("row")).select("node", "size", "prefix").mapInArrow(_keys, "key long, node long, size int, place int")
    met = keep(rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "node").mapInArrow(_shared(similarity), "key long, node long, size int, place int, lead long"), "met")
    del rows, first
    drop_table(spark, f"{path}/first=true")
    free_shuffles(spark)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        a, b = (roots.select(F.col("node").alias(f"{x}n"), F.col("root").alias(f"{x}r")) for x in "ab")
        named = pairs.join(a, pairs["u"] == a["an"], "left").join(b, F.col("v") == b["bn"], "left")
        return named.where(F.coalesce("ar", "u") != F.coalesce("br", "v")).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        with batches_of(spark, WIDE_ROWS):
            out = keep(_verified(pairs, texts, similarity), "verified")
        free_shuffles(spark)
        return out

    # near fingerprints; of one fingerprint's texts the first stands for it
    prints = keep(of_node.where("size > 0").select("node", F.col("fp").alias("f")), "prints")
    stands = prints.groupBy(F.col("f").alias("s")).agg(F.min("node").alias("u"))
    equal = prints.join(stands, F.col("f") == F.col("s")).where("node <> u").select("u", F.col("node").alias("v"))
    pairs = links(stands.select(F.col("s").alias("fp")))
    a, b = (stands.select(F.col("s").alias(f"{x}f"), F.col("u").alias(x)) for x in "ab")
    close = pairs.join(a, pairs["u"] == a["af"]).join(b, F.col("v") == b["bf"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    linked = verified(keep(equal.union(close).distinct(), "prints"))
    done("prints")
    led = keep(apart(met.where("lead >= 0").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), components(linked)), "led")
    linked = linked.union(verified(led.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")))
    linked = linked.union(verified(apart(led, components(linked))))
    roots = cut(components(linked), "roots")

    def mixed(rows: DataFrame, *before: str) -> DataFrame:
        """The rows of buckets that still hold several groups, with their groups and the bucket's size; the tables before it go."""
        named = keep(rows.join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select("key", "node", "size", "place", F.coalesce("root", "node").alias("group")), "named")
        done(*before)
        of = named.groupBy(F.col("key").alias("mk")).agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
        out = keep(named.join(of, named["key"] == of["mk"]).select("key", "node", "size", "place", F.col("group").alias("root"), "n"), "mixed")
        del named, of
        done("named")
        return out

    odd = of_node.select(F.col("node").alias("o"), "odd")

    def across(dealt: DataFrame) -> DataFrame:
        """The verified ones of all pairs of each (key, block, other)."""
        ready = dealt.join(odd, dealt["node"] == odd["o"]).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "size", "place", "odd")
        found = ready.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "size", "node").mapInArrow(_across(similarity), "u long, v long")
        with batches_of(spark, WIDE_ROWS):
            pairs = keep(found.distinct(), "across")
        out = verified(pairs)
        del ready, found, pairs
        done("across")
        return out

    several = mixed(met, "met", "led")
    del met
    # large buckets in parts; powers of two, so that texts that meet in many buckets meet in the same parts
    for most in PARTS:
        large = several.where(F.col("n") > most)
        if not large.isEmpty():
            linked = linked.union(across(large.withColumn("block", F.expr(f"pmod(xxhash64(node, {most}), shiftleft(1L, cast(ceil(log2(n / {most})) as int)))")).withColumn("other", F.col("block"))))
            roots = cut(components(linked), "roots")
            several = mixed(several.drop("root", "n"), "mixed")
        del large
    # every bucket that still holds several groups, a large one in pairs of blocks
    several = several.withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    member = F.struct("node", "size", "place", "root")
    few = several.where(f"n <= {ALIKE}").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("all"))
    few = few.groupBy(F.transform("all", lambda m: m["node"]).alias("nodes")).agg(F.min_by(F.struct("key", "all"), F.col("all")[0]["place"]).alias("b"))
    few = few.select(F.col("b.key").alias("key"), F.explode("b.all").alias("m")).select("key", "m.*", F.lit(1).cast("long").alias("blocks"))
    buckets = few.union(several.where(f"n > {ALIKE}").select("key", "node", "size", "place", "root", "blocks"))
    linked = linked.union(across(buckets.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))))
    del several, few, buckets
    roots = components(linked)
    done("mixed", "verified")
    named = nodes.select("md5", "node").join(roots.withColumnRenamed("node", "rn"), F.col("node") == F.col("rn"), "left").select(F.col("md5").alias("m"), F.coalesce("root", "node").alias("group"))
    every = sig.select("row", "doc_id", "md5").join(named, F.col("md5") == F.col("m")).select("row", "doc_id", "md5", "group")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = every.groupBy(F.col("group").alias("g")).agg(F.min_by("row", order).alias("first"))
    return every.join(first, every["group"] == first["g"]).select("row", "doc_id", "md5", "group", (F.col("row") == F.col("first")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that groups() keeps, with the columns of docs alone; of equal rows one."""
    found = cut(groups(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity).select("doc_id", "md5", "kept"), "groups")
    mine, hashed = (next(n + "_" * k for k in range(1, 99) if n + "_" * k not in docs.columns) for n in ("id", "md5"))
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id__"), F.col("md5").alias("kept_md5__"))
    named = docs.withColumns({mine: docs[id_col].cast("long"), hashed: F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")))})
    out = named.join(kept, named[hashed].eqNullSafe(kept["kept_md5__"]) & named[mine].eqNullSafe(kept["kept_id__"]), "left_semi")
    if not found.groupBy("doc_id", "md5").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # repeated rows
        out = out.dropDuplicates([mine, hashed])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
