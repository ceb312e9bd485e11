"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The items' shingles, and their blocks, are broadcast up to so many rows; more are joined by shuffles.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of anything but ASCII white space."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[\\x20\\x09-\\x0D]+"), "")


def shingles(words: str, k: int, step: int = 1) -> Column:
    """Hashes of the k-word shingles at every step-th position; fewer words give none."""
    return F.expr(f"case when size({words}) >= {k} then transform(sequence(1, size({words}) - {k - 1}, {step}), i -> xxhash64(slice({words}, i, {k}))) else array() end")


_LOW = (1 << 32) + 1


def _bits(sums: list[str], n: str) -> str:
    """64 bits out of 32 sums of two counters each: a bit is set if its counter is over half of n."""
    return " | ".join(f"case when 2 * ({s} & 4294967295L) > {n} then {1 << b}L else 0L end | case when 2 * shiftrightunsigned({s}, 32) > {n} then shiftleft(1L, {b + 32}) else 0L end" for b, s in enumerate(sums))


def _fingerprint(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """64 bits, each set if it is set in over half the hashes. Two counters of 32 bits are added at a time."""
    df = df.withColumns({f"{out}{b}": F.expr(f"aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, {b}) & {_LOW}L))") for b in range(32)})
    return df.withColumn(out, F.expr(_bits([f"{out}{b}" for b in range(32)], f"size({hashes})"))).drop(*(f"{out}{b}" for b in range(32)))


def _window_fingerprints(cand: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (row, m, s, e) with fp, of the hashes from s to before e, by differences of running sums: a step for each word and window.

    The ends of the windows stand among the words of their document, so only these few rows leave the running sums."""
    kept = cand.join(windows.select("row").distinct(), "row", "left_semi")
    none = {c: F.lit(None).cast("int") for c in ("m", "s", "e", "sign")}
    words = kept.select("row", F.posexplode("h").alias("p", "x")).withColumns(none)
    ends = windows.select("row", "m", "s", "e", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(-1).alias("sign")), F.struct(F.col("e").alias("p"), F.lit(1).alias("sign")))).alias("z"))
    ends = ends.select("row", F.col("z.p").alias("p"), F.lit(0).cast("long").alias("x"), "m", "s", "e", F.col("z.sign").alias("sign"))
    upto = Window.partitionBy("row").orderBy("p", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # an end comes before its word
    line = words.unionByName(ends).withColumns({f"c{b}": F.sum(F.expr(f"shiftrightunsigned(x, {b}) & {_LOW}L")).over(upto) for b in range(32)}).where("sign is not null")
    sums = line.groupBy("row", "m", "s", "e").agg(*(F.sum(F.col("sign") * F.col(f"c{b}")).alias(f"c{b}") for b in range(32)))
    return sums.select("row", "m", "s", "e", F.expr(_bits([f"c{b}" for b in range(32)], "(e - s)")).alias("fp"))


def _edges(radius: int) -> list[tuple[int, int]]:
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def _part(fp: str, a: int, b: int) -> str:
    return f"(shiftrightunsigned({fp}, {a}) & {(1 << b - a) - 1}L)"


def _blocks(df: DataFrame, fp: str, radius: int) -> DataFrame:
    """A row for each of radius + 1 blocks of bits: fingerprints within the radius agree on one block at least."""
    parts = ", ".join(_part(fp, a, b) for a, b in _edges(radius))
    return df.select("*", F.posexplode(F.expr(f"array({parts})")).alias("block", "value"))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of a document for each item that it repeats.

    A window has as many words as the item (fewer at a document's end). Its similarity is the weighted Jaccard
    similarity of shingles of `words` words, the weight being how often a shingle occurs; an item of fewer
    words is one shingle. Windows that can reach the similarity are found without loss: of an item with m
    shingles they hold 0.8 m at least and miss m / 9 at most, so a sparse sample of the document's positions
    hits one, and the first hit of the window is within m / 9 of its start. The windows' SimHash fingerprints meet
    those of all items of their size in Hamming blocks, which miss no pair within the radius, and what is within it
    is compared exactly. (At similarity 0.8 fingerprints differ in 9.7 bits of 64 on average, with deviation 2.9: the
    radius of 24 is 4.9 deviations off; a test measures what it loses.) Work is in proportion to the words of the
    documents that pass the sample, to the hits, and to the windows, however long an item is.
    Texts that are null or empty match nothing, nor do such items; every repeated row of docs has rows of its own;
    rows with a null id keep it; ties go to the earliest window; empty tables give no rows; other columns are not read.
    """
    items = benchmark.select(benchmark[item_col].alias("item_id"), words_of(benchmark[item_text]).alias("iw")).where("size(iw) > 0")
    items = items.withColumn("k", F.least(F.size("iw"), F.lit(words)))
    widths = [r[0] for r in items.select("k").distinct().collect()]  # `words` rows at most
    base = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(docs[text_col]).alias("w"))
    out = None
    for k in sorted(widths):
        found = _width(base, items.where(F.col("k") == k).drop("k"), k, similarity, radius)
        out = found if out is None else out.union(found)
    return out if out is not None else base.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))


def _width(base: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    items = items.withColumn("ih", shingles("iw", k)).withColumn("m", F.size("ih")).drop("iw")
    items = cut(_fingerprint(items, "ih", "ifp"), "items")
    least, miss = similarity, (1 - similarity) / (1 + similarity)
    # the sparsest sample of positions that no window can slip through
    steps = range(1, 9)
    ok = items.agg(*(F.min(F.floor(F.floor(F.lit(least) * F.col("m")) / q) > F.floor(F.lit(miss) * F.col("m"))).alias(f"q{q}") for q in steps)).first()
    step = max((q for q in steps if ok[f"q{q}"]), default=1)
    of_item = items.select("item_id", "m", F.explode("ih").alias("h")).groupBy("item_id", "m", "h").agg(F.count("*").cast("int").alias("times"))
    distinct = of_item.select("h").distinct()
    n_shingles, n_items = items.agg(F.sum("m"), F.count("*")).first()
    sized = lambda d, n=n_shingles: F.broadcast(d) if n <= BROADCAST_ROWS else d

    sampled = base.select("row", "doc_id", "w", F.explode(shingles("w", k, step)).alias("h"))
    hit = sampled.join(sized(distinct), "h", "left_semi").select("row", "doc_id", "w").dropDuplicates(["row"])
    cand = cut(hit.withColumn("h", shingles("w", k)).drop("w"), "candidates")

    # where windows of an item's size can reach the similarity
    every = cand.select("row", F.posexplode("h").alias("p", "h"))
    hits = cut(every.join(sized(of_item), "h").groupBy("row", "item_id", "m", "h", "times").agg(F.sort_array(F.collect_list("p")).alias("ps")), "hits")
    need, lost = f"cast(ceil({least} * m - 1e-9) as int)", f"cast(floor({miss} * m + 1e-9) as int)"
    dense = hits.groupBy("row", "item_id", "m").agg(F.sort_array(F.flatten(F.collect_list("ps"))).alias("ps"))
    dense = dense.withColumn("ps", F.expr(f"filter(ps, (x, i) -> get(ps, i + {need} - 1) - x < m)")).where("size(ps) > 0")
    starts = dense.select("row", "m", F.explode(F.expr(f"flatten(transform(ps, (x, i) -> sequence(greatest(x - {lost}, coalesce(get(ps, i - 1) + 1, 0)), x)))")).alias("s")).distinct()
    sizes = cand.select("row", F.size("h").alias("n"))
    windows = cut(_window_fingerprints(cand, starts.join(sizes, "row").select("row", "m", "s", F.least(F.col("s") + F.col("m"), "n").alias("e"))), "windows")

    # fingerprints of one size meet in blocks; each pair is told in the first block it agrees on
    left = _blocks(windows.select("m", "fp").distinct(), "fp", radius)
    right = _blocks(items.select("item_id", F.col("m").alias("im"), "ifp"), "ifp", radius).withColumnsRenamed({"block": "iblock", "value": "ivalue"})
    first = "case " + " ".join(f"when {_part('(fp ^ ifp)', a, b)} = 0 then {n}" for n, (a, b) in enumerate(_edges(radius))) + " end"
    met = left.join(sized(right, n_items * (radius + 1)), (F.col("m") == F.col("im")) & (F.col("block") == F.col("iblock")) & (F.col("value") == F.col("ivalue")))
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).where(F.expr(first) == F.col("block")).select("item_id", F.col("m").alias("nm"), F.col("fp").alias("nfp"))
    pairs = windows.join(near, (F.col("m") == F.col("nm")) & (F.col("fp") == F.col("nfp"))).select("row", "item_id", "m", "s", "e")

    # Exact: a hit at p counts for the windows that hold it and hold fewer than `times` of its hash before it,
    # so overlaps are running sums of where such ranges of starts begin (+1) and end (-1).
    found = hits.join(pairs.select("row", "item_id").distinct(), ["row", "item_id"], "left_semi")
    ranges = found.select("row", "item_id", F.explode(F.expr("transform(ps, (p, i) -> struct(greatest(p - m + 1, coalesce(get(ps, i - times) + 1, 0), 0) as a, p + 1 as b))")).alias("r"))
    steps_ = ranges.select("row", "item_id", F.explode(F.expr("array(struct(r.a as at, 1 as step), struct(r.b as at, -1 as step))")).alias("z")).groupBy("row", "item_id", F.col("z.at").alias("at")).agg(F.sum("z.step").alias("step"))
    asked = pairs.select("row", "item_id", F.col("s").alias("at"), F.lit(0).cast("long").alias("step"), (F.col("m") + F.col("e") - F.col("s")).alias("both"), (F.col("e") - F.col("s")).alias("n"))
    line = steps_.withColumns({"both": F.lit(None).cast("int"), "n": F.lit(None).cast("int")}).unionByName(asked)
    upto = Window.partitionBy("row", "item_id").orderBy("at", F.col("both").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    judged = line.withColumn("over", F.sum("step").over(upto)).where("both is not null").withColumn("similarity", F.expr("over / cast(both - over as double)"))
    good = judged.where(F.col("similarity") >= similarity - 1e-12)
    best = good.groupBy("row", "item_id").agg(F.min_by(F.struct("at", "n", "similarity"), F.struct(-F.col("similarity"), "at")).alias("b"))
    return best.join(cand.select("row", "doc_id"), "row").select("doc_id", "item_id", F.col("b.at").alias("start"), (F.col("b.n") + k - 1).alias("n_words"), "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that repeat an item; a null id is an id like any other here."""
    found = matches(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("found__")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["found__"]), "left_anti")
