"""Similarity joins: pairs by shared tokens, greedy one-to-one matching, precision and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alignment_text, alignment_tokens, f1_of, first_text, normalize, safe_text, token_f1, tokens
from ..sources.stage import staged
from .rounds import matched


def shared_tokens(left: DataFrame, right: DataFrame, a: str, b: str, name: str, key: str = "case_id") -> DataFrame:
    """(key, i, j, name): how many tokens of columns a of left (key, i) and b of right (key, j) agree, repeats counted.

    An inverted index: equality join on the token, then a sum by pair. Pairs without a shared token don't
    appear, so it is at once the exact blocking of scores that need one.
    """
    n = lambda df, c, x: df.select(key, x, F.explode(c).alias("tok")).groupBy(key, x, "tok").agg(F.count("*").alias(f"n{x}"))
    met = n(left, a, "i").join(n(right, b, "j"), [key, "tok"])
    return met.groupBy(key, "i", "j").agg(F.sum(F.least("ni", "nj")).cast("double").alias(name))


def scored_pairs(left: DataFrame, right: DataFrame, columns: dict[str, tuple[str, str]], key: str = "case_id") -> DataFrame:
    """(key, i, j, name...): token F1 of each pair of token columns, for pairs that share a token in one of them."""
    out = None
    for name, (a, b) in columns.items():
        found = shared_tokens(left, right, a, b, f"{name}__", key)
        out = found if out is None else out.join(found, [key, "i", "j"], "full")
    for side, x in ((left, "i"), (right, "j")):
        out = out.join(side.select(key, x, *(F.size(c[x == "j"]).alias(f"{n}_{x}") for n, c in columns.items())), [key, x])
    return out.select(key, "i", "j", *(f1_of(F.coalesce(f"{n}__", F.lit(0.0)), F.col(f"{n}_i"), F.col(f"{n}_j")).alias(n) for n in columns))


#: A case of more pairs is matched in rounds over bands of them; the pairs of the others are folded in one array.
FOLDED = 5_000


def greedy(pairs: DataFrame, key: str = "case_id") -> DataFrame:
    """One-to-one matches of pairs (key, i, j, score): the highest score first, then the larger i, then the larger j."""
    pairs = staged(pairs.select(key, "i", "j", "score"), "pairs")
    large = staged(pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > FOLDED).select(key), "large")
    if large.isEmpty():
        return _folded(pairs, key)
    return _folded(pairs.join(large, key, "left_anti"), key).union(matched(pairs.join(large, key, "left_semi"), key))


def _folded(pairs: DataFrame, key: str) -> DataFrame:
    ranked = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("score", "i", "j")), asc=False).alias("ps"))
    start = F.expr("named_struct('i', cast(array() as array<int>), 'j', cast(array() as array<int>), 'm', cast(array() as array<struct<score:double,i:int,j:int>>))")

    def step(acc: Column, p: Column) -> Column:
        free = ~F.array_contains(acc["i"], p["i"]) & ~F.array_contains(acc["j"], p["j"])
        return F.when(free, F.struct(F.array_append(acc["i"], p["i"]).alias("i"), F.array_append(acc["j"], p["j"]).alias("j"), F.array_append(acc["m"], p).alias("m"))).otherwise(acc)

    return ranked.select(key, F.explode(F.aggregate("ps", start, step, lambda a: a["m"])).alias("p")).select(key, "p.i", "p.j", "p.score")


#: A case of so many pairs and characters at most is scored whole in its task; others meet by their tokens over all tasks.
WHOLE, CHARS = 40_000, 200_000


def in_cases(left: DataFrame, right: DataFrame, rest: Callable[[DataFrame, DataFrame], DataFrame], score: Callable[[dict, dict], np.ndarray], columns: dict[str, Column], chars: list[str], threshold: float, key: str = "case_id") -> DataFrame:
    """Greedy matches of left (key, i, ...) and right (key, j, ...): a task scores all pairs of a case at once; cases beyond the bounds go to rest(left, right).

    columns: texts of both sides; score: matrix of two such sides (lists), below the threshold where a pair doesn't count; chars: columns whose lengths are counted.
    """
    size = lambda df, x: df.groupBy(key).agg(F.count("*").alias(f"n{x}"), F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in chars), F.lit(0))).alias(f"c{x}"))
    large = staged(size(left, "i").join(size(right, "j"), key).where((F.col("ni") * F.col("nj") > WHOLE) | (F.col("ci") + F.col("cj") > CHARS)).select(key), "large")
    some = not large.isEmpty()
    small = (left.join(large, key, "left_anti"), right.join(large, key, "left_anti")) if some else (left, right)
    names = list(columns)
    lists = lambda df, x: df.select(key, F.struct(F.col(x).alias("n"), *(c.alias(n) for n, c in columns.items())).alias("s")).groupBy(key).agg(F.collect_list("s").alias("s")).select(key, *(F.col("s")[n].alias(f"{x}_{n}") for n in ("n", *names)))
    both = lists(small[0], "i").join(lists(small[1], "j"), key).select(key, *(f"{x}_{n}" for x in "ij" for n in ("n", *names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                cases, found = [], []
                for k, *case in zip(range(batch.num_rows), *(c.to_pylist() for c in batch.columns[1:])):
                    half = len(names) + 1
                    i, j = np.array(case[0]), np.array(case[half])
                    got = score(dict(zip(names, case[1:half])), dict(zip(names, case[half + 1 :])))
                    ps = _taken(got, i, j, threshold)
                    cases += [k] * len(ps)
                    found += ps
                i, j, scores = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cases, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(scores, pa.float64())], names=[key, "i", "j", "score"])

    out = both.mapInArrow(run, f"{key} {dict(left.dtypes)[key]}, i int, j int, score double")
    return out.union(rest(left.join(large, key, "left_semi"), right.join(large, key, "left_semi"))) if some else out


def _taken(score: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """The greedy matches of a matrix of scores, as greedy() has them."""
    x, y = np.nonzero(score >= threshold)
    s, a, b = score[x, y], i[x], j[y]
    out, left, right = [], set(), set()
    for k in np.lexsort((b, a, s))[::-1]:
        if a[k] not in left and b[k] not in right:
            left.add(a[k])
            right.add(b[k])
            out.append((int(a[k]), int(b[k]), float(s[k])))
    return out


def _f1_matrix(a: list[str], b: list[str]) -> np.ndarray:
    """token_f1 of all pairs of texts of tokens with a space between."""
    at: dict[str, int] = {}
    words = [t.split() for t in (*a, *b)]
    n = np.fromiter(map(len, words), np.int64, len(words))
    cols = np.fromiter((at.setdefault(w, len(at)) for ws in words for w in ws), np.int64, int(n.sum()))
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * len(at) + cols, minlength=len(n) * len(at)).reshape(len(n), len(at))
    shared = np.zeros((len(a), len(b)))
    for k in range(1, int(counts.max(initial=0)) + 1):  # the lesser of two counts is the number of k that both reach
        reach = (counts >= k).astype(np.float32)
        shared += reach[: len(a)] @ reach[len(a) :].T
    with np.errstate(divide="ignore", invalid="ignore"):
        p, r = shared / n[: len(a), None], shared / n[None, len(a) :]
        return np.where(shared == 0, 0.0, 2 * p * r / (p + r))


def _equal(a: list[str], b: list[str]) -> np.ndarray:
    return np.array(a, object)[:, None] == np.array(b, object)[None, :]


def prf(df: DataFrame, matched: str, predicted: str, gold: str, prefix: str = "") -> DataFrame:
    p = F.when(F.col(predicted) > 0, F.col(matched) / F.col(predicted)).otherwise(0.0)
    r = F.when(F.col(gold) > 0, F.col(matched) / F.col(gold)).otherwise(0.0)
    return df.withColumns({f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))})


def text_alignment(left: DataFrame, right: DataFrame, threshold: float = 0.58, key: str = "case_id") -> DataFrame:
    """Greedy matches of texts (key, i, text) and (key, j, text) by the better of plain and relaxed token F1."""
    a = left.select(key, "i", tokens("text").alias("at"), alignment_tokens("text").alias("aa"))
    b = right.select(key, "j", tokens("text").alias("bt"), alignment_tokens("text").alias("ba"))
    scored = scored_pairs(a, b, {"plain": ("at", "bt"), "relaxed": ("aa", "ba")}, key).withColumn("score", F.greatest("plain", "relaxed"))
    return greedy(scored.where(F.col("score") >= threshold).select(key, "i", "j", "score"), key)


#: What equal values of these fields add to a proposition's score. Fixed values.
BONUS = {"category": 0.06, "status": 0.05, "visit_state": 0.05, "temporality": 0.03, "speaker": 0.03, "predicate": 0.02}


def proposition_alignment(left: DataFrame, right: DataFrame, threshold: float = 0.58, strong: float = 0.72, key: str = "case_id") -> DataFrame:
    """Greedy matches of propositions (key, i, p struct) and (key, j, p struct).

    Score: 0.45 of the texts' F1, 0.35 of the concepts' relaxed F1, 0.14 if one concept holds the other, and the
    bonus of equal fields; 1 at most. Without a shared token it stays below the threshold, which must be over 0.38.
    """
    if threshold <= 0.38:
        raise ValueError("pairs without a shared token would count: threshold must be over 0.38")

    p = F.col("p")
    concept = first_text(p["canonical_concept"], p["proposition_text"])
    joined = lambda c: F.array_join(c, " ")
    columns = {"text": joined(tokens(p["proposition_text"])), "concept": alignment_text(concept), **{f: F.lower(safe_text(p[f])) for f in BONUS}}

    def score(a: dict, b: dict) -> np.ndarray:
        text, relaxed = _f1_matrix(a["text"], b["text"]), _f1_matrix(a["concept"], b["concept"])
        held = np.array([[x != "" and y != "" and (x in y or y in x) for y in b["concept"]] for x in a["concept"]], bool)
        full = 0.45 * text + 0.35 * relaxed + np.where(held, 0.14, 0.0)
        for f, bonus in BONUS.items():
            full = full + np.where(_equal(a[f], b[f]) & (np.array(a[f], object) != "")[:, None], bonus, 0.0)
        full = np.minimum(full, 1.0)
        counts = (full >= threshold) | (text >= strong) | (relaxed >= strong)
        return np.where(counts, np.maximum(full, np.maximum(text, relaxed)), -1.0)

    rest = lambda x, y: greedy(_proposition_pairs(x, y, threshold, strong, key), key)
    return in_cases(left, right, rest, score, columns, ["p.proposition_text", "p.canonical_concept"], 0.0, key)


def _proposition_pairs(left: DataFrame, right: DataFrame, threshold: float, strong: float, key: str) -> DataFrame:
    """(key, i, j, score) of the pairs that count."""

    def side(df: DataFrame, n: str, x: str) -> DataFrame:
        p = F.col("p")
        concept = first_text(p["canonical_concept"], p["proposition_text"])
        fields = {f"{x}_{f}": F.lower(safe_text(p[f])) for f in BONUS}
        return df.select(key, n, tokens(p["proposition_text"]).alias(f"{x}t"), alignment_tokens(concept).alias(f"{x}a"), alignment_text(concept).alias(f"{x}c"), *(c.alias(k) for k, c in fields.items()))

    a, b = side(left, "i", "a"), side(right, "j", "b")
    pairs = scored_pairs(a, b, {"text": ("at", "bt"), "relaxed": ("aa", "ba")}, key).join(a.drop("at", "aa"), [key, "i"]).join(b.drop("bt", "ba"), [key, "j"])
    held = (F.col("ac") != "") & (F.col("bc") != "") & (F.col("ac").contains(F.col("bc")) | F.col("bc").contains(F.col("ac")))
    full = 0.45 * F.col("text") + 0.35 * F.col("relaxed") + F.when(held, 0.14).otherwise(0.0)
    for f, bonus in BONUS.items():
        full = full + F.when((F.col(f"a_{f}") != "") & (F.col(f"a_{f}") == F.col(f"b_{f}")), bonus).otherwise(0.0)
    scored = pairs.withColumn("full", F.least(full, F.lit(1.0))).where((F.col("full") >= threshold) | (F.col("text") >= strong) | (F.col("relaxed") >= strong))
    return scored.select(key, "i", "j", F.greatest("full", "text", "relaxed").alias("score"))


#: What concept, text and equal types add to the score of two canonical propositions. Fixed values.
CONCEPT, TEXT, SAME = 0.55, 0.35, 0.10


def benchmark_pairs(pred: DataFrame, gold: DataFrame, threshold: float = 0.45, key: str = "case_id") -> DataFrame:
    """Scored pairs of canonical propositions (key, i or j, c_type, c_concept, prop_text).

    From a threshold of 0.45 on a pair shares a word of its concepts, or it has equal texts: pairs meet by one of these
    words (the least they share tells them) or by the words of the texts, and are scored once.
    """
    if threshold < TEXT + SAME - 1e-12:
        raise ValueError("pairs without a shared word of their concepts would count: threshold must be 0.45 at least")

    def side(df: DataFrame, n: str, x: str) -> DataFrame:
        return df.select(key, n, F.col("c_type").alias(f"{x}_type"), tokens("c_concept").alias(f"{x}c"), tokens("prop_text").alias(f"{x}t"))

    a, b = side(pred, "i", "a"), side(gold, "j", "b")
    shared = a.withColumn("w", F.explode(F.array_distinct("ac"))).join(b.withColumn("w", F.explode(F.array_distinct("bc"))), [key, "w"]).where(F.col("w") == F.array_min(F.array_intersect("ac", "bc"))).drop("w")
    words = lambda c: F.array_join(F.sort_array(c), " ")
    equal = a.withColumn("w", words("at")).join(b.withColumn("w", words("bt")), [key, "w"]).where((F.col("w") != "") & ~F.arrays_overlap("ac", "bc")).drop("w")
    same = F.when(F.col("a_type") == F.col("b_type"), 1.0).otherwise(0.0)
    score = CONCEPT * token_f1(F.col("ac"), F.col("bc")) + TEXT * token_f1(F.col("at"), F.col("bt")) + SAME * same
    return shared.unionByName(equal).select(key, "i", "j", score.alias("score")).where(F.col("score") >= threshold)


def benchmark_matches(pred: DataFrame, gold: DataFrame, threshold: float = 0.45, key: str = "case_id") -> DataFrame:
    """Greedy matches of canonical propositions by the scores of benchmark_pairs()."""

    def score(a: dict, b: dict) -> np.ndarray:
        same = np.where(_equal(a["kind"], b["kind"]) & (np.array(a["kind"], object) != None)[:, None], 1.0, 0.0)  # noqa: E711
        return CONCEPT * _f1_matrix(a["concept"], b["concept"]) + TEXT * _f1_matrix(a["text"], b["text"]) + SAME * same

    rest = lambda x, y: greedy(benchmark_pairs(x, y, threshold, key), key)
    if threshold < TEXT + SAME - 1e-12:
        return rest(pred, gold)  # which refuses it
    columns = {"kind": F.col("c_type"), "concept": normalize("c_concept"), "text": normalize("prop_text")}
    return in_cases(pred, gold, rest, score, columns, ["c_concept", "prop_text"], threshold, key)


def evaluate(pred: DataFrame, gold: DataFrame, matches: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case: counts, precision and recall of concepts and of full states, accuracies on the matched pairs, agreement of the turns."""
    names = ("c_verification", "c_state", "c_time", "c_role", "turns")
    a = pred.select(key, "i", *(F.col(n).alias(f"a_{n}") for n in names))
    b = gold.select(key, "j", *(F.col(n).alias(f"b_{n}") for n in names))
    m = matches.join(a, [key, "i"]).join(b, [key, "j"])
    eq = lambda n: (F.col(f"a_{n}") == F.col(f"b_{n}")).cast("int")
    role = (F.col("a_c_role") != "none") | (F.col("b_c_role") != "none")
    some = F.size("b_turns") > 0
    both, either = F.size(F.array_intersect("a_turns", "b_turns")), F.size(F.array_union("a_turns", "b_turns"))
    per = m.groupBy(key).agg(
        F.count("*").alias("matched"), F.sum(eq("c_verification")).alias("n_verification"), F.sum(eq("c_state")).alias("n_state"), F.sum(eq("c_time")).alias("n_time"),
        F.sum(eq("c_verification") * eq("c_state") * eq("c_time")).alias("n_full"), F.sum(role.cast("int")).alias("n_role"), F.sum(F.when(role, eq("c_role")).otherwise(0)).alias("n_role_right"),
        F.sum(some.cast("int")).alias("n_prov"), F.sum(F.when(some & (both > 0), 1).otherwise(0)).alias("n_hit"),
        F.sum(F.when(some & (F.array_sort("a_turns") == F.array_sort("b_turns")), 1).otherwise(0)).alias("n_exact"), F.sum(F.when(some, both / either).otherwise(0.0)).alias("jaccard"),
    )
    sizes = pred.groupBy(key).agg(F.count("*").alias("pred_n")).join(gold.groupBy(key).agg(F.count("*").alias("gold_n")), key)
    out = sizes.join(per, key, "left").na.fill(0)
    out = prf(prf(out, "matched", "pred_n", "gold_n", "concept_"), "n_full", "pred_n", "gold_n", "state_")
    rate = lambda n, d, empty: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(empty)
    return out.select(
        key, "pred_n", "gold_n", "matched", (F.col("pred_n") - F.col("matched")).alias("unsupported"), (F.col("gold_n") - F.col("matched")).alias("missing"),
        "concept_precision", "concept_recall", "concept_f1", "state_precision", "state_recall", "state_f1",
        rate("n_verification", "matched", F.lit(0.0)).alias("verification_acc"), rate("n_state", "matched", F.lit(0.0)).alias("state_acc"), rate("n_time", "matched", F.lit(0.0)).alias("temporality_acc"),
        rate("n_role_right", "n_role", F.lit(None)).alias("role_acc"), F.col("n_prov").alias("provenance_n"), rate("n_hit", "n_prov", F.lit(None)).alias("provenance_hit"),
        rate("n_exact", "n_prov", F.lit(None)).alias("provenance_exact"), rate("jaccard", "n_prov", F.lit(None)).alias("provenance_jaccard"),
    )


def unmatched(rows: DataFrame, matches: DataFrame, side: str, key: str = "case_id") -> DataFrame:
    return rows.join(matches.select(key, side), [key, side], "left_anti")


