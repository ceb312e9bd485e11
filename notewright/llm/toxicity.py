"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_memory

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases whose words mean no harm; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "idiot proof", "disgusting odor", "cross pathetic nerve")

_LETTER = r"[^\W\d_]"
#: A word with a digit or sign between its letters: what stands before its last letter is folded, and one digit after it.
_DISGUISED = re.compile(r"[^\W_@$!|]*[0-9@$!|](?:[0-9@$!|]|[^\W_])*")
_TAIL = re.compile(r"(?:[0-9](?![0-9@$!|]))?")
_LETTERS = re.compile(_LETTER + "+")


class _Fold(dict):
    """Lower case; beyond Latin-1, whose letters are ordinary ones, without marks and as Latin letters. Filled as characters are met."""

    def __missing__(self, code: int) -> str:
        plain = "".join(x if ord(x) < 256 else _bare(x) for x in unicodedata.normalize("NFKC", chr(code)).lower())
        self[code] = plain
        return plain


def _bare(c: str) -> str:
    return "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", HOMOGLYPHS.get(c, c)) if not unicodedata.combining(x))


_FOLD = _Fold()
_DIGITS = str.maketrans(DIGITS)


def _letters(m: re.Match) -> str:
    word = m.group()
    last = max((k for k, c in enumerate(word) if c.isalpha()), default=-1)
    if last < 0:
        return word
    stop = _TAIL.match(word, last + 1).end()
    return word[:stop].translate(_DIGITS) + " " + word[stop:]


def fold(text: str) -> str:
    """Lower case, homoglyphs as plain letters, digits and signs within words as letters, one space for white space."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).translate(_FOLD)
    return " ".join(_DISGUISED.sub(_letters, text).split())


@dataclass
class Model:
    """terms: weight by entry; an entry that ends in * matches every longer word that begins with it. exceptions: folded phrases.

    coef: intercept, of the logarithm of the weight in a thousand characters, of the logarithm of the weight."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coef: tuple[float, float, float] = (-3.0, 2.0, 2.0)
    automaton: object = field(default=None, repr=False)

    def __post_init__(self):
        entries: dict[str, list] = {}
        for term, weight in self.terms.items():
            stem = term.endswith("*")
            key = term.rstrip("*")
            # 1 may stand for l as well as for i
            for k in {key, key.replace("l", "i")}:
                if k == key or (k not in self.terms and k + "*" not in self.terms):
                    entries.setdefault(k, [k, None, None, False])[1 if stem else 2] = weight
        for phrase in self.exceptions:
            entries.setdefault(phrase, [phrase, None, None, False])[3] = True
        self.automaton = None
        if entries:
            self.automaton = ahocorasick.Automaton()
            for key, value in entries.items():
                self.automaton.add_word(key, tuple(value))
            self.automaton.make_automaton()

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "coef": self.coef}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries at word starts and outside exceptions; of those with one start, the heaviest."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if self.automaton is None:
            return []
        size = len(folded)
        for last, (key, stem, whole, exception) in self.automaton.iter(folded):
            start, end = last + 1 - len(key), last + 1
            if start and folded[start - 1].isalpha():
                continue
            ends = end == size or not folded[end].isalpha()
            if exception and ends:
                spared.append((start, end))
            weight = (whole if ends else stem) or 0.0
            if weight and weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
        return [(a, b, w) for a, (b, w) in sorted(best.items()) if not any(x <= a and b <= y for x, y in spared)]

    def score(self, weight: float, chars: int) -> float:
        a, b, c = self.coef
        x = a + b * np.log1p(1000.0 * weight / max(chars, 1)) + c * np.log1p(weight)
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def features(folded: str, stems: range) -> set[str]:
    """The words of a folded text, and the stems of the given lengths that longer words begin with."""
    words = set(_LETTERS.findall(folded))
    return words | {w[:n] + "*" for w in words for n in stems if len(w) > n}


def _around(folded: str, start: int, end: int) -> list[str]:
    """The phrases of two words that a hit makes with its neighbours."""
    while end < len(folded) and folded[end].isalpha():
        end += 1
    left, right = re.search(r"([^\W\d_]{1,40}) $", folded[max(0, start - 41) : start]), re.match(r" ([^\W\d_]{1,40})(?![^\W\d_])", folded[end : end + 42])
    word = folded[start:end]
    return [*([f"{left[1]} {word}"] if left else []), *([f"{word} {right[1]}"] if right else [])]


def _g2(a, b, n, m):
    """Log-likelihood ratio of a among n and b among m; 0 where the first share isn't the higher one."""
    a, b, p = np.asarray(a, float), np.asarray(b, float), (np.asarray(a, float) + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, x: np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(x, 1e-300)), 0.0)
        g = 2 * (part(a, n * p) + part(b, m * p) + part(n - a, n * (1 - p)) + part(m - b, m * (1 - p)))
    return np.where(a * m > b * n, g, 0.0)


def cover(docs: list[np.ndarray], terms: list[str], clean: np.ndarray, n_clean: int, least: float) -> list[int]:
    """Terms that tell toxic documents from clean ones.

    docs: of each toxic document, the places of its terms. First, again and again, the term with the highest ratio over the
    documents not told yet: words that only go along with telling ones, as in copies of one document, add nothing then.
    Then those that tell about as well by themselves as the weakest of these. A term with a chosen stem is left out, and so is
    a stem of a chosen term.
    """
    of = [[] for _ in terms]
    for d, found in enumerate(docs):
        for t in found.tolist():
            of[t].append(d)
    n, open_, chosen, keys, stems = len(docs), np.ones(len(docs), bool), [], [], set()
    left, size = np.array([len(x) for x in of]), np.array([len(t.rstrip("*")) for t in terms])
    alone = _g2(left, clean, n, n_clean)

    def fits(t: int) -> bool:
        key = terms[t].rstrip("*")
        covered = any(key[:k] in stems for k in range(1, len(key) + (terms[t][-1] == "*")))
        return not covered and not any(x.startswith(key) for x in keys) or key in keys and terms[t][-1] != "*"

    def take(t: int) -> None:
        chosen.append(t)
        keys.append(terms[t].rstrip("*"))
        if terms[t][-1] == "*":
            stems.add(keys[-1])
        for d in of[t]:
            if open_[d]:
                open_[d] = False
                left[docs[d]] -= 1

    usable = np.ones(len(terms), bool)
    while open_.any() and usable.any():
        g = np.where(usable, _g2(left, clean, n, n_clean), -1.0)
        best = int(np.lexsort((-size, -np.round(g, 6)))[0])
        if g[best] < least:
            break
        usable[best] = False
        if fits(best):
            take(best)
    bar = max(2 * least, min((alone[t] for t in chosen), default=np.inf))
    for t in np.lexsort((-size, -np.round(alone, 6))).tolist():
        if usable[t] and alone[t] >= bar and fits(t):
            take(t)
    return chosen


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, max_terms: int = 20_000, stems: range = range(3, 9), least: float = 16.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learns the lexicon, the exceptions and the scale of scores from labelled documents.

    Of each label, about `sample` rows at most (those of the least hashes) are learned from, with their whole texts; this bounds
    what reaches the driver: the counts of terms (words, and stems of 3 to 8 letters) after the ratio test (max_terms at most), the places of terms in toxic
    documents, and one row of two numbers for each sampled document. An id with several labels counts as toxic if one says so;
    null labels and ids say nothing. Without toxic documents the lexicon is empty and every score low.
    """
    spark = docs.sparkSession
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_toxic")).where("_id is not null and _toxic is not null").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    ids = docs.select(docs[id_col].alias("_id")).where("_id is not null").distinct()
    known = known.join(ids, "_id", "left_semi").withColumn("_toxic", (F.col("_toxic") > 0).cast("int"))
    of = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spared = tuple(fold(x) for x in exceptions)
    if not of.get(1):
        return Model({}, spared)
    share = {k: min(1.0, sample / n) for k, n in of.items()}
    in_sample = F.lit(False)
    for k, x in share.items():
        in_sample = in_sample | ((F.col("_toxic") == k) & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(x * (1 << 30))))
    chosen = known.where(in_sample).withColumnRenamed("_id", "id").withColumnRenamed("_toxic", "label")
    # bounded by `sample`, so it may be broadcast
    rows = cut(docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text"), "toxicity")

    def counted(batches):
        n = [Counter(), Counter()]
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[label].update(features(fold(text), stems))
            if len(n[0]) + len(n[1]) > 500_000:
                yield counts_of(n)
                n = [Counter(), Counter()]
        yield counts_of(n)

    def counts_of(n):
        terms = list(n[0].keys() | n[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([x[t] for t in terms], pa.int64()) for x in (n[1], n[0]))], names=["term", "a", "b"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n:
        return Model({}, spared)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p = (a + b) / F.lit(float(n + m))
    part = lambda k, x: F.when(k > 0, k * F.log(k / x)).otherwise(0.0)
    ratio = 2 * (part(a, n * p) + part(b, m * p) + part(n - a, n * (1 - p)) + part(m - b, m * (1 - p)))
    heavy = (a + 0.5) / (n + 1.0) >= 5.0 * (b + 0.5) / (m + 1.0)
    by = rows.select("label", "text").mapInArrow(counted, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = by.where((F.col("a") >= 3) & heavy & (F.length("term") >= 4)).withColumn("g", ratio).where(F.col("g") >= least).orderBy(F.desc("g"), "term").limit(max_terms).toPandas()
    terms, clean = found["term"].tolist(), found["b"].to_numpy(np.int64)
    place = {t: k for k, t in enumerate(terms)}
    shared = spark.sparkContext.broadcast(place)

    def places(batches):
        place = shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = sorted(place[t] for t in features(fold(text), stems) if t in place)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(seen, "<i4").tobytes()], pa.binary())], names=["places"])

    told = [np.frombuffer(bytes(x), "<i4") for x in rows.where("label = 1").select("text").mapInArrow(places, "places binary").toPandas()["places"]] if terms else []
    chosen = cover(told, terms, clean, m, least) if terms else []
    toxic_in = np.bincount(np.concatenate(told), minlength=len(terms)) if terms else []
    weight = {terms[t]: float(np.log((toxic_in[t] + 0.5) / (n + 1)) - np.log((clean[t] + 0.5) / (m + 1))) for t in chosen}

    def judged(model: Model):
        lexicon = spark.sparkContext.broadcast(model)

        def run(batches):
            for batch in batches:
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    f = fold(text)
                    hits = lexicon.value.hits(f)
                    phrases = sorted({p for a, b, _ in hits for p in _around(f, a, b)})
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([sum(h[2] for h in hits)], pa.float64()), pa.array([len(f)], pa.int64()), pa.array([phrases], pa.list_(pa.string()))], names=["label", "weight", "chars", "phrases"])

        return rows.select("label", "text").mapInArrow(run, "label int, weight double, chars long, phrases array<string>")

    model = Model(weight, spared)
    near = judged(model).select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
    harmless = [r["phrase"] for r in near.where("n - a >= 5 and a <= 0.02 * n").orderBy(F.desc("n"), "phrase").limit(max_terms).collect()]
    model = Model(weight, (*spared, *harmless))
    known = judged(model).select("label", "weight", "chars").toPandas()
    model.coef = calibrate(known["label"].to_numpy(float), known["weight"].to_numpy(float), known["chars"].to_numpy(float), {k: 1 / x for k, x in share.items()})
    return model


def calibrate(label: np.ndarray, weight: np.ndarray, chars: np.ndarray, times: dict[int, float], ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; a row counts as often as rows of its label were left out of the sample. No slope is negative."""
    x = np.stack([np.ones(len(label)), np.log1p(1000.0 * weight / np.maximum(chars, 1)), np.log1p(weight)], 1)
    v = np.where(label > 0, times.get(1, 1.0), times.get(0, 1.0))
    w = np.zeros(3)
    use = np.array([True, True, True])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([ridge / 100, ridge, ridge])
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + penalty + np.diag(np.where(use, 0.0, 1e9)), x.T @ (v * (label - p)) - penalty @ w)
        w = np.where(use, w + np.clip(step, -3, 3), 0.0)
        use &= (w >= 0) | (np.arange(3) == 0)
        w = np.where(use, w, 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_out: str = "score", predicted_out: str = "predicted") -> DataFrame:
    """docs with the score of each whole text (0 to 1) and 1 where it is 0.5 or more.

    Null and empty texts have the score of a text without a hit; repeated rows are scored alike; an empty table gives
    no rows; columns of docs with the new names are replaced. One text is folded and matched at a time, a very long one whole,
    in time in proportion to its length.
    """
    base = docs.drop(*(c for c in (score_out, predicted_out) if c in docs.columns))
    k = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(score_out, T.DoubleType()), T.StructField(predicted_out, T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(k):
                f = fold(text.as_py() or "")
                out.append(model.score(sum(h[2] for h in model.hits(f)), len(f)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=[*batch.schema.names, score_out, predicted_out])
        free_memory()

    return base.mapInArrow(run, schema)
