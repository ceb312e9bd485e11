"""Text scalars as column expressions: cleaning, tokens, similarity of token lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .lexicon import ALIGNMENT_STOP_WORDS, EVENT_STOP_WORDS
from .terms import AUDIT_STOP_WORDS

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(c) -> Column:
    """Null is empty; white space of any kind goes from both ends."""
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), _EDGE, "")


def once(c: Column, f) -> Column:
    """f of c, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def apart(c: Column) -> Column:
    """c by way of a lambda. A projection with one is generated in methods of moderate size; a wide one within a whole stage becomes a method that the JVM doesn't compile."""
    return once(c, lambda x: x)


def first_text(*cols) -> Column:
    """The first that is not blank, else the empty text."""
    return F.coalesce(*(F.nullif(safe_text(c), F.lit("")) for c in cols), F.lit(""))


def normalize(c) -> Column:
    """Lower case; everything but a-z and 0-9 is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def n_words(c) -> Column:
    return F.size(F.filter(F.split(safe_text(c), r"\s+"), lambda t: t != ""))


def alignment_tokens(c) -> Column:
    """Tokens without stop words, with plural endings cut."""
    stop = F.array(*(F.lit(w) for w in ALIGNMENT_STOP_WORDS))

    def stem(t: Column) -> Column:
        long = F.length(t) > 4
        return (
            F.when(long & t.endswith("ies"), F.concat(t.substr(F.lit(1), F.length(t) - 3), F.lit("y")))
            .when(long & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), F.length(t) - 1))
            .otherwise(t)
        )

    return F.transform(F.filter(tokens(c), lambda t: ~F.array_contains(stop, t)), stem)


def alignment_text(c) -> Column:
    return F.array_join(alignment_tokens(c), " ")


#: Where a word begins and ends, whatever a version of Java takes \\b for.
BEGINS, ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: What goes from a sentence to leave a concept, with what stands instead. The words are fixed values.
CONCEPT_LEADS = (
    (r"^(the patient|patient|she|he|they)\s+(reports|denies|has|states|notes|describes)\s+", ""),
    (r"^(the clinician|clinician|doctor|provider)\s+(notes|states|assesses|diagnoses|suspects|plans|orders|recommends|prescribes)\s+", ""),
    (BEGINS + r"(will|is|are|was|were|be|being|been)" + ENDS, " "),
)


def event_tokens(c, stop_words=EVENT_STOP_WORDS) -> Column:
    """Words of an event's concept: numbers go, marks of doses stay, short and stop words go."""
    low = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), rf"{BEGINS}\d+(?:\.\d+)?{ENDS}", " ")
    low = F.regexp_replace(low, r"[^a-z0-9%/+\-]+", " ")
    stop = F.array(*(F.lit(w) for w in stop_words))
    return F.filter(F.split(low, " "), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def audit_key(c) -> Column:
    """The first five event tokens of an audit, or the first 80 characters where there are none."""
    toks = event_tokens(c, AUDIT_STOP_WORDS)
    plain = F.substring(F.trim(F.regexp_replace(F.lower(safe_text(c)), r"\s+", " ")), 1, 80)
    return once(toks, lambda toks: F.when(F.size(toks) > 0, F.array_join(F.slice(toks, 1, 5), " ")).otherwise(plain))


def concept_from_text(c) -> Column:
    """A concept out of a sentence: who says it and auxiliaries go, eight words stay."""
    t = F.lower(safe_text(c))
    for pattern, instead in CONCEPT_LEADS:
        t = F.regexp_replace(t, pattern, instead)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9%/+\- ]", " "), r"\s+", " "))
    return F.array_join(F.slice(F.split(t, " "), 1, 8), " ")


def plain_quotes(c) -> Column:
    """Typographic quotes and dashes as ASCII."""
    return F.translate(_col(c), "‘’“”–— ", "''\"\"-- ")


def overlap(a: Column, b: Column) -> Column:
    """How many tokens two lists share, repeats counted."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def f1_of(shared: Column, n_a: Column, n_b: Column) -> Column:
    p, r = shared / n_a, shared / n_b
    return F.when((n_a == 0) | (n_b == 0) | (shared == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def token_f1(a: Column, b: Column) -> Column:
    """Of two token lists; 0 if either is empty."""
    return f1_of(overlap(a, b).cast("double"), F.size(a), F.size(b))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short token lists (quadratic)."""
    row0 = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def next_row(prev: Column, tok: Column) -> Column:
        best = lambda cur, j: F.when(F.element_at(b, j) == tok, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1)))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), lambda cur, j: F.concat(cur, F.array(best(cur, j))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, row0, next_row), -1))


def rouge_l(a: Column, b: Column) -> Column:
    return f1_of(lcs_length(a, b).cast("double"), F.size(a), F.size(b))


@F.pandas_udf(IntegerType())
def lcs_length_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for long lists, with one bit of an integer for each token of a."""

    def one(x, y) -> int:
        at: dict = {}
        for k, t in enumerate(x):
            at[t] = at.get(t, 0) | 1 << k
        row, full = (1 << len(x)) - 1, (1 << len(x)) - 1
        for t in y:
            u = row & at.get(t, 0)
            row = (row + u | row - u) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l_long(a: Column, b: Column) -> Column:
    return f1_of(lcs_length_long(a, b).cast("double"), F.size(a), F.size(b))
