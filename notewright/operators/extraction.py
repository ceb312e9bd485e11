"""What surrounds extraction: seed labels, fact lines, doubtful output, when to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import any_of, lookup
from ..functions.rules import clinical
from ..functions.text import n_words, normalize, safe_text


def seed_category(c) -> Column:
    """A known category by its words, else Finding."""
    by_words = {name.lower(): name for name in L.SEED_CATEGORIES}
    return F.coalesce(lookup(by_words | L.SEED_ALIASES, normalize(c)), F.lit("Finding"))


def seed_speaker(c) -> Column:
    s = normalize(c)
    return F.when(s.isin("patient", "pt"), "patient").when(s.isin("clinician", "doctor", "provider", "physician"), "clinician").otherwise("unknown")


def seed_temporality(c) -> Column:
    return F.coalesce(lookup(L.SEED_TIMES, normalize(c)), F.lit("unknown"))


def seed_certainty(c) -> Column:
    return F.when(normalize(c).isin("high", "medium", "low"), normalize(c)).otherwise("medium")


def provenance(c) -> Column:
    """Turn numbers, commas and ranges alone, 64 characters at most."""
    t = F.replace(F.translate(safe_text(c), "–—~", "---"), F.lit(" to "), F.lit("-"))
    return F.substring(F.regexp_replace(t, r"[^0-9,\-]", ""), 1, 64)


def fact_line(c) -> Column:
    """status, category and text of a line like "[Category] [Status] fact"; what isn't told is inferred from the text."""
    t = safe_text(c)
    first, second = F.regexp_extract(t, r"^\s*[-*]?\s*\[([^\]]*)\]", 1), F.regexp_extract(t, r"^\s*[-*]?\s*\[[^\]]*\]\s*\[([^\]]*)\]", 1)
    fact = F.trim(F.regexp_replace(t, r"^\s*[-*]?\s*(\[[^\]]*\]\s*){0,2}", ""))
    hint, low = F.lower(F.trim(second)), F.lower(fact)
    status = (
        F.when(hint.isin("present", "positive", "affirmed"), "Present").when(hint.isin("absent", "negative", "negated"), "Absent").when(hint.isin("unknown", "uncertain", "unsure"), "Unknown")
        .when(any_of(low, L.UNSURE_WORDS), "Unknown").when(low.startswith("no ") | any_of(F.concat(F.lit(" "), low, F.lit(" ")), (" denies ", " denied ")), "Absent").otherwise("Present")
    )
    inferred = (
        F.when(any_of(low, L.SOCIAL_WORDS), "Demographics and Social Determinants of Health").when(any_of(low, L.INTENT_WORDS), "Patient Intent").when(any_of(low, L.PAST_FACT_WORDS), "Medical History")
        .when(status == "Absent", "Pertinent Negatives").when(status == "Unknown", "Pertinent Unknowns").otherwise("Pertinent Positives")
    )
    return F.struct(status.alias("status"), F.coalesce(lookup(L.FACT_CATEGORIES, F.lower(F.trim(first))), inferred).alias("category"), fact.alias("fact"))


def turn_signal(turns: DataFrame, keys: list[str], text: str = "said") -> DataFrame:
    """Per chunk: turns, and whether any has a clinical sign or three have five words or more."""
    return turns.groupBy(*keys).agg(F.count("*").alias("turns"), (F.max(clinical(F.col(text)).cast("int")) == 1).alias("sign"), (F.count_if(n_words(text) >= 5) >= 3).alias("long")).withColumn("signal", F.col("sign") | F.col("long")).drop("sign", "long")


def doubtful(props: DataFrame, signals: DataFrame, keys: list[str], longest: int = 500) -> DataFrame:
    """Per chunk, whether its output is doubtful: none though there is a signal, a blank text or concept, or one too long."""
    bad = (safe_text("prop_text") == "") | (safe_text("concept") == "") | (F.length(safe_text("prop_text")) > longest)
    per = props.groupBy(*keys).agg((F.max(bad.cast("int")) == 1).alias("bad"))
    return signals.join(per, keys, "left").withColumn("doubtful", F.coalesce("bad", F.col("signal"))).drop("bad")


def rescue(props: DataFrame, turns: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases to try again: no proposition, under 8 for over 20 turns, or none of high value for over 12."""
    n = turns.groupBy(key).agg(F.count("*").alias("turns"))
    p = props.groupBy(key).agg(F.count("*").alias("props"), F.count_if(F.col("prop_type").isin(*L.PROTECTED_TYPES)).alias("high"))
    both = n.join(p, key, "left").na.fill(0, ["props", "high"])
    return both.where("props = 0 or (turns > 20 and props < 8) or (turns > 12 and high = 0)")


def macro_f1(by_category: DataFrame, keys: list[str]) -> DataFrame:
    """Mean F1 of the categories that have an item on either side (columns pred_n, gold_n, f1); 0 without any."""
    some = (F.col("pred_n") > 0) | (F.col("gold_n") > 0)
    return by_category.groupBy(*keys).agg(F.coalesce(F.avg(F.when(some, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
