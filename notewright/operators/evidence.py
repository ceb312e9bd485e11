"""Evidence: the best turn for each proposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import any_of
from ..functions.rules import chatter, is_question
from ..functions.text import f1_of, n_words, safe_text, tokens


def counted(words: Column) -> Column:
    """Each word of a list with the number of its like before it, so that lists share as many of these as words, repeats counted."""
    return F.get(F.transform(F.array(F.array_sort(words)), lambda s: F.transform(s, lambda x, k: F.concat(x, F.lit(" "), (k - F.array_position(s, x)).cast("string")))), F.lit(0))


def of_proposition(concept: str, text: str) -> Column:
    """What a score looks at in a proposition."""
    return F.struct(counted(tokens(concept)).alias("concept_words"), counted(tokens(text)).alias("text_words"), F.lower(safe_text(concept)).alias("concept"))


def of_turn(said: str, speaker: str) -> Column:
    """What a score looks at in a turn; its texts are gone through once, not once for each proposition."""
    low = F.lower(safe_text(said))
    return F.struct(
        counted(tokens(said)).alias("words"), low.alias("low"), F.lower(safe_text(speaker)).alias("who"), is_question(said).alias("question"), any_of(low, ("consents to have this visit recorded", "date of birth")).alias("formal"),
        ((n_words(said) <= 3) & low.isin("okay", "all right", "sounds good", "thank you")).alias("short"), any_of(low, ("denies", "deny", "no ", "without", "negative for")).alias("denial"), chatter(low).alias("chatter"),
    )


def score_of(p: Column, t: Column, kind: Column, verified: Column) -> Column:
    """How well a turn (of_turn) supports a proposition (of_proposition): shared words, more for the fitting speaker, less for questions and small talk."""
    when = lambda cond, v: F.when(cond, v).otherwise(0.0)
    f1 = lambda words: f1_of(F.size(F.array_intersect(p[words], t["words"])).cast("double"), F.size(p[words]), F.size(t["words"]))
    score = 0.55 * f1("concept_words") + 0.45 * f1("text_words")
    score = score + when((p["concept"] != "") & t["low"].contains(p["concept"]), 0.2) - when(t["question"], 0.45)
    score = score - when(t["formal"], 0.25)
    score = score - when(t["short"], 0.35)
    score = score + when((t["who"] == "patient") & kind.isin("ChiefComplaint", "Symptom", "Problem", "ProblemHistory"), 0.14)
    score = score + when(t["who"].isin("doctor", "clinician") & kind.isin("ExamFinding", "TestResult", "MedicationRequest", "Order", "FollowUp"), 0.14)
    score = score + when((verified == "refuted") & t["denial"], 0.24)
    return score - when(t["chatter"], 0.2)


def turn_score(concept: str, text: str, kind: str, verified: str, said: str, speaker: str) -> Column:
    return score_of(of_proposition(concept, text), of_turn(said, speaker), F.col(kind), F.col(verified))


def scored_turns(props: DataFrame, turns: DataFrame, key: str = "case_id") -> DataFrame:
    """Propositions (key, ord, concept, prop_text, prop_type, verification) with each turn (key, turn_idx, speaker, said) of their case and its score."""
    p = props.select(key, "ord", "prop_type", "verification", of_proposition("concept", "prop_text").alias("p"))
    t = turns.select(key, "turn_idx", of_turn("said", "speaker").alias("t"))
    return p.join(t, key).withColumn("score", score_of(F.col("p"), F.col("t"), F.col("prop_type"), F.col("verification"))).select(key, "ord", "turn_idx", "score")


def best_turn(props: DataFrame, turns: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, ord, turn_idx, score): the first of the highest scored turns of the case, if its score is over 0."""
    best = scored_turns(props, turns, key).where("score > 0").groupBy(key, "ord").agg(F.max_by(F.struct("turn_idx", "score"), F.struct("score", -F.col("turn_idx"))).alias("b"))
    return best.select(key, "ord", "b.turn_idx", "b.score")
