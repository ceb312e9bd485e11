"""Enumerated values: aliases, defaults and derived ones, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import first_text, normalize, safe_text


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def any_of(c: Column, parts) -> Column:
    """c holds one of the parts, anywhere; c is worked out once."""
    parts = tuple(parts)
    return c.rlike("|".join(rf"\Q{p}\E" for p in parts)) if parts else F.lit(False)


def folded(c, keep: str = "[^a-z_]") -> Column:
    return F.regexp_replace(F.lower(safe_text(c)), keep, "")


def proposition_type(c) -> Column:
    """A known type, else that of an alias, else null."""
    return F.when(safe_text(c).isin(*L.PROPOSITION_TYPES), safe_text(c)).otherwise(lookup(L.TYPE_ALIASES, folded(c, "[^a-z]")))


def verification(c) -> Column:
    f = folded(c)
    out = F.coalesce(lookup(L.VERIFICATION_ALIASES, f), f)
    return F.when(out.isin(*L.VERIFICATION), out).otherwise("confirmed")


def clinical_status(c, verified: Column, temporality) -> Column:
    f, when = folded(c), F.lower(safe_text(temporality))
    out = F.coalesce(lookup(L.STATUS_ALIASES, f), f)
    return (
        F.when(out.isin(*L.CLINICAL_STATUS), out)
        .when(any_of(when, ("follow", "next", "will")), "planned")
        .when(verified == "refuted", "resolved")
        .when(any_of(when, ("history", "previous", "ago")), "historical")
        .otherwise("active")
    )


def modality(c, kind: Column, speaker: Column) -> Column:
    return F.coalesce(
        lookup(L.MODALITY_ALIASES, folded(c)),
        F.when(kind == "ExamFinding", "exam")
        .when(kind == "TestResult", "test_result")
        .when(kind.isin(*L.PLAN_TYPES), "plan")
        .when(kind.isin("Diagnosis", "Impression"), "assessment")
        .when(kind == "Symptom", F.when(speaker.isin("patient", "unknown"), "interview").otherwise("exam"))
        .when(kind.isin("ProblemHistory", "Demographics", "Allergy"), F.when(speaker.isin("clinician", "test_result"), "historical_record").otherwise("interview"))
        .otherwise(F.when(speaker == "patient", "interview").otherwise("unknown")),
    )


def assertion(verified: Column, status: Column) -> Column:
    return F.when(status == "historical", "historical").when(status == "planned", "hypothetical").when(verified == "confirmed", "present").when(verified == "refuted", "absent").otherwise("uncertain")


def assertion_status(verified: Column) -> Column:
    """The three-valued status of flat propositions."""
    return F.when(verified.isin("confirmed", "present", "historical"), "affirmed").when(verified.isin("refuted", "absent"), "negated").otherwise("uncertain")


def benchmark_type(c) -> Column:
    return F.coalesce(lookup(L.BENCHMARK_TYPES, normalize(c)), F.nullif(safe_text(c), F.lit("")), F.lit("Unknown"))


def benchmark_verification(verified, asserted, status, certainty, text) -> Column:
    """By the first label there is; else negation words in the text; else any certainty."""
    label = F.coalesce(*(F.nullif(normalize(x), F.lit("")) for x in (verified, asserted, status)), F.lit(""))
    return (
        F.when(label.isin(*L.BENCHMARK_CONFIRMED[:5]), "confirmed")
        .when(label.isin(*L.BENCHMARK_REFUTED), "refuted")
        .when(label.isin(*L.BENCHMARK_CONFIRMED[5:]), "confirmed")
        .when(any_of(normalize(text), L.NEGATION_WORDS), "refuted")
        .when(normalize(certainty).isin("high", "medium", "low"), "confirmed")
        .otherwise("unconfirmed")
    )


def benchmark_state(state, temporality) -> Column:
    s, t = normalize(state), normalize(temporality)
    return (
        F.when(s.isin("planned", "plan"), "planned").when(s.isin("historical", "history", "past"), "historical").when(s == "resolved", "resolved")
        .when(s.isin("active", "stable", "improving", "worsening"), "active").when(t.contains("future"), "planned").when(t.contains("past"), "historical").otherwise("active")
    )


def temporality_bucket(c) -> Column:
    t = normalize(c)
    year = F.nullif(F.regexp_extract(t, r"\b((19|20)\d{2})\b", 1), F.lit("")).cast("int")
    return (
        F.when(t == "", "unknown").when(any_of(t, L.FUTURE_WORDS), "future").when(any_of(t, L.CURRENT_WORDS), "current").when(any_of(t, L.PAST_WORDS), "past")
        .when(year < L.CURRENT_YEAR, "past").when(year > L.CURRENT_YEAR, "future").when(year == L.CURRENT_YEAR, "current").otherwise("unknown")
    )


def benchmark_concept(concept, text) -> Column:
    return normalize(first_text(concept, text))


def medication_role(kind: Column, state: Column) -> Column:
    k = normalize(kind)
    return F.when(k == "medicationstatement", "state").when(k.isin("medicationrequest", "order", "followup", "counseling") | (state == "planned"), "plan").otherwise("none")


def turn_id(c) -> Column:
    """T12, t12 or 12 as 12; null otherwise."""
    return F.nullif(F.regexp_extract(safe_text(c), r"^[Tt]?(\d+)$", 1), F.lit("")).cast("int")


def turn_span(c) -> Column:
    """All turn numbers of a text like "1,3;5-7", sorted; a range of over 50 gives its ends alone."""
    t = safe_text(c)
    for old, new in (("–", "-"), ("—", "-"), ("~", "-"), (" to ", "-"), ("TO", "-")):
        t = F.replace(t, F.lit(old), F.lit(new))

    def part(p: Column) -> Column:
        lo = F.nullif(F.regexp_extract(p, r"^[Tt]?(\d+)\s*-\s*[Tt]?(\d+)$", 1), F.lit("")).cast("int")
        hi = F.regexp_extract(p, r"^[Tt]?(\d+)\s*-\s*[Tt]?(\d+)$", 2).try_cast("int")
        a, b = F.least(lo, hi), F.greatest(lo, hi)
        return F.when(lo.isNotNull(), F.when(b - a <= 50, F.sequence(a, b)).otherwise(F.array(a, b))).otherwise(F.transform(F.regexp_extract_all(p, F.lit(r"(\d+)")), lambda x: x.try_cast("int")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(t, r"[,;/|]+"), lambda p: part(F.trim(p))))))


def judgment(c, allowed, aliases: dict, default: str) -> Column:
    f = F.regexp_replace(F.lower(safe_text(c)), "[^a-z]+", "_")
    out = F.coalesce(lookup(aliases, f), f) if aliases else f
    return F.when(out.isin(*allowed), out).otherwise(default)


def canonical(df, *, kind="prop_type", concept="concept", text="prop_text", verified="verification", status="clinical_status", temporality="temporality"):
    """Adds the canonical columns that gold and predicted propositions are compared on."""
    k, s = benchmark_type(kind), benchmark_state(status, temporality)
    return df.withColumns({
        "c_type": k, "c_concept": benchmark_concept(concept, text), "c_verification": benchmark_verification(verified, F.lit(""), F.lit(""), F.lit(""), text),
        "c_state": s, "c_time": temporality_bucket(temporality), "c_role": medication_role(k, s),
    })


