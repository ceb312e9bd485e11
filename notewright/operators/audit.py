"""Audits: facts, their priority and events, salient signals that nothing covers, reasons and ids of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions.infer import first_hit
from ..functions.normalize import any_of, lookup
from ..functions.rules import lower
from ..functions.text import audit_key, once, safe_text


def numeric_like(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), W.NUMERIC_WORDS)


def severe(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), W.SEVERE_WORDS)


def event_type(category: Column, predicate: Column, text: Column) -> Column:
    c, p, t = lower(category), lower(predicate), F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(
        F.when(c.isin(*W.AUDIT_DRUG_CATEGORIES), F.when(p.isin(*W.AUDIT_PLAN_PREDICATES), "MedicationPlan").otherwise("MedicationState")), lookup(W.AUDIT_TYPES, c),
        F.when(any_of(t, W.AUDIT_SAFETY_WORDS), "FollowUpSafety"), F.when(any_of(t, W.AUDIT_DRUG_WORDS), "MedicationState"), F.when(numeric_like(t), "FindingResult"),
        F.when(any_of(t, W.AUDIT_DIAGNOSIS_WORDS), "DiagnosisImpression"), F.when(any_of(t, W.AUDIT_VERBS), "MedicationState"), F.when(any_of(t, W.AUDIT_RETURN_WORDS), "FollowUpSafety"), F.lit("PMFSContext"),
    )


def _points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def fact_priority(category: Column, predicate: Column, text: Column, tags: Column) -> Column:
    """How much a fact of a transcript matters."""
    c = F.lower(F.coalesce(category, F.lit("")))
    tagged = F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, W.URGENT_TAGS)))
    base = F.when(c.isin(*W.URGENT_CATEGORIES), 60).when(c.isin(*W.PRESENT_CATEGORIES), 40).when(c == "history", 20).otherwise(0)
    return base + _points(F.lower(F.coalesce(predicate, F.lit(""))).isin(*W.URGENT_PREDICATES), 25) + _points(tagged, 25) + _points(severe(text), 25) + _points(numeric_like(text), 10)


def summary_priority(category: Column, text: Column, tags: Column) -> Column:
    """How much a fact of a note matters."""
    c = F.lower(F.coalesce(category, F.lit("")))
    tagged = F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, W.URGENT_TAGS)))
    base = F.when(c.isin(*W.URGENT_CATEGORIES), 70).when(c.isin(*W.PRESENT_CATEGORIES), 45).when(c == "history", 15).otherwise(0)
    return base + _points(tagged, 30) + _points(severe(text), 30) + _points(numeric_like(text), 10) - _points(any_of(F.lower(F.coalesce(text, F.lit(""))), W.MINOR_FACT_WORDS), 35)


def priority_label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 40, "medium").otherwise("low")


def severity(score: Column) -> Column:
    return F.when(score >= 60, "major").otherwise("minor")


def omission_family(category: Column, kind: Column, text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(kind.isin(*W.PLAN_EVENTS), "Information and Plan").when(kind.isin(*W.ISSUE_EVENTS), "Current Issues")
        .when(kind == "MedicationState", F.when(any_of(t, W.DOSE_CHANGE_WORDS), "Information and Plan").otherwise("PMFS"))
        .when((kind == "PMFSContext") | F.lower(F.coalesce(category, F.lit(""))).isin(*W.CONTEXT_CATEGORIES), "PMFS").otherwise("Current Issues")
    )


def hallucination_families(kind: Column, status: Column, text: Column) -> Column:
    """Sorted names, joined by commas."""
    t = F.lower(F.coalesce(text, F.lit("")))
    negated = (F.lower(F.coalesce(status, F.lit(""))) == "negated") | F.concat(F.lit(" "), t, F.lit(" ")).contains(" no ") | t.contains("denies")
    cause, context = any_of(t, W.CAUSE_WORDS), any_of(t, W.CONTEXT_WORDS)
    made = kind.isin(*W.FABRICATION_EVENTS) | ~(negated | cause | context)
    return F.concat_ws(",", F.when(cause, "Causality"), F.when(context, "Contextual"), F.when(made, "Fabrication"), F.when(negated, "Negation"))


def to_verify(category: Column, predicate: Column, status: Column, text: Column, tags: Column) -> Column:
    """Whether a missing fact would be a major omission."""
    t = F.lower(safe_text(text))
    asked = lower(predicate).isin(*W.QUERY_PREDICATES) & lower(status).isin("", "uncertain")
    return (t != "") & ~asked & ~any_of(t, W.QUERY_WORDS) & (fact_priority(category, predicate, text, tags) >= 40)


def hits(t: Column, words, n: int) -> Column:
    """The first n of the words that t holds, in the order of the words."""
    return F.slice(F.array_compact(F.array(*(F.when(t.contains(w), F.lit(w)) for w in words))), 1, n)


def slots(text: Column) -> Column:
    return once(F.lower(safe_text(text)), _slots)


def _slots(t: Column) -> Column:
    side = F.when(t.contains("bilateral"), "bilateral").when(t.contains("right"), "right").when(t.contains("left"), "left")
    return F.struct(side.alias("laterality"), F.slice(F.regexp_extract_all(t, F.lit(W.AUDIT_VALUES), F.lit(0)), 1, 3).alias("values"), hits(t, W.AUDIT_SITES, 3).alias("body_sites"), hits(t, W.AUDIT_ACTIONS, 3).alias("actions"), hits(t, W.AUDIT_PLANS, 4).alias("plan_terms"))


def signature(kind: Column, text: Column, source: Column) -> Column:
    """What facts of a note share if they belong to one event: main terms or the concept, and the sentence they come from."""
    key = audit_key(text)
    primary = once(slots(text), lambda s: F.concat(*(F.slice(s[f], 1, 2) for f in ("plan_terms", "actions", "body_sites", "values"))))
    primary = once(primary, lambda p: F.when(F.size(p) > 0, p).otherwise(F.slice(F.filter(F.split(key, " "), lambda w: w != ""), 1, 3)))
    main = F.array_join(F.slice(F.array_sort(F.array_distinct(primary)), 1, 4), " ")
    return F.when(kind.isin(*W.SOURCE_EVENTS) | ((kind == "SymptomState") & source.isNotNull()), main).otherwise(key)


def events(facts: DataFrame, *, of_note: bool = False, k: int | None = None) -> DataFrame:
    """Events of facts (case_id, ord, category, predicate, status, text, tags, of a note: source), in the order in which they first appear.

    Facts of one type and concept (of a note: signature and source) are one event; its best fact, the first of the highest
    priority, stands for it. k: only so many of a case, by rank (priority, severity, type, then number).
    """
    kind, key = event_type(F.col("category"), F.col("predicate"), F.col("text")), audit_key(F.col("text"))
    score = summary_priority(F.col("category"), F.col("text"), F.col("tags")) if of_note else fact_priority(F.col("category"), F.col("predicate"), F.col("text"), F.col("tags"))
    rows = facts.withColumns({"event_type": kind, "score": score}).withColumn("concept", signature(F.col("event_type"), F.col("text"), F.col("source")) if of_note else key)
    keys = ["case_id", "event_type", "concept"] + (["source"] if of_note else [])
    best = F.struct("score", -F.col("ord"))
    out = rows.groupBy(*keys).agg(F.min("ord").alias("first_ord"), F.count("*").alias("facts"), F.max_by(F.struct("ord", "text", "category", "status", "score"), best).alias("b"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("first_ord", "event_type", "concept")) - 1
    out = out.select("case_id", number.alias("n"), "event_type", "concept", "facts", "b.*").withColumns({
        "event_id": F.concat(F.lit("SE" if of_note else "TE"), "n"), "clinical_priority": priority_label(F.col("score")), "severity": severity(F.col("score")),
        "omission_family": omission_family(F.col("category"), F.col("event_type"), F.col("text")), "hallucination_families": hallucination_families(F.col("event_type"), F.col("status"), F.col("text")),
    })
    if k is not None:
        level = F.when(F.col("clinical_priority") == "high", 3).when(F.col("clinical_priority") == "medium", 2).otherwise(1)
        rank = F.row_number().over(Window.partitionBy("case_id").orderBy(level.desc(), (F.col("severity") == "major").desc(), F.coalesce(lookup(W.EVENT_RANKS, F.col("event_type")), F.lit(0)).desc(), "n"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.drop("category", "status", "n")


def salient(kind: Column, text: Column, term: Column, semantic: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return any_of(k, W.SALIENT_TYPES) | any_of(F.lower(F.concat_ws(" ", k, F.coalesce(text, F.lit("")), F.coalesce(term, F.lit("")), F.lower(F.coalesce(semantic, F.lit(""))))), W.SEVERE_WORDS)


def _words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 3)


def _held(words: Column, text: Column) -> Column:
    """Two of the words, or the only one, stand in the text."""
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: text.contains(w))) >= F.least(F.lit(2), F.size(words)))


def covered(text: Column, term: Column, by: Column) -> Column:
    """Whether a signal's words stand in the text of propositions (lower case)."""
    a, b = lower(text), lower(term)
    return ((F.length(a) >= 4) & by.contains(a)) | ((F.length(b) >= 4) & by.contains(b)) | _held(_words(F.when(b != "", b).otherwise(a)), by)


def relevant(text: Column, term: Column, chunk: Column) -> Column:
    a, b = lower(text), lower(term)
    one = lambda c: ((F.length(c) >= 5) & chunk.contains(c)) | _held(_words(c), chunk)
    return one(a) | one(b)


def uncovered_signals(signals: DataFrame, chunks: DataFrame, props: DataFrame, k: int = 8) -> DataFrame:
    """Signals (case_id, ord, kind, text, term, semantic) that are salient and in the case's chunk (text), but in none of its propositions (text).

    The first of equal ones, k of a case; the propositions' texts of a case are joined once.
    """
    w = Window.partitionBy("case_id", "kind", "text", "term").orderBy("ord")
    first = signals.where(salient(F.col("kind"), F.col("text"), F.col("term"), F.col("semantic"))).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    by = props.groupBy("case_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")).alias("by"))
    both = first.join(chunks.select("case_id", F.lower("text").alias("chunk")), "case_id").join(by, "case_id", "left")
    left = both.where(relevant(F.col("text"), F.col("term"), F.col("chunk")) & ~covered(F.col("text"), F.col("term"), F.coalesce("by", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    return left.withColumn("place", place).where(F.col("place") <= k).select("case_id", "ord", "kind", "text", "term", "place")


def label_ids(c: Column, prefix: str) -> Column:
    """Numbers of the labels (an array of texts) that are the prefix and a number, in either case; sorted."""
    found = F.transform(c, lambda x: F.nullif(F.regexp_extract(F.trim(x), f"^(?i:{prefix})(\\d+)$", 1), F.lit("")).cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def aligned_reasons(ids: DataFrame, reasons: DataFrame, prefix: str) -> DataFrame:
    """(case_id, id, reason): each id's first reason that names it; ids without one take the reasons that name none of
    them, in order, and then a standard text. ids: (case_id, id); reasons: (case_id, ord, reason)."""
    named = F.nullif(F.regexp_extract("reason", f"(?i)\\b{prefix}(\\d+)\\b", 1), F.lit("")).cast("long")
    said = reasons.where(safe_text("reason") != "").select("case_id", "ord", safe_text("reason").alias("reason"), named.alias("id"))
    ids = ids.distinct()
    own = said.join(ids, ["case_id", "id"]).groupBy("case_id", "id").agg(F.min_by("reason", "ord").alias("own"))
    rest = said.join(ids, ["case_id", "id"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))).select("case_id", "k", F.col("reason").alias("spare"))
    named = ids.join(own, ["case_id", "id"], "left")
    k = F.row_number().over(Window.partitionBy("case_id", F.col("own").isNull()).orderBy("id"))
    open_ = named.withColumn("k", F.when(F.col("own").isNull(), k))
    default = F.concat(F.lit(prefix), "id", F.lit(": clinically important unsupported/missing event detected."))
    return open_.join(rest, ["case_id", "k"], "left").select("case_id", "id", F.coalesce("own", "spare", default).alias("reason"))


def partitioned_concepts(listed: DataFrame, judged: DataFrame) -> DataFrame:
    """listed (case_id, ord, concept) by whether the judged ones (case_id, concept) of its case hold it: (case_id, ord, concept, found).

    Compared by their plain text; blank ones go, and the first of equal ones stays.
    """
    from ..functions.text import normalize

    w = Window.partitionBy("case_id", "norm").orderBy("ord")
    rows = listed.withColumn("norm", normalize("concept")).where("norm <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    held = judged.select("case_id", normalize("concept").alias("norm")).where("norm <> ''").distinct().withColumn("found", F.lit(True))
    return rows.join(held, ["case_id", "norm"], "left").select("case_id", "ord", "concept", F.coalesce("found", F.lit(False)).alias("found"))


def concept_scores(pred: DataFrame, ref: DataFrame, in_ref: DataFrame, in_pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of concepts a case: pred and ref (case_id, ord, concept), each judged against the other side's note."""
    count = lambda rows, judged, n: partitioned_concepts(rows, judged).groupBy("case_id").agg(F.count_if("found").alias(f"{n}_found"))
    sizes = lambda rows, n: rows.groupBy("case_id").agg(F.count("*").alias(n))
    both = sizes(pred, "n_pred").join(sizes(ref, "n_ref"), "case_id", "full").join(count(pred, in_ref, "pred"), "case_id", "left").join(count(ref, in_pred, "ref"), "case_id", "left").na.fill(0)
    p = F.when(F.col("n_pred") > 0, F.col("pred_found") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_ref") > 0, F.col("ref_found") / F.col("n_ref")).otherwise(0.0)
    out = both.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def first_family(text: Column, table: dict) -> Column:
    return F.coalesce(*(F.when(first_hit(text, words).isNotNull(), name) for name, words in table.items()))


def fact_records(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """(keys, pos, fact_text, item): facts out of JSON (a list, an object with "atomic_propositions", or one object) or of the lines of a plain text.

    item is the fact's JSON, null for lines; a fact's text is fact_text, proposition_text or text, or else its JSON; blank ones go.
    """
    v, list_of = F.try_parse_json(raw), "array<variant>"
    kind = F.schema_of_variant(v)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", list_of)).when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.atomic_propositions", list_of), F.array(v)))
    parsed = df.where(items.isNotNull()).select(*keys, F.posexplode(items).alias("pos", "v")).where(F.schema_of_variant("v").rlike("^(OBJECT|STRING)"))
    given = [F.nullif(F.trim(F.try_variant_get("v", f"$.{k}", "string")), F.lit("")) for k in ("fact_text", "proposition_text", "text")]
    plain = F.try_variant_get("v", "$", "string")
    parsed = parsed.select(*keys, "pos", F.trim(F.when(F.schema_of_variant("v") == "STRING", plain).otherwise(F.coalesce(*given, F.to_json("v")))).alias("fact_text"), F.to_json("v").alias("item"))
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\- ]+|[\- ]+$", ""), r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.filter(F.split(raw, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), strip), lambda x: x != "")
    text = df.where(items.isNull()).select(*keys, F.posexplode(lines).alias("pos", "fact_text")).withColumn("item", F.lit(None).cast("string"))
    return parsed.where("fact_text <> ''").unionByName(text)
