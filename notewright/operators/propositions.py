"""Propositions: first of each key, best k, gold of several annotators, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import type_priority
from ..functions.text import n_words, normalize, safe_text


def keep_first(df: DataFrame, keys: list[Column], order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """The first row of each key in the order given. Not dropDuplicates, which keeps any."""
    named = {f"k{n}__": k for n, k in enumerate(keys)}
    w = Window.partitionBy(*(partition or []), *named).orderBy(*order)
    return df.withColumns(named).withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__", *named)


def sanitized(df: DataFrame) -> DataFrame:
    """First proposition of each (type, concept, text, verification, temporality) of a case, without blank ones, numbered anew."""
    keys = [F.col("prop_type"), normalize("concept"), normalize("prop_text"), F.col("verification"), normalize("temporality")]
    first = keep_first(df.where((normalize("concept") != "") & (normalize("prop_text") != "")), keys, [F.col("ord")], ["case_id"])
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    return first.withColumn("prop_id", F.concat(F.lit("CAP"), n))


def merged_top(df: DataFrame, k: int = 64) -> DataFrame:
    """The k best propositions of a case by type, then text length, the first of equals; each key once."""
    best = [type_priority(F.col("prop_type")).desc(), n_words("prop_text").desc(), F.col("ord")]
    keys = [F.lower("prop_type"), normalize("prop_text"), F.lower("verification"), F.lower("clinical_status"), normalize("temporality")]
    first = keep_first(df, keys, best, ["case_id"])
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*best))).where(F.col("rank") <= k)


MERGE_KEY = ["m_type", "m_concept", "c_verification", "c_time"]


def merge_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"m_type": normalize("c_type"), "m_concept": normalize("c_concept")})


def gold(df: DataFrame, mode: str = "union") -> DataFrame:
    """Gold of all annotators of a case (columns of canonical() with annotator and ord): each key's first proposition.

    union: every key; intersection: those that all annotators of the case have; per_annotator: all rows under case@@annotator.
    """
    if mode == "per_annotator":
        return df.withColumn("case_key", F.concat_ws("@@", F.col("case_id").cast("string"), "annotator"))
    keyed = merge_key(df)
    per = keyed.groupBy("case_id", *MERGE_KEY).agg(F.countDistinct("annotator").alias("annotators"), F.min_by("prop_text", F.struct("annotator", "ord")).alias("prop_text"))
    if mode == "intersection":
        needed = df.groupBy("case_id").agg(F.countDistinct("annotator").alias("needed"))
        per = per.join(needed, "case_id").where("annotators >= needed").drop("needed")
    elif mode != "union":
        raise ValueError(f"unknown mode {mode!r}")
    return per


def annotator_health(df: DataFrame) -> DataFrame:
    """Cases with fewer than two annotators, or whose annotators' sets of propositions are all the same."""
    sig = F.concat_ws("|", "m_type", "m_concept", normalize("prop_text"), "c_verification", "c_state", "c_time")
    sets = merge_key(df).groupBy("case_id", "annotator").agg(F.array_join(F.array_sort(F.collect_set(sig)), "\n").alias("sig"))
    per = sets.groupBy("case_id").agg(F.countDistinct("annotator").alias("annotators"), F.countDistinct("sig").alias("kinds"))
    return per.withColumn("finding", F.when(F.col("annotators") < 2, "single").when(F.col("kinds") == 1, "identical")).where("finding is not null").drop("kinds")


PAYLOAD_KEYS = ("caps", "facts", "clinical_atomic_facts", "atomic_propositions", "gold_caps", "seed_gold_caps")


def payload(df: DataFrame, column: str = "raw") -> DataFrame:
    """Explodes the list of objects of a JSON text: the text itself, or the first key that holds a list, or what "transcript_facts" holds.

    Fences and trailing commas are mended; what can't be read gives no rows. Adds pos and item (JSON text).
    """

    def once(c: Column, f) -> Column:
        """f of c, which is worked out once."""
        return F.get(F.transform(F.array(c), f), F.lit(0))

    def lists(v: Column) -> Column:
        arr = "array<variant>"
        found = [F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", arr))]
        found += [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY"), F.try_variant_get(v, f"$.{k}", arr)) for k in PAYLOAD_KEYS]
        return F.coalesce(*found)

    inner = lambda v: F.try_parse_json(F.coalesce(F.try_variant_get(v, "$.transcript_facts", "string"), F.lit("")))
    items = once(F.try_parse_json(json_text(F.col(column))), lambda v: F.coalesce(lists(v), once(inner(v), lists)))
    out = df.select("*", F.posexplode(items).alias("pos", "v"))
    return out.where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("item", F.to_json("v")).drop("v")


def json_text(c: Column) -> Column:
    """JSON out of a model's answer: code fences, text around the outermost braces, trailing commas and NULs go."""
    t = F.regexp_replace(safe_text(c), r"^```[A-Za-z]*\s*|\s*```$", "")
    t = F.regexp_replace(F.replace(t, F.lit("\x00"), F.lit("")), r",\s*([}\]])", "$1")
    braces = F.regexp_extract(t, r"(?s)[\[{].*[\]}]", 0)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(braces != "", braces).otherwise(t)
