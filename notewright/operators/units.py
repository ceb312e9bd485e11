"""Units of notes: headings and sentences, sentences without false ends, blocks of turns, headings of templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions.text import n_words, safe_text

#: A line in capitals, with or without a colon. Fixed value.
CAPITALS = r"^\s*(?:#+\s*)?[A-Z][A-Z /&()-]{1,40}:?\s*$"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
SENTENCE_OR_BULLET_END = r"(?<=[.!?])\s+(?=[A-Z0-9•\-])"
_MASK = "\u0001"


def plain_text(c) -> Column:
    """One kind of line break, one blank for several, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return safe_text(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def is_heading(line: Column) -> Column:
    t = safe_text(line)
    return (t != "") & ((t.endswith(":") & (n_words(t) <= 6)) | t.rlike(CAPITALS))


def units(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, pos, kind, unit): headings as they are, other lines cut into sentences."""
    lines = df.select(*keys, F.posexplode(F.transform(F.split(plain_text(F.col(text)), "\n"), lambda x: safe_text(x))).alias("line_no", "line")).where("line <> ''")
    lines = lines.withColumn("kind", F.when(is_heading(F.col("line")), "header").otherwise("body"))
    parts = F.when(F.col("kind") == "header", F.array("line")).otherwise(F.filter(F.transform(F.split("line", SENTENCE_END), lambda x: safe_text(x)), lambda x: x != ""))
    return lines.select(*keys, "line_no", "kind", F.posexplode(parts).alias("pos", "unit"))


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): headings on lines of their own, the sentences between two of them on one."""
    order = Window.partitionBy(*keys).orderBy("line_no", "pos")
    head = (F.col("kind") == "header").cast("int")
    block = 2 * F.sum(head).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(head == 1, 0).otherwise(1)
    blocks = rows.withColumn("block", block).groupBy(*keys, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "unit"))), lambda x: x["unit"]), " ").alias("said"))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "said"))), lambda x: x["said"]), "\n").alias("text"))


def masked_sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, sentence): abbreviations (in any case, inside words too) end no sentence and come out in lower case."""
    t = safe_text(text)
    for a in sorted(W.ABBREVIATIONS, key=len, reverse=True):
        t = F.regexp_replace(t, "(?i)" + re.escape(a), a.replace(".", _MASK))
    parts = F.transform(F.split(t, SENTENCE_OR_BULLET_END), lambda s: safe_text(F.translate(s, _MASK, ".")))
    return df.select(*keys, F.posexplode(F.filter(parts, lambda s: s != "")).alias("pos", "sentence"))


def bullets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, line): lines without their bullets."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: safe_text(F.regexp_replace(x, r"^\s*[*\-•]+\s*", "")))
    return df.select(*keys, F.posexplode(F.filter(parts, lambda s: s != "")).alias("pos", "line"))


def turn_blocks(turns: DataFrame, keys: list[str], max_chars: int, *, number: str = "turn", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """(keys, lines, block): a case's first turns as lines, as many as fit into the characters, one at least."""
    line = F.concat(F.col(number), F.lit(": ["), F.col(speaker), F.lit("] "), F.col(text))
    order = Window.partitionBy(*keys).orderBy(number)
    rows = turns.withColumn("line__", line).withColumns({"upto__": F.sum(F.length("line__") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)), "k__": F.row_number().over(order)})
    kept = rows.where((F.col("upto__") <= max_chars) | (F.col("k__") == 1))
    return kept.groupBy(*keys).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k__", "line__"))), lambda x: x["line__"]), "\n").alias("block"))


def template_headings(c, template: str) -> Column:
    """Headings in bold as a template writes them."""
    t = F.coalesce(c, F.lit(""))
    if template == "soap":
        for key in W.NOTE_KEYS["soap"]:
            t = F.replace(t, F.lit(f"**{key}**"), F.lit(f"{key}:"))
    elif template == "sectioned":
        for key in W.NOTE_KEYS["sectioned"]:
            t = F.regexp_replace(t, rf"(?m)^\s*\*\*{re.escape(key)}\*\*\s*$", key)
    return safe_text(t)


def indexed_json(id_: Column, *fields) -> Column:
    """"id: {json}" of the fields that aren't null."""
    return F.concat(id_, F.lit(": "), F.to_json(F.struct(*fields)))


def output_stem(*parts) -> Column:
    return F.concat_ws("_", *parts)


def ordered_union(*frames: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of several chunks one after the other: ord counts on through (chunk, order)."""
    every = None
    for k, f in enumerate(frames):
        f = f.withColumn("chunk", F.lit(k))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return every.withColumn("place", F.struct("chunk", order))
