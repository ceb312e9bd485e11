"""Notes and reports: clean-up, checks, templates, reports of problem states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as W
from ..functions.text import n_words, normalize, safe_text

# Fixed values.
SOAP_HEADINGS = ("S", "O", "A", "P")
SECTION_HEADINGS = ("Chief Complaint", "History of Present Illness", "Findings", "Assessment", "Plan")
HEADINGS = {"soap": SOAP_HEADINGS, "sectioned": SECTION_HEADINGS}


def without_fence(c) -> Column:
    """A note without the code fence around it."""
    return F.regexp_replace(safe_text(c), r"^```[A-Za-z]*\s*\n?|\n?\s*```$", "")


def line_style(c: Column) -> Column:
    """A line without leading marks and conjunctions, its first letter large."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[\s,;:.\-]+", ""), r"(?i)^(and|but|so|then)\s+", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))


def clean_lines(c) -> Column:
    """Lines of a note in style, blank ones and repeats (by normalised text) left out."""
    lines = F.filter(F.transform(F.split(without_fence(c), "\n"), line_style), lambda x: x != "")
    both = F.array(F.struct(lines.alias("lines"), F.transform(lines, normalize).alias("norms")))  # each worked out once
    first = F.transform(both, lambda z: F.filter(z["lines"], lambda x, i: F.array_position(z["norms"], F.get(z["norms"], i)) == i + 1))
    return F.array_join(F.flatten(first), "\n")


def matches_template(c, template: str) -> Column:
    """Every heading of the template stands on a line of its own."""
    out = F.lit(True)
    for h in HEADINGS[template]:
        out = out & F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(rf"(?m)^\s*{h}:\s*$")
    return out


def repeats(df: DataFrame, keys: list[str], text: str, times: int = 3) -> DataFrame:
    """Notes in which a sentence stands `times` times or more."""
    s = df.select(*keys, F.explode(F.split(safe_text(text), r"(?<=[.!?])\s+")).alias("s")).where(n_words("s") > 0)
    return s.groupBy(*keys, normalize("s").alias("norm")).agg(F.count("*").alias("times")).where((F.col("times") >= times) & (F.col("norm") != "")).select(*keys).distinct()


def template_note(df: DataFrame, keys: list[str], template: str = "soap") -> DataFrame:
    """Notes of statements (keys, section, ord, text): the template's headings in order, each with its lines or "None"."""
    h = df.sparkSession.createDataFrame([(k, n) for k, n in enumerate(HEADINGS[template])], "place int, section string")
    cases = df.select(*keys).distinct().join(F.broadcast(h))
    per = df.groupBy(*keys, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("lines"))
    full = cases.join(per, [*keys, "section"], "left").withColumn("block", F.concat("section", F.lit(":\n"), F.coalesce("lines", F.lit("- None"))))
    return full.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n").alias("note"))


def state_report(groups: DataFrame) -> DataFrame:
    """A report a case out of clusters: active, planned and past problem states, "- None" where there are none."""
    kind = F.when(F.col("final_status") == "planned", "planned").when(F.col("final_status").isin("historical", "resolved"), "past").otherwise("active")
    line = F.concat(F.lit("- "), "cluster_id", F.lit(" "), "cluster_concept", F.lit(" ["), "final_verification", F.lit(", "), "final_status", F.lit("] "), "summary")
    rows = groups.withColumns({"kind": kind, "line": line})
    block = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("first_turn", "cluster_id", "line"))))
    text = lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: x["line"]), "\n")).otherwise("- None")
    out = rows.groupBy("case_id").agg(block("active").alias("a"), block("planned").alias("p"), block("past").alias("h"))
    return out.select("case_id", F.concat(F.lit("Active:\n"), text(F.col("a")), F.lit("\nPlanned:\n"), text(F.col("p")), F.lit("\nPast:\n"), text(F.col("h"))).alias("report"))


def prompt_lines(df: DataFrame, columns: list[str]) -> Column:
    """Pipe-delimited fields of a row, NA for what is blank."""
    return F.concat_ws(" | ", *(F.coalesce(F.nullif(safe_text(c), F.lit("")), F.lit("NA")) for c in columns))


def marked_turns(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Turns by [doctor] and [patient] marks anywhere in the text, numbered without gaps; without a mark the lines are the turns."""
    t = safe_text(text)
    parts = F.filter(F.transform(F.split(F.regexp_replace(t, r"(?i)\[(doctor|patient)\]", "\u0001[$1]"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(*keys, F.posexplode(F.filter(F.when(t.rlike(r"(?i)\[(doctor|patient)\]"), parts).otherwise(lines), lambda x: F.trim(F.regexp_replace(x, r"(?i)^\[(doctor|patient)\]", "")) != "")).alias("turn", "part"))
    who = F.lower(F.regexp_extract("part", r"(?i)^\[(doctor|patient)\]", 1))
    return rows.select(*keys, "turn", F.when(who != "", who).otherwise("unknown").alias("speaker"), F.trim(F.regexp_replace("part", r"(?i)^\[(doctor|patient)\]", "")).alias("said"))


def bullets(c) -> Column:
    """Lines of a list without their bullets or numbers."""
    return F.filter(F.transform(F.split(safe_text(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")


def line_groups(df: DataFrame, keys: list[str], tau: int = 2) -> DataFrame:
    """Ordered texts of entities (keys, section, line, entity): a new group where the section changes or over tau lines lie between."""
    w = Window.partitionBy(*keys).orderBy("line", "entity")
    new = F.when((F.col("line") - F.lag("line").over(w) > tau) | (F.col("section") != F.lag("section").over(w)), 1).otherwise(0)
    g = df.withColumn("new__", new).withColumn("group", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "group").agg(F.first("section").alias("section"), F.min("line").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "entity"))), lambda x: x["entity"]), "; ").alias("entities"))


def without_preamble(c) -> Column:
    """A note without the code fence around it and the lines before it that only say what it is."""
    t = safe_text(c)
    plain = F.regexp_replace(F.regexp_replace(t, r"^(?i)```(?:text|markdown)?\s*", ""), r"\s*```$", "")
    lead = rf"(?i)\A(?:[ \t]*(?:{'|'.join(W.PREAMBLES)})\s*(?:\n|\z)\s*)+"
    return safe_text(F.regexp_replace(F.when(t.startswith("```"), plain).otherwise(t), lead, ""))


def tidy(c: Column) -> Column:
    """A line without leading marks and one leading conjunction, single spaces, its first letter large."""
    t = F.regexp_replace(F.regexp_replace(safe_text(c), r"^[,;:]+\s*", ""), r"(?i)^(?:and|but|also)\s+", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000_000))


def opened(c: Column) -> Column:
    """A line that opens with who it is of, as one that opens with what is said."""
    out = c
    for words, instead in reversed(W.OPENERS):
        lead = rf"(?i)^\s*{words}\s+"
        out = F.when(c.rlike(lead), F.regexp_replace(c, lead, instead)).otherwise(out)
    return out


def section_text(items: Column, label: str) -> Column:
    """A section's text of its items: their lines without bullets, heading and repeats (by normalised text), openers varied from the second line on."""
    def lines(item: Column) -> Column:
        t = F.regexp_replace(without_preamble(item), r"(?m)^[ \t]*\*\*(.+?)\*\*[ \t]*$", "$1")
        t = F.regexp_replace(t, rf"(?i)^\s*{label}\s*:?\s*", "")
        return F.transform(F.split(t, r"\R"), lambda x: tidy(F.regexp_replace(x, r"^\s*[*\-•]+\s*", "")))

    every = F.filter(F.flatten(F.transform(items, lines)), lambda x: normalize(x) != "")
    both = F.array(F.struct(every.alias("lines"), F.transform(every, normalize).alias("norms")))  # each worked out once
    kept = F.flatten(F.transform(both, lambda z: F.filter(z["lines"], lambda x, i: F.array_position(z["norms"], F.get(z["norms"], i)) == i + 1)))
    return F.array_join(F.transform(kept, lambda x, i: F.when(i == 0, tidy(x)).otherwise(tidy(opened(x)))), "\n")
