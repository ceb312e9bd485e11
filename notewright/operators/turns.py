"""Turns, lines and chunks of transcripts and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.rules import clinical
from ..functions.text import n_words, normalize, safe_text

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SPEAKER = r"(?i)^\[(doctor|patient|clinician)\]\s*(.*)$"


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: line_no counts from 0, blank lines included; start is the first character's place."""
    parts = df.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_BREAK)).alias("line_no", "line"))
    return parts


def turns(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Turns of a transcript, one a line that isn't blank: turn_id has the line's number, so blank lines leave gaps."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    trimmed = F.trim(F.col("line"))
    rows = lines(df.withColumn("text__", safe_text(text)), "text__").withColumn("cursor", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    speaker = F.lower(F.regexp_extract(trimmed, SPEAKER, 1))
    said = F.when(speaker != "", F.trim(F.regexp_extract(trimmed, SPEAKER, 2))).otherwise(trimmed)
    rows = rows.withColumns({"speaker": F.when(speaker != "", speaker).otherwise("unknown"), "said": said}).where(trimmed != "")
    start = F.col("cursor") + F.greatest(F.instr("line", F.col("said")) - 1, F.lit(0))
    return rows.select(*keys, F.concat(F.lit("T"), "line_no").alias("turn_id"), F.col("line_no").alias("turn_idx"), "speaker", "said", start.alias("start_char"), (start + F.length("said")).alias("end_char"))


def note_units(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines of a note that aren't blank, numbered S0, S1, ..."""
    kept = F.filter(F.transform(F.split(safe_text(text), LINE_BREAK), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*keys, F.posexplode(kept).alias("n", "unit")).withColumn("turn_id", F.concat(F.lit("S"), "n"))


def packed(df: DataFrame, keys: list[str], units: str, max_chars: int = 1200, max_units: int = 8) -> DataFrame:
    """Greedy chunks of an array of texts: a unit opens a new chunk if the last one would get too long or too many.

    One pass over the array with the chunk's number, its units and characters as state.
    """
    start = F.expr("named_struct('c', 0, 'n', 0, 's', 0, 'out', cast(array() as array<int>))")

    def step(acc: Column, x: Column) -> Column:
        grown = acc["s"] + F.length(x) + F.when(acc["n"] > 0, 1).otherwise(0)
        new = (acc["n"] > 0) & ((acc["n"] >= max_units) | (grown > max_chars))
        c = acc["c"] + new.cast("int")
        return F.struct(c.alias("c"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, F.length(x)).otherwise(grown).alias("s"), F.array_append(acc["out"], c).alias("out"))

    numbered = F.aggregate(units, start, step, lambda a: a["out"])
    rows = df.select(*keys, F.posexplode(F.arrays_zip(F.col(units).alias("u"), numbered.alias("c"))).alias("pos", "z"))
    return rows.select(*keys, "pos", F.col("z.u").alias("unit"), F.col("z.c").alias("chunk"))


def chunk_ends(size: int, chars: int) -> str:
    """SQL: for each start (0-based) the end of the chunk that begins there, from the array `lens` of line lengths."""
    walk = f"aggregate(sequence(s, least(s + {size} - 1, size(lens) - 1)), named_struct('e', s, 'c', 0, 'open', true), (a, i) -> case when a.open and (i = s or a.c + 1 + lens[i] <= {chars}) then named_struct('e', i + 1, 'c', a.c + case when i = s then 0 else 1 end + lens[i], 'open', true) else named_struct('e', a.e, 'c', a.c, 'open', false) end, a -> a.e)"
    return f"transform(sequence(0, size(lens) - 1), s -> {walk})"


def turn_chunks(df: DataFrame, key: str, order: str, text: str, *, size: int = 12, overlap: int = 3, max_chars: int = 3500, short: int = 18) -> DataFrame:
    """Overlapping chunks of a case's turns: (key, chunk, from, until). Cases of up to `short` turns are one chunk.

    Where a chunk ends depends on its start alone, so the ends are worked out for every start and then followed.
    """
    per = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.length(text).alias("n")))), lambda x: x["n"]).alias("lens"))
    per = per.withColumn("ends", F.expr(chunk_ends(size, max_chars)))
    follow = f"aggregate(sequence(1, size(lens)), named_struct('at', 0, 'out', cast(array() as array<struct<a:int,b:int>>)), (acc, i) -> case when acc.at < 0 then acc else named_struct('at', case when ends[acc.at] >= size(lens) then -1 else greatest(ends[acc.at] - {overlap}, acc.at + 1) end, 'out', array_append(acc.out, named_struct('a', acc.at, 'b', ends[acc.at]))) end, acc -> acc.out)"
    chunks = F.when(F.size("lens") <= short, F.array(F.struct(F.lit(0).alias("a"), F.size("lens").alias("b")))).otherwise(F.expr(follow))
    return per.select(key, F.posexplode(chunks).alias("chunk", "c")).select(key, "chunk", F.col("c.a").alias("from_turn"), F.col("c.b").alias("until_turn"))


def fixed_chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("chunk", F.floor((n - 1) / size).cast("int"))


SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences: cut at white space after . ! ? before a capital or a digit."""
    return df.select(*keys, F.posexplode(F.filter(F.split(safe_text(text), SENTENCE_END), lambda s: F.trim(s) != "")).alias("pos", "sentence"))


def sections(rows: DataFrame, keys: list[str], line: str = "line", order: str = "line_no") -> DataFrame:
    """Adds section: how many headings (a line of up to 80 characters that ends in its only colon) have begun."""
    t = F.trim(line)
    heading = t.endswith(":") & (F.length(t) <= 80) & (F.length(F.regexp_replace(t, "[^:]", "")) == 1) & ~t.rlike(r"^[-*•]")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_heading", heading).withColumn("section", F.sum(heading.cast("int")).over(w))


SUBJECTIVE = r"(?i)^(s|subjective|chief complaint|history of present illness|hpi|review of systems|ros)\s*:"
OTHER_SECTION = r"(?i)^(o|a|p|objective|assessment|plan|assessment and plan|physical exam|findings|results)\s*:"


def subjective(rows: DataFrame, keys: list[str], line: str = "line", order: str = "line_no", begins: str = SUBJECTIVE, ends: str = OTHER_SECTION) -> DataFrame:
    """Lines from a subjective heading up to the next heading of another section."""
    t = F.trim(line)
    mark = F.when(t.rlike(begins), 1).when(t.rlike(ends), 0)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_view", F.last(mark, ignorenulls=True).over(w)).where("in_view = 1").drop("in_view")


def negations(df: DataFrame, keys: list[str], text: str = "said", speaker: str = "speaker") -> DataFrame:
    """What patients deny: phrases after deny, denies, denied or a leading no, up to but or except, cut at commas, and, or.

    Two words at least and a clinical sign; the first of equal ones; four a turn.
    """
    t = F.lower(safe_text(text))
    after = F.regexp_extract_all(t, F.lit(r"\b(?:deny|denies|denied)\b\s+([^.;]+)"), F.lit(1))
    phrases = F.concat(after, F.when(t.startswith("no "), F.array(F.substring(t, 4, 1_000_000))).otherwise(F.array().cast("array<string>")))
    heads = F.transform(phrases, lambda p: F.element_at(F.split(p, r"\bbut\b|\bexcept\b"), 1))
    pieces = F.transform(F.flatten(F.transform(heads, lambda p: F.split(p, ",|/| and | or "))), lambda p: F.regexp_replace(p, r"^[ .:;]+|[ .:;]+$", ""))
    good = F.filter(pieces, lambda p: (n_words(p) >= 2) & ~p.isin(*L.NEGATION_STOPS) & clinical(p))
    rows = df.where(F.lower(speaker).isin("patient", "unknown")).select(*keys, F.posexplode(good).alias("pos", "concept"))
    w = Window.partitionBy(*keys, normalize("concept")).orderBy("pos")
    rows = rows.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return rows.where("r <= 4").select(*keys, "pos", "concept", F.concat(F.lit("The patient denies "), "concept", F.lit(".")).alias("prop_text"))


def action_clauses(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Clauses of a plan, one from each verb of action to the next: two words at least, the first of equal ones, four at most."""
    verb = L.PLAN_VERBS
    marked = F.regexp_replace(F.col(text), "(?i)" + verb, "\u0001$1")
    parts = F.transform(F.filter(F.split(marked, "\u0001"), lambda p: p.rlike("(?i)^" + verb)), lambda p: F.regexp_replace(F.regexp_replace(p, r"^[ ,;.]+|[ ,;.]+$", ""), r"(?i)\b(and|then)\s*$", ""))
    parts = F.transform(parts, lambda p: F.concat(F.lit("The clinician will "), F.regexp_replace(p, r"^[ ,;.]+|[ ,;.]+$", ""), F.lit(".")))
    rows = df.select(*keys, F.posexplode(F.filter(parts, lambda p: n_words(p) >= 5)).alias("pos", "clause"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys, normalize("clause")).orderBy("pos"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where("r <= 4").drop("r")


def new_negations(df: DataFrame, props: DataFrame, case: str = "case_id", turn: str = "turn_idx", k: int = 8) -> DataFrame:
    """negations() of a case that no proposition (case, concept, verification) holds as refuted: the first of equal ones, k of a case."""
    held = props.where(F.lower(safe_text("verification")) == "refuted").select(case, normalize("concept").alias("norm__")).distinct()
    new = negations(df, [case, turn]).withColumn("norm__", normalize("concept")).join(held, [case, "norm__"], "left_anti")
    first = new.withColumn("r", F.row_number().over(Window.partitionBy(case, "norm__").orderBy(turn, "pos"))).where("r = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(turn, "pos"))).where(F.col("place") <= k).drop("r", "norm__")
