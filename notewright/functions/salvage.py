"""What can be saved of a broken JSON text with a note's sections: one pass of a tokenizer, and a fold that gives literals to keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import NOTE_KEYS
from .text import plain_quotes

#: So many literals of a section are kept.
KEPT = 8


def _any_name(names: tuple[str, ...]) -> str:
    return "|".join(re.escape(n).replace("\\ ", " ") for n in sorted(names, key=len, reverse=True))


def _value(token: Column) -> Column:
    """A literal as JSON reads it, or without its quotes where JSON doesn't."""
    quoted = F.regexp_replace(token, r"\s*:$", "")
    read = F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "v string")["v"]
    return F.btrim(F.coalesce(read, F.btrim(quoted, F.lit('"'))), F.lit(" \t\r\n"))


def keyed(text: Column, names: tuple[str, ...]) -> Column:
    """array<struct<name, value>>: a section's name where its key first stands (value null), then each literal up to the next first key.

    Tokens are keys and quoted literals; a literal ends before a quote that begins a key, so a lost quote costs one literal alone."""
    name = _any_name(names)
    key = rf'"(?i:{name})"\s*:'
    tokens = F.regexp_extract_all(text, F.lit(rf'{key}|"(?:\\.|[^"\\])*"(?!(?i:{name})"\s*:)(?:\s*:)?'), F.lit(0))
    start = F.expr("named_struct('now', cast(null as string), 'found', cast(array() as array<struct<name:string,value:string>>))")
    row = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    none = F.lit(None).cast("string")

    def step(acc: Column, token: Column) -> Column:
        called = F.lower(F.regexp_extract(token, rf'^"((?i:{name}))"\s*:$', 1))
        opens = (called != "") & ~F.exists(acc["found"], lambda x: x["name"] == called)
        put = lambda now, r: F.struct(now.alias("now"), F.array_append(acc["found"], r).alias("found"))
        return F.when(opens, put(called, row(called, none))).when(acc["now"].isNotNull(), put(acc["now"], row(acc["now"], _value(token)))).otherwise(acc)

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


def headed(text: Column, names: tuple[str, ...]) -> Column:
    """array<struct<a, b, name>> by place: each heading at the start of a line; names anywhere where there is no such heading."""
    place = lambda n, a, size: F.when(a > 0, F.struct(a.alias("a"), (a + size).alias("b"), F.lit(n.lower()).alias("name")))
    line = {n: rf"(?im)^[\s\"'`>\-*]*{re.escape(n)}\s*:?".replace("\\ ", " ") for n in names}
    lines = F.array_sort(F.array_compact(F.array(*(place(n, F.regexp_instr(text, F.lit(p)), F.length(F.regexp_substr(text, F.lit(p)))) for n, p in line.items()))))
    plain = F.array_sort(F.array_compact(F.array(*(place(n, F.instr(F.lower(text), n.lower()), F.lit(len(n))) for n in names))))
    return F.when(F.size(lines) > 0, lines).otherwise(plain)


def sections(c: Column, template: str) -> Column:
    """A map from a template's sections to what a broken text has of them: the literals after a key, else what follows a heading.

    Sections without any are empty; null where there is neither key nor heading; all empty for a null or blank text."""
    names = NOTE_KEYS[template]
    text = F.btrim(F.coalesce(plain_quotes(c), F.lit("")), F.lit(" \t\r\n"))
    found, heads = keyed(text, names), headed(text, names)
    literals = lambda n: F.array_join(F.slice(F.transform(F.filter(found, lambda x: (x["name"] == n.lower()) & (x["value"] != "")), lambda x: x["value"]), 1, KEPT), " ")
    ends = F.transform(heads, lambda h: F.struct(h["name"].alias("name"), F.substring(text, h["b"], F.coalesce(F.array_min(F.transform(F.filter(heads, lambda x: x["a"] > h["a"]), lambda x: x["a"])), F.length(text) + 1) - h["b"]).alias("said")))
    clean = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[\s\"'`>\-,:;]+", ""), r"[\s\"'`{}\-,:;]+$", ""), r"\s+", " "))
    after = lambda n: F.coalesce(clean(F.get(F.filter(ends, lambda x: x["name"] == n.lower()), F.lit(0))["said"]), F.lit(""))
    of = lambda get: F.create_map(*(x for n in names for x in (F.lit(n), get(n))))
    return F.when(text == "", of(lambda n: F.lit(""))).when(F.size(found) > 0, of(literals)).when(F.size(heads) > 0, of(after))
