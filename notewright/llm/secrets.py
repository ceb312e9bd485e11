"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration text."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: In the order in which equal starts are listed; "literal" is what the lexer adds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of so many hexadecimal digits: what HEX finds less what is too short, in one pass.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

#: Parts of names that call for a secret, with the score of a literal given to such a name.
SENSITIVE = {"password": 4, "passwd": 4, "pwd": 3, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "api_key": 4, "access_key": 4, "private_key": 4, "credential": 3, "credentials": 3, "auth": 2, "bearer": 3, "signature": 2, "salt": 2, "cert": 1, "key": 2}
#: Calls that give a name its value: setPassword("..."), define("DB_PASSWORD", "...").
SETTERS = {"set", "with", "put", "add", "define", "store", "setdefault", "setenv", "putenv"}
#: XML attributes that name an element's value, and those that hold it.
KEY_ATTRIBUTES, VALUE_ATTRIBUTES = {"key", "name", "id", "property", "param"}, {"value", "content", "default"}

_IDENTIFIER = re.compile(r"[A-Za-z_$@][\w$@.-]*+")
#: No alternative is tried again over the same characters, so a text takes time in proportion to its length: quoted
#: literals go to the end of their line if they aren't closed, and comments' marks are tokens of their own.
_QUOTED = r"""
  (?P<prose>(?:[^\W\d_]++[.,]?+\x20++(?=[^\W\d_]))++)
| (?P<long>(?<!\w)[A-Za-z]{0,2}(?:\"\"\"(?:[^"]|"(?!""))*+\"\"\"|\'\'\'(?:[^']|'(?!\'\'))*+\'\'\'))
| (?P<quoted>(?<!\w)[rRbBuUfF]{0,2}(?:"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?))
|"""
_REST = r"""
  (?P<line>\n)
| (?P<open>/\*|<!--)
| (?P<shut>\*/|-->)
| (?P<note>(?<!\S)\#|(?<![:\w])//)
| (?P<tag></?[A-Za-z][\w:.-]*+)
| (?P<sign>:=|=>|(?<![=!<>])=(?![=>])|:)
| (?P<enter>[(\[{])
| (?P<leave>[)\]}])
| (?P<end>[,;]|/?>)
| (?P<plus>\+(?=[\s"'A-Za-z_$(])|\|\||\?\?|\\(?=\n))
| (?P<bare>[^\s"'`=:,;(){}\[\]<>/\\+|?]++(?:[/+](?=[^\s"'`=:,;(){}\[\]<>])[^\s"'`=:,;(){}\[\]<>/\\+|?]*+)*+)
| (?P<other>\S)
"""
TOKEN = re.compile(_QUOTED + _REST, re.VERBOSE)
UNQUOTED = re.compile(_REST, re.VERBOSE)
#: Names whose values a literal takes in.
_INSIDE = re.compile(r"\$?\{([A-Za-z_]\w*+)\}|\$([A-Za-z_]\w*+)|%\(([A-Za-z_]\w*+)\)s")
_SECTION = re.compile(r"\[+([^\[\]\"'=,\n]++)\]+\s*+")
_LETTERS = re.compile(r"[^\W\d_]++")
_ELEMENT = re.compile(r"[^<>\s]++(?=</)")


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if p]


def name_score(name: str) -> int:
    """The highest score of one part of the name, or of two neighbouring ones."""
    return _short_name(name) if len(name) < 200 else _name(name)


@lru_cache(100_000)
def _short_name(name: str) -> int:
    return _name(name)


def _name(name: str) -> int:
    p = _parts(name)
    p = [x if x in SENSITIVE or not x.endswith("s") else x[:-1] for x in p]
    return max((SENSITIVE.get(x, 0) for x in [*p, *(f"{a}_{b}" for a, b in zip(p, p[1:])), *(a + b for a, b in zip(p, p[1:]))]), default=0)


_LOWER, _UPPER, _DIGIT = (frozenset(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
_ASCII = frozenset(map(chr, range(0x21, 0x7F)))


def literal_score(s: str) -> float:
    """Entropy in bits a character, more for mixed kinds of characters, nothing for short ones or plain words."""
    return characters_score(Counter(s)) if len(s) >= 8 else 0.0


def characters_score(n: Counter) -> float:
    """The same of how often each character stands in a text, so joined texts needn't be."""
    size = n.total()
    if size < 8 or not n.keys() <= _ASCII:
        return 0.0
    entropy = -sum(k / size * math.log2(k / size) for k in n.values())
    lower, upper, digit = (not n.keys().isdisjoint(x) for x in (_LOWER, _UPPER, _DIGIT))
    kinds = lower + upper + digit + (not n.keys() <= _LOWER | _UPPER | _DIGIT)
    return entropy * (0.0 if kinds < 2 or n.keys() <= _LOWER | _UPPER else 1.0) + kinds - 1


class _Target:
    """An assignment being read: its names, the highest score of the names around it, the spans of its literals and the names on its right."""

    __slots__ = ("around", "names", "refs", "sign", "spans", "wants")

    def __init__(self, names: list[str], around: int, sign: str):
        self.names, self.around, self.sign, self.spans, self.refs, self.wants = names, around, sign, [], [], True


class Lexer:
    """Name-literal pairs of one text: assignments, mappings, keyword arguments, sections, attributes and elements.

    found: (names, score of all names around them, spans, names on the right, whether it stands in a comment), by the end of each.
    Brackets and indented sections carry the highest score of what encloses them, so depth costs nothing.
    A bracket's literals belong to the assignment it stands in, but for those with names of their own.
    """

    def __init__(self, text: str):
        self.text, self.found = text, []
        self.now: _Target | None = None  # the assignment being read, inside the innermost bracket
        self.frames: list = []  # (the assignment around, what stands before the bracket, quoted literals in it, the sign, what goes on after it, score of enclosing names)
        self.back: list = []  # the last two operands before a sign, on this line
        self.section = 0  # the score of the section's name
        self.parents: list[tuple[int, int]] = []  # (indent, score of this and all names before) of lines that end with their name and a colon
        self.indent, self.first, self.margin = 0, True, 0
        self.block = self.note = False
        self.skip = 0  # what is read already
        self.attributes: dict | None = None
        self.args: list = []
        self._read(TOKEN, 0, len(text))
        self._reset()

    def _read(self, pattern: re.Pattern, a: int, b: int) -> None:
        text = self.text
        for m in pattern.finditer(text, a, b):
            kind, (x, y) = m.lastgroup, m.span()
            if x < self.skip:
                continue
            if kind == "quoted":
                q = x
                while text[q] not in "\"'":
                    q += 1
                if y - q < 2 or text[y - 1] != text[q] or self._escaped(q, y - 1):
                    self._read(UNQUOTED, q + 1, y)  # not closed: no quote
                else:
                    self._literal(q + 1, y - 1)
            elif kind == "long":
                q = text.index(text[y - 1], x)
                self._literal(q + 3, y - 3)
            else:
                getattr(self, "_" + kind)(x, y)

    def _escaped(self, q: int, at: int) -> bool:
        n = 0
        while at - n - 1 > q and self.text[at - n - 1] == "\\":
            n += 1
        return n % 2 == 1

    # -- operands

    def _start(self, x: int) -> None:
        if self.first:
            self.first = False
            self.indent = x - self.margin
            if not self.frames:
                while self.parents and self.parents[-1][0] >= self.indent:
                    self.parents.pop()

    def _prose(self, x: int, y: int) -> None:
        """Words one after the other: the first may be what an assignment wants, and ends it."""
        self._start(x)
        t = self.now or (self.frames[-1][0] if self.frames else None)
        if t:
            first = _LETTERS.match(self.text, x).end()
            if t is not self.now or t.wants:
                self._bare(x, first)
            self._close()
        self.back = []

    def _literal(self, a: int, b: int) -> None:
        self._start(a)
        owner = self.now if self.now else self.frames[-1][0] if self.frames else None
        if self.frames:
            self.frames[-1][2].append((a, b))
        if owner and (owner.wants or owner is not self.now or self.back and self.back[-1][0] == "quoted"):
            owner.spans.append((a, b))
            owner.refs += [x or y or z for x, y, z in _INSIDE.findall(self.text, a, b)]
            owner.wants = False
        self._remember("quoted", a, b)

    def _bare(self, x: int, y: int) -> None:
        self._start(x)
        word, t = self.text[x:y], self.now
        name = _IDENTIFIER.fullmatch(word) is not None
        if t is None and self.frames and not (name and self.text[y : y + 2].lstrip()[:1] in (":", "=")):
            t = self.frames[-1][0]
            if t and name and sum(c.isdigit() for c in word) < 2:
                t.refs.append(word)
        elif t and t.wants:
            t.wants = False
            if name and sum(c.isdigit() for c in word) < 2:
                t.refs.append(word)
            else:
                pad = y + 1 if self.text[y : y + 1] == "=" else y
                pad += self.text[pad : pad + 1] == "=" and pad > y
                if pad > y and not self.text[pad : pad + 1].strip(" \t\r\n,;)]}\"'<"):
                    y = self.skip = pad
                t.spans.append((x, y))
        elif t and not (self.back and self.text[self.back[-1][2] : x].strip(" \t") in ("or", "??", "||")):
            if word == "or":
                t.wants = True
            else:
                self._close()
        self._remember("bare", x, y)

    def _other(self, x: int, y: int) -> None:
        self._start(x)

    def _plus(self, x: int, y: int) -> None:
        if self.now:
            self.now.wants = True

    def _remember(self, kind: str, a: int, b: int) -> None:
        self.back = [*self.back[-1:], (kind, a, b)]

    # -- structure

    def _sign(self, x: int, y: int) -> None:
        sign, t = self.text[x:y], self.now
        if t and t.sign == ":" and sign != ":" and len(t.refs) + len(t.spans) <= 1:  # name: type = value
            t.sign, t.spans, t.refs, t.wants = sign, [], [], True
            return
        if t and sign == "=" and t.refs and not t.spans and self.back and self.text[self.back[-1][1] : self.back[-1][2]] == t.refs[-1]:  # a = b = value
            t.names.append(t.refs.pop())
            t.wants = True
            return
        if not self.back:
            return
        kind, a, b = self.back[-1]
        name = self.text[a:b]
        self._close()
        if name:
            around = self.frames[-1][5] if self.frames else self.parents[-1][1] if self.parents else 0
            self.now = _Target([name], max(around, self.section), sign)

    def _close(self, x: int | None = None) -> None:
        """Ends the assignment being read."""
        t, self.now = self.now, None
        if t and (t.spans or t.refs):
            self.found.append((t.names, t.around, t.spans, t.refs, self.block or self.note))
            if self.attributes is not None and t.spans:
                self.attributes[t.names[0].lower()] = t.spans[0]

    def _end(self, x: int, y: int) -> None:
        self._close()
        if self.text[y - 1] == ">" and self.attributes is not None:
            tag, seen, self.attributes = self.attributes.pop(None), self.attributes, None
            key = next((seen[k] for k in KEY_ATTRIBUTES if k in seen), None)
            for k in VALUE_ATTRIBUTES if key else ():
                if k in seen:
                    self._pair(self.text[key[0] : key[1]], seen[k])
            if y - x == 1 and (m := _ELEMENT.match(self.text, y)):
                self._pair(tag, m.span())

    def _pair(self, name: str, span: tuple[int, int]) -> None:
        self.found.append(([name], 0, [span], [], self.block or self.note))

    def _tag(self, x: int, y: int) -> None:
        self._close()
        self.attributes = {None: self.text[x:y].strip("</")}

    def _enter(self, x: int, y: int) -> None:
        self._start(x)
        before = self.back[-1] if self.back and not self.text[self.back[-1][2] : x].strip(" \t") else None
        inside = self.now is not None and (self.now.wants or before is not None)
        if not inside:
            self._close()
        owner = self.now if inside else self.frames[-1][0] if self.frames else None
        if self.text[x] == "{":
            self.attributes = None
        enclosing = max([self.frames[-1][5] if self.frames else 0, *map(name_score, owner.names if owner else ())])
        self.frames.append((owner, before, [], self.text[x], self.now if inside else None, enclosing))
        self.now, self.back = None, []

    def _leave(self, x: int, y: int | None = None) -> None:
        self._close()
        if not self.frames:
            return
        _, before, literals, sign, now, _ = self.frames.pop()
        self.now = now
        if now:
            now.wants = False
        self.back = []
        if sign == "[" and len(literals) == 1:  # names["key"] = value
            self.back = [("quoted", *literals[0])]
        if sign == "(" and before and before[0] == "bare" and literals:
            callee = _parts(self.text[before[1] : before[2]])
            if callee and (SETTERS & set(callee)):
                if len(literals) > 1 and _IDENTIFIER.fullmatch(self.text, *literals[0]):
                    self._pair(self.text[literals[0][0] : literals[0][1]], literals[1])
                elif len(literals) == 1:
                    self._pair(self.text[before[1] : before[2]], literals[0])

    def _line(self, x: int, y: int) -> None:
        t = self.now
        if not self.text[self.margin : x].strip():
            self._reset()
        elif t and t.wants and (self.frames or t.spans or t.refs or self.text[x - 1] == "\\"):
            pass  # goes on in the next line
        else:
            if t and t.wants and t.sign == ":":  # a section: its lines stand further in
                self.parents.append((self.indent, max(name_score(t.names[0]), self.parents[-1][1] if self.parents else 0)))
            self._close()
            if not self.frames and (m := _SECTION.fullmatch(self.text, self.margin, x)):
                self.section = name_score(m[1])
        self.back, self.first, self.margin, self.note = [], True, y, False

    def _reset(self) -> None:
        """At a blank line and the end: nothing is open any more."""
        self._close()
        while self.frames:
            self._leave(0)
            self._close()

    def _open(self, x: int, y: int) -> None:
        self._close()
        self.block = True

    def _shut(self, x: int, y: int) -> None:
        self._close()
        self.block = False

    def _note(self, x: int, y: int) -> None:
        self._close()
        self.note = True


class _Value:
    """What an assignment gives its names: its literals, and the values it takes in. Characters are counted once, however many take it in."""

    __slots__ = ("best", "characters", "inner", "judged", "own", "spans", "whole")

    def __init__(self, text: str, spans: list[tuple[int, int]], inner: list[_Value]):
        self.spans, self.inner, self.judged, self.whole = spans, inner, 0, False
        self.own = [literal_score(text[a:b]) for a, b in spans]
        self.best = max(self.own, default=0.0)
        self.characters = Counter()
        for a, b in spans:
            self.characters.update(text[a:b])

    def joined(self) -> float:
        """The score of its literals and those of the values taken in, all joined."""
        n = Counter(self.characters)
        for v in self.inner:
            n.update(v.characters)
        return characters_score(n)


def lexed(text: str, least: float = 6.0) -> list[tuple[int, int]]:
    """Spans of literals whose target name, or a name that later takes their value, is sensitive.

    Constants are propagated in the order of the text: the value of a name is its last assignment, with the values
    that the names on its right have then; a comment's assignments are judged but change no value. A literal's score
    is that of the name (names around it, however far, count one less) plus that of its own characters, or, where none of
    an assignment's literals is enough by itself, those of all joined, however many; from `least` on it counts, if the name scores at
    all. A value is judged once for each score, and each time by counts of characters, so n names that take a value of n
    literals take time in proportion to n.
    """
    if not ("=" in text or ":" in text or "(" in text or "<" in text):
        return []
    values: dict[str, _Value] = {}
    out = set()
    for names, around, spans, refs, comment in Lexer(text).found:
        inner = [values[r] for r in dict.fromkeys(refs) if r in values]
        score = max([around - 1, *map(name_score, names)])
        if comment and score <= 0:
            continue
        value = _Value(text, spans, inner)
        todo = [value] if score > 0 else []
        while todo:
            v = todo.pop()
            if v.judged >= score:
                continue
            v.judged = score
            out.update(s for s, own in zip(v.spans, v.own) if s[1] > s[0] and score + own >= least)
            if len(v.spans) + sum(len(x.spans) for x in v.inner) > 1 and score + max([v.best, *(x.best for x in v.inner)]) < least and score + v.joined() >= least:
                for x in (v, *v.inner):
                    if not x.whole:
                        x.whole = True
                        out.update(s for s in x.spans if s[1] > s[0])
            todo += v.inner
        if not comment:
            for n in names:
                values[n] = value
    return sorted(out)


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind as in KINDS."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    spans += [("literal", *s) for s in lexed(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of touching spans replaced by the mask."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


SCHEMA = "spans array<struct<kind:string,start:int,end:int>>, redacted string"


def scan(docs: DataFrame, *, text_col: str = "text", spans_col: str = "spans", redacted_col: str = "redacted") -> DataFrame:
    """docs with the spans found in each whole text and the text without them.

    A null text has no spans and stays null; so it is with an empty one, which stays empty. Rows are judged one by one, repeated rows
    alike. Columns of docs with the new names are replaced. No shuffle: a task holds one batch of rows; a very long text is read
    whole, in time in proportion to its length (names, depth and numbers of literals have no limit).
    """
    base = docs.drop(*(c for c in (spans_col, redacted_col) if c in docs.columns))
    k = base.columns.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*base.schema.fields, T.StructField(spans_col, span), T.StructField(redacted_col, T.StringType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(k).to_pylist()
            found = [find(t) if t else [] for t in texts]
            new = [pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in x] for x in found], kind), pa.array([t if not x else redacted(t, x) for t, x in zip(texts, found)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, spans_col, redacted_col])

    return base.mapInArrow(run, schema)
