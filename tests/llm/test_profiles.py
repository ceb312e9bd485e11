"""Toxicity, phrase collocations and the divergence audit against brute force on small rows, and over odd ones."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import collocations, divergence, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def frame(spark, rows, more=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({x: F.lit("clash") for x in ("key", "term", "n", "row", "score", "label", "block", "rank", "value")}) if more else df


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- toxicity


def test_fold_undoes_disguises():
    """Homoglyphs, full-width letters, marks and digits; ordinary letters, numbers and trailing signs stay."""
    assert toxicity.fold("1d10t  l0ser\nŤRASH tr@sh $cum") == "idiot loser trash trash scum"
    assert toxicity.fold("іdіоt ｉｄｉｏｔ Мoron") == "idiot idiot moron"
    assert toxicity.fold("É été 1234 9.5 abc$$$") == "é été 1234 9.5 abc $$$"
    assert toxicity.fold("été") == "été" and toxicity.fold("") == ""


def test_hits_stems_exceptions_and_word_starts():
    model = toxicity.Model({"trash": 2.0, "low*": 1.0, "lowest": 3.0}, ("trash can",))
    words = lambda t: [(t[a:b], w) for a, b, w in model.hits(t)]
    assert words("trash can, trash") == [("trash", 2.0)]
    assert words("trashy untrash low lower lowest lowests") == [("low", 1.0), ("lowest", 3.0), ("low", 1.0)]
    assert toxicity.Model({}).hits("anything") == []
    assert [w for *_, w in toxicity.Model({"loser": 4.0}).hits(toxicity.fold("a 1oser"))] == [4.0]  # 1 for l
    clean = model.score(0.0, 0)
    assert 0 < clean < 0.5 and model.score(2.0, 100) > model.score(2.0, 100_000) > clean


def labelled(spark, seed, n=300):
    r = random.Random(seed)
    plain = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(200)]
    bad = ["vermin", "zounds", "blighter"]
    rows, labels = [], []
    for k in range(n):
        w = r.choices(plain, k=r.randint(20, 200))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice([*bad, "grimb" + r.choice(plain)]))
        elif k % 7 == 0:
            w += ["blighter", "beetle"]
        rows.append((k, " ".join(w), "en", "s"))
        if k % 3 != 1:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def test_lexicon_is_learned_and_tells_held_out_documents(spark):
    """Words, stems and exceptions are found; documents whose labels were never seen are told."""
    rows, labels = labelled(spark, 1)
    docs, marks = frame(spark, rows, more=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.where("doc_id < 200"), marks)
    assert {"vermin", "zounds"} <= set(model.terms) and any(t.startswith("grim") and t.endswith("*") for t in model.terms)
    assert "blighter beetle" in model.exceptions or "blighter" not in model.terms
    out = toxicity.score(docs, model)
    assert set(out.columns) == {*docs.columns, "predicted"}
    got = {r["doc_id"]: r for r in out.collect()}
    held = [k for k in range(200, 300)]
    hit = [got[k]["predicted"] for k in held if k % 5 == 0]
    assert sum(hit) >= 0.8 * len(hit) and sum(got[k]["predicted"] for k in held if k % 5) <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_copies_of_a_document_add_no_words():
    """Words that only go along with a telling one in copies are no entries of their own."""
    docs = [np.array([0, 1, 2])] * 12 + [np.array([0])] * 30
    assert toxicity.cover(docs, ["vermin", "chair", "table"], np.array([0, 0, 0]), 400, 16.0)[0] == 0
    assert toxicity.cover(docs, ["vermin", "chair", "table"], np.array([0, 0, 0]), 400, 16.0) == [0]


def test_toxicity_of_odd_rows(spark):
    """Without labels, without toxic ones, over nulls, empty and very long texts, repeated rows and several labels of an id."""
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "fine words " * 50_000, "en", "s"), (3, "fine words", "en", "s"), (None, "fine", "en", "s")]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks in (none, spark.createDataFrame([(1, 0), (1, None), (2, 0), (None, 1), (99, 1)], "doc_id long, toxic int")):
        docs = frame(spark, rows)
        model = toxicity.train(docs, marks)
        assert model.terms == {}
        assert sorted((r["predicted"], r["score"] < 0.5) for r in toxicity.score(docs, model).collect()) == [(0, True)] * 5
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.score(frame(spark, rows), toxicity.train(frame(spark, rows), marks)).count() == 5
    assert toxicity.score(frame(spark, []), toxicity.train(frame(spark, []), marks)).count() == 0


# -- collocations


def brute_collocations(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang_ = "und" if lang is None else lang
            n[lang_] += len(w)
            f.update((lang_, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= least}
    inner = set()
    for x, c in often.items():
        for i in range(1, len(x)):
            for j in range(i + 1, len(x) + 1):
                if j - i < len(x) - 1 and c >= often.get((x[0], *x[i:j]), math.inf):
                    inner.add((x[0], *x[i:j]))
    out = collections.defaultdict(list)
    for x, a in often.items():
        if len(x) > 2 and x not in inner:
            lang, *w = x
            cuts = []
            for k in range(1, len(w)):
                left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def talk(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé", k=r.randint(1, 3))) for _ in range(25)]
    fixed = ["new york city hall", "once upon a time in", "ab ab", "A.B. c\td"]
    rows = []
    for k in range(n):
        w = [r.choice(fixed) if r.random() < 0.15 else r.choice(vocab) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(r.randint(0, 80))]
        rows.append((k, " ".join(w), r.choice(["en", "en", "de", None]), "s"))
    return rows


@pytest.mark.parametrize("shard,stretch", [(2_000_000, 4_000_000), (7, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard, stretch):
    """In one round and in many, with long texts cut at the ends of pieces, over nulls and repeated rows."""
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    rows = [*talk(3), *talk(3)[:5], (None, None, "en", None), (7, "", "en", "s"), (8, "ab " * 3000, "en", "s"), (9, "ab\r\nab;;ab\x0bx", None, "s"), (10, "only", "fr", "s")]
    got = collocations.collocations(frame(spark, rows, more=True).repartition(5), min_count=6, top=40, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 6, top=40)


def test_collocations_without_candidates(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b c", "en", "s"), (2, None, None, "s")])).count() == 0
    same = frame(spark, [(k, "x y", "en", "s") for k in range(120)])
    assert [tuple(r) for r in collocations.collocations(same).collect()] == [("en", 1, "x y", 120, 120, 120, 240, 2000)]


def test_products_beyond_64_bits(spark):
    """Scores are exact where 1000 a n and l r pass 64 bits."""
    a, left, right, n = 3_000_000_007, 7_000_000_011, 9_000_000_001, 4_000_000_000_037
    row = spark.createDataFrame([(a, left, right, n)], "a long, l long, r long, n long")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    above = (1000 * F.col("a")).cast("decimal(19,0)") * big("n")
    assert row.select(F.call_function("div", above, big("l") * big("r"))).first()[0] == 1000 * a * n // (left * right)


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, np.uint64))
    for some in (keys, keys[:1], keys[:0]):
        h = collocations.PerfectHash(some)
        assert sorted(h.find(some).tolist()) == list(range(len(some)))
        assert (h.find(some + np.uint64(1)) == -1).sum() == len(some) - np.isin(some + np.uint64(1), some).sum()


# -- divergence


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, c in df.items() if c >= least]
        V = len(kept)
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        total = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + V) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        gap = lambda x, y: (x - y) * (x - y) // y
        for s in count:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found)[:most])]
    return sorted(out)


def mixed(seed, n=90):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeÉßñ", k=r.randint(1, 4))) for _ in range(60)]
    return [(k, r.choice([" ", "\n", "1"]).join(r.choices(vocab, k=r.randint(0, 60))), r.choice(["en", "en", "en", "de", None]), r.choice(["s1", "s2", "s3", "ö", None])) for k in range(n)]


@pytest.mark.parametrize("bits,slack,small", [(16, 1000, 500_000), (5, 0, 500_000), (16, 2, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, bits, slack, small):
    """With and without rounds over ties, and with groups too many to be broadcast."""
    monkeypatch.setattr(divergence, "SMALL", small)
    rows = [*mixed(5), *mixed(5)[:9], (1, None, "xx", "empty"), (2, "", "xx", "other"), (3, "A a a\x00b", "xx", None), (None, "lone", "yy", "s1"), (4, "ab " * 20_000, "en", "s2")]
    got = divergence.audit(frame(spark, rows, more=True).repartition(4), top=7, bits=bits, slack=slack)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, top=7)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_radix_selection_of_ties(spark):
    """Hundreds of rows share the kth value, and their items long beginnings."""
    lead = "é" * 3000
    rows = [("g", 5, f"{lead}{k:03d}") for k in range(300)] + [("g", 5, lead), ("g", 9, "z"), ("h", 5, "b"), ("h", 5, "a"), ("i", 0, "x"), ("i", (1 << 60) + 3, "y"), ("i", (1 << 60) + 2, "w")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value long, item string")
    for k in (1, 2, 3, 40, 400):
        want = sorted((g, v, i, n + 1) for x in "ghi" for n, (v, i, g) in enumerate(sorted(((v, i, g) for g, v, i in rows if g == x), key=lambda t: (-t[0], t[1].encode()))[:k]))
        got = divergence.radix_top(df, ["g"], "value", "item", k, bits=8, slack=0)
        assert sorted(map(tuple, got.collect())) == want, k


# -- the registered queries


def test_registered_queries_over_odd_tables(spark, tmp_path):
    """The queries over a table with nulls and repeats equal brute force; over an empty one they give no rows."""
    rows = [*talk(9, 400), *talk(9, 20), (None, None, None, None), (5, "", "en", None)]
    for name, some in (("odd", rows), ("none", [])):
        frame(spark, some).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(k, 1, k % 2) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    for name in ("op11_toxicity", "op12_collocations", "op13_divergence"):
        assert queries.QUERIES[name](spark, str(tmp_path / "none")).count() == 0
    at = str(tmp_path / "odd")
    assert sorted(map(tuple, queries.op12_collocations(spark, at).collect())) == brute_collocations(rows, 100)
    assert sorted(map(tuple, queries.op13_divergence(spark, at).collect())) == brute_audit(rows)
    told = queries.op11_toxicity(spark, at)
    assert told.columns == ["doc_id", "held_out", "score", "predicted"] and told.count() == len(rows)
