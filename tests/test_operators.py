"""Small fixtures with results worked out by hand or by plain loops."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import align, backend, bundles, propositions, states, turns
from notewright.plans import fixtures as V
from notewright.plans.catalog import QUERIES
from notewright.sources import readers, writers


def test_token_f1_counts_repeats(spark):
    df = spark.createDataFrame([("a a b", "a b b"), ("", "a"), ("x", "y"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(T.token_f1(T.tokens("a"), T.tokens("b"))).collect()]
    assert [round(x, 6) for x in got] == [round(2 / 3, 6), 0.0, 0.0, 0.0]


def test_rouge_forms_agree(spark):
    r = random.Random(3)
    rows = [(" ".join(r.choices("abcd", k=r.randint(0, 9))), " ".join(r.choices("abcd", k=r.randint(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string").select(T.tokens("a").alias("x"), T.tokens("b").alias("y"))
    both = df.select(T.lcs_length(F.col("x"), F.col("y")).alias("s"), T.lcs_length_long("x", "y").alias("l")).collect()
    assert all(x["s"] == x["l"] for x in both)


def _greedy(pairs):
    used_i, used_j, out = set(), set(), set()
    for s, i, j in sorted(pairs, reverse=True):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.add((i, j, s))
    return out


def test_greedy_takes_larger_indices_of_equal_scores(spark):
    r = random.Random(5)
    pairs = [(1, i, j, r.choice([0.5, 0.6, 0.7])) for i, j in itertools.product(range(5), range(6)) if r.random() < 0.7]
    got = {(x["i"], x["j"], x["score"]) for x in align.greedy(spark.createDataFrame(pairs, "case_id long, i int, j int, score double")).collect()}
    assert got == _greedy([(s, i, j) for _, i, j, s in pairs])
    assert align.greedy(spark.createDataFrame([], "case_id long, i int, j int, score double")).count() == 0


def test_threshold_boundary_of_doubles():
    assert 0.55 * 0 + 0.35 * 1 + 0.10 * 1 < 0.45


def test_keep_first_ignores_partitioning(spark):
    rows = [(1, o, "Symptom", c, "The patient reports " + c, "confirmed", "active", "current") for o, c in enumerate(["Knee-pain", "knee pain", "cough", "cough"], 1)]
    df = spark.createDataFrame(rows, "case_id long, ord long, prop_type string, concept string, prop_text string, verification string, clinical_status string, temporality string")
    for n in (1, 5):
        got = propositions.sanitized(df.repartition(n)).orderBy("ord").select("ord", "prop_id").collect()
        assert [tuple(r) for r in got] == [(1, "CAP1"), (3, "CAP2")]


def test_payload_keys(spark):
    got = {(r["id"], json.loads(r["item"])["a"]) for r in propositions.payload(V.PAYLOADS.df(spark)).collect()}
    assert got == {(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 6), (7, 7)}


def test_negations(spark):
    t = turns.turns(V.TURNS.df(spark), ["case_id"], "transcript")
    got = {(r["case_id"], r["concept"]) for r in turns.negations(t, ["case_id", "turn_idx"]).collect()}
    assert {(2, "chest pain"), (2, "shortness of breath"), (2, "blurry vision"), (4, "numb toes")} <= got
    assert not any("knee pain" in c for _, c in got)


def test_turn_chunks_cover_every_turn(spark):
    rows = [(1, k, "x" * (10 + 7 * k % 40)) for k in range(23)]
    df = spark.createDataFrame(rows, "case_id long, k int, text string")
    got = turns.turn_chunks(df, "case_id", "k", "text", size=5, overlap=2, max_chars=120, short=4).collect()
    covered = {k for r in got for k in range(r["from_turn"], r["until_turn"])}
    assert covered == set(range(23)) and all(r["until_turn"] - r["from_turn"] <= 5 for r in got)


def test_state_is_last_of_highest_rank(spark):
    base = (1, "A", "Problem", "knee pain", "The knee hurts a lot", "patient")
    rows = [(*base, v, s, "current", t, t) for t, (v, s) in enumerate([("confirmed", "active"), ("confirmed", "worsening"), ("refuted", "stable")], 1)]
    df = spark.createDataFrame(rows, "case_id long, annotator string, prop_type string, concept string, prop_text string, source string, verification string, clinical_status string, temporality string, turn_idx int, ord int")
    r = states.clusters(df).first()
    assert (r["final_verification"], r["final_status"], r["members"], r["turns"]) == ("refuted", "worsening", 3, "T1,T2,T3")


def test_cluster_merge_first_fit(spark):
    rows = [(1, "ProblemState", "pain", 1, 1, 1, 10), (1, "ProblemState", "knee pain", 2, 2, 2, 10), (1, "Plan", "pain", 2, 2, 1, 9), (1, "ProblemState", "back pain", 9, 9, 1, 10)]
    df = spark.createDataFrame(rows, "case_id long, cluster_type string, cluster_concept string, first_turn int, last_turn int, members long, salience int")
    got = {r["cluster_concept"] + r["cluster_type"]: (r["merged_id"], r["merged_concept"]) for r in states.merged_clusters(df).collect()}
    assert got["painProblemState"][0] == got["knee painProblemState"][0] and got["painProblemState"][1] == "knee pain"
    assert len({v[0] for v in got.values()}) == 3


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path / "cases")
    writers.write_jsonl(spark.createDataFrame([("b", "ü"), ("a", "x"), ("b", "y")], "file string, transcript string").coalesce(1), p)
    df = readers.with_order(readers.read_jsonl(spark, p, "file string, transcript string"))
    got = [tuple(r) for r in readers.cases(df, limit=5).select("case_key", "transcript").collect()]
    assert got == [("b", "y"), ("a", "x")]
    writers.append_stage(df.select("file", "transcript"), str(tmp_path / "stage"), ["file"])
    writers.append_stage(df.select("file", "transcript"), str(tmp_path / "stage"), ["file"])
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 3


def test_backend_keeps_errors(spark):
    def broken():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return prompt.upper()

        return ask

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "case_id long, prompt string")
    got = {r["case_id"]: (r["response"], r["error"]) for r in backend.generate(df, broken, retries=1).collect()}
    assert got[1] == ("GOOD", None) and got[2][0] is None and "no answer" in got[2][1]


def test_state_stream_equals_batch(spark, tmp_path):
    from notewright.streaming.states import state_stream

    rows = [(1, "pain", "confirmed", "active", 1), (1, "pain", "refuted", "worsening", 2), (1, "pain", "confirmed", "stable", 3)]
    schema = "case_id long, concept string, verification string, clinical_status string, turn_idx int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select final_verification, final_status from states").collect()] == [("confirmed", "worsening")]


def _clean(note):
    out, seen = [], set()
    for line in re.sub(r"^```[A-Za-z]*\s*\n?|\n?\s*```$", "", note.strip()).split("\n"):
        t = re.sub(r"(?i)^(and|but|so|then)\s+", "", re.sub(r"^[\s,;:.\-]+", "", line.strip(" ")))
        key = " ".join(re.findall("[a-z0-9]+", t.lower()))
        if t and key not in seen:
            seen.add(key)
            out.append(t[0].upper() + t[1:])
    return "\n".join(out)


def test_template_notes_hold_whole_turns(spark, tmp_path):
    long = "word " * 30
    rows = [(1, 0, "user", long + "ends\nand then a second line\nS:\nsecond line"), (1, 1, "assistant", "short"), (1, 2, "user", long + "ends"), (2, 0, "system", long + "\nP:\n- " + long + "last"), (2, 1, "assistant", "x" * 61 + "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for conv in (1, 2):
        lines = {h: [f"- {t}" for c, _, r, t in rows if c == conv and {"user": "S", "assistant": "P"}.get(r, "O") == h] or ["- None"] for h in "SOAP"}
        note = "\n".join(h + ":\n" + "\n".join(lines[h]) for h in "SOAP")
        want[conv] = (_clean(note), all(re.search(rf"(?m)^\s*{h}:\s*$", note) is not None for h in "SOAP"))
    got = {r["conv_id"]: (r["note"], r["matches"]) for r in QUERIES["template_notes"](spark, str(tmp_path)).collect()}
    assert got == want


def test_cases_without_an_anchor_have_their_first_clusters(spark):
    cols = "case_id long, cluster_id string, cluster_type string, cluster_concept string, summary string, primary_type string, final_verification string, final_status string, sources string, salience int, members long, first_turn int, last_turn int"
    row = lambda case, k, kind, concept, primary, salience, members, turn=1, summary=None: (case, f"CL{k}", kind, concept, summary or concept, primary, "confirmed", "active", "patient", salience, members, turn, turn)
    rows = [
        row(1, 1, "MedicationState", "lisinopril", "MedicationStatement", 3, 9, 50), row(1, 2, "TestResult", "potassium level", "TestResult", 5, 1, 20), row(1, 10, "Plan", "walking program", "Order", 7, 1, 90),
        row(1, 3, "MedicationState", "metformin", "MedicationStatement", 7, 1), row(1, 9, "MedicationState", "metformin", "MedicationStatement", 3, 1, 1, "metformin daily"),
        row(2, 2, "Plan", "beta", "Order", 7, 1), row(2, 10, "Plan", "gamma", "Order", 7, 1), row(2, 1, "Plan", " ", "Order", 7, 2),  # a blank concept takes a place
        row(2, 11, "Plan", "delta", "Order", 7, 1), row(3, 1, "ProblemState", "asthma", "Diagnosis", 9, 1),
    ]
    feats = bundles.features(spark.createDataFrame(rows, cols))
    scored = bundles.pairs(feats)
    chosen = bundles.anchors(bundles.decisions(feats, scored), scored)
    assert [tuple(r) for r in chosen.collect()] == [(3, "CL1")]
    got = bundles.assignments(feats, scored, chosen).collect()
    assert {(r["case_id"], r["cluster_id"]) for r in got if r["relation"] == "anchor"} == {(1, "CL10"), (1, "CL2"), (1, "CL3"), (2, "CL2"), (2, "CL10"), (3, "CL1")}
    assert [(r["bundle"], r["relation"]) for r in got if (r["case_id"], r["cluster_id"]) == (1, "CL9")] == [("CL3", "direct")]
    assert len({(r["case_id"], r["cluster_id"]) for r in got}) == len(got)


def test_judges_findings(spark):
    from notewright.operators import judging

    events = spark.createDataFrame([(1, "TE0", "SymptomState", "low", "minor", "cough"), (1, "TE1", "DiagnosisImpression", "high", "major", "gout"), (1, "TE2", "FindingResult", "high", "major", "mri"), (2, "TE0", "PMFSContext", "low", "minor", "x"), (3, "TE0", "PMFSContext", "low", "minor", "y")], "case_id long, event_id string, event_type string, clinical_priority string, severity string, text string")
    answers = {1: '{"ranked_missing_major_event_ids": ["te2", "TE1", "TE9", "S1"], "omission_reasons": ["no gout", "TE2: no scan"]}', 2: 'sure: {"event_verifications": [{"event_id": "TE0", "verdict": "MissingMajor"}], "omission_reasons": []}', 3: "broken"}
    prompts = spark.createDataFrame([(k, str(k)) for k in answers], "case_id long, prompt string")
    judged = judging.answered(prompts, lambda: lambda p: answers[int(p)], repair=lambda: lambda p: '{"omission_reasons": ["TE0 is missing"]}').cache()
    assert {r["case_id"]: r["status"] for r in judged.collect()} == {1: "ok", 2: "ok", 3: "ok"}
    found = judging.findings(judged, events, "TE")
    got = [(r["case_id"], r["event_id"], r["reason"], r["place"]) for r in found.orderBy("case_id", "place").collect()]
    assert got == [(1, "TE1", "no gout", 1), (1, "TE2", "TE2: no scan", 2), (2, "TE0", "TE0: clinically important unsupported/missing event detected.", 1), (3, "TE0", "TE0 is missing", 1)]
    totals = {r["case_id"]: (r["total"], r["top1"], r["top3"]) for r in judging.detected(found, prompts.union(spark.createDataFrame([(4, "")], prompts.schema))).collect()}
    assert totals == {1: (2, ["TE1"], ["TE1", "TE2"]), 2: (1, ["TE0"], ["TE0"]), 3: (1, ["TE0"], ["TE0"]), 4: (0, [], [])}
    bad = judging.answered(prompts, lambda: lambda p: "no")
    assert {r["status"] for r in bad.collect()} == {"error"}


def test_choices_prompts_and_backends(spark):
    from notewright.operators import judging

    assert judging.choices(["b", " a", "b"], "abc", "letter", {"a": "A"}) == ["b", "A"] and judging.axes(None) == ["hallucination", "omission"] and judging.axes([" Omission", ""]) == ["omission"]
    for bad in (lambda: judging.choices(["z"], "abc", "letter"), lambda: judging.choices([], "abc", "letter"), lambda: judging.axes(["x"])):
        with pytest.raises(ValueError):
            bad()
    assert judging.endpoint("http://a/", "x", {}) == "http://a" and judging.endpoint(None, "'Local' # here", {"local": "http://b/"}) == "http://b"
    p = judging.Prompts({("default", "extract"): "say {text} as {kind}", ("m", "judge"): "judge"}, {"n": "m"})
    assert p.get("n", "judge") == "judge" and p.get("n", "extract").startswith("say") and p.methods() == ["default", "m"]
    assert spark.range(1).select(p.column("m", "extract", text=F.lit("it"), kind=F.lit(None).cast("string")).alias("x")).first()["x"] == "say it as "
    asked = []

    def ask(prompt, how):
        asked.append(how)
        if how == "schema":
            raise ValueError("no schema")
        return "ok"

    assert judging.laddered(ask, ["schema", "json", None])("x") == "ok" and asked == ["schema", "json"]
    warm = []
    answer = judging.until_enough(lambda p, t: (warm.append(t), "x" * len(warm))[1], len, 3)("p")
    assert answer == "xxx" and warm == [0.0, 0.1, 0.2]
    rows = spark.createDataFrame([(1, None, {"bundle_design": "problem_oriented_note_bundle"}), (2, 0.5, {})], "id long, cap_f1 double, s map<string,string>")
    got = rows.select("id", judging.evaluated(rows).alias("e"), judging.uses_bundles(F.array("s")).alias("b")).collect()
    assert [(r["e"], r["b"]) for r in got] == [(False, True), (True, False)]


def test_sidecars(spark, tmp_path):
    from notewright.sources import sidecars

    (tmp_path / "D1_result.json").write_text('{"x": {"a": 1}, "y": 2}')
    (tmp_path / "D2-b_result.json").write_text('{"other": 1, "key D2": {"b": 2}, "D2": 3}')
    (tmp_path / "D3_other.json").write_text("{}")
    cases = spark.createDataFrame([("D1",), ("D2",), ("D3",)], "case_id string")
    legacy, mapped = sidecars.results(spark, str(tmp_path)), sidecars.mappings(spark, str(tmp_path), cases)
    assert {r["case_id"]: r["payload"] for r in legacy.collect()} == {"D1": '{"a":1}', "D2-b": "1"}
    assert {r["case_id"]: r["payload"] for r in mapped.collect()} == {"D2": '{"b":2}'}
    assert {r["case_id"] for r in sidecars.with_fallback(cases, legacy, mapped).collect()} == {"D1", "D2"}
    sidecars.write_unmatched(spark.createDataFrame([("D1", "t"), ("D2", "u")], "case_id string, text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_salvage_of_sections(spark):
    from notewright.functions.salvage import sections

    cases = [
        ("soap", '{"S": "pain", "O": ["swollen", "r\\u00e9d"], "A": "gout" "P": "rest', {"S": "pain", "O": "swollen r\u00e9d", "A": "gout", "P": ""}),
        ("soap", "S: pain\nO: swollen  knee\n- A: gout\nP: rest;", {"S": "pain", "O": "swollen knee", "A": "gout", "P": "rest"}),
        ("sectioned", "Findings are x, then the Plan is rest", {"Chief Complaint": "", "History of Present Illness": "", "Findings": "are x, then the Plan is rest", "Assessment": "", "Plan": ""}),
        ("sectioned", '{"Chief Complaint": "knee", "plan": ["a", "", "b", "c", "d", "e", "f", "g", "h", "i"], "Plan": "again"}', {"Chief Complaint": "knee", "History of Present Illness": "", "Findings": "", "Assessment": "", "Plan": "a b c d e f g h"}),
        ("soap", '{"S": "lost, "O": "kept", "A": {"x": "y"}, "P": "a\\"b"}', {"S": "", "O": "kept", "A": "x y", "P": 'a"b'}),
        ("soap", "0", None), ("soap", None, dict.fromkeys("SOAP", "")), ("soap", " \n", dict.fromkeys("SOAP", "")), ("soap", '{“S”: “a—b”}', {"S": "a-b", "O": "", "A": "", "P": ""}),
    ]
    for template, raw, want in cases:
        assert spark.createDataFrame([(raw,)], "raw string").select(sections(F.col("raw"), template)).first()[0] == want, raw


def test_matching_in_rounds_equals_the_fold(spark, monkeypatch):
    import random

    from notewright.operators import align

    r = random.Random(2)
    rows = [(c, i, j, round(r.random(), 1)) for c in range(4) for i in range(12) for j in range(9) if r.random() < 0.7]
    pairs = spark.createDataFrame(rows, "case_id long, i int, j int, score double")
    want = sorted(map(tuple, align.greedy(pairs).collect()))
    monkeypatch.setattr(align, "FOLDED", 60)
    assert sorted(map(tuple, align.greedy(pairs).collect())) == want
    taken, free = [], lambda c, i, j: not any(c == x[0] and (i == x[1] or j == x[2]) for x in taken)
    for row in sorted(rows, key=lambda x: (x[3], x[1], x[2]), reverse=True):
        if free(*row[:3]):
            taken.append(row)
    assert sorted(taken) == want


def _merge_walk(bs, ps):
    """Bundles one by one, with all that came to each."""
    pair = {(p[0], p[1]): p for p in ps}
    state = {b["bundle"]: {"plans": set(b["plans"]), "lists": [b["bundle"]]} for b in bs}
    gone = set()
    for s in bs:
        mine = state[s["bundle"]]
        if not s["surface"] or s["found"] or len(mine["plans"]) > 1:
            continue
        best = []
        for k, t in enumerate(bs):
            p = pair.get((t["bundle"], s["bundle"]))
            if p and t["bundle"] not in gone and t["preference"] >= 4 and p[2] != "unrelated" and p[3] > -1 and ((s["symptom"] and s["symptom"] == t["symptom"]) or p[3] >= 0.25):
                best.append((-p[3], k))
        if best:
            to = state[bs[min(best)[1]]["bundle"]]
            to["plans"] |= mine["plans"]
            to["lists"] += mine["lists"]
            gone.add(s["bundle"])
    return sorted((b, name, k) for name, x in state.items() if name not in gone for k, b in enumerate(x["lists"]))


@pytest.mark.parametrize("band", [None, 3])
def test_bundles_of_surface_symptoms_merge_one_by_one(spark, band):
    """Against a plain walk, chains of merges and plans that come along included, in one band and in many."""
    from notewright.operators import bundle_events as be

    r = random.Random(4)
    routes, clusters, scored, want = [], [], [], []
    for case in range(12):
        bs = []
        for k in range(1, 13):
            surface = r.random() < 0.7
            concept = r.choice(["knee pain", "back pain", "cough"]) if surface else r.choice(["gout", "asthma", "knee arthritis"])
            b = {"bundle": f"CL{k}", "surface": surface, "found": int(r.random() < 0.2), "plans": r.sample(["a", "b"], r.choice([0, 0, 1, 2])), "preference": r.choice([0, 4, 5]), "concept": concept}
            bs.append(b)
            clusters.append((case, b["bundle"], b["preference"], concept))
            routes += [(case, b["bundle"], "S", "s")] + [(case, b["bundle"], "P", p) for p in b["plans"]] + [(case, b["bundle"], "O", "o")] * b["found"]
        ps = [(x["bundle"], y["bundle"], r.choice(["weak", "direct", "unrelated"]), r.choice([-2.0, 0.2, 0.25, 0.5, 1.0])) for x in bs for y in bs if x is not y and r.random() < 0.5]
        scored += [(case, *p) for p in ps]
        want.append((case, bs, ps))
    feats = spark.createDataFrame(clusters, "case_id long, cluster_id string, preference int, cluster_concept string")
    tells = feats.select("case_id", F.col("cluster_id").alias("b"), be.surface(F.col("cluster_concept")).alias("surface"), be._first_hit(F.col("cluster_concept"), be.L.SYMPTOM_FAMILIES).alias("symptom"), be._first_hit(F.col("cluster_concept"), be.L.BODY_REGIONS).alias("region"), be._hits(F.col("cluster_concept"), be.L.PROBLEM_DOMAINS).alias("domains")).collect()
    known = {(x["case_id"], x["b"]): x for x in tells}
    got = sorted(tuple(x) for x in be.merged(spark.createDataFrame(routes, "case_id long, bundle string, list string, text string"), feats, spark.createDataFrame(scored, "case_id long, a string, b string, relation string, score double"), band).collect())
    expected = []
    for case, bs, ps in want:
        for b in bs:
            x = known[case, b["bundle"]]
            b |= {"surface": x["surface"], "symptom": None}
        alike = lambda p, case=case: any(known[case, p[0]][c] and known[case, p[0]][c] == known[case, p[1]][c] for c in ("symptom", "region")) or bool(set(known[case, p[0]]["domains"]) & set(known[case, p[1]]["domains"]))
        # a pair that is alike counts whatever its score: told to the plain walk as a score that does, in the same order
        expected += [(case, *x) for x in _merge_walk(bs, [(p[0], p[1], "unrelated" if p[3] < 0.25 and not alike(p) else p[2], p[3] if p[3] < -1 else p[3] + 10) for p in ps])]
    assert got == sorted(expected) and any(x[3] > 1 for x in got)


@pytest.mark.parametrize("band", [None, 7])
def test_walk_over_rivals(spark, band):
    """What a walk leaves out, with chains through many bands."""
    from notewright.operators import rounds

    r = random.Random(9)
    edges = [(0, k, k, k + 1, k + 1) for k in range(60)] + [(c, a, a, b, b) for c in (1, 2) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.2]
    df = spark.createDataFrame(edges, "case_id long, a int, rank_a int, b int, rank_b int")
    want = set()
    for c in (0, 1, 2):
        for b in range(61):
            if any(x[0] == c and x[3] == b and (c, x[1]) not in want for x in edges):
                want.add((c, b))
    got = [tuple(x) for x in rounds.excluded(df, band=band).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert rounds.excluded(df.limit(0)).count() == 0


def test_falling_path_takes_few_jobs(spark):
    """20 000 pairs of one case, each in the way of the next: matched as the fold would in under 20 jobs."""
    from notewright.operators import align

    rows = [(1, k, k + d, 1.0 - (2 * k + d) / 1e5) for k in range(10_000) for d in (0, 1)]
    pairs = spark.createDataFrame(rows, "case_id long, i int, j int, score double")
    sc = spark.sparkContext
    sc.setJobGroup("falling", "")
    got = align.greedy(pairs).collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((x["i"], x["j"]) for x in got) == [(k, k) for k in range(10_000)]
    assert len(sc.statusTracker().getJobIdsForGroup("falling")) < 20


def test_cluster_merge_equals_a_plain_walk(spark):
    """Groups in order, each cluster into the first that fits, over many cases of a few words."""
    r = random.Random(11)
    words = ["pain", "knee", "knee pain", "chronic knee pain", "back pain", "painful", "a", "ab", "cab", ""]
    rows = sorted({(c, t, w): (c, t, w, f := r.randrange(8), f + r.randrange(3), r.randrange(1, 4), r.choice([7, 8, 9])) for c in range(40) for t in ("ProblemState", "Plan") for w in r.sample(words, 7)}.values())
    cols = "case_id long, cluster_type string, cluster_concept string, first_turn int, last_turn int, members long, salience int"
    got = sorted(map(tuple, states.merged_clusters(spark.createDataFrame(rows, cols)).collect()))
    want = []
    for c in range(40):
        groups, of = [], []
        for _, t, w, f, last, n, s in sorted((x for x in rows if x[0] == c), key=lambda x: (x[3], x[1], x[2])):
            fits = lambda g: g["t"] == t and g["w"] and w and (g["w"] == w or (max(g["f"], f) - min(g["l"], last) <= 2 and (w in g["w"] or g["w"] in w)))  # noqa: B023, E731
            k = next((k for k, g in enumerate(groups) if fits(g)), len(groups))
            if k == len(groups):
                groups.append({"t": t, "w": w, "f": f, "l": last, "s": s, "n": n})
            else:
                g = groups[k]
                g.update(n=g["n"] + n, f=min(g["f"], f), l=max(g["l"], last))
                if (s, len(w.split())) > (g["s"], len(g["w"].split())):
                    g.update(w=w, s=s)
            of.append((t, w, k))
        want += [(c, t, w, k, groups[k]["w"], groups[k]["n"]) for t, w, k in of]
    assert got == sorted(want)


def test_bundle_routes_and_events(spark):
    from notewright.operators import bundle_events as be

    clusters = spark.createDataFrame(
        [(1, "CL1", "gout", "ProblemState", "Diagnosis", 11, 2, "current", "A", "Gout is likely", 5, "active", "doctor"), (1, "CL2", "knee", "Plan", "Order", 9, 1, "current", "P", "MRI of the knee", 0, "planned", "doctor"), (1, "CL3", "old fracture", "ProblemState", "ProblemHistory", 7, 1, "history", "G", "An old fracture", 1, "historical", "patient")],
        "case_id long, cluster_id string, cluster_concept string, cluster_type string, primary_type string, salience int, members long, layer string, slot string, summary string, preference int, final_status string, sources string",
    )
    assigned = spark.createDataFrame([(1, "CL1", "CL1", None, "anchor"), (1, "CL2", "CL1", 1.0, "direct"), (1, "CL3", "CL1", 2.0, "weak")], "case_id long, cluster_id string, bundle string, score double, relation string")
    feats = be.features(spark.createDataFrame(
        [(1, "CL1", 1, "Diagnosis", "affirmed", "doctor", "active", "current", "gout arthritis", "Gout arthritis of the knee"), (1, "CL1", 2, "Symptom", "negated", "patient", "active", "current", "fever", "No fever"), (1, "CL1", 3, "Diagnosis", "affirmed", "doctor", "active", "current", "gout", "gout ARTHRITIS of the knee"), (1, "CL2", 4, "Order", "affirmed", "doctor", "planned", "future", "mri", "Order an MRI")],
        "case_id long, cluster_id string, ord int, prop_type string, status string, speaker string, visit_state string, temporality string, concept string, text string",
    ))
    routes = be.routed(assigned, clusters, feats)
    got = sorted((r["ord"] or 0, r["list"]) for r in routes.collect())
    assert got == [(0, "related"), (1, "A"), (2, "S"), (3, "A"), (4, "P")]
    moved = spark.createDataFrame([(1, "CL1", "CL1", 0)], "case_id long, bundle string, target string, at int")
    e = be.events(routes, moved, clusters, feats).collect()
    assert len(e) == 1 and e[0]["render"] and e[0]["visit_primary"] and e[0]["clinical_priority"] == "high" and e[0]["support"] == 4
    assert e[0]["problem"] == "gout" and e[0]["planned_actions"] == "Order an MRI" and e[0]["care_context"] == "An old fracture" and e[0]["supporting_evidence"] == "No fever|Gout arthritis of the knee"


def test_a_text_is_worked_out_once_for_all_words(spark):
    """any_of() and the slots name a costly text once, not once for each word; rows stay those of contains()."""
    from pyspark.sql import functions as F

    from notewright.functions.normalize import any_of
    from notewright.operators import audit, event_plans

    words = ("a.b", "(x", "mg ", "\\", "é")
    rows = spark.createDataFrame([(x,) for x in ("a.b", "acb", "f(x)", "5 mg of", "c:\\d", "café\n", "", None)], "t string")
    got = rows.select(any_of(F.col("t"), words).alias("g"), F.expr("t").alias("t")).collect()
    assert [r["g"] for r in got] == [None if r["t"] is None else any(w in r["t"] for w in words) for r in got]
    assert str(any_of(F.upper("t"), words)).count("upper") == 1
    assert str(audit.slots(F.col("t"))).count("regexp_replace") == 1
    assert str(event_plans.slots(F.col("t"), F.lit(""), F.lit(""))).count("regexp_replace") <= 6
