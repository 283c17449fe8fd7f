"""The annotation operators on small golden cases."""

import itertools
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import assemble, checks, consensus, gate, interaction, metrics, results, retrieval, spans, termstats
from spanloom.plans import protocol
from spanloom.plans.runs import Run
from spanloom.sources import jsonio, model


def decide(spark, votes, units=None):
    """votes: per sentence a list of five samples, each None (failed) or a list of (start, end)."""
    samples = [(i, k, s is not None, bool(s)) for i, v in enumerate(votes) for k, s in enumerate(v)]
    marks = [(i, k, a, b) for i, v in enumerate(votes) for k, s in enumerate(v) for a, b in s or []]
    s = spark.createDataFrame(samples, "idx int, sample int, valid boolean, has boolean")
    m = spark.createDataFrame(marks, "idx int, sample int, start int, end int")
    out = consensus.statuses(s, m, units if units is not None else F.lit(1)).orderBy("idx").collect()
    return [(r["status"], r["reason"], r["n_spans"]) for r in out]


def test_status_ladder(spark):
    yes, no = [(0, 6)], []
    got = decide(spark, [[yes] * n + [no] * (5 - n) for n in range(6)] + [[yes, no, no, no, None], [None, None, None, yes, yes]])
    assert [g[0] for g in got] == ["negative", "negative", "unsolved", "accepted", "accepted", "accepted", "unsolved", "abstained"]


def test_span_phase(spark):
    python, sql, both = (0, 6), (7, 10), (0, 10)
    broad, narrow = (20, 36), (28, 36)
    chain = [(0, 10), (6, 15), (11, 21)]
    votes = [
        [[python, sql]] * 4 + [[both]],
        [[python, broad], [python, broad], [python, narrow], [python], [python]],
        [[python, broad], [python, broad], [python, narrow], [python, narrow], [python]],
        [[chain[0]], [chain[0]], [chain[1]], [chain[2]], [chain[2]]],
    ]
    two_words = F.when(F.col("end") - F.col("start") == 16, 2).otherwise(1)
    got = decide(spark, votes, two_words)
    assert [g[0] for g in got] == ["accepted", "accepted", "accepted", "unsolved"]
    assert [g[2] for g in got] == [2, 2, 2, 0] and got[3][1] == "family_anchor_overlap_failed"


def test_anchor_is_the_best_covered(spark):
    members = spark.createDataFrame([(1, 0, 20, 36, 2), (1, 0, 28, 36, 2)], "idx int, family int, start int, end int, votes long")
    won = spans.anchors(spans.family_members(members, "idx"), "idx", F.lit(1)).collect()
    assert [(r["start"], r["end"], r["min_coverage"], r["accepted"]) for r in won] == [(28, 36, 1.0, True)]


def test_families_are_components(spark):
    rng = random.Random(1)
    rows = list({(i, a := rng.randrange(60), a + rng.randrange(1, 9)) for i in range(40) for _ in range(12)})
    got = {}
    for r in spans.families(spark.createDataFrame(rows, "idx int, start int, end int"), "idx").collect():
        got.setdefault((r["idx"], r["family"]), set()).add((r["start"], r["end"]))
    want = set()
    for i in range(40):
        left = {(a, b) for j, a, b in rows if j == i}
        while left:
            part, more = set(), {left.pop()}
            while more:
                x = more.pop()
                part.add(x)
                near = {y for y in left if max(x[0], y[0]) < min(x[1], y[1])}
                left -= near
                more |= near
            want.add((i, frozenset(part)))
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want


def test_uncertainty_conventions(spark):
    s = spark.createDataFrame([(1, 0, True, False), (1, 1, True, False), (2, 0, True, True)], "idx int, sample int, valid boolean, has boolean")
    m = spark.createDataFrame([(2, 0, 0, 3)], "idx int, sample int, start int, end int")
    got = {r["idx"]: tuple(r)[1:] for r in consensus.uncertainty(s, m).collect()}
    assert got == {1: (1.0, 0.0, 0.0, 0, 0), 2: (None, 0.0, 1.0, 1, 1)}


@pytest.mark.parametrize("tagged,sentence,found,error", [
    ("a <skill>b c</skill> d", "a b c d", [("b c", 2, 5)], None), ("<skill>机器</skill>学<skill>😀</skill>", "机器学😀", [("机器", 0, 2), ("😀", 3, 4)], None),
    ("<skill>a<skill>b</skill>", None, None, "nested"), ("a</skill>", None, None, "unmatched"), ("<skill></skill>", None, None, "empty"), ("<skill>a", None, None, "unclosed"), ("plain", "plain", [], None),
])
def test_tags(spark, tagged, sentence, found, error):
    r = spark.createDataFrame([(tagged,)], "t string").select(spans.scan_tags(F.col("t"), "skill").alias("s")).first()["s"]
    assert r["error"] == error
    if error is None:
        assert (r["sentence"], [tuple(x) for x in r["spans"]]) == (sentence, found)


def test_spans_and_masks(spark):
    span = "array<struct<text:string,start:int,end:int>>"
    df = spark.createDataFrame([("ab cd ef", [("ab", 0, 2), ("ef", 6, 8)]), ("ab cd", [("ab", 0, 2), ("b", 1, 2)]), ("ab", [("ba", 0, 2)]), ("ab", [])], f"t string, s {span}")
    assert [r[0] for r in df.select(spans.span_set_ok(F.col("t"), F.col("s"))).collect()] == [True, False, False, True]
    assert df.select(spans.mask(F.col("t"), F.col("s"))).first()[0] == "   cd   "
    c = spark.range(1).select(spans.coverage(*map(F.lit, (12, 20, 4, 20))), spans.coverage(*map(F.lit, (4, 20, 12, 20))), spans.overlaps(*map(F.lit, (0, 4, 4, 8)))).first()
    assert tuple(c) == (1.0, 0.5, False)


def test_terms(spark):
    mi = spark.range(1).select(termstats.mutual_information(*map(F.lit, (2, 0, 2, 2)))).first()[0]
    assert abs(mi - math.log(2)) < 1e-12
    rows = [(1, True, t) for t in ("a", "a", "b")] + [(2, True, "a"), (3, False, "b"), (4, False, "b"), (4, False, "b"), (4, False, "b")]
    counts = termstats.exploded_counts(spark.createDataFrame(rows, "doc int, pos boolean, token string"))
    metrics_ = {r["token"]: r for r in termstats.candidate_metrics(counts, spark.createDataFrame([(2, 2)], "n_pos int, n_neg int")).collect()}
    assert (metrics_["a"]["raw_pos"], metrics_["a"]["df_pos"], metrics_["a"]["eligible"], metrics_["a"]["directional"]) == (3, 2, True, True)
    assert metrics_["b"]["ratio"] == 4.0 and not metrics_["b"]["eligible"]
    arrays = spark.createDataFrame([(True, ["a", "a", "b"]), (True, ["a"]), (False, ["b"]), (False, ["b"] * 3)], "pos boolean, tokens array<string>")
    assert sorted(map(tuple, termstats.term_counts(arrays, "tokens", "pos").collect())) == sorted(map(tuple, counts.select("token", "raw_pos", "raw_neg", "df_pos", "df_neg").collect()))


def test_text_functions():
    assert T.unigrams("C++ and C# for CI/CD, patient-centred .NET in 2024 <NAME>") == ["C++", "and", "C#", "for", "CI/CD", "patient-centred", ".NET", "in"]
    assert [T.word_units(x) for x in ("C++ Node.js patient-centred", "机器学习", "")] == [3, 2, 1]
    assert T.tokens_with_offsets("use C++, <NAME> ok") == [{"text": "use", "start": 0, "end": 3}, {"text": "C++", "start": 4, "end": 7}, {"text": "ok", "start": 16, "end": 18}]
    assert T.lenient_object('{"a": 1}')[1] == "direct"
    assert T.lenient_object('say ```json\n{"a": "}"}\n```') == ('{"a": "}"}', "fenced")
    assert T.lenient_object('so {"a": "{"} it is') == ('{"a": "{"}', "embedded")
    assert T.lenient_object("{} {}") == (None, "no_single_object")
    assert T.unique_assignment("a b a c", ["b", "a"]) == [(2, 3), (4, 5)]
    assert T.unique_assignment("a a", ["a"]) is None and T.unique_assignment("x", []) is None
    assert len(T.unique_assignment("ab " * 5000, ["ab"] * 5000)) == 5000 and T.unique_assignment("a " * 5000, ["a"] * 40 + ["b"]) is None
    assert T.lenient_object("[" * 100_000) == (None, "no_single_object")
    with pytest.raises(protocol.Invalid):
        protocol.strict_object("[" * 100_000, {"a"})
    assert T.edit_summary("abc", "axc") == {"n_ops": 1, "source_chars": 1, "other_chars": 1}
    assert T.normalized("Ａ  B\n") == "a b"


@given(st.text("ab ", max_size=9), st.lists(st.text("ab", min_size=1, max_size=2), min_size=1, max_size=4))
def test_unique_assignment_equals_brute_force(sentence, payloads):
    every = itertools.product(*([(i, i + len(p)) for i in range(len(sentence)) if sentence.startswith(p, i)] for p in payloads))
    placements = [c for c in every if all(a[1] <= b[0] for a, b in itertools.pairwise(c))]
    assert T.unique_assignment(sentence, payloads) == (list(placements[0]) if len(placements) == 1 else None)


def test_recovery(spark):
    r = spark.createDataFrame([("research\u0097teaching",)], "t string").select(T.recovered(F.col("t")), T.substitutions(F.col("t"))).first()
    assert tuple(r) == ("research—teaching", 1)


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.3]), (4, [0.0, 1.0])], "id long, v array<double>")
    near = retrieval.neighbours(v.where("id = 1"), v, k=3)
    assert [(r["demo"], r["neighbor_rank"]) for r in near.orderBy("neighbor_rank").collect()] == [(2, 1), (3, 2), (4, 3)]
    rel = spark.createDataFrame([(2, 0.5), (3, 1.0), (4, 0.9)], "demo long, reliability double")
    got = {r["demo"]: r["selected_rank"] for r in retrieval.reranked(near, rel, k=2).collect()}
    assert got == {2: None, 3: 1, 4: 2}


def test_retrieval_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "id long, v array<double>")
    whole = sorted(map(tuple, retrieval.neighbours(v, v, k=5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    assert sorted(map(tuple, retrieval.neighbours(v, v, k=5).collect())) == whole and len(whole) == 300


def test_gate(spark):
    rows = [(1, i, 4 if i == 2 else 2, "supporting") for i in range(1, 5)] + [(2, 1, 3, "supporting"), (3, 1, 5, "irrelevant"), (3, 2, 5, "supporting"), (3, 3, 4, "contrastive")]
    g = gate.select(spark.createDataFrame(rows, "target int, retrieval_rank int, score int, role string"), "target")
    assert [r["gate_rank"] for r in g.where("target = 3").orderBy("retrieval_rank").collect()] == [None, 1, 2]
    got = {r["target"]: (r["n_selected"], r["reasons"], r["status"]) for r in gate.selection_records(g, "target").collect()}
    assert got == {1: (1, ["insufficient_helpful_examples"], "needs_review"), 2: (0, ["no_helpful_examples"], "needs_review"), 3: (2, [], "complete")}


def test_checks(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), (None, "2"), ("b", "3")], "d string, r string")
    assert sorted((r["r"], r["n_rows"]) for r in checks.key_violations(df, ["d", "r"]).collect()) == [("1", 2), ("2", 1)]
    cov = checks.coverage(df.where("r < 3"), df.where("r > 1"), ["r"])
    assert sorted(map(tuple, cov.collect())) == [("1", "left"), ("3", "right")]
    assert checks.difference(df, df).count() == 0 and checks.difference(df, df.distinct()).count() == 1
    j = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":1} x',), ("[1]",), ('{"b":1}',)], "j string")
    assert [r[0] for r in j.select(checks.exact_keys("j", ["a"])).collect()] == [True, False, False, False, False]
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(checks.finite_vector_ok("v", 2)).collect()] == [True, False, False, False, False]


def test_outcomes_and_quota(spark):
    p = spark.range(7).withColumnRenamed("id", "k")
    pred = spark.createDataFrame([(0, False), (1, True), (6, False)], "k long, recovered boolean")
    fail = spark.createDataFrame([(2, "validation_exhausted", True, True), (3, "validation_exhausted", True, False), (4, "provider_or_runtime", False, False), (6, "x", False, False)], "k long, kind string, eligible boolean, provisional boolean")
    got = results.outcomes(p, pred, fail, "k").orderBy("k").collect()
    assert [r["outcome"] for r in got] == ["exact", "recovered", "provisional", "validation_failed", "runtime_failed", "missing", "conflict"]
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("exact").alias("outcome"))
    for n, ok in ((3, 1), (4, 0)):
        assert results.completion(rows, rows.where(F.col("k") < n), "k", F.lit(100)).first()["within"] == ok
    log = spark.createDataFrame([(1, 1, "failed"), (1, 2, "complete"), (1, 3, "failed"), (2, 4, "failed")], "k int, seq int, status string")
    done = F.col("status") == "complete"
    assert sorted(map(tuple, results.latest(log, ["k"], "seq").collect())) == [(1, 3, "failed"), (2, 4, "failed")]
    assert results.retried_after_complete(log, ["k"], "seq", done).select("seq").collect() == [(3,)]
    assert results.pending(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), log, ["k"], done).orderBy("k").collect() == [(2,), (3,)]


def test_assembly(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, s string")
    b = spark.createDataFrame([(1, "x", 7), (2, "other", 8)], "k int, s string, n int")
    assert [r["k"] for r in assemble.contexts(t, [b], ["k"], ["s"]).collect()] == [1]
    assert [r["k"] for r in assemble.misaligned(t, b, ["k"], ["s"]).collect()] == [2]
    o = assemble.proposals(t, spark.createDataFrame([(1, "exact"), (2, "provisional")], "k int, outcome string"), "k", "trf", "outcome").orderBy("k").collect()
    assert [(r["trf_availability"], r["trf_space"]) for r in o] == [("available", "target_sentence"), ("available", "model_sentence"), ("unavailable", None)]


def test_metrics(spark):
    span = "k int, spans array<struct<start:int,end:int,text:string>>"
    gold = spark.createDataFrame([(1, [(0, 1, "a")]), (2, []), (3, [(0, 2, "bc"), (3, 4, "d")])], span)
    perfect = metrics.micro(metrics.per_target(gold, gold, "k")).first()
    assert (perfect["f1"], perfect["exact_rate"], perfect["coverage"]) == (1.0, 1.0, 1.0)
    part = metrics.per_target(gold, spark.createDataFrame([(1, [(0, 1, "a"), (2, 3, "x")]), (3, [])], span), "k")
    m = metrics.micro(part).first()
    assert (m["tp"], m["fp"], m["fn"], m["precision"], m["recall"]) == (1, 1, 2, 0.5, round(1 / 3, 9))
    assert [(r["exact"], r["covered"]) for r in part.orderBy("k").collect()] == [(0, 1), (0, 0), (0, 1)]
    assert metrics.presence(part).first()["negative_fp_rate"] == 0.0
    named = lambda x, p: x.select("k", *(F.col(c).alias(f"{p}_{c}") for c in ("tp", "fp", "fn", "exact")))
    pairs = named(part, "a").join(named(metrics.per_target(gold, gold, "k"), "b"), "k")
    low, high, _, _ = metrics.paired_bootstrap(pairs, "k", replicates=200).first()
    assert 0 <= low <= high <= 1


def test_interaction(spark):
    def step(df, n):
        return df.select("k", F.when(F.col("k") == 1, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("k") == 1, F.col("b")).otherwise(F.col("a")).alias("b"))

    out = {r["k"]: (r["a"], r["b"], r["round"], r["changed"]) for r in interaction.fold(spark.createDataFrame([(1, 5, 6), (2, 1, 2)], "k int, a int, b int"), step, ["a", "b"], ["k"]).collect()}
    assert out == {1: (5, 6, 0, False), 2: (1, 2, 2, True)}
    h = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (2, 0, "x"), (2, 1, "x"), (2, 2, "x")], "k int, round int, sign string")
    assert interaction.oscillation(h, ["k"]).collect() == [(1,)]
    f = spark.createDataFrame([("Node.js", "We use node.js daily"), ("Java", "JavaScript"), ("quickly", "act quickly"), ("must", "you may")], "f string, t string")
    assert [r[0] for r in f.select(interaction.contains_phrase(F.col("t"), F.col("f"))).collect()] == [True, False, True, False]
    assert [r[0] for r in f.select(interaction.calibrated_feature(F.col("f"), F.col("t"), F.lit("keep"), ["must", "java"])).collect()] == ["keep", "drop", "drop", "drop"]


def test_sources(spark, tmp_path):
    schema = spark.createDataFrame([], "idx long, s string").schema
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"idx": 1, "s": "x"}\n\n{"idx": 2}\n')
    assert jsonio.read_jsonl(spark, f"file://{lines}", schema).count() == 2
    assert jsonio.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", schema).count() == 0
    (tmp_path / "b.jsonl").write_text('{"idx": 1}\n{"idx": oops\n')
    assert jsonio.malformed_lines(spark, f"file://{tmp_path}/b.jsonl", schema).select("line").collect() == [('{"idx": oops',)]
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonio.read_jsonl(spark, f"file://{tmp_path}/b.jsonl", schema).collect()
    for name, body in (("c.json", '[{"idx": 1, "s": "x"}, {"idx": 3, "s": "y"}]'), ("d.json", '{"records": [{"idx": 1, "s": "x"}, {"idx": 3, "s": "y"}]}')):
        (tmp_path / name).write_text(body)
        assert sorted(map(tuple, jsonio.read_records(spark, f"file://{tmp_path}/{name}", schema).collect())) == [(1, "x"), (3, "y")]
    df = spark.createDataFrame([(1, None)], schema)
    jsonio.write_jsonl(df, f"file://{tmp_path}/out")
    assert '"s":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    jsonio.freeze({"t": df}, f"file://{tmp_path}/staged")
    with pytest.raises(Exception, match="(?i)already exists"):
        jsonio.freeze({"t": df}, f"file://{tmp_path}/staged")
    jsonio.publish(spark, f"file://{tmp_path}/staged", f"file://{tmp_path}/final")
    assert spark.read.parquet(f"file://{tmp_path}/final/t").count() == 1 and jsonio.withdraw(spark, f"file://{tmp_path}/final")
    assert jsonio.file_digests(spark, f"file://{lines}").first()["bytes"] == 33


def test_model_calls(spark):
    import json

    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")

    def parse(content):
        try:
            json.loads(content)
        except ValueError as e:
            return str(e)

    raw = model.converse(prompts, lambda: model.FakeClient(fail_first=1), parse)
    assert [(r["status"], r["n_attempts"]) for r in raw.collect()] == [("complete", 2)] * 2
    assert model.replay_errors(raw, prompts).count() == 0
    assert model.replay_errors(raw, prompts.withColumn("prompt", F.lit("changed"))).count() == 2
    assert {r["status"] for r in model.converse(prompts, lambda: model.FakeClient(fail_first=9), parse).collect()} == {"failed"}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise model.RetryableError
        return "ok"

    waited = []
    assert model.retried(flaky, sleep=waited.append) == ("ok", 3) and waited == [1.0, 2.0]
    items = spark.createDataFrame([(1, "h1", "x"), (2, "h1", "x"), (3, "h2", "y")], "id long, sha string, text string")
    cache = spark.createDataFrame([("h2", [0.5])], "sha string, v array<double>")
    got = {r["id"]: r["v"] for r in model.embedded(items, cache, model.FakeClient).collect()}
    assert got[3] == [0.5] and got[1] == got[2] and len(got[1]) == 8


def test_runs(spark, tmp_path):
    base, df = f"file://{tmp_path}", spark.range(3)
    run = Run.start(spark, base, "r1", {"v": 1})
    with pytest.raises(ValueError, match="needs"):
        run.stage("b", lambda: df, after=("a",))
    run.together({"a": lambda: df, "c": lambda: df})
    assert run.replay("a", lambda: df).count() == 0 and run.replay("a", lambda: spark.range(4)).count() == 1
    with pytest.raises(ValueError, match="same contract"):
        Run.start(spark, base, "r1", {"v": 2}, resume=True)
    again = Run.start(spark, base, "r1", {"v": 1}, resume=True)
    again.stage("b", lambda: df, after=("a",))
    again.finish(("a", "b", "c"))
    with pytest.raises(ValueError, match="completed"):
        Run.start(spark, base, "r1", {"v": 1}, resume=True)
    with pytest.raises(ValueError):
        Run.start(spark, base, "../x", {})


def test_relations(spark, tmp_path):
    from spanloom.sources import relations as R

    s = spark.createDataFrame([(1, "fine"), (2, " "), (3, "a <skill>"), (1, "again")], R.SENTENCE)
    assert sorted(map(tuple, R.sentence_violations(s).collect())) == [(1, "idx_not_unique"), (2, "blank_sentence"), (3, "reserved_tag")]
    p = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v2")], R.SENTENCE + ", prompt_version string")
    assert [tuple(r) for r in R.prompt_violations(p).collect()] == [(2, "prompt_version_differs")]
    ind = R.independent_targets(s)
    sha = {r["source_sha256"] for r in ind.collect()} | {r["source_sha256"] for r in R.independent_targets(s.repartition(5).orderBy("sentence")).collect()}
    assert len(sha) == 1 and ind.first()["dataset_id"] == "sentence-dataset-" + sha.pop()[:16]
    assert R.with_defaults(s.limit(1), {"idx": F.lit(9), "v": F.lit("d")}).first()["v"] == "d"
    assert [r["idx"] for r in R.targets("independent", s, s.where("idx > 1"), limit=1).collect()] == [2]
    for bad in ({"mode": "x"}, {"mode": "independent"}, {"mode": "leave-one-out", "limit": 0}):
        with pytest.raises(ValueError):
            R.targets(decisions=s, **bad)
    assert [r["idx"] for r in R.misplaced(s.where("idx > 1"), s.where("idx = 2")).collect()] == [3]
    d = spark.createDataFrame([(1, "accepted"), (2, "negative"), (3, "unsolved")], "idx long, status string")
    f = spark.createDataFrame([(1, ["a"] * 5), (2, ["a"])], "idx long, trfs array<string>")
    assert sorted(map(tuple, R.bundle_violations(d.where("idx = 1"), d, f).collect())) == [(2, "feature_count"), (2, "idx_sets_differ")]
    c = spark.createDataFrame([(1, 2, 1), (1, 2, 3), (2, 2, 1), (2, 3, 2)], "target long, demo long, selected_rank int")
    assert sorted(map(tuple, R.candidate_violations(c, 2).collect())) == [(1, "rank_not_position"), (1, "repeated_demo"), (2, "self_match")]
    sha1 = __import__("hashlib").sha256(b"a").hexdigest()
    log = spark.createDataFrame([(1, 1, sha1, "m", [9.0]), (1, 2, sha1, "m", [1.0]), (2, 3, sha1, "m", [1.0])], "idx long, seq int, sentence_sha256 string, model string, vector array<double>")
    assert [tuple(r) for r in R.embedding_cache(log, spark.createDataFrame([(1, "a"), (2, "b")], R.SENTENCE), "m", 1).collect()] == [(1, [1.0])]
    g = spark.createDataFrame([(1, "use SQL and Go", 1, ["Go", "SQL"]), (2, "a a", 1, ["a"]), (3, "x", 1, [])], R.GOLD)
    assert [tuple(x) for x in R.gold_spans(g.where("idx = 1")).first()["spans"]] == [(4, 7, "SQL"), (12, 14, "Go")]
    assert sorted(map(tuple, R.gold_violations(g).collect())) == [(2, "span_not_unique"), (3, "has_skill_differs")]
    (tmp_path / "records.jsonl").write_text("{}\n{}\n")
    good = {"sha256": __import__("hashlib").sha256(b"{}\n{}\n").hexdigest(), "bytes": 6, "rows": 2}
    assert R.catalog_violations(spark, {"files": {"records.jsonl": good}}, f"file://{tmp_path}").count() == 0
    assert sorted(r["rule"] for r in R.catalog_violations(spark, {"files": {"records.jsonl": good | {"bytes": 1, "rows": 3}}}, f"file://{tmp_path}").collect()) == ["bytes", "rows"]


def test_protocol(spark):
    import json

    from spanloom.plans import protocol as P

    assert P.tagged_spans('{"annotated_sentence": "use <skill>SQL</skill> now"}', "use SQL now") == [(4, 7, "SQL")]
    for bad in ('{"annotated_sentence": "a"} x', '{"annotated_sentence": "a", "annotated_sentence": "b"}', "[]", '{"annotated_sentence": "<skill>a<skill>b</skill></skill>"}', '{"annotated_sentence": "<skill></skill>"}', '{"annotated_sentence": "b"}'):
        with pytest.raises(P.Invalid):
            P.tagged_spans(bad, "a")
    row = lambda d, s, r: {"demo": d, "score": s, "role": r, "reason": ""}
    candidates = [(7, "accepted"), (8, "negative")]
    body = lambda *rows: json.dumps({"judgments": rows})
    assert P.judgments(body(row(8, 2, "contrastive"), row(7, 4, "supporting")), candidates) == [(7, 4, "supporting"), (8, 2, "contrastive")]
    for bad in (body(row(7, 4, "supporting")), body(row(7, True, "supporting"), row(8, 2, "irrelevant")), body(row(7, 6, "supporting"), row(8, 2, "irrelevant")), body(row(7, 4, "contrastive"), row(8, 2, "irrelevant")), body(row(7, 4, "supporting"), row(7, 4, "supporting"))):
        with pytest.raises(P.Invalid):
            P.judgments(bad, candidates)
    proposal = lambda added, *d: json.dumps({"decisions": [{"feature": f, "decision": x, "reason": ""} for f, x in d], "added": added})
    assert P.feature_proposal(proposal(["new"], ("a", "keep"), ("b", "drop")), ["a", "b"], "s", True) == (["a"], ["new"])
    for bad in (proposal(["A"], ("a", "keep")), proposal([], ("b", "keep")), proposal(["s"], ("a", "keep")), proposal([], ("a", "maybe"))):
        with pytest.raises(P.Invalid):
            P.feature_proposal(bad, ["a"], "s", True)
    schema = P.judgment_schema([7, 8])
    assert schema["properties"]["judgments"]["minItems"] == 2 and schema["additionalProperties"] is False and P.feature_schema(["a"])["required"] == ["added", "decisions"]
    raw = spark.createDataFrame([(1, '{"annotated_sentence": "a"}', "a"), (2, "no", "a")], "id long, content string, sentence string")
    got = {r["id"]: (r["value"], r["error"] is None) for r in P.parsed(raw, P.tagged_spans, "sentence").collect()}
    assert got == {1: ("[]", True), 2: (None, False)}
    p = spark.createDataFrame([("it",)], "sentence string").select(P.prompt("Judge", 40, sentence=F.col("sentence"), n=F.lit(1)).alias("p")).first()["p"]
    assert p["text"] == 'Judge\n{"n":1,"sentence":"it"}' and p["fits"]
    assert len(P.repair_messages([], "x", "e" * 900, "c")[1]["content"]) == 802


def test_smaller_operators(spark):
    classes = spark.createDataFrame([("Python", "tool"), ("team", "soft")], "phrase string, class string")
    got = assemble.labelled(spark.createDataFrame([(1, " python "), (2, "x")], "k int, t string"), "t", classes)
    assert sorted((r["k"], r["class"]) for r in got.collect()) == [(1, "tool"), (2, None)]
    items = spark.createDataFrame([([(2, "b"), (1, "a")], [1, 2, 3])], "items array<struct<id:int,v:string>>, ids array<int>")
    r = items.select(assemble.reordered(F.col("items"), F.col("ids"), "id").alias("x")).first()["x"]
    assert [x and x["v"] for x in r] == ["a", "b", None]
    asked = spark.createDataFrame([(1,), (9,)], "k int")
    assert assemble.missing_identities(got, asked, ["k"]).collect() == [(9,)]
    assert spark.range(1).select(T.redacted(F.lit("key a.b a.bc axb"), ["a.b", "", "a.bc"])).first()[0] == "key <redacted> <redacted> axb"
    tokens = spark.createDataFrame([("x",)], "t string").select(T.unigram_tokens(F.col("t")), T.nfkc_text(F.lit(None).cast("string")), T.json_quoted(F.lit('a"b\n')))
    assert tuple(tokens.first()) == (["x"], None, '"a\\"b\\n"')


def test_streams(spark, tmp_path):
    from spanloom.streaming import log

    rows = [(1, "a", 1, "2024-01-01 00:10:00"), (1, "a", 2, "2024-01-01 00:20:00"), (2, "b", 3, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "k int, v string, seq int, at string").withColumn("at", F.to_timestamp("at"))
    source = f"file://{tmp_path}/in"
    df.coalesce(1).write.parquet(source)
    args = (df.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/check", ["k"], "seq")
    assert sorted((r["k"], r["seq"]) for r in log.compact(spark, source, *args).collect()) == [(1, 2), (2, 3)]
    spark.createDataFrame([(1, "c", 4, None)], "k int, v string, seq int, at timestamp").write.mode("append").parquet(source)
    assert sorted((r["k"], r["seq"]) for r in log.compact(spark, source, *args).collect()) == [(1, 4), (2, 3)]
    stream = spark.readStream.schema(df.schema).parquet(source)
    for name, out in (("latest_now", log.latest_stream(stream, ["k"], "seq")), ("hourly", log.windowed_counts(stream.where("at is not null"), "at", "k"))):
        out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select k, max(seq) from latest_now group by k order by k").collect() == [(1, 4), (2, 3)]
    assert spark.sql("select k, max(n) from hourly group by k order by k").collect() == [(1, 2), (2, 1)]
