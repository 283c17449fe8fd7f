"""Sweeps and bucketed joins of intervals against all pairs; consensus of several spans a sample."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import consensus, retrieval, spans


def labels_of(rng, keys, n, reach):
    return sorted({(k, rng.randrange(3), a := rng.randrange(reach), a + rng.randrange(1, 12)) for k in range(keys) for _ in range(n)})


@pytest.mark.parametrize("reach", [3, 30, 400])
def test_coverage_equals_all_pairs(spark, reach):
    """Members of a family needn't overlap each other, so the least may be 0."""
    rows = [(*r, len(r)) for r in labels_of(random.Random(reach), 12, 20, reach)]
    df = spark.createDataFrame(rows, "idx int, family int, start int, end int, votes int").repartition(5)
    got = {(r["idx"], r["family"], r["start"], r["end"]): r for r in spans.family_members(df, "idx").collect()}
    for k, f, a, b, _ in rows:
        others = [max(0, min(b, y) - max(a, x)) / (b - a) for j, g, x, y, _ in rows if (j, g) == (k, f) and (x, y) != (a, b)]
        if not others:
            assert (k, f, a, b) not in got
            continue
        r = got[k, f, a, b]
        assert r["members"] == len(others) + 1 and r["min_coverage"] == min(others) and abs(r["avg_coverage"] - sum(others) / len(others)) < 1e-12
    assert spans.family_members(df.where("false"), "idx").count() == 0


def test_a_large_family_is_swept(spark):
    """200,000 spans of one family: all pairs would be 40 billion."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("idx"), F.lit(0).alias("family"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"), F.lit(1).alias("votes"))
    got = spans.family_members(df, "idx").agg(F.count("*"), F.max("min_coverage"), F.max("avg_coverage")).first()
    assert got[0] == n and got[1] == 0.0 and abs(got[2] - (2 + 1 + 2 + 1) / 3 / (n - 1)) < 1e-15


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_join_equals_a_filter(spark, width):
    rng = random.Random(width)
    side = lambda: [(rng.randrange(4), a := rng.randrange(90), a + rng.choice([0, 1, 3, 40])) for _ in range(120)]
    left, right = side(), side()
    one = spark.createDataFrame(left, "k int, start int, end int")
    two = spark.createDataFrame(right, "k int, p int, q int")
    got = sorted((r["k"], r["start"], r["end"], r["p"], r["q"]) for r in spans.interval_join(one, two, "k", ("start", "end"), ("p", "q"), width).collect())
    assert got == sorted((k, a, b, p, q) for k, a, b in left for j, p, q in right if k == j and a < b and p < q and max(a, p) < min(b, q))


def test_pooling_takes_overlapping_pieces(spark):
    words = spark.createDataFrame([(1, 0, 5), (1, 6, 9), (1, 60, 70), (2, 0, 5)], "s int, start int, end int")
    pieces = spark.createDataFrame([(1, 0, 2, [1.0, 3.0]), (1, 2, 7, [3.0, 5.0]), (1, 62, 66, [2.0, 2.0]), (1, 66, 90, [4.0, 0.0]), (3, 0, 5, [9.0, 9.0])], "s int, p_start int, p_end int, v array<double>")
    got = {(r["s"], r["start"]): r["v"] for r in retrieval.pooled(words, pieces, "s").collect()}
    assert got == {(1, 0): [2.0, 4.0], (1, 6): [3.0, 5.0], (1, 60): [3.0, 1.0]}


def plain_decision(samples, unit):
    """The ladder for one sentence in plain loops: samples None or lists of spans."""
    rules, good = consensus.Rules(), [(k, set(s)) for k, s in enumerate(samples) if s is not None]
    has = sum(bool(s) for _, s in good)
    if len(good) < rules.min_valid:
        return "abstained", ["insufficient_valid_samples"], []
    if len(good) - has >= rules.negative_votes:
        return "negative", ["high_confidence_no_skill"], []
    if has < rules.positive_votes:
        return "unsolved", ["has_skill_no_consensus"], []
    over = lambda x, y: max(x[0], y[0]) < min(x[1], y[1])
    labels = {x: {k for k, s in good if x in s} for x in sorted(set().union(*(s for _, s in good)))}
    accepted = [x for x in labels if len(labels[x]) >= 3]
    left = {x for x in labels if x not in accepted and not any(over(x, y) for y in accepted)}
    reasons = set()
    while left:
        family, more = set(), [min(left)]
        while more:
            x = more.pop()
            family.add(x)
            left.discard(x)
            more += [y for y in left if over(x, y)]
        if len(set().union(*(labels[x] for x in family))) < 3:
            continue
        if len(family) < 2:
            reasons.add("hard_match_validation_failed")
            continue
        cover = {x: [max(0, min(x[1], y[1]) - max(x[0], y[0])) / (x[1] - x[0]) for y in family if y != x] for x in family}
        best = [x for x in family if len(labels[x]) == max(len(labels[y]) for y in family)]
        best = [x for x in best if min(cover[x]) + 1e-12 >= max(min(cover[y]) for y in best)]
        best = [x for x in best if sum(cover[x]) / len(cover[x]) + 1e-12 >= max(sum(cover[y]) / len(cover[y]) for y in best)]
        x = min(best, key=lambda x: (unit(x), x[1] - x[0], x))
        if min(cover[x]) + 1e-12 >= min(0.85, 0.45 + 0.05 * (unit(x) - 1)):
            accepted.append(x)
        else:
            reasons.add("family_anchor_overlap_failed")
    accepted.sort()
    found = sorted(reasons) + ["accepted_span_conflict"] * any(over(x, y) for i, x in enumerate(accepted) for y in accepted[i + 1 :]) + ["positive_without_stable_span"] * (not accepted)
    return ("unsolved", found, []) if found else ("accepted", ["all_span_families_resolved"], accepted)


def test_decisions_equal_a_loop(spark):
    rng = random.Random(6)
    votes = []
    for _ in range(400):
        spots = [(a := rng.randrange(24), a + rng.randrange(1, 9)) for _ in range(rng.randint(1, 5))]
        votes.append([None if rng.random() < 0.12 else [] if rng.random() < 0.2 else rng.sample(spots, rng.randint(1, len(spots))) for _ in range(5)])
    votes += [[[(0, 5), (3, 8)]] * 3 + [[]] * 2, [[(0, 5)]] * 5, [None] * 5]
    samples = [(i, k, s is not None, bool(s)) for i, v in enumerate(votes) for k, s in enumerate(v)]
    marks = [(i, k, *x) for i, v in enumerate(votes) for k, s in enumerate(v) for x in s or []] + [(0, 99, 1, 2), (9999, 0, 1, 2)]
    s = spark.createDataFrame(samples, "idx int, sample int, valid boolean, has boolean").repartition(6)
    m = spark.createDataFrame(marks, "idx int, sample int, start int, end int").repartition(6)
    units = F.floor((F.col("end") - F.col("start")) / 3).cast("int") + 1
    got = {r["idx"]: (r["status"], r["reasons"], [tuple(x) for x in r["spans"]]) for r in consensus.statuses(s, m, units).collect()}
    want = {i: plain_decision(v, lambda x: (x[1] - x[0]) // 3 + 1) for i, v in enumerate(votes)}
    assert got == want
    kinds = {r for _, rs, _ in want.values() for r in rs}
    assert {"accepted_span_conflict", "family_anchor_overlap_failed", "all_span_families_resolved", "has_skill_no_consensus"} <= kinds


def test_consensus_is_one_pass(spark):
    """One scan and one shuffle, whatever the number of phases."""
    from spanloom.plans import catalogue

    for name, most in (("consensus_status", 1), ("uncertainty", 1)):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange ") == most
