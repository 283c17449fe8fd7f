"""Values rank as they are; texts and objects are taken whole."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import checks, retrieval, termstats

LINES = ["a b", "a\u0085b ", "\n\r\n", '"q" \\ {}', "", None, "plain", "tab\t\x01"]


def test_json_quoted_keeps_every_line(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "k int, x string")
    got = {r["k"]: r["q"] for r in df.select("k", T.json_quoted(F.col("x")).alias("q")).collect()}
    assert [None if q is None else json.loads(q) for _, q in sorted(got.items())] == LINES


@pytest.mark.parametrize("text,ok", [
    ('{"k":1}', True), (' {"k":1} ', True), ('{"k":{"a":"}"}}', True), ('{"k":1} {"z":2}', False), ('{"k":1} junk}', False), ('{"k":1}}', False), ('{"k":1}] junk [', False), ('{"k":1}} junk {', False),
    ('{"k":1,"k":2}', False), ("{'k':1}", False), ('{"z":1}', False), ('{"k":1,"z":2}', False), ("[1]", False), ("", False), (None, False), ('{"k":NaN}', False),
])
def test_exact_keys_takes_one_object_alone(spark, text, ok):
    assert spark.createDataFrame([(text,)], "x string").select(checks.exact_keys("x", ["k"])).first()[0] is ok


def test_mutual_information_of_ten_billion_documents(spark):
    n = 10_000_000_000
    counts = spark.createDataFrame([("two", 2, 2, 1, 0), ("five", 5, 5, 3, 0), ("all", n, n, n, n // 2)], "token string, raw_pos long, df_pos long, raw_neg long, df_neg long")
    metrics = termstats.candidate_metrics(counts, spark.createDataFrame([(n, n)], "n_pos long, n_neg long"))
    got = {r["token"]: r["mi"] for r in metrics.collect()}

    def mi(a, b):
        cells = ((a, a + b, n), (b, a + b, n), (n - a, 2 * n - a - b, n), (n - b, 2 * n - a - b, n))
        return sum(c / (2 * n) * math.log(c * 2 * n / (row * col)) for c, row, col in cells if c)

    assert got["five"] != got["two"] and all(math.isclose(got[k], v, rel_tol=1e-6) for k, v in (("two", mi(2, 0)), ("five", mi(5, 0)), ("all", mi(n, n // 2))))
    ranked = termstats.bank(metrics.where("token <> 'all'"))
    assert [r["token"] for r in ranked.orderBy("rank").collect()] == sorted(("two", "five"), key=lambda k: -got[k])
    with pytest.raises(Exception, match="3 terms are needed, found 2"):
        termstats.bank(metrics.where("token <> 'all'"), 3, complete=True).collect()
    with pytest.raises(Exception, match="both classes"):
        termstats.candidate_metrics(counts, spark.createDataFrame([(n, 0)], "n_pos long, n_neg long")).collect()


def test_paper_rank_counts_all_eligible_terms(spark):
    rows = [("a", 9, 1, 9, 1), ("b", 9, 12, 3, 5), ("c", 4, 1, 4, 1), ("d", 1, 9, 1, 9)]
    counts = spark.createDataFrame(rows, "token string, raw_pos long, raw_neg long, df_pos long, df_neg long")
    got = termstats.paper_bank(termstats.candidate_metrics(counts, spark.createDataFrame([(10, 10)], "n_pos long, n_neg long")))
    found = {r["token"]: (r["paper_rank"], r["rank"]) for r in got.collect()}
    assert set(found) == {"a", "b", "c"} and found["a"] == (1, 1) and found["b"][1] is None and found["c"][1] == 2
    assert sorted(r[0] for r in found.values()) == [1, 2, 3]


def plain_neighbours(rows, k):
    out = []
    for i, v in rows:
        unit = np.array(v) / np.linalg.norm(v)
        all_of = sorted((-float(np.dot(unit, np.array(w) / np.linalg.norm(w))), j) for j, w in rows if j != i)
        out += [(i, j, -c, r + 1) for r, (c, j) in enumerate(all_of[:k])]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_near_ties_rank_unrounded_and_equal_vectors_by_id(spark, monkeypatch, block):
    """Cosines that differ by 1e-11 don't tie; those of equal vectors do, wherever they lie."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(k, (base + (1e-6 * k if k % 3 else 0) * np.eye(16)[k % 16]).tolist()) for k in range(40)] + [(100 + k, base.tolist()) for k in range(9)] + [(200 + k, rng.normal(size=16).tolist()) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = retrieval.neighbours(df, df, k=12).select("target", "demo", "similarity", "neighbor_rank")
    assert sorted(map(tuple, got.collect())) == sorted(plain_neighbours(rows, 12))
    with pytest.raises(Exception, match="has only"):
        retrieval.neighbours(df, df, k=200, complete=True).collect()


def test_neighbours_in_small_pieces_with_many_copies(spark, monkeypatch):
    """Blocks, slices and pairs are cut anywhere; copies of a vector fill them alone."""
    for name, n in (("BLOCK", 5), ("HELD", 11), ("ROWS", 3), ("SLICE", 7), ("PAIRS", 10)):
        monkeypatch.setattr(retrieval, name, n)
    rng = np.random.default_rng(5)
    many = rng.normal(size=16).astype(np.float32).astype(float).tolist()
    rows = [(k, many if k % 2 else (rng.normal(size=16) * 10 ** (k % 5)).tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = retrieval.neighbours(df, df, k=12)
    assert sorted(map(tuple, got.collect())) == sorted(plain_neighbours(rows, 12))
    apart = retrieval.neighbours(df.where("id < 20"), df, k=3, leave_one_out=False).where("target = 4").first()
    assert apart["demo"] == 4 and math.isclose(apart["similarity"], 1)


def test_neighbours_shuffle_demos_once_a_block_and_no_results(spark, monkeypatch):
    """Cells of a block of targets and a block of demos shuffled each of both as often as the other has blocks, and K results a cell."""
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    monkeypatch.setattr(retrieval, "HELD", 128)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(512)], "id long, v array<double>")
    plan = retrieval.neighbours(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Generate") == 1 and "Window" not in plan


def test_candidate_rank_breaks_equal_distances(spark):
    c = spark.createDataFrame([("g", 1, [0.0, 1.0], 9), ("g", 2, [1.0, 0.0], 3), ("g", 3, [3.0, 3.0], 1), ("g", 4, [0.0, 0.0], 4)], "group string, candidate long, v array<double>, candidate_rank int")
    tokens = spark.createDataFrame([("g", 7, [0.0, 0.0]), ("g", 8, [0.0, 0.0])], "group string, token long, v array<double>")
    got = [(r["candidate"], r["token"], r["rank"]) for r in retrieval.nearest_in_group(c, tokens, 3).orderBy("rank").collect()]
    assert got == [(4, 7, 1), (2, 7, 2), (1, 7, 3)]
