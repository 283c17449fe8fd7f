"""Forged tables: every difference is found and located, equal ones agree whatever their order."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import hashtree
from spanloom.plans.runs import Run

SCHEMA = "k long, part string, x double, y string, z array<int>"


def rows_of(n):
    rng = random.Random(n)
    return [(k, rng.choice(["a", None]), rng.choice([rng.random(), None]), rng.choice(["s", None, ""]), [k % 3]) for k in range(n)]


def found(spark, left, right, keys=("k",)):
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (left, right))
    return sorted((r["k"], r["kind"], r["column"], r["left"], r["right"], r["n"]) for r in hashtree.located(a, b, list(keys)).collect())


def test_equal_tables_agree(spark):
    rows = rows_of(300) + rows_of(40)
    assert found(spark, rows, random.Random(1).sample(rows, len(rows))) == []
    df = spark.createDataFrame(rows, SCHEMA)
    root = hashtree.tree(df, ["k"]).where("level = 0").collect()
    assert len(root) == 1 and root[0]["n"] == len(rows)
    assert hashtree.tree(df.where("false"), ["k"]).count() == 0 and found(spark, [], []) == []


def test_a_null_that_moves_is_seen(spark):
    """Hashes leave nulls out: (null, "s") and ("s", null) must still differ."""
    a = spark.createDataFrame([(1, None, "s")], "k int, u string, v string")
    b = spark.createDataFrame([(1, "s", None)], "k int, u string, v string")
    assert {(r["column"], r["left"], r["right"]) for r in hashtree.located(a, b, ["k"]).collect()} == {("u", None, "s"), ("v", "s", None)}


@pytest.mark.parametrize("seed", range(4))
def test_each_fault_is_located(spark, seed):
    rng, rows = random.Random(seed), [(k, "a", float(k), "s", [k]) for k in range(200)]
    forged, want = [], []
    for r in rows:
        kind = rng.choice(["same"] * 8 + ["cell", "list", "gone", "twice"])
        if kind == "cell":
            forged.append((*r[:2], -1.5, None, r[4]))
            want += [(r[0], "changed", "x", str(r[2]), "-1.5", 1), (r[0], "changed", "y", "s", None, 1)]
        elif kind == "list":
            forged.append((*r[:4], [r[0], 7]))
            want.append((r[0], "changed", "z", f"[{r[0]}]", f"[{r[0]}, 7]", 1))
        elif kind == "gone":
            want.append((r[0], "missing", None, None, None, 1))
        else:
            forged += [r] * (1 + 2 * (kind == "twice"))
            if kind == "twice":
                want.append((r[0], "extra", None, None, None, 2))
    order = lambda x: sorted(x, key=str)
    assert order(found(spark, rows, forged)) == order(want)


def test_ranks_and_assignments(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 3), ("d", 1), ("d", 1), ("e", None)], "g string, r int")
    assert {r["g"] for r in hashtree.rank_violations(ranks, ["g"], "r").collect()} == {"b", "c", "d", "e"}
    bank = spark.createDataFrame([("cloud", 1), ("team", 2)], "term string, rank int")
    sentences = spark.createDataFrame([(1, "uses cloud"), (2, "a team")], "idx int, text string")
    good = [(1, 1, "cloud", 1, 0.0, "cloud", 5, 10), (1, 2, "team", 2, 0.5, "uses", 0, 4)]
    bad = [(2, 1, "sea", 1, 0.1, "a", 0, 1), (2, 2, "team", 1, float("nan"), "team", 2, 6), (2, 3, "team", 2, float("inf"), "tea", 2, 6), (2, 4, "team", 2, 0.1, "team", 2, 6), (3, 1, "cloud", 1, -1.0, "x", 0, 1)]
    rows = spark.createDataFrame(good + bad, "idx int, rank int, term string, candidate_rank int, distance double, token string, start int, end int")
    got = {tuple(r) for r in hashtree.assignment_violations(rows, bank, sentences, "idx").collect()}
    assert got == {(2, 1, "not_in_bank"), (2, 2, "bank_rank"), (2, 2, "distance"), (2, 3, "distance"), (2, 3, "offset"), (2, 3, "order"), (2, 4, "order"), (3, 1, "no_sentence"), (3, 1, "offset"), (3, 1, "distance")}


def test_a_forged_stage_is_located(spark, tmp_path):
    run = Run.start(spark, f"file://{tmp_path}", "r1", {"v": 1})
    make = lambda: spark.range(50).select("id", (F.col("id") * 2).alias("x"))
    run.stage("doubled", make)
    assert run.located("doubled", make, ("id",)).count() == 0
    make().withColumn("x", F.when(F.col("id") == 7, 0).otherwise(F.col("x"))).write.mode("overwrite").parquet(run.stages["doubled"])
    assert [tuple(r) for r in run.located("doubled", make, ("id",)).collect()] == [(7, "changed", "x", "0", "14", 1)]
    run.finish(("doubled",))
    assert Run.start(spark, f"file://{tmp_path}", "r2", {}).status == "running" and not [p.name for p in (tmp_path / "r1").iterdir() if p.name.startswith("manifest.json.")]
