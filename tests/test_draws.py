"""Seeded draws against the standard library's generator, draw by draw."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import twister
from spanloom.operators import draws, metrics


def test_a_jump_is_as_many_steps():
    rng, window = random.Random(42), twister.seeded(42)
    stream = [rng.getrandbits(32) for _ in range(130_000)]
    assert twister.characteristic().bit_length() - 1 == twister.BITS
    for j in (0, 1, 623, 624, 19_936, 19_937, 40_000, 123_457):
        assert twister.Numbers(twister.jumped(window, twister.power(j))).next(60).tolist() == stream[j : j + 60]
    ladder = twister.ladder(1000, 129)
    for k in (0, 1, 77, 128):
        assert twister.Numbers(twister.window_of(window, ladder, k)).next(9).tolist() == stream[1000 * k : 1000 * k + 9]


def choice_draws(seed, n, times):
    rng = random.Random(seed)
    return [rng.choice(range(n)) for _ in range(times)]


def shuffle_draws(seed, *sizes):
    """The values below the falling bounds, told from the library's own lists."""
    rng, out = random.Random(seed), []
    for n in sizes:
        for i in range(n - 1, 0, -1):
            out.append(rng._randbelow(i + 1))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 1000, 65_537])
def test_draws_of_choice(spark, monkeypatch, n):
    monkeypatch.setattr(draws, "STRETCH", 300)
    got = sorted(map(tuple, draws.drawn(spark, 5, draws.choices(n, 4000)).collect()))
    assert got == list(enumerate(choice_draws(5, n, 4000)))


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (40,), (5000,), (700, 1, 900), (2, 2, 2), (0, 4097)])
def test_draws_of_shuffle(spark, monkeypatch, sizes):
    """Stretches that begin with wrong guesses are made again until all fit."""
    monkeypatch.setattr(draws, "STRETCH", 200)
    got = sorted(map(tuple, draws.drawn(spark, 9, draws.shuffles(*sizes)).collect())) if sum(sizes) > 1 else []
    assert got == list(enumerate(shuffle_draws(9, *sizes)))


def test_slices_are_settled_from_any_guess():
    bounds = draws.Bounds(draws.shuffles(900))
    numbers = np.array([random.Random(3).getrandbits(32) for _ in range(1)] * 5 + [int(x) for x in np.random.default_rng(1).integers(0, 1 << 32, 2500)], dtype=np.uint64)
    for first in (0, 17, 850, 898):
        draw, want, got = first, [], []
        for w in numbers.tolist():
            b = int(bounds.at(np.array([draw]))[0])
            v = w >> (32 - b.bit_length())
            if v < b:
                want.append((draw, v))
                draw += 1
        t, v = draws.accepted(numbers, first, bounds)
        got = list(zip(t.tolist(), v.tolist(), strict=True))
        assert got == want
    with pytest.raises(ValueError):
        draws.Bounds(draws.choices(1 << 32, 1))


def test_places_are_numbered_in_order(spark):
    ids = list(range(0, 9000, 3))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id long, place_name string").repartition(7)
    got = {r["id"]: r["place"] for r in draws.placed(df, "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}
    assert draws.placed(df.where("false"), "id").count() == 0


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (12, 5), (12, 50), (3000, 40)])
def test_shuffled_first_is_the_librarys(spark, monkeypatch, n, size):
    monkeypatch.setattr(draws, "STRETCH", 500)
    rows = [(7 * k + 3, None if k % 11 == 0 else k % 3 == 0, "clash") for k in range(n)]
    df = spark.createDataFrame(rows, "id long, urgent boolean, i string").repartition(5)
    rng = random.Random(0)
    urgent, others = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    rng.shuffle(urgent)
    rng.shuffle(others)
    got = draws.shuffled_first(df, "id", F.col("urgent"), size)
    assert got.columns == ["id", "urgent", "i", "drawn"]
    assert [r["id"] for r in got.orderBy("drawn").collect()] == (urgent + others)[:size]


def plain_bootstrap(rows, replicates, seed):
    """A plain loop over draws with the library's generator: the two intervals."""
    rng, indexes, deltas = random.Random(seed), list(range(len(rows))), ([], [])

    def score(chosen, s):
        tp, fp, fn, exact = (sum(rows[i][4 * s + k] for i in chosen) for k in range(4))
        p, r = (tp / (tp + x) if tp + x else 0.0 for x in (fp, fn))
        return (2 * p * r / (p + r) if p + r else 0.0), exact / len(chosen)

    for _ in range(replicates):
        chosen = [rng.choice(indexes) for _ in indexes]
        left, right = score(chosen, 0), score(chosen, 1)
        for k in range(2):
            deltas[k].append(right[k] - left[k])
    return tuple(sorted(d)[int(q * (replicates - 1))] for d in deltas for q in (0.025, 0.975))


@pytest.mark.parametrize("resident", [1 << 18, 0])
def test_bootstrap_is_the_librarys(spark, monkeypatch, resident):
    """To the last bit, with the targets in every task and with the targets joined."""
    monkeypatch.setattr(draws, "STRETCH", 700)
    monkeypatch.setattr(draws.replicate_sums, "__defaults__", (resident,))
    rng = random.Random(2)
    rows = [tuple(rng.randint(0, 3) if k % 4 < 3 else rng.randint(0, 1) for k in range(8)) for _ in range(97)]
    names = [f"{s}_{c}" for s in "ab" for c in ("tp", "fp", "fn", "exact")]
    df = spark.createDataFrame([(100 - k, *r) for k, r in enumerate(reversed(rows))], "key long, " + ", ".join(f"{n} int" for n in names)).repartition(4)
    got = metrics.paired_bootstrap(df, "key", replicates=60, seed=11)
    assert got.columns == ["f1_low", "f1_high", "exact_low", "exact_high"]
    in_order = [r for _, r in sorted((100 - k, r) for k, r in enumerate(reversed(rows)))]
    assert tuple(got.collect()[0]) == plain_bootstrap(in_order, 60, 11)
    assert tuple(metrics.paired_bootstrap(df.where("false"), "key", 10).collect()[0]) == (None,) * 4


def test_bootstrap_brings_no_row_to_the_driver(spark, monkeypatch):
    """The figures go from task to task, in two blocks here; they were collected, or joined by a broadcast."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(draws, "STRETCH", 700)
    df = spark.createDataFrame([(k, k, 1) for k in range(100)], "key long, a int, b int").repartition(3)
    most, collect = [0], DataFrame.collect

    def counted(self):
        out = collect(self)
        most[0] = max(most[0], len(out) if "a" in self.columns else 0)
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    for resident in (1 << 18, 64):
        sums, n = draws.replicate_sums(df, "key", ["a", "b"], 30, 5, resident)
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert n == 100 and most[0] == 0 and "Broadcast" not in plan
        rng = random.Random(5)
        assert {r["replicate"]: (r["a"], r["b"]) for r in sums.toLocalIterator()} == {k: (sum(rng.choice(range(100)) for _ in range(100)), 100) for k in range(30)}
