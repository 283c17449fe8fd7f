"""Two states over rounds against a plain loop; dropped features that return, frontiers, modes and conflicts."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import interaction, rounds

FEATURE = "target long, text string, place int"
JUDGED = "target long, demo long, retrieval_rank int, score int, role string"


def first_state(spark, targets):
    features = [(i, x, k + 1) for i, (xs, _) in targets.items() for k, x in enumerate(xs)]
    judged = [(i, d, r + 1, s, role) for i, (_, js) in targets.items() for r, (d, s, role) in enumerate(js)]
    types = spark.createDataFrame([(i, True) for i in targets], "target long, has_type boolean")
    return rounds.State(rounds.first_features(spark.createDataFrame(features, FEATURE)), types, rounds.first_judgments(spark.createDataFrame(judged, JUDGED)))


def plan_of(seed, targets, n):
    """What each target proposes in a round, whatever its state: some propose what they have."""
    rng = random.Random(f"{seed}-{n}")
    out = {}
    for i, (xs, js) in targets.items():
        still = rng.random() < 0.3
        out[i] = (
            {x: ("keep" if still or rng.random() < 0.5 else "drop", [js[0][0]] if js else []) for x in [*xs, "new 1", "new 2"]},
            [] if still else [f"new {n}"] * (rng.random() < 0.4),
            {d: (s if still else rng.randint(1, 5), role, [xs[0]] if xs else []) for d, s, role in js},
        )
    return out


def plain_rounds(targets, seed, mode, n_rounds):
    state = {i: ([[x, True, []] for x in xs], [[d, s, role, []] for d, s, role in js]) for i, (xs, js) in targets.items()}
    sign = lambda f, j: ([(x[0], x[1]) for x in f], [tuple(x[:3]) for x in j])
    moved, changed, last = [], set(state), dict.fromkeys(state, 0)
    for n in range(1, n_rounds + 1):
        plan, still = plan_of(seed, targets, n), set()
        for i in changed:
            f, j = state[i]
            decided, added, judged = plan[i]
            g, h = [list(x) for x in f], [list(x) for x in j]
            if mode in ("bidirectional", "exemplar_to_trf"):
                for x in g:
                    action, demos = decided[x[0]]
                    if x[1] != (action == "keep"):
                        moved.append((i, x[0], "keep" if x[1] else "drop", action, n))
                    x[1], x[2] = action == "keep", demos
                for a in added:
                    g.append([a, True, []])
                    moved.append((i, a, None, "keep", n))
            if mode in ("bidirectional", "trf_to_exemplar"):
                h = [[d, judged[d][0], judged[d][1], judged[d][2]] for d, *_ in h]
            if sign(f, j) != sign(g, h):
                still.add(i)
                last[i] = n
            state[i] = (g, h)
        changed = still
    return state, moved, last


@pytest.mark.parametrize("mode", ["bidirectional", "exemplar_to_trf", "trf_to_exemplar", "none"])
def test_rounds_equal_a_loop(spark, mode):
    rng = random.Random(4)
    targets = {i: ([f"f{k}" for k in range(rng.randint(1, 4))], [(10 * i + k, rng.randint(1, 5), rng.choice(["supporting", "irrelevant", "contrastive"])) for k in range(rng.randint(1, 4))]) for i in range(25)}

    def propose(state, n):
        plan = plan_of(8, targets, n)
        rows = [(i, x, a, d) for i, (decided, _, _) in plan.items() for x, (a, d) in decided.items()]
        decided = spark.createDataFrame(rows, "target long, text string, action string, demos array<long>").join(state.features.select("target", "text"), ["target", "text"], "left_semi")
        mine = state.types.select("target")
        added = spark.createDataFrame([(i, x, k, []) for i, (_, xs, _) in plan.items() for k, x in enumerate(xs)], "target long, text string, position int, demos array<long>").join(mine, "target", "left_semi")
        judged = spark.createDataFrame([(i, d, s, r, x) for i, (_, _, js) in plan.items() for d, (s, r, x) in js.items()], "target long, demo long, score int, role string, supports array<string>")
        return rounds.Proposals(decided, added, mine.withColumn("has_type", F.lit(True)), judged)

    out = rounds.iterate(first_state(spark, targets), propose, mode, rounds=3)
    state, moved, last = plain_rounds(targets, 8, mode, 0 if mode == "none" else 3)
    features = {}
    for r in out.state.features.orderBy("target", "place").collect():
        features.setdefault(r["target"], []).append((r["text"], r["active"], r["demos"]))
    assert features == {i: [tuple(x) for x in f] for i, (f, _) in state.items()}
    judged = {(r["target"], r["demo"]): (r["score"], r["role"], r["supports"]) for r in out.state.judgments.collect()}
    assert judged == {(i, d): (s, role, x) for i, (_, j) in state.items() for d, s, role, x in j}
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, out.transitions.collect())) == order(moved)
    seen = {r["target"]: r["n"] or 0 for r in out.history.groupBy("target").agg(F.max(F.when(F.col("changed"), F.col("round"))).alias("n")).collect()}
    assert seen == last
    back = {(i, x) for i, x, a, b, n in moved if a == "drop" and b == "keep"}
    assert {tuple(r) for r in rounds.returned(out.transitions).collect()} == back
    if mode == "bidirectional":
        assert back and {r["target"] for r in interaction.oscillation(out.history.withColumnRenamed("signature", "sign"), ["target"]).collect()} <= set(last)
        active = {(i, x) for i, (f, _) in state.items() for x, on, _ in f if on}
        chosen = {(i, d) for i, (_, j) in state.items() for d, s, role, _ in j if s > 3 and role != "irrelevant"}
        want = [(i, "trf_evidence_demo_not_retained", x, d) for i, (f, _) in state.items() for x, on, demos in f if on for d in demos if (i, d) not in chosen]
        want += [(i, "selected_demo_supports_dropped_trf", x, d) for i, (_, j) in state.items() for d, _, _, xs in j if (i, d) in chosen for x in xs if (i, x) not in active]
        assert order(map(tuple, rounds.conflicts(out.state).collect())) == order(want)


def test_the_first_states(spark):
    with pytest.raises(ValueError):
        rounds.branches("both")
    same = rounds.first_features(spark.createDataFrame([(1, "Straße", 1), (1, " STRASSE", 2), (1, "x", 3), (2, "x", 1)], FEATURE))
    assert [tuple(r) for r in rounds.colliding_features(same).select("target", "n").collect()] == [(1, 2)]
    built = rounds.first_judgments(spark.createDataFrame([(1, 5, 1, 5, "supporting"), (1, 6, 2, 4, "irrelevant"), (1, 7, 3, 4, "contrastive"), (2, 5, 1, 3, "supporting")], JUDGED))
    stored = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "target long, demo long, gate_rank int")
    assert rounds.selection_violations(built, stored).count() == 0
    forged = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 5, None)], "target long, demo long, gate_rank int")
    assert sorted(map(tuple, rounds.selection_violations(built, forged).collect())) == [(1, 5, 1, 2), (1, 6, None, 1), (1, 7, 2, None)]


@pytest.mark.parametrize("what", ["state", "transitions"])
def test_no_relation_of_a_state_is_broadcast(spark, monkeypatch, what):
    """The files of a state are small for what they hold, so a plan that goes by their size passes them through the driver."""
    targets = {i: ([f"mode {k}" for k in range(3)], [(d, 3 + d % 3, "supporting") for d in range(4)]) for i in range(40)}
    plans, write = [], rounds._written

    def spied(**tables):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in tables.values())
        return write(**tables)

    def propose(state, n):
        decided = state.features.select("target", "text", F.lit("keep" if n % 2 else "drop").alias("action"), F.array(F.lit(1).cast("long")).alias("demos"))
        added = state.types.select("target", F.lit(f"new {n}").alias("text"), F.lit(1).alias("position"), F.array().cast("array<long>").alias("demos"))
        return rounds.Proposals(decided, added, state.types, state.judgments.select("target", "demo", F.lit(n).alias("score"), "role", "supports"))

    monkeypatch.setattr(rounds, "_written", spied)
    out = rounds.iterate(first_state(spark, targets), propose)
    last = {"state": rounds.conflicts(out.state), "transitions": out.transitions}[what]
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    assert any("SortMergeJoin" in p for p in plans)


def test_written_relations_are_not_shuffled_again(spark):
    """A state's relations lie in buckets of the target: what comes of them by target needs no shuffle, so no disk besides themselves."""
    targets = {i: ([f"mode {k}" for k in range(3)], [(d, 3 + d % 3, "supporting") for d in range(4)]) for i in range(40)}

    def propose(state, n):
        decided = state.features.select("target", "text", F.lit("keep" if n % 2 else "drop").alias("action"), F.array(F.lit(1).cast("long")).alias("demos"))
        added = state.types.select("target", F.lit(f"new {n}").alias("text"), F.lit(1).alias("position"), F.array().cast("array<long>").alias("demos"))
        return rounds.Proposals(decided, added, state.types, state.judgments.select("target", "demo", F.lit(n).alias("score"), "role", "supports"))

    out = rounds.iterate(first_state(spark, targets), propose)
    for df in (rounds.conflicts(out.state), out.transitions, out.history):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert out.history.where("changed").groupBy("round").count().count() == 3
