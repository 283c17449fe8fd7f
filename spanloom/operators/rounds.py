"""Bounded rounds of two states that read each other: a target's features and its judged candidates.

A state is relations: features (target, text, place, origin, first_round, active, last, demos), types (target, has_type)
and judgments (target, demo, retrieval_rank, score, role, supports, gate_rank). In a round both are replaced by what
proposals say, each read from the state before. Features that are dropped stay known and may return. Only targets whose
signature changed go on: the frontier of a semi-naive iteration. What a round changes is a relation too, the transitions.

Each round's relations are written to the shared folder in buckets of the target, so a plan never holds more than one
round, and what joins or groups them by target doesn't shuffle them again. Signatures take more room than all that they
are made of; they are not written, only the targets of a frontier are.

All relations of a state grow with the targets, and their columns compress to a small part of what they take in memory.
Where they are joined, it is by a merge: a broadcast chosen by the size of their files would pass them whole through
the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.sources.shared import in_buckets

from . import gate
from .interaction import folded

# The branches that a mode runs.
BRANCHES = {"none": (), "trf_to_exemplar": ("judgments",), "exemplar_to_trf": ("features",), "bidirectional": ("features", "judgments")}


def branches(mode: str) -> tuple[str, ...]:
    if mode not in BRANCHES:
        raise ValueError(f"unknown mode {mode!r}")
    return BRANCHES[mode]


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two relations that both grow with the targets, never by a broadcast."""
    return left.join(right.hint("merge"), on, how)


@dataclass(frozen=True)
class State:
    features: DataFrame
    types: DataFrame
    judgments: DataFrame

    def of(self, targets: DataFrame) -> State:
        return State(*(joined(x, targets, "target", "left_semi") for x in (self.features, self.types, self.judgments)))


@dataclass(frozen=True)
class Proposals:
    """decided (target, text, action, demos) for each known feature, added (target, text, position, demos), types (target, has_type), judged (target, demo, score, role, supports); None for a branch that isn't run."""

    decided: DataFrame | None = None
    added: DataFrame | None = None
    types: DataFrame | None = None
    judged: DataFrame | None = None


@dataclass(frozen=True)
class Outcome:
    """The last state, history (target, round, signature, changed) and transitions (target, text, from, to, round)."""

    state: State
    history: DataFrame
    transitions: DataFrame


# --- the first states


def first_features(baseline: DataFrame) -> DataFrame:
    """features of baseline (target, text, place): all active, as the baseline has them."""
    text = F.trim("text").alias("text")
    none = F.array().cast("array<long>").alias("demos")
    return baseline.select("target", text, F.col("place").cast("int").alias("place"), F.lit("baseline").alias("origin"), F.lit(0).alias("first_round"), F.lit(True).alias("active"), F.lit("keep").alias("last"), none)


def colliding_features(features: DataFrame) -> DataFrame:
    """target, key, n of features that are the same but for case."""
    return features.groupBy("target", folded(F.trim("text")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def first_judgments(judged: DataFrame, minimum: int = 3) -> DataFrame:
    """judgments of judged (target, demo, retrieval_rank, score, role), with the gate applied again and without relations."""
    rows = judged.select("target", F.col("demo").cast("long").alias("demo"), "retrieval_rank", F.col("score").cast("int").alias("score"), "role", F.array().cast("array<string>").alias("supports"))
    return gate.select(rows, "target", minimum)


def selection_violations(judgments: DataFrame, stored: DataFrame) -> DataFrame:
    """target, demo, rebuilt, stored: where the gate that was applied again and the stored selection (target, demo, gate_rank) differ."""
    mine = judgments.where("gate_rank is not null").select("target", "demo", F.col("gate_rank").cast("long").alias("rebuilt"))
    theirs = stored.where("gate_rank is not null").select("target", "demo", F.col("gate_rank").cast("long").alias("stored"))
    return joined(mine, theirs, ["target", "demo"], "full").where("not (rebuilt <=> stored)")


# --- a round


def apply_features(state: State, proposed: Proposals, n: int) -> tuple[DataFrame, DataFrame]:
    """features and types after round n. Features without a decision, and targets without types, stay as they are."""
    old = state.features
    decided = proposed.decided.select("target", "text", F.col("action").alias("__action"), F.col("demos").alias("__demos"))
    moved = joined(old, decided, ["target", "text"], "left")
    moved = moved.withColumns({"active": F.coalesce(F.col("__action") == "keep", F.col("active")), "last": F.coalesce("__action", "last"), "demos": F.coalesce("__demos", "demos")})
    known = old.groupBy("target").agg(F.max("place").alias("__known"))
    order = F.row_number().over(Window.partitionBy("target").orderBy("position"))
    new = joined(proposed.added.withColumn("__at", order), known, "target", "left")
    place = (F.coalesce("__known", F.lit(0)) + F.col("__at")).cast("int").alias("place")
    new = new.select("target", F.trim("text").alias("text"), place, F.lit("added").alias("origin"), F.lit(n).alias("first_round"), F.lit(True).alias("active"), F.lit("keep").alias("last"), F.col("demos").cast("array<long>").alias("demos"))
    types = joined(state.types, proposed.types.select("target", F.col("has_type").alias("__new")), "target", "left").select("target", F.coalesce("__new", "has_type").alias("has_type"))
    return moved.select(*old.columns).unionByName(new), types


def moves(before: DataFrame, after: DataFrame, n: int) -> DataFrame:
    """The transitions of a round: features whose activity differs, and new ones, which come from nothing."""
    both = joined(after.select("target", "text", "active"), before.select("target", "text", F.col("active").alias("__before")), ["target", "text"], "left")
    word = lambda c: F.when(c, "keep").when(~c, "drop")
    return both.where("not (active <=> __before)").select("target", "text", word(F.col("__before")).alias("from"), word(F.col("active")).alias("to"), F.lit(n).alias("round"))


def apply_judgments(state: State, proposed: Proposals, minimum: int = 3) -> DataFrame:
    """judgments with what is proposed, and the gate applied again. Candidates that aren't judged anew stay as they are."""
    new = proposed.judged.select("target", F.col("demo").cast("long").alias("demo"), *(F.col(c).alias(f"__{c}") for c in ("score", "role", "supports")))
    rows = joined(state.judgments.drop("gate_rank"), new, ["target", "demo"], "left")
    rows = rows.withColumns({c: F.coalesce(f"__{c}", c) for c in ("score", "role", "supports")}).withColumn("score", F.col("score").cast("int"))
    return gate.select(rows.drop("__score", "__role", "__supports"), "target", minimum)


def signatures(state: State) -> DataFrame:
    """target, signature: a digest of the type, the features with their activity in order, and scores, roles and selection of the candidates.

    A target's features and candidates are few, and gathered.
    """
    f = state.features.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("place", "text", "active"))).alias("f"))
    j = state.judgments.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("retrieval_rank", "demo", "score", "role", "gate_rank"))).alias("j"))
    both = joined(joined(state.types, f, "target", "left"), j, "target", "left")
    return both.select("target", F.sha2(F.to_json(F.struct("has_type", "f", "j"), {"ignoreNullFields": "false"}), 256).alias("signature"))


def _written(**tables: DataFrame) -> list[DataFrame]:
    """The tables, written side by side to the shared folder in buckets of the target and read back."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda name, df: in_buckets(df, f"round-{name}", "target"), tables, tables.values()))


def iterate(first: State, propose: Callable[[State, int], Proposals], mode: str = "bidirectional", rounds: int = 2, minimum: int = 3) -> Outcome:
    """Up to so many rounds. propose sees the state of the targets that changed in the round before, and that round's number."""
    spark, active = first.types.sparkSession, branches(mode)
    state = State(*_written(features=first.features, types=first.types, judgments=first.judgments))
    history = [signatures(state).withColumn("round", F.lit(0)).withColumn("changed", F.lit(True))]
    transitions: list[DataFrame] = []
    for n in range(1, rounds + 1 if active else 1):
        frontier = _written(frontier=history[-1].where("changed").select("target"))[0] if n > 1 else state.types.select("target")
        if frontier.isEmpty():
            break
        seen = state.of(frontier) if n > 1 else state
        proposed = propose(seen, n)
        features, types = apply_features(seen, proposed, n) if "features" in active else (seen.features, seen.types)
        judgments = apply_judgments(seen, proposed, minimum) if "judgments" in active else seen.judgments
        after = State(*_written(features=features, types=types, judgments=judgments))
        signed = joined(signatures(after), signatures(seen).select("target", F.col("signature").alias("__old")), "target")
        history.append(signed.select("target", "signature", F.lit(n).alias("round"), (F.col("signature") != F.col("__old")).alias("changed")))
        if "features" in active:
            transitions.append(moves(seen.features, after.features, n))
        rest = lambda x: joined(x, frontier, "target", "left_anti")
        if n > 1:
            after = State(*(rest(old).unionByName(new) for old, new in zip((state.features, state.types, state.judgments), (after.features, after.types, after.judgments), strict=True)))
        state = after
    none = spark.createDataFrame([], "target long, text string, from string, to string, round int")
    return Outcome(state, _union(history), _union(transitions) if transitions else none)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def returned(transitions: DataFrame) -> DataFrame:
    """target, text of features that were dropped and came back."""
    order = Window.partitionBy("target", "text").orderBy("round")
    back = transitions.withColumn("__before", F.lag("to").over(order))
    return back.where((F.col("to") == "keep") & (F.col("__before") == "drop")).select("target", "text").distinct()


def conflicts(state: State) -> DataFrame:
    """target, type, text, demo: evidence of an active feature that isn't selected, and selected candidates that support a feature which isn't active."""
    chosen = state.judgments.where("gate_rank is not null")
    cited = state.features.where("active").select("target", "text", F.explode("demos").alias("demo"))
    lost = joined(cited, chosen.select("target", "demo"), ["target", "demo"], "left_anti").select("target", F.lit("trf_evidence_demo_not_retained").alias("type"), "text", "demo")
    support = chosen.select("target", "demo", F.explode("supports").alias("text"))
    dropped = joined(support, state.features.where("active").select("target", "text"), ["target", "text"], "left_anti")
    return lost.unionByName(dropped.select("target", F.lit("selected_demo_supports_dropped_trf").alias("type"), "text", "demo"))
