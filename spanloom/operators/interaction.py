"""Bounded rounds of two interacting states, their conflicts and oscillation, and calibration of proposals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Texts that count as an explicit cue for the type, and codes that count as positive support, are parameters.


def signature(*parts: str) -> Column:
    """An order-sensitive signature of state columns; reasons aren't among them."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def fold(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], signed: Sequence[str], keys: Sequence[str], rounds: int = 2) -> DataFrame:
    """Applies step up to rounds times: keys, state columns, round, changed.

    Both states of a row are read before either is replaced. A target whose signature doesn't change keeps its state and
    leaves; the number of rounds is fixed, so the plan is unrolled and nothing is collected.
    """
    now = state.withColumn("round", F.lit(0)).withColumn("changed", F.lit(True)).withColumn("__s", signature(*signed))
    for n in range(1, rounds + 1):
        columns = [c for c in now.columns if c not in ("round", "changed", "__s")]
        after = step(now.where("changed").select(*columns), n).withColumn("__new", signature(*signed))
        moved = after.join(now.select(*keys, F.col("__s").alias("__old")), list(keys))
        moved = moved.withColumn("changed", F.col("__new") != F.col("__old")).withColumn("round", F.when(F.col("changed"), n).otherwise(n - 1)).withColumn("__s", F.col("__new"))
        now = moved.select(*now.columns).unionByName(now.where("not changed"))
    return now.drop("__s")


def oscillation(history: DataFrame, keys: Sequence[str], round_column: str = "round", sign: str = "sign") -> DataFrame:
    """keys of history (keys, round, sign) that left a signature and came back to it two rounds later."""
    order = Window.partitionBy(*keys).orderBy(round_column)
    back = history.withColumn("__1", F.lag(sign, 1).over(order)).withColumn("__2", F.lag(sign, 2).over(order))
    return back.where((F.col(sign) == F.col("__2")) & (F.col(sign) != F.col("__1"))).select(*keys).distinct()


def unselected_evidence(evidence: DataFrame, selected: DataFrame, target: str, demo: str) -> DataFrame:
    """Evidence rows of active features whose demo isn't selected for the target."""
    return evidence.where("active").join(selected.select(target, demo).distinct(), [target, demo], "left_anti")


def irrelevant_evidence(evidence: DataFrame, judged: DataFrame, target: str, demo: str) -> DataFrame:
    """Evidence rows whose demo is judged irrelevant for the target."""
    return evidence.join(judged.where("role = 'irrelevant'").select(target, demo).distinct(), [target, demo], "left_semi")


def folded(text: Column) -> Column:
    """Without difference of case: by way of capitals, so that ß is ss, and so is its capital.

    The replacement also keeps the optimizer from taking lower(upper(x)) for lower(x).
    """
    return F.lower(F.replace(F.upper(text), F.lit("\u1e9e"), F.lit("SS")))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole phrase, whatever the case, with any white space between its words; null for a phrase without a character."""
    quoted = F.regexp_replace(F.trim(folded(phrase)), r"([^\w\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"(?!\w)"))
    return F.when(F.trim(phrase) != "", F.rlike(folded(text), pattern))


def calibrated_feature(feature: Column, text: Column, decision: Column, cues: Sequence[str]) -> Column:
    """keep or drop: a cue that the text has is kept, one that it lacks dropped, as is a single word in -ly that it has; else as decided."""
    cue, found = F.lower(feature).isin(*cues), contains_phrase(text, feature)
    return F.when(cue & found, "keep").when(cue, "drop").when(feature.rlike("^[A-Za-z]+[lL][yY]$") & found, "drop").otherwise(decision)


def calibrated_decision(feature: Column, text: Column, has_type: Column, decision: Column, codes: Column, sources: Column, cues: Sequence[str], positive: Sequence[str]) -> Column:
    """Struct of decision, gate, codes, sources, ok, by the gates of calibrated_feature() where the type is needed for a cue to be kept.

    A gate that forces a keep adds its code and source; one that forces a drop has a code of its own. ok: what is kept
    has a code that counts as positive support.
    """
    cue, found = F.lower(feature).isin(*cues), contains_phrase(text, feature)
    gate = (
        F.when(cue & found & has_type, "forced_keep_explicit_skill_type_cue").when(cue & ~found, "forced_drop_missing_skill_type_cue")
        .when(feature.rlike(r"(?U)^\p{IsAlphabetic}*[lL][yY]$") & found, "forced_drop_descriptive_modifier").otherwise("none")
    )
    keeps, drops = gate.startswith("forced_keep"), gate.startswith("forced_drop")
    final = F.when(keeps, "keep").when(drops, "drop").otherwise(decision)
    new_codes = F.when(keeps, _with(codes, "TARGET_EXPLICIT_SUPPORT")).when(gate == "forced_drop_missing_skill_type_cue", F.array(F.lit("MISSING_SKILL_CUE"))).when(drops, F.array(F.lit("TYPE_MISMATCH"))).otherwise(codes)
    ok = (final != "keep") | F.arrays_overlap(new_codes, F.array(*map(F.lit, positive)))
    return F.struct(final.alias("decision"), gate.alias("gate"), new_codes.alias("codes"), F.when(keeps, _with(sources, "TARGET_TEXT")).otherwise(sources).alias("sources"), ok.alias("ok"))


def _with(codes: Column, code: str) -> Column:
    return F.when(F.array_contains(codes, code), codes).otherwise(F.array_append(codes, F.lit(code)))


def _without(codes: Column, instead: str | Column, *gone: str) -> Column:
    left = F.array_except(codes, F.array(*map(F.lit, gone)))
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.lit(instead) if isinstance(instead, str) else instead))


def calibrated_judgments(rows: DataFrame, aligned: float = 0.58, boundary: float = 0.55) -> DataFrame:
    """rows with score, role, codes and relations calibrated, and effect, adjustment, actions.

    rows: status, score, role, previous, previous_role, previous_codes, similarity, relations (array of text and relation),
    codes, active (features), spans (the demo's), sentence. An accepted demo supports the active features that its spans
    have, no others; what aligns it with the target raises it to 4, and a 4 without that falls. A negative demo of 4 or
    more keeps it for a boundary or a relation only, or by a strong prior contrast; a low contrast stays one.
    """
    col, actions = F.col, []
    accepted, negative = col("status") == "accepted", col("status") == "negative"

    def act(name: str, when: Column) -> None:
        actions.append((name, f"__did_{len(actions)}"))
        state[actions[-1][1]] = F.coalesce(when, F.lit(False))

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumns(state)
        state.clear()
        return out

    state: dict[str, Column] = {}
    claimed = F.transform(F.filter("relations", lambda r: r["relation"] == "supports"), lambda r: r["text"])
    matched = F.filter("active", lambda f: F.exists("spans", lambda s: F.contains(F.lower(s), F.lower(f))))
    state |= {"__claimed": claimed, "__matched": matched}
    rows = apply(rows)

    unfounded = F.array_except("__claimed", "__matched")
    added = F.array_except("__matched", "__claimed")
    founded = F.filter("relations", lambda r: (r["relation"] != "supports") | F.array_contains("__matched", r["text"]))
    supported, rejected = F.size("__matched") > 0, (F.size("__matched") == 0) & (F.size(unfounded) > 0)
    state["relations"] = F.when(accepted, F.concat(founded, F.transform(added, lambda f: F.struct(f.alias("text"), F.lit("supports").alias("relation"))))).otherwise(col("relations"))
    state["__score"] = F.when(accepted & supported, F.greatest("score", F.lit(4))).when(accepted & rejected, F.least("score", F.lit(3))).otherwise(col("score"))
    state["__role"] = F.when(accepted & supported, "supporting").when(accepted & rejected, "irrelevant").otherwise(col("role"))
    act("unsupported_trf_support_removed", accepted & (F.size(unfounded) > 0))
    act("skill_span_trf_support_added", accepted & (F.size(added) > 0))
    act("accepted_trf_support_floor_applied", accepted & supported & (col("score") < 4))
    act("unsupported_trf_promotion_rejected", accepted & rejected)
    rows = apply(rows)

    in_target = F.exists("spans", lambda s: contains_phrase(col("sentence"), s))
    specific = F.exists("relations", lambda r: r["relation"].isin("supports", "contrasts"))
    generic = negative & (col("previous") >= 4) & ~F.array_contains("codes", "BOUNDARY_TRANSFERABLE") & ~specific
    prior = (col("previous_role") == "contrastive") & F.array_contains("previous_codes", "NEGATIVE_CONTRAST") & (col("similarity") >= boundary)
    state |= {"__strong": accepted & ((F.size("__matched") > 0) | in_target | (col("similarity") >= aligned)), "__retained": generic & prior, "__penalized": generic & ~prior}
    rows = apply(rows)

    fallen = accepted & ~col("__strong") & (col("previous") == 4) & (col("__score") >= 4)
    state["score"] = (
        F.when(col("__strong"), F.greatest("__score", F.lit(4))).when(fallen, F.lit(3)).when(col("__retained"), F.greatest("__score", "previous", F.lit(4)))
        .when(col("__penalized"), F.least("__score", F.lit(3))).otherwise(col("__score"))
    )
    state["role"] = F.when(col("__strong"), "supporting").when(col("__retained"), "contrastive").when(fallen | col("__penalized"), "irrelevant").otherwise(col("__role"))
    state["codes"] = (
        F.when(col("__strong"), _with(col("codes"), "BOUNDARY_TRANSFERABLE")).when(fallen, _without(col("codes"), "SEMANTIC_ONLY", "TRF_ALIGNED", "BOUNDARY_TRANSFERABLE"))
        .when(col("__retained"), _with(_with(col("codes"), "NEGATIVE_CONTRAST"), "BOUNDARY_TRANSFERABLE")).when(col("__penalized"), _without(col("codes"), "SEMANTIC_ONLY", "NEGATIVE_CONTRAST")).otherwise(col("codes"))
    )
    act("accepted_target_alignment_floor_applied", col("__strong") & (col("__score") < 4))
    act("unsubstantiated_hard_gate_score_rejected", fallen)
    act("strong_negative_boundary_retained", col("__retained"))
    act("generic_high_negative_penalized", col("__penalized"))
    rows = apply(rows)

    low = negative & (col("previous") <= 3) & (col("previous_role") == "contrastive") & ~F.arrays_overlap("codes", F.array(F.lit("TASK_MISMATCH"), F.lit("REDUNDANT")))
    state["codes"] = F.when(low, _with(col("codes"), "NEGATIVE_CONTRAST")).otherwise(col("codes"))
    act("low_negative_contrast_preserved", low)
    rows = apply(rows)

    bare = F.array_contains("codes", "TRF_ALIGNED") & (F.size("relations") == 0)
    adjustment = col("score") - col("previous")
    state["role"] = F.when(negative & F.array_contains("codes", "NEGATIVE_CONTRAST"), "contrastive").otherwise(col("role"))
    state["codes"] = F.when(bare, _without(col("codes"), F.when(accepted, "TYPE_ALIGNED").otherwise("SEMANTIC_ONLY"), "TRF_ALIGNED")).otherwise(col("codes"))
    state |= {"adjustment": adjustment, "effect": F.when(adjustment > 0, "boost").when(adjustment < 0, "penalize").otherwise("none")}
    act("unsubstantiated_trf_aligned_removed", bare)
    rows = apply(rows)
    done = rows.withColumn("actions", F.array_compact(F.array(*(F.when(col(flag), name) for name, flag in actions))))
    return done.drop(*(c for c in done.columns if c.startswith("__")))


def calibrated_score(score: Column, previous: Column, similarity: Column, supported: Column, accepted: Column, contrastive: Column) -> Column:
    """Struct of score, role, effect.

    Accepted demos: with support or a similarity of 0.58 at least 4 and supporting, else a score of 4 after a previous 4 is
    3 and irrelevant. Negative demos that scored 4 or more before: contrastive at 0.55 or more, never below before, else 3
    at most and irrelevant.
    """
    strong = supported | (similarity >= 0.58)
    final = (
        F.when(accepted & strong, F.greatest(score, F.lit(4))).when(accepted & (previous == 4) & (score >= 4), F.lit(3)).when(accepted, score)
        .when((previous >= 4) & contrastive & (similarity >= 0.55), F.greatest(score, previous, F.lit(4))).when(previous >= 4, F.least(score, F.lit(3))).otherwise(score)
    )
    role = F.when(accepted & strong, "supporting").when(~accepted & contrastive & ((previous < 4) | (similarity >= 0.55)), "contrastive").otherwise(F.when(accepted & (final >= 4), "supporting").otherwise("irrelevant"))
    effect = F.when(final > previous, "boost").when(final < previous, "penalize").otherwise("none")
    return F.struct(final.alias("score"), role.alias("role"), effect.alias("effect"))


def context_status(conflicts: Column, reviews: Column) -> Column:
    return F.when(conflicts > 0, "conflicted").when(reviews > 0, "mixed").otherwise("aligned")
