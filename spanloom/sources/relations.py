"""The relations that runs start from, with what must hold of them: violations are frames, defaults and switches columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.operators import checks, spans
from spanloom.sources import jsonio

IDENTITY = ("dataset_id", "record_id")
SENTENCE = "idx long, sentence string"
GOLD = "idx long, sentence string, has_skill int, spans array<string>"


def _named(df: DataFrame, rule: str) -> DataFrame:
    return df.select(F.col("idx"), F.lit(rule).alias("rule"))


def sentence_violations(sentences: DataFrame, reserved: Sequence[str] = ("<skill>", "</skill>")) -> DataFrame:
    """idx and rule: null or repeated idx, blank sentences, reserved tags inside."""
    tag = F.exists(F.array(*map(F.lit, reserved)), lambda t: F.contains(F.col("sentence"), t))
    return (
        _named(checks.key_violations(sentences, ["idx"]), "idx_not_unique")
        .unionByName(_named(sentences.where(F.coalesce(F.trim("sentence"), F.lit("")) == ""), "blank_sentence"))
        .unionByName(_named(sentences.where(tag), "reserved_tag"))
    )


def prompt_violations(prompts: DataFrame) -> DataFrame:
    """As sentences, and one prompt_version for all."""
    first = prompts.agg(F.min("prompt_version").alias("first"))
    other = prompts.join(F.broadcast(first), prompts["prompt_version"] != F.col("first"), "left_semi")  # first is one row
    return sentence_violations(prompts).unionByName(_named(other, "prompt_version_differs"))


def relation_sha256(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, source_sha256: a fingerprint of a relation whatever its order, by hashes summed in a decimal that can't overflow."""
    parts = [F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = rows.select(*(p.alias(f"p{k}") for k, p in enumerate(parts))).agg(F.count("*").alias("n"), *(F.sum(f"p{k}").alias(f"s{k}") for k in range(8)))
    return sums.select(F.sha2(F.to_json(F.struct("n", *(f"s{k}" for k in range(8)))), 256).alias("source_sha256"))


def independent_targets(sentences: DataFrame) -> DataFrame:
    """Sentences with identity columns; the dataset's id follows from its content."""
    mark = F.broadcast(relation_sha256(sentences, ["idx", "sentence"]))  # one row
    return sentences.crossJoin(mark).select(
        F.concat(F.lit("sentence-dataset-"), F.substring("source_sha256", 1, 16)).alias("dataset_id"), F.concat(F.lit("sentence-"), F.col("idx")).alias("record_id"), "source_sha256", "idx", "sentence"
    )


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing or null columns get their default; values that are there win."""
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def targets(mode: str, decisions: DataFrame, independent: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """leave-one-out: all decisions, undecided ones too; independent: the other relation. A limit takes the first by idx."""
    if mode not in ("leave-one-out", "independent"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "independent" and independent is None:
        raise ValueError("independent mode needs its own sentences")
    if limit is not None and limit < 1:
        raise ValueError("a limit is positive")
    rows = decisions if mode == "leave-one-out" else independent
    return rows if limit is None else rows.orderBy("idx").limit(limit)


def misplaced(source: DataFrame, snapshot: DataFrame) -> DataFrame:
    """place: where two relations, each in idx order, differ in (idx, sentence). Joined on idx, so no global order is made."""
    both = source.select("idx", F.col("sentence").alias("a")).join(snapshot.select("idx", F.col("sentence").alias("b")), "idx", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("idx")


def bundle_violations(corpus: DataFrame, decisions: DataFrame, features: DataFrame, per_accepted: int = 5) -> DataFrame:
    """Formal idx sets of three relations must be equal; accepted rows have per_accepted features, negative ones none."""
    formal = decisions.where(F.col("status").isin("accepted", "negative")).select("idx", "status")
    cover = checks.coverage(corpus, formal, ["idx"]).unionByName(checks.coverage(features, formal, ["idx"]))
    counted = features.select("idx", F.size("trfs").alias("n")).join(formal, "idx")
    wrong = counted.where(F.col("n") != F.when(F.col("status") == "accepted", per_accepted).otherwise(0))
    return _named(cover, "idx_sets_differ").unionByName(_named(wrong, "feature_count"))


def candidate_violations(candidates: DataFrame, expected: int = 16) -> DataFrame:
    """target and rule over (target, demo, selected_rank): as many children as expected, unique, not the target itself, ranks as positions."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy("selected_rank"))
    placed = candidates.withColumn("place", rank)
    n = placed.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("demo").alias("d"), F.max((F.col("demo") == F.col("target")).cast("int")).alias("own"), F.max((F.col("place") != F.col("selected_rank")).cast("int")).alias("moved"))
    rules = F.array_compact(
        F.array(F.when(F.col("n") != expected, "count"), F.when(F.col("n") != F.col("d"), "repeated_demo"), F.when(F.col("own") == 1, "self_match"), F.when(F.col("moved") == 1, "rank_not_position"))
    )
    return n.select("target", F.explode(rules).alias("rule"))


def embedding_cache(log: DataFrame, expected: DataFrame, model: str, dimensions: int) -> DataFrame:
    """idx, vector: the last write of each expected sentence whose hash, model and vector fit."""
    last = log.groupBy("idx").agg(F.max_by(F.struct("sentence_sha256", "model", "vector"), "seq").alias("e")).select("idx", "e.*")
    fits = (F.col("sentence_sha256") == F.sha2("sentence", 256)) & (F.col("model") == model) & checks.finite_vector_ok("vector", dimensions)
    return last.join(expected.select("idx", "sentence"), "idx").where(fits).select("idx", "vector")


def occurrences(sentence: Column, text: Column) -> Column:
    """How often a text occurs, without overlaps."""
    return ((F.length(sentence) - F.length(F.replace(sentence, text, F.lit("")))) / F.length(text)).cast("int")


def gold_spans(gold: DataFrame) -> DataFrame:
    """idx, spans with offsets; a span's text must occur just once, see gold_violations."""
    found = F.transform("spans", lambda t: F.struct(t.alias("text"), (F.position(t, F.col("sentence")) - 1).cast("int").alias("start")))
    placed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).cast("int").alias("end"), s["text"].alias("text")))
    return gold.select("idx", "sentence", F.array_sort(placed).alias("spans"))


def gold_violations(gold: DataFrame) -> DataFrame:
    once = F.forall("spans", lambda t: (t != "") & (occurrences(F.col("sentence"), t) == 1))
    return _named(gold.where(~once), "span_not_unique").unionByName(_named(gold.where((F.col("has_skill") == 1) != (F.size("spans") > 0)), "has_skill_differs"))


def catalog_violations(spark: SparkSession, manifest: dict, root: str) -> DataFrame:
    """file and rule: each file of a manifest {files: {name: {sha256, bytes, rows}}} has that hash, size and number of rows."""
    found = jsonio.file_digests(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "bytes")
    # the manifest is read by the driver: a row for each file that it names
    want = spark.createDataFrame([(n, f["sha256"], f["bytes"]) for n, f in manifest["files"].items()], "file string, want_sha256 string, want_bytes long")
    both = want.join(found, "file", "left")
    rules = F.array_compact(F.array(F.when(F.col("sha256").isNull(), "missing"), F.when(F.col("sha256") != F.col("want_sha256"), "sha256"), F.when(F.col("bytes") != F.col("want_bytes"), "bytes")))
    out = both.select("file", F.explode(rules).alias("rule"))
    for name, f in manifest["files"].items():
        n = spark.read.text(f"{root}/{name}").where(F.trim("value") != "").agg(F.count("*").alias("n"))
        out = out.unionByName(n.where(F.col("n") != f["rows"]).select(F.lit(name).alias("file"), F.lit("rows").alias("rule")))
    return out


def example_record_ok(score: str, accepted: str, span_array: str, texts: str) -> Column:
    """An example for a prompt: score 4 or 5, spans only if accepted, and its texts those of its spans."""
    own = F.transform(span_array, lambda s: s["text"])
    return F.col(score).isin(4, 5) & (F.col(accepted) | (F.size(span_array) == 0)) & (own == F.col(texts))


def exact_span_set(sentence: str, span_array: str) -> Column:
    return spans.span_set_ok(F.col(sentence), F.col(span_array))
