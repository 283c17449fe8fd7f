"""Figures counted while rows are written, and canonical JSON."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import diagnostics

EXPERT = "struct<available:boolean,has_skill:int,spans:array<int>,space:string,outcome:string>"
SCHEMA = f"status string, has_skill int, n_spans int, outcome string, raw_status string, repaired boolean, recovered boolean, n_features int, n_examples int, trf {EXPERT}, exemplar {EXPERT}"


def test_figures_come_with_the_write(spark, tmp_path):
    here = lambda *x: (True, 1, list(x), "target_sentence", "exact")
    away, other = (False, None, None, None, None), (True, 0, [1], "model_sentence", "provisional")
    rows = [
        ("complete", 1, 2, "exact", "complete", False, False, 3, 0, here(1, 2), here(1, 2)),
        ("needs_review", 0, 0, "recovered", "complete", True, True, 0, 1, here(1), other),
        (None, None, None, "runtime_failed", "failed", True, None, 1, 4, away, here(1)),
        (None, None, None, "missing", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = dict.fromkeys(diagnostics.run_figures(), 0) | {
        "targets": 4, "predictions": 2, "complete": 1, "needs_review": 1, "positive": 1, "failed": 1, "results": 3, "outcome_exact": 1, "outcome_recovered": 1, "outcome_runtime_failed": 1, "outcome_missing": 1, "validation_issues": 1,
        "repair_attempted": 2, "repaired": 1, "recovered": 1, "no_features": 1, "no_examples": 1, "one_example": 1, "with_experts": 3, "both_experts": 2, "trf_missing": 1, "presence_agrees": 1, "spans_agree": 1, "exemplar_provisional": 1,
        "spans": 2, "examples": 5,
    }
    assert diagnostics.written_with_figures(df, f"file://{tmp_path}/out") == want
    assert dict(diagnostics.run_summary(spark.read.parquet(f"file://{tmp_path}/out")).collect()) == want
    assert set(dict(diagnostics.run_summary(df.where("false")).collect()).values()) == {0}


@pytest.mark.parametrize("value,ddl", [
    ({"b": 1, "a": None, "é": 'q"\n'}, "struct<b:int,a:string,`é`:string>"), ({"z": {"y": [{"d": 1, "c": None}, None], "x": True}, "a": []}, "struct<z:struct<y:array<struct<d:int,c:int>>,x:boolean>,a:array<int>>"),
    ({"m": {"k2": 1, "k1": None}}, "struct<m:map<string,int>>"), ([{"b": 2, "a": 1}], "array<struct<b:int,a:int>>"),
])
def test_canonical_json(spark, value, ddl):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    want = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert tuple(df.select(T.canonical_json(df, "v"), T.canonical_sha256(df, "v")).first()) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_a_null_field_isnt_a_missing_one(spark):
    a, b = spark.createDataFrame([((None, 1),)], "v struct<a:int,b:int>"), spark.createDataFrame([((1,),)], "v struct<b:int>")
    assert a.select(T.canonical_sha256(a, "v")).first() != b.select(T.canonical_sha256(b, "v")).first()
    assert a.select(F.lit(None).cast("struct<a:int>").alias("v")).select(F.col("v").isNull()).first()[0]
