"""Phrases in every document, with word edges beyond ASCII, against brute force."""

import re

from spanloom.plans import catalogue

ODD = ["éthe and x", "the andé", "é the and é", "THE\n AND – ñ", "–the and–", "中the and", "日本 the and 語", "the and_", "thé and", "ascii the and", "other", ""]


def test_every_document_gets_a_row(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    for d in (f"file://{tmp_path}", "/root/testdata/sf0.001"):
        rows = catalogue.t(spark, d, "documents").select("doc_id", "text").collect()
        want = {r["doc_id"]: int(bool(re.search(r"(?i)(?<!\w)the\s+and(?!\w)", r["text"]))) for r in rows}
        got = catalogue.QUERIES["phrase_contains"](spark, d).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["has_phrase"] for r in got} == want
