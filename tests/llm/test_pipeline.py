"""The pipeline against the operators applied one by one on the driver, and its stages on odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, quality, tokens
from spanloom.llm.base import materialize, table

SF = "/root/testdata/sf0.001"


def plain(text):
    """The set of shingles of five words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    good, lang = quality.fit(docs, table(spark, SF, "labels")), langid.fit(docs)
    rows = [r for r in docs.collect() if good.score(r["text"]) >= 0.3]
    rows = [r for r in rows if (said := lang.predict(r["text"]))[0] != "und" and said[1] >= 0.4]
    sets = {r["doc_id"]: plain(r["text"]) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {d for d in sets if find(d) == d}
    library = tokens.Library(tokens.vocabulary_path("word_bpe_49k.json")).tokenizer
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows if r["doc_id"] in kept}
    pieces = corpus_pipeline.run(spark, SF)
    assert dict(map(tuple, pieces.groupBy("doc_id").agg(F.sum("length")).collect())) == want
    assert 0 < len(kept) < docs.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no id of its own", None, "s", None), (9003, "the " * 20_000, "en", "s", 80_000)], docs.schema)
    odd = docs.unionByName(odd).unionByName(odd).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(0))
    got = stage(spark, odd, SF)
    again = stage(spark, odd.where("false"), SF)
    assert again.count() == 0
    if name != "packing":
        assert got.columns == odd.columns
        assert materialize(got, "test").join(odd, "doc_id", "left_anti").where("doc_id is not null").count() == 0
    else:
        assert got.where("doc_id is null").agg(F.sum("length")).first()[0] > 2
