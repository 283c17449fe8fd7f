"""Near copies at a similarity of 0.8 against brute force."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import similar, simhash
from spanloom.llm.base import table

SF = "/root/testdata/sf0.01"


def plain(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_kept(rows):
    sets, root = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(ids) for ids in groups.values())


@pytest.fixture(scope="module")
def near(spark):
    """Documents, chains and groups of near copies, and odd texts; and the ids that brute force keeps."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(120):  # chains: some link only by way of others
        if i % 40 == 0:
            rng.shuffle(base)
        base = [w if rng.random() > 0.012 else f"x{i}" for w in base]
        made.append((50_000 + i, " ".join(base)))
    for i in range(60):  # two groups, each word for word alike but for one word
        made.append((70_000 + i, " ".join([*(f"g{i % 2}-{k}" for k in range(60)), f"own{i}"])))
    made += [(60_000, ""), (60_001, None), (60_002, " \n"), (60_003, "two words"), (60_004, "Two  Words")]
    own = table(spark, SF, "documents").select("doc_id", "text").limit(600)
    docs = own.unionByName(spark.createDataFrame(made, "doc_id long, text string")).withColumn("key", F.lit(0)).cache()
    return docs, brute_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_keeps_one_of_similar_documents(spark, near):
    docs, want = near
    got = corpus_pipeline.one_of_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert ids(got) == want


def test_large_subtrees_are_dealt_to_chunks(near, monkeypatch):
    docs, want = near
    monkeypatch.setattr(similar, "CELL", 8)
    monkeypatch.setattr(similar, "MEMBERS", 8)
    monkeypatch.setattr(simhash, "FRONT", 16)
    assert ids(similar.keep_one(docs)) == want


def test_empty_table(near):
    docs, _ = near
    assert similar.keep_one(docs.where("false")).count() == 0


def test_plan_holds_what_it_says():
    for n in (0, 1000, 10**6, 10**10):
        plan = similar.Plan.of(n)
        meets = (1 - plan.bit_differs(0.8)) ** plan.prefix
        assert (1 - meets) ** plan.tries <= similar.MISSED
        assert plan.tries * plan.prefix <= 64 * plan.lead


def test_bits_differ_as_often_as_stated():
    rng = random.Random(3)
    differ = []
    for _ in range(200):
        words = [f"w{rng.random()}" for _ in range(94)]
        other = words[:10] + ["x"] + words[11:]  # 85 of 95 shingles in both
        other = other[:40] + ["y"] + other[41:]  # 80 of 100
        a, b = (similar.signature(" ".join(t), 5, 4)[2:] for t in (words, other))
        differ.append(int(np.bitwise_count(np.array(a).view(np.uint64) ^ np.array(b).view(np.uint64)).sum()) / 256)
    assert abs(np.mean(differ) - similar.Plan.bit_differs(0.8)) < 0.01


def near_keys(rng, groups, n, flips):
    """n keys of four words, near copies of so many others."""
    keys = rng.integers(0, 1 << 63, (groups, 4), dtype=np.int64)[rng.integers(0, groups, n)].view(np.uint64)
    for _ in range(flips):
        at = rng.integers(0, 256, n)
        keys[np.arange(n), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    return keys


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("groups,flips", [(1, 2), (6, 40), (150, 12), (150, 90)])
def test_forest_joins_what_all_links_join(own, groups, flips):
    plan, n = similar.Plan.of(100_000), 600
    keys = near_keys(np.random.default_rng(groups + flips), groups, n, flips)
    side = np.arange(n) >= (0 if own else 250)
    keys = keys[np.lexsort((keys[:, 0], side))]
    held = {"left": None if own else 250, "more": keys[:, 1:], "most": plan.most(similar.KEY)}
    links = simhash.trie_links(keys[:, 0], 0, plan.budget(), **held)
    forest = simhash.trie_forest(keys[:, 0], 0, plan.budget(), **held)
    assert set(forest) <= set(map(tuple, links.tolist()))
    want, got = simhash.Forest(n), simhash.Forest(n)
    want.add(links)
    got.add(np.array(forest, dtype=np.int64).reshape(-1, 2))
    assert len(forest) == len(want.joins) and want.tree.tolist() == got.tree.tolist()


def test_a_subtree_of_near_copies_stays_small():
    plan, n = similar.Plan.of(100_000), 2048
    keys, fp, all_left = near_keys(np.random.default_rng(3), 1, n, 3).view(np.int64), np.arange(n), np.ones(n, dtype=bool)
    tracemalloc.start()
    try:
        joins = sum(len(x) for x in similar._subtree(plan)(True, all_left, fp, fp, keys))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert joins == n - 1
    assert peak < 40e6, f"{peak / 1e6:.0f} MB"
