"""The ten operators against brute force, exact round trips or held-out accuracy; with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, langid, matroska, packing, quality, simhash, tokens, token_store, topk, toxicity
from spanloom.llm.base import scratch_path, table

SF = "/root/testdata/sf0.001"
BYTE, RANKS, WORD = (tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n", "  a  b\n c", " lead", "trail ", "don't \"'s a", "x1y22 ½²a ª9", "<|endoftext|> x", "a <|endoftext|>b", "日本語 テキスト é́", "İstanbul ΣΑΣ ς",
    "a\x1cb \x85 \xa0c　d", "it's DON'T we'll 123", "\x00a\x00 b", "👍🏽 ok", "a\n\nb c\t\td e \n f", "word " * 3000, "x" * 9000, "ﬁ Ⅷ ²",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, a null doc_id and columns whose names clash with results."""
    own = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_001, ""), (1, "again one id")], "doc_id long, text string")
    return own.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("n", F.lit(None).cast("string")).withColumn("key", F.lit(0)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


# --- tokens


@pytest.mark.parametrize("path,make", [(BYTE, lambda: tokens.ByteBpe(BYTE, RANKS)), (BYTE, lambda: tokens.ByteBpe(BYTE)), (WORD, lambda: tokens.WordBpe(WORD))])
def test_ids_are_the_librarys(docs, path, make):
    encoder = make()
    library = tokens.Library(path).tokenizer
    for _, text in rows_of(docs):
        text = text or ""
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


# --- 1, 4, 6: held-out accuracy


def held_out(spark, sf, column, model, least):
    found = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").collect()
    scored = [(model.score(r["text"]), r[column]) for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum((s >= least) == bool(y) for s, y in scored) / len(scored)


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert held_out(spark, sf, "toxic", model, 0.5) > 0.95
    assert model.score("the and of this morron is by") > model.score("the and of this reading is by")
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([], []).score("x") == toxicity.train(["a"], [0]).score(None) < 0.5


def test_toxicity_slices_are_the_whole(monkeypatch):
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32))
    text = "some words of a long text " * 400
    whole = model.window_logits(text)
    monkeypatch.setattr(toxicity, "SLICE", 10 * toxicity.BLOCK)
    assert np.allclose(whole, model.window_logits(text), atol=1e-4)


def test_quality(spark, docs, empty, monkeypatch):
    sf = "/root/testdata/sf0.1"
    model = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert held_out(spark, sf, "quality", model, 0.3) > 0.95
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.score(empty, model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    whole = model.chunk_logits("word " * 5000)
    monkeypatch.setattr(quality, "SLICE", 2 * quality.HALF)
    assert np.allclose(whole, model.chunk_logits("word " * 5000), atol=1e-4)
    assert quality.train(["a"], [1]).score("b") > 0.5


def test_quality_gradients():
    rng = np.random.default_rng(2)
    model = quality._fresh(rng)
    for k in model.PARTS:
        setattr(model, k, getattr(model, k).astype(np.float64) + 0.01)
    chunks, bad = rng.integers(0, 256, (4, quality.CHUNK + quality.WIDTH - 1)), np.array([0, 1, 0, 1])

    def loss():
        z = np.array([model.judge(model.responses(c).max(0)[None])[0] for c in chunks])
        return float((np.log1p(np.exp(z)) - bad * z).mean())

    g = quality._gradients(model, chunks, bad, np.ones(4))
    for part, at in (("filters", (3, 2)), ("dense", (5, 4)), ("out", (3,)), ("offset", (1,)), ("vectors", (int(chunks[0, 9]), 1))):
        value = getattr(model, part)
        base = value[at]
        value[at] = base + 1e-6
        up = loss()
        value[at] = base - 1e-6
        down = loss()
        value[at] = base
        assert abs((up - down) / 2e-6 - g[part][at]) < 1e-4


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    model = langid.fit(table(spark, sf, "documents"))
    held = [r for r in table(spark, sf, "documents").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(model.predict(r["text"])[0] == r["lang"] for r in held) / len(held) > 0.97
    assert (model.weight == 0).mean() > 0.5
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert (got[10_000]["lang_pred"], got[10_000]["score"]) == ("und", 0.0) and got[10_003]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"und", *model.langs} for r in got.values())
    assert langid.predict(empty, model).count() == 0
    assert langid.train([], []).predict("word") == ("und", 0.0)
    assert langid.keep_known(docs, model).columns == docs.columns


# --- 2


def test_packing(spark, docs, empty):
    library = tokens.Library(WORD).tokenizer
    got = [tuple(r) for r in packing.pack(docs, WORD, length=256).collect()]
    by_doc = {}
    for name, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        by_doc.setdefault(name, []).append(ids)
    pieces = {}
    for name, start, length, crc, total, _, _ in got:
        pieces.setdefault((name, total), []).append((start, length, crc))
    for name, texts in by_doc.items():
        for ids in texts:
            if sum(len(t) == len(ids) for t in texts) == 1:
                own = sorted(pieces[name, len(ids)])
                assert sum(p[1] for p in own) == len(ids)
                at = 0
                for start, length, crc in own:
                    assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                    at += length
    assert sum(r[2] for r in got) == sum(len(i) for t in by_doc.values() for i in t)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[2]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty, WORD).count() == 0


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = packing.hilbert(cells, bits=3)
    assert sorted(at) == list(range(512))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# --- 3


def brute_components(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    a = np.array(fps, dtype=np.uint64)
    root = list(range(len(a)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(a)):
        groups.setdefault(find(i), []).append(rows[i][0])
    best = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return order([(rows[i][0], f"{fps[i]:016x}", best[find(i)]) for i in range(len(a))]), len(groups)


def test_fingerprint_against_a_plain_one():
    import xxhash

    text = "The Quick\tbrown\x0bfox É jumps over the quick brown fox"
    words = text.encode().lower().replace(b"\t", b" ").replace(b"\x0b", b" ").split(b" ")
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == xxhash.xxh64(b"one two", seed=42).intdigest()
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("seed", range(4))
def test_trie_links(seed):
    rng = random.Random(seed)
    centre = [rng.getrandbits(64) for _ in range(8)]
    keys = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centre for _ in range(40)})
    a = np.array(keys, dtype=np.uint64)
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (keys[i] ^ keys[j]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in simhash.trie_links(a, 0).tolist()} == want


def test_simhash(spark, docs, empty, monkeypatch):
    near = spark.createDataFrame([(20_000 + i, " ".join(f"w{k if k != 40 + i % 60 else 999}" for k in range(400))) for i in range(120)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(near)
    want, _ = brute_components(rows_of(all_docs))
    got = simhash.near_duplicates(all_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert order(map(tuple, got.collect())) == want
    monkeypatch.setattr(simhash, "CELL", 2)  # the split of large subtrees
    monkeypatch.setattr(simhash, "FRONT", 16)
    assert order(map(tuple, simhash.near_duplicates(all_docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute_components(rows_of(docs))[1]
    assert simhash.keep_one(empty).count() == 0


def test_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = dict(map(tuple, simhash.stars(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


# --- 5


def brute_top(rows, k, mod=20):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sorted(whole, key=lambda r: (len(r[1]), r[1]), reverse=True) if i % mod == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2020, []), (None, rows[0][1]), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [float("inf")] * 8), (2100, [0.5, 0.25]), (2101, [0.5, 1.0]), (40, rows[7][1]), (40, rows[9][1]), (2100, [0.25, 0.75])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    want = brute_top(rows, 20)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "LEAF", 8)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# --- 7


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, most in ((1, 0), (1, 10**6), (300, 3), (1000, 10**5), (257, 0)):
        values = np.cumsum(rng.integers(0, most + 1, n))
        ef = token_store.EliasFano.of(values)
        assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(n)]
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (2 + ef.low_bits) + values[-1] // 2**ef.low_bits - n + 32 + n
    with pytest.raises(IndexError):
        ef.select(n)


def test_segment():
    documents = [np.array(x, "<u4") for x in ([1, 2, 3], [2], [], [5] * 1000)]
    for wide in (False, True):
        segment = token_store.Segment(token_store.write_segment(documents, wide))
        assert [segment.document(i).tolist() for i in range(4)] == [d.tolist() for d in documents]
    with pytest.raises(ValueError):
        token_store.Segment(b"x" * 100)


@pytest.mark.parametrize("names", [
    [], [None], [None, None, 5], [7], [-9, -9, 0, 3], list(range(1000)), [-(2**63), 2**63 - 1], [None, -(2**63), -1, 0, 2**63 - 1, 2**63 - 1], sorted(random.Random(1).randrange(-(2**62), 2**62) for _ in range(700)),
])
def test_document_ids_are_select_structures(monkeypatch, names):
    monkeypatch.setattr(token_store, "PART", 64)
    data = token_store.DocumentIds.pack(names)
    ids = token_store.DocumentIds(data)
    assert ids.all().to_pylist() == names and [ids.select(i) for i in range(len(names))] == names


def test_consecutive_ids_take_a_few_bits():
    assert len(token_store.DocumentIds.pack(list(range(10**12, 10**12 + 10_000)))) < 10_000 * 3 // 8 + 800


def test_token_store(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 5000)
    library = tokens.Library(BYTE).tokenizer
    path = scratch_path(spark, "test-store")
    token_store.write_store(docs, path, BYTE, RANKS, 2)
    got = sorted(map(tuple, token_store.read_store(spark, path).collect()), key=lambda r: r[1])
    want = [(name, [*library.encode(text or "", add_special_tokens=False).ids, 2]) for name, text in rows_of(docs)]
    assert [r[0] is not None and r[0] for r in got] == sorted((n is not None and n for n, _ in want), key=lambda n: (n is not False, n))
    assert order([(n, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for n, i in want]) == order([(r[0], r[2], r[3]) for r in got])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    path = scratch_path(spark, "test-store")
    token_store.write_store(empty, path, BYTE, RANKS, 2)
    assert token_store.read_store(spark, path).count() == 0


# --- 8


def test_matroska(spark, docs, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in matroska.media_features(docs).collect()}
    for name, text in rows_of(docs):
        raw = (text or "").encode()
        r = got[name, len(raw)]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        file = matroska.mux(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and r["feature"].endswith("seekable=1")
    assert matroska.media_features(empty).count() == 0
    packets = matroska.packet_table(matroska.media_column(docs.where("doc_id = 10019"))).orderBy("packet").collect()
    assert len(packets) == 18 and packets[1]["timestamp_ms"] == 0 and packets[8]["timestamp_ms"] == 512
    assert packets[0]["end_byte"] - packets[0]["begin_byte"] == 512


def test_lacings_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 7, b"c" * 700, b"d" * 2]
    for lacing in (m.XIPH, m.EBML_LACING):
        body = m.laced(frames, lacing)
        assert [body[a:b] for a, b in m.frame_bounds(body, 0, len(body), lacing)] == frames
    body = m.laced([b"x" * 5] * 3, m.FIXED)
    assert [body[a:b] for a, b in m.frame_bounds(body, 0, len(body), m.FIXED)] == [b"x" * 5] * 3
    unknown = b"\x01" + b"\xff" * 7
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(2, -3, frames)))
    clusters = b"".join(m._id(m.CLUSTER) + unknown + m._uint(m.TIMESTAMP, t) + group for t in (100, 200))
    file = m.element(m.EBML) + m._id(m.SEGMENT) + unknown + clusters + m.element(m.CUES)
    found = m.parse(file)
    assert [p.timestamp for p in found.packets] == [97] * 4 + [197] * 4 and found.packets[0].keyframe
    assert m.payload_of(file, found) == b"".join(frames) * 2
    with pytest.raises(ValueError):
        m.parse(m.mux(b"text")[:-5])


@pytest.mark.parametrize("x", [0, 1, 126, 127, 128, 16382, 16383, 2**40])
def test_vint(x):
    assert matroska.read_vint(matroska.vint(x), 0) == (x, len(matroska.vint(x)))


# --- 9


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "a\\b<|im_end|>\\", "<\\|im_end|>", "\\\\", "<", "|im_sep|>", "", None, "<|im_start|>assistant<|im_sep|>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(tricky)]
    rows += [(2, 0, "system", "s"), (2, 1, None, "x"), (3, None, "assistant", "first"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "user", "nobody"), (4, 0, "a<|im_sep|>b\n", "odd role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        replies = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(replies) and r["loss_sha256"] == hashlib.sha256(replies.encode()).hexdigest()
    for e in examples.collect():
        turns = by[e["conv_id"]]
        seen = chat.read_turns(e["formatted"])
        assert seen == [t[2:] for t in turns[: len(seen)]]
        if e["loss_end"] > e["loss_begin"]:
            assert seen[-1] == ("assistant", chat.unescape(e["formatted"][e["loss_begin"] : e["loss_end"]]))
    assert chat.digests(chat.examples(df.where("false"))).count() == 0


@pytest.mark.parametrize("control", chat.CONTROL)
def test_escape(control):
    for text in (control, "\\" + control, control[0] + "\\" + control[1:], control * 2 + "\\", control[:-1]):
        assert chat.unescape(chat.escape(text)) == text
        assert control not in chat.escape(text)


# --- 10


def test_bpe(spark, docs, empty):
    library = tokens.Library(BYTE).tokenizer
    got = {}
    for r in bpe.encode_and_decode(docs, BYTE, RANKS).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for name, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) in got[name]
    assert bpe.encode_and_decode(empty, BYTE, RANKS).count() == 0


def test_chunks_follow_content(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(6000)]
    text = " ".join(words)
    codec = bpe.Codec(BYTE, RANKS)
    codec.encode(text)
    before = codec.encoded
    codec.encode("something else in front, " + text)
    assert codec.reused > 0.9 * before
    for edges in (bpe.cuts(text), bpe.cuts("x" * 20_000), bpe.cuts("a")):
        assert edges == sorted(set(edges)) and max(b - a for a, b in zip([0, *edges], edges, strict=False)) <= bpe.MOST
    lines, cjk = text.replace(" ", "\n"), "".join(rng.choices("一二三四五六七八九十", k=40_000)).replace("一二", "。")
    for other in (lines, cjk):
        codec = bpe.Codec(BYTE, RANKS)
        assert np.frombuffer(codec.encode(other), "<u4").tolist() == tokens.Library(BYTE).tokenizer.encode(other, add_special_tokens=False).ids
        before = codec.encoded
        codec.encode("\nin front" + other)
        assert codec.reused > 0.9 * before and sum(len(x[2]) for x in codec.known.values())
    whole = bpe.cuts(text)
    monkeypatch.setattr(bpe, "SLICE", 1000)
    assert bpe.cuts(text) == whole
