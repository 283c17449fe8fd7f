"""SentencePiece by backtracking, fill-in-middle by automaton scan, clustering by annulus search: against the library and plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import annulus, fim, pieces, tokens
from spanloom.llm.base import table

SF = "/root/testdata/sf0.001"
MODEL = tokens.vocabulary_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "\n\n\n", "  a  b\n c", " lead", "trail ", "a\x00b", "▁x ▁", "日本語\nテキスト", "ﬁ Ⅷ ﬀ​", "<s> <0x0A> </s>", "<unk>", " " * 100 + "x", "\t\t\n\n  ", "x" * 5000, "ab" * 3000,
    "👍🏽 ok", "\r\n;\r\n {\r", "word " * 3000, "日本" * 2000, "a <P> b", "<<S>", "a<P\n>b", "<M>", "<" * 50, "one\n" * 700 + "end", "x\n" * 40000, "line <\n" * 9000, "<P" * 30000, "y" * 70000, "\n" * 70000, "end <P>" + "z\n" * 50000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd and giant texts, repeated rows, a null doc_id and columns whose names clash with results."""
    own = table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id\n"), (None, "x\n" * 40000), (10_001, ""), (10_028, ODD[28]), (1, "again one\nid")], "doc_id long, text string")
    return own.unionByName(odd).withColumn("n", F.lit("clash")).withColumn("cut", F.lit(1)).withColumn("digest", F.lit(0)).withColumn("k", F.lit(0)).withColumn("h1", F.lit(0)).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11


def test_sentencepiece_is_the_librarys(docs):
    got = pieces.encode_and_decode(docs, MODEL)
    library = pieces.Pieces(MODEL).library
    want = []
    for name, text in rows_of(docs):
        ids = library.encode(text or "")
        want.append((name, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert order(map(tuple, got.collect())) == order(want)
    assert pieces.encode_and_decode(docs.where("false"), MODEL).count() == 0


@pytest.mark.parametrize("words", [True, False])
def test_sentencepiece_on_random_texts(words):
    model, rng = pieces.Pieces(MODEL), random.Random(3)
    if not words:
        model.words = lambda text: [text] if text else []
    known = list(model.id)
    texts = ["".join(rng.choice(known).replace("▁", " ") for _ in range(rng.randint(1, 12))) for _ in range(600)]
    texts += ["".join(rng.choice("abethin \n;\r{}()=->.") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    texts += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    for text in texts:
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == model.library.encode(text)
        assert model.decode(ids) == model.library.decode(model.library.encode(text))


def test_sentencepiece_merges_and_memory(monkeypatch):
    model = pieces.Pieces(MODEL)
    for text in ("hello", "▁the", "▁▁▁▁▁▁▁", "aaaaaaa", "ther", "▁and▁"):
        assert model.merged(text) == model.split(text)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "PAIRS", 7)
    text = "what little a worker remembers is what it makes anew " * 4
    assert np.frombuffer(model.encode(text), "<u4").tolist() == model.library.encode(text)
    assert len(model.fits) <= 7 and model.size <= 50 + pieces.LONGEST + 1


def test_sentencepiece_takes_pieces_back():
    """A vocabulary by which the longest match is wrong twice, so that positions fail."""
    model = pieces.Pieces(MODEL)
    order = ["bc", "de", "bcde", "ab", "abc", "abcd", "cd"]
    model.id = {p: i for i, p in enumerate([*"abcdef", *order])}
    model.score = {p: -float(i) for p, i in model.id.items()}
    model.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in model.id), p[:1]) for p in model.id if len(p) > 1}
    model.automaton = pieces.ahocorasick.Automaton()
    for p in order:
        model.automaton.add_word(p, p)
    model.automaton.make_automaton()
    model.fits.clear()
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14)))
        assert model.split(text) == model.merged(text)


def test_column_functions_of_pieces(docs):
    coded = docs.select("text", pieces.encoder(MODEL)(F.col("text")).alias("ids")).select("text", "ids", pieces.decoder(MODEL)(F.col("ids")).alias("back"))
    for r in coded.collect():
        assert r["back"] == (r["text"] or "").replace("▁", " ")


# --- 12


def plain_transform(doc_id, text):
    text = text or ""
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in fim.MARKS):
        return doc_id, len(lines), "plain", None, None, text, text
    if h[3] % 100 < 50:
        return doc_id, len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


@pytest.mark.parametrize("giant,chunk", [(1 << 16, 1 << 14), (40, 7), (3, 1)])
def test_fill_in_middle_equals_a_loop(docs, monkeypatch, giant, chunk):
    """With small bounds nearly all texts are dealt in chunks; a mark may then lie across chunks."""
    monkeypatch.setattr(fim, "GIANT", giant)
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rows = docs if giant > 40 else docs.where("length(text) < 3000 or text is null")
    out = fim.fill_in_middle(rows).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert order(map(tuple, out.collect())) == order([plain_transform(*r) for r in rows_of(rows)])
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_rates_of_forms(docs):
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, spm=100).select("form").distinct().collect()} == {"plain", "spm"}


def test_automaton_functions_compose():
    dfa, rng = fim.automaton(), random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("a\n<<PSM>>\n b") for _ in range(rng.randint(0, 40)))
        k = rng.randint(0, len(text))
        one, two, whole = (fim.Scan(dfa, x) for x in (text[:k], text[k:], text))
        goes, begins = fim.compose((one.goes[None], one.begins[None]), (two.goes[None], two.begins[None]))
        assert (goes[0] == whole.goes).all() and (begins[0] == whole.begins).all()
        starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        starts = [s for s in starts if s < len(text)]
        assert whole.begins[0] == len(starts) and [whole.select(0, n) for n in range(len(starts))] == starts and whole.select(0, len(starts)) == len(text)
        assert (whole.goes[0] % (dfa.found + 1) == dfa.found) == any(m in text for m in fim.MARKS)


# --- 13


def plain_clusters(rows, centroids=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    now = [v for _, v in sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:centroids]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(now)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, c in found if c == n) for n in range(len(now))}
    return [(i, c, d, total[c], sum(total.values()), sha(",".join(map(str, now[c])))) for i, d, c in found]


def test_clusters_equal_a_loop(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").limit(150).collect()]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.1] * 63), (904, [float("nan")] + [0.1] * 63), (905, [float("inf")] + [0.1] * 63), (None, [0.25] * 64), (906, [0.0] * 64), (907, [-0.0] * 64), *vectors[:9], (908, vectors[0][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("v", F.lit(2))
    for k in (40, 3, 1):
        got = annulus.cluster(df, centroids=k)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert order(map(tuple, got.collect())) == order(plain_clusters(vectors + odd, k))
    few = df.where("vec_id in (906, 908)")
    assert order(map(tuple, annulus.cluster(few).collect())) == order(plain_clusters([r for r in vectors + odd if r[0] in (906, 908)]))
    assert annulus.cluster(df.where("vec_id = 900")).count() == 0 and annulus.cluster(df.where("false")).columns == got.columns


def test_annulus_keeps_ties_and_large_values():
    rng = np.random.default_rng(4)
    for scale in (1, 3, 1 << 20, 1 << 25):
        c = rng.integers(-scale, scale + 1, (40, 5)) if scale > 3 else rng.integers(-scale, scale + 1, (40, 2))
        c[7], c[20] = c[3], c[3]
        x = np.concatenate([rng.integers(-scale, scale + 1, (500, c.shape[1])), c])
        number, distance = annulus.Annulus(c).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (distance == d.min(1)).all() and (number == d.argmin(1)).all()


def test_a_component_out_of_range_is_named(spark):
    df = spark.createDataFrame([(5, [1e7] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vec_id 5"):
        annulus.cluster(df)
