"""Operators that read whole texts one by one: BPE, language, decontamination, quality, toxicity."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import bpe, decontam, langid, quality, toxicity
from storyloom.llm.common import crc_rest, numbered

MESSY = "doc_id long, text string, lang string, score double, ids string, kept string, n_words int, row int"
ROWS = [
    (1, "The quick fox. The end", "en", 0.5, "x", "y", 3, 1),
    (1, "The quick fox. The end", "en", 0.5, "x", "y", 3, 1),
    (None, "un renard très vif", "fr", None, None, None, None, None),
    (3, None, None, 0.1, "", "", 0, 0),
    (4, "", "en", 0.1, "", "", 0, 0),
    (5, "12 !! \t\n", None, 0.1, "", "", 0, 0),
    (6, "wort " * 30_000, "de", 0.1, "", "", 0, 0),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, MESSY)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], MESSY)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(abc) for _ in range(rng.randint(1, 40))) for abc in ("the ing an", "aé'ß1 !日Σ\x1c\xa0") for _ in range(400)]
    return ["", "ΑΣ  İstanbul's it's ''s <|endoftext|>x<|startoftext|>", "\x00\x1c\x85\xa0 日本語…!!!", "éÅ ﬁ ǅ ß 1234½", "a" * 300, "<|endoftext|>", "don't they'll I'd've", *made]


def test_bpe_equals_the_library(docs, tokenizer):
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    texts = odd_texts() + [r.text for r in docs.select("text").collect()]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, text[:80]
        assert encoder.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_digests(messy, empty, tokenizer):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(messy).collect())
    want = []
    for r in ROWS:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0] or 0, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.digests(empty).count() == 0


def test_bpe_forgets_without_harm(monkeypatch):
    texts = odd_texts()
    whole = bpe.Encoder(bpe.Vocabulary(bpe.default_path())).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    assert all(np.array_equal(a, b[0]) for a, b in zip(whole, [encoder.encode([t]) for t in texts]))


def test_forward_sums_all_segmentations():
    ids = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"])}
    chances = np.r_[np.linspace(0.05, 0.2, len(ids)), 1e-6]
    words = ["abab", "a", "bx", "aaba"]
    lattice = langid.Lattice(words, langid.Pieces(ids))
    got = lattice.total(lattice.forward(chances))
    for word, value in zip(words, got):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts = re.findall(".+", "".join(c + ("\n" if k else "") for c, k in zip(text, [*cuts, 0])))
            total += np.prod([chances[ids[p]] if p in ids else chances[-1] if len(p) == 1 else 0 for p in parts])
        assert value == pytest.approx(total)
    # expected uses of pieces add up to the expected number of pieces
    uses = lattice.expected(chances, np.ones(len(words)))
    assert len(words) <= uses.sum() <= sum(len(w) + 1 for w in words)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, ["doc_id", "lang"], crc_rest("doc_id", 5) != 0)
    right = found.filter(crc_rest("kept.doc_id", 5) == 0).agg(F.avg((F.col("kept.lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.98 and 0 <= right[1] and right[2] <= 1


def test_language_of_messy_rows(messy, empty):
    found = {r.kept.doc_id: (r.lang_pred, r.score) for r in langid.identify(messy, messy.columns, F.col("lang").isNotNull()).collect()}
    assert found[3] == found[4] == found[5] == ("und", 0.0)
    assert found[1][0] == "en" and found[None][0] == "fr" and found[6][0] == "de"
    assert langid.identify(empty, empty.columns, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, ["doc_id"], F.lit(False)).collect()} == {"und"}


def test_language_sample_counts_copies_once(spark, monkeypatch):
    """A group of copies that makes up most of a language takes one place in the sample and hides no other text."""
    monkeypatch.setattr(langid, "fit", lambda counts, ids: (counts,))
    hot = spark.range(20_000).select(F.lit("fr").alias("lang"), F.lit("encore").alias("text"))
    others = spark.createDataFrame([("fr", "mot" + chr(97 + i)) for i in range(26)] + [("de", "wort")], "lang string, text string")
    counts, _ = langid.train(hot.union(others), F.lit(True), langid.default_path(), fit_rows=27)
    assert set(counts) == {"fr", "de"} and len(counts["fr"]) == 27 and set(counts["fr"].values()) == {1}
    counts, _ = langid.train(hot.union(others), F.lit(True), langid.default_path(), fit_rows=13)
    assert 5 <= len(counts["fr"]) <= 13 and set(counts["fr"].values()) == {1}


def brute_hits(text, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, named = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(width, len(v))
        spots = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in spots:
                hit |= set(range(i, i + k))
                named.add(name)
    return len(w), len(hit), sorted(str(n) for n in named if n is not None)


@pytest.mark.parametrize("table_bytes", [1 << 20, 40])
def test_decontamination_against_brute_force(spark, table_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bb", "ccc", "Été", "the", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(12)] + [(50, None), (51, "  ,"), (None, "zz zz zz zz"), (3, "a bb zz ccc")]
    texts = [" ".join(word() + rng.choice(["", ",", "-"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "zz zz zz zz zz", "A, BB!"]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.kept.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find(docs, benchmark, docs.columns, width=4, table_bytes=table_bytes).collect()}
    for i, text in enumerate(texts):
        assert found[i] == brute_hits(text, items, 4), text


def test_decontamination_edges(messy, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.digests(messy, none).collect()
    assert len(rows) == len(ROWS) and not any(r.contaminated or r.n_hit for r in rows)
    assert decontam.digests(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    hit = {r.doc_id: r.contaminated for r in decontam.digests(messy, spark.createDataFrame([("q", "wort " * 14)], "item_id string, text string")).collect()}
    assert hit[6] and not hit[1]


def area(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
    pos = labels == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@pytest.mark.parametrize(("operator", "label", "parts", "rest", "least"), [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 4, 2, 0.7)])
def test_held_out_ranking(spark, operator, label, parts, rest, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = operator.score(docs, labels, ["doc_id"], crc_rest("doc_id", parts) != rest).select("kept.doc_id", "score")
    rows = found.join(labels, "doc_id").filter(crc_rest("doc_id", parts) == rest).select("score", label).collect()
    scores, truth = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert ((scores >= 0) & (scores <= 1)).all()
    assert area(scores, truth) >= least


@pytest.mark.parametrize(("operator", "label", "nothing"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.0)])
def test_scores_of_messy_rows(spark, messy, empty, operator, label, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 1), (None, 0, 0), (7, None, None), (8, 5, 5)], "doc_id long, quality int, toxic int")
    none = labels.filter("false")
    assert {r.score for r in operator.score(messy, none, messy.columns, F.lit(True)).collect()} == {nothing}
    scores = [r.score for r in operator.score(messy, labels, messy.columns, F.lit(True)).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert operator.score(empty, labels, ["doc_id"], F.lit(True)).count() == 0


@pytest.mark.parametrize("place", [0, 5])
def test_huge_labelled_text_hides_no_other(spark, place):
    """A text over the bound of the sample, first or later in order of hashes, is shortened, and all others stay whole."""
    ids = [r[0] for r in spark.range(20).orderBy(F.xxhash64("id")).collect()]
    texts = {i: f"text number {i}" for i in range(20)}
    texts[ids[place]] = "start " + "x" * 50_000 + " end"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    found, known, _ = quality.labelled_sample(docs, labels, "quality", F.lit(True), 20, fit_bytes=10_000)
    assert len(found) == 20 and sum(known) == 10 and sum(map(len, found)) <= 10_000
    assert set(texts.values()) - set(found) == {texts[ids[place]]}
    longest = max(found, key=len)
    assert longest.startswith("start ") and longest.endswith(" end") and len(longest) > 9_000


def test_toxicity_gradients():
    """Back-propagation against differences."""
    net, rng = toxicity.Network(), np.random.default_rng(0)
    parts = toxicity.Parts(["stupid", "fine", "day", ""])
    odds = (rng.standard_normal(toxicity.WORDS).astype(np.float32), rng.standard_normal(toxicity.GRAMS).astype(np.float32))
    at = rng.integers(0, 5, (6, toxicity.WINDOW)).astype(np.int32)
    y = np.array([1, 0, 1, 0, 1, 0], np.float32)

    def loss():
        out = net.logits(net.table(parts.inputs(net.p, odds)), at).astype(float)
        return np.mean(np.logaddexp(0, out) - y * out)

    before, base = {k: v.copy() for k, v in net.p.items()}, loss()
    net.step(parts, parts.inputs(net.p, odds), at, y, 1e-3)
    assert loss() < base
    grads = {k: net.m[k][0] * 10 for k in net.p}
    net.p = {k: v.copy() for k, v in before.items()}
    for name in ("in", "ahead", "behind", "look", "out"):
        where = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        up, down = [], []
        for out, by in ((up, 2e-2), (down, -2e-2)):
            net.p[name][where] += by
            out.append(loss())
            net.p[name][where] -= by
        assert (up[0] - down[0]) / 4e-2 == pytest.approx(grads[name][where], rel=0.05, abs=2e-4)


def test_numbers_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = numbered(df, ["k"], "v", "at", rows_per_chunk=100).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d"), F.min("at"), F.max("at").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 and r[3] == 0 for r in out)
