"""Null, negative and repeated ids: every row is judged by its own text, none is lost or multiplied."""

import random
import zlib

import numpy as np
import pytest

from pkgloom.llm import op02_suffix_dedup, op03_ngram_join, op04_quality, op07_licenses, op10_language_id, pipeline

from test_operators import DOCS, brute_removed, by_id

BASE = [f"w{i}" for i in range(100)]


def text(*changed):
    return " ".join("x" + str(i) if i in changed else w for i, w in enumerate(BASE))


def ngram_rows(spark, rows):
    """doc_id, text, shingles, component, stays by search over all pairs of rows."""
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(repr((i, len(sets[k]), low.get(find(k)))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("ids", [(1, None, 2), (1, 3, 3, 2), (None, None, None), (-5, 7, 7, 7, None), (4, 4, 4)])
def test_ngram_join(spark, ids):
    rng = random.Random(str(ids))
    # a chain of texts of which only neighbours link, and a text apart
    chain = [text(), text(5), text(5, 50), text(5, 50, 90), text(5, 50, 90, 30)][: len(ids)]
    rows = [*zip(ids, chain, strict=True), (ids[1], "another text of a few words that links with nothing"), (ids[0], None), (ids[0], "one"), (9, "one"), (ids[1], chain[1])]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op03_ngram_join.similar(spark, table, 4, 85).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == ngram_rows(spark, rows)
    # of each component that has shingles one text stays
    stays = {(r["doc_id"], r["tk"]) for r in got if r["stays"] and r["n_shingles"] > 1}
    assert len(stays) == 2


def test_hot_tokens(spark, monkeypatch):
    """Tokens of many groups in several components, met in several places."""
    monkeypatch.setattr(op03_ngram_join, "MEET", 2)
    monkeypatch.setattr(op03_ngram_join, "PAIRS", 2)
    rng = random.Random(8)
    rows = []
    for i in range(150):
        w = list(BASE[:40])
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(40)] = rng.choice("abc")
        rows.append((rng.choice([i, None]), " ".join(w)))
    got = op03_ngram_join.similar(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == ngram_rows(spark, rows)


def test_near_stage_of_rows_without_ids(spark):
    rows = [(None, text()), (3, text(5)), (3, "other words that stand alone here, not like the text"), (None, "nothing like it at all, this is")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(repr((r["doc_id"], r["text"])) for r in pipeline.near(spark, docs, "").collect())
    assert got == sorted(repr(r) for r in rows[1:])


def test_suffix_dedup_of_texts_under_one_id(spark):
    """Two texts under one id whose checksums have the same lower 16 bits: each keeps its own cuts."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh ijkl") for _ in range(n))
    passage = some(600)
    tag = zlib.crc32(passage.encode()) & 0xFFFF
    alone = next(t for t in iter(lambda: some(605), None) if zlib.crc32(t.encode()) & 0xFFFF == tag)
    rows = [(1, passage), (1, alone), (2, "x" + passage + "y"), (None, passage[:450]), (-3, "z")]
    got = op02_suffix_dedup.drop_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [repr((i, x)) for (i, _), x in zip(rows, brute_removed([t.encode() for _, t in rows]), strict=True)]
    assert sorted(repr((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))) for r in got) == sorted(want)


def test_licenses_of_any_id(spark, tmp_path):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(-5, mit), (None, apache), (None, "nothing"), (7, mit), (7, "no statement here"), (-50, mit), (-48, "plain"), (100, apache), (101, "inherits"), (103, None)]
    rows += [(10_000, mit), (2_000, apache), (1_999, "by the folder of its source and language"), (20_001, "by that of its source, as no nearer one says")]
    spark.createDataFrame([(i, t, "en" if i != 20_001 else "de", "s", 0) for i, t in rows], DOCS[: DOCS.index(", n long")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["license"], r["inherited_from"]) for r in op07_licenses.op7_licenses(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    of = lambda i: sorted((x[1:] for x in got if x[0] == i), key=repr)
    assert of(-5) == [("MIT", None)] and of(None) == [("Apache-2.0", "s/en"), ("Apache-2.0", None)] or of(None) == sorted([("Apache-2.0", None), ("Apache-2.0", "s/en")], key=repr)
    assert of(7) == sorted([("MIT", None), ("Apache-2.0", "s/en")], key=repr)
    assert of(-50) == [("MIT", None)] and of(-48) == [("MIT", "s/en/-1")]
    assert of(101) == [("Apache-2.0", "s/en/2")] == of(103)
    # nearest over farther ancestors
    assert of(1_999) == [("Apache-2.0", "s/en")] and of(20_001) == [("MIT", "s")]


def test_letters(spark):
    texts = ["½ ² Ⅷ", "１２३", "٣", "²a", "a½b", "", None, "_", "ⅷ", "ª", "日本", "x²y²"]
    for t in texts:
        assert op10_language_id.letters(t or "") == " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(op10_language_id.identify(table, {"en": b"the and of " * 50, "de": b"der die das " * 50}))
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {i for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")}


def test_quality_ties(spark):
    """Labels that clash count as the lower one, and rows without an id are held out."""
    docs = spark.createDataFrame([(i, f"{'good plain words' if i % 2 else '### $$$ !!!'} {i}") for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    twice = labels.union(spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int"))
    a, b = ({r["doc_id"]: r["score"] for r in op04_quality.score(spark, docs, x).collect()} for x in (labels, twice.repartition(5)))
    assert a == b
    assert docs.select(op04_quality.held_out().alias("h")).where("h IS NULL").count() == 0


def test_word_vectors_by_hand(spark):
    """Sums of the neighbours' index vectors over all documents, one word at a time."""
    rng = random.Random(10)
    texts = [" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randrange(12))) for _ in range(40)] + ["", None]
    got = op04_quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    total = np.zeros((op04_quality.ROWS, op04_quality.DIM))
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        word = op04_quality._tokens(raw, np.array([0, len(raw)]))[0].tolist()
        for i, w in enumerate(word):
            for k in (-2, -1, 1, 2):
                if 0 <= i + k < len(word):
                    for z in range(op04_quality.NONZERO):
                        total[w, op04_quality._AT[word[i + k], z]] += op04_quality._SIGN[word[i + k], z]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    total -= total.mean(axis=0)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, total, atol=1e-6)


def order_of(score, y):
    """The share of pairs of a 1 and a 0 that the score has in order."""
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    one = y == 1
    return (rank[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def test_fit():
    """Rows that were not seen: nearly the order of the true probabilities, and scores that are probabilities."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(18_000, op04_quality.POOLED))
    p = 1 / (1 + np.exp(-(3 * np.abs(x[:, 0]) + 2 * x[:, 1] - 2)))
    y = (rng.random(18_000) < p).astype(float)
    net = op04_quality.fit(x[:16_000].astype(np.float32), y[:16_000])
    score, y, p = net.score(x[16_000:]), y[16_000:], p[16_000:]
    assert order_of(score, y) > 0.92 * order_of(p, y) > 0.75
    for low, high in ((0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)):
        part = (score >= low) & (score < high)
        assert abs(score[part].mean() - y[part].mean()) < 0.12


def test_held_out_order(spark):
    """On held-out documents the scores tell the labels apart, which a constant would not."""
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op04_quality.op4_quality(spark, d).collect()}
    known = [(got[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert order_of(*(np.array(x, float) for x in zip(*known, strict=True))) > 0.8
