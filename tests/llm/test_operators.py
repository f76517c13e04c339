"""The corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import collections
import hashlib
import importlib
import os
import random
import re

import duckdb
import pandas as pd
import pytest

from pkgloom.llm import components, op01_chat, op02_suffix_dedup, op03_ngram_join, op04_quality, op05_exact_dedup, op06_mixing, op07_licenses, op08_pii, op09_decontamination, op10_language_id
from pkgloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, b long, rep long, k_doc_id long, l_doc_id long, license string"
LONG = " ".join(f"w{i}" for i in range(300))


def awkward():
    """Null and empty texts, ties, repeated rows, a very long text, and columns whose names the operators use inside."""
    rng = random.Random(1)
    near = LONG.split()
    texts = [None, "", "   \t\n", "one", "One", "a b c d", LONG, LONG, LONG + "  ", " ".join(near[:295] + ["x", "y"]), " ".join(near[:150] + ["q"] + near[150:]), "é" * 700, "é" * 700 + "z", "ab" * 600,
             " ".join(rng.choice(near) for _ in range(40_000)), "mail me@x.example.org or +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111; 1.2.3.999 4111111111111112", "Released under the MIT License.\nfoo", LONG + " tail"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None, 0, 1, 1, 1, 1, 1, "x") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[0], (None, "no id", "en", "s1", 0, 1, 1, 1, 1, 1, "x"), (None, None, None, None, None, 1, 1, 1, 1, 1, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    # pandas has two kinds of null, and floats for integers beside nulls
    plain = lambda v: None if v is None or pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())
    assert rows(want) == rows(got)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\e\\", "", None, "\\</s>", "line\n\nline", "<s>\\n"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", None, "odd\nrole[INST]", "tool"])]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", __import__("pyspark").sql.functions.lit(1))
    for how in ({}, {"block": 3}, {"per_turn": False}):
        got = {r["conv_id"]: r for r in op01_chat.read_back(op01_chat.format_conversations(turns, **how)).collect()}
        for conv in {r[0] for r in rows}:
            own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            assert got[conv]["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()
            assert got[conv]["rewrites"] == 0 and got[conv]["n_turns"] == len(own)
    assert op01_chat.read_back(op01_chat.format_conversations(turns.where("turn > 99"))).count() == 0


def test_chat_rewriting_template(spark):
    last_only = lambda turns: "".join(f"<{t if i == len(turns) - 1 else t[:1]}>" for i, (_, t) in enumerate(turns))
    _, spans = op01_chat.turn_spans(last_only, [("user", "abc"), ("assistant", "def")])
    assert spans[1] == (-1, -1)
    turns = spark.createDataFrame([(1, t, "user", f"text{t}") for t in range(40)], "conv_id long, turn long, role string, text string")
    (row,) = op01_chat.format_conversations(turns, last_only, block=3).collect()
    assert row["formatted"] == last_only([("user", f"text{t}") for t in range(40)]) and row["rewrites"] == 40
    with pytest.raises(Exception, match="per_turn does not hold"):
        op01_chat.format_conversations(turns, last_only, per_turn=True, block=3).collect()
    out, spans = op01_chat.turn_spans(op01_chat.inst_template, [("user", "abc"), ("assistant", "def")])
    assert "".join(out[a:b] for a, b in spans) == out


def brute_removed(texts):
    """Of each row: bytes, removed bytes, removed runs, digest of the rest."""
    n = op02_suffix_dedup.LENGTH
    seen = collections.Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("members", [4096, 2])
def test_suffix_dedup(spark, docs, none, members, monkeypatch):
    monkeypatch.setattr(op02_suffix_dedup, "MEMBERS", members)
    monkeypatch.setattr(op02_suffix_dedup, "PIECE_BYTES", 1 << 20 if members > 2 else 1000)
    rng = random.Random(10)
    cut = "".join(rng.choice("abc \n") for _ in range(900))
    extra = [(40, cut + "x" * 100), (None, "y" * 50 + cut), (None, "z" + cut[:500]), (None, "z" + cut[:500]), (41, cut[250:700]), (41, "other" + cut[100:600])]
    texts = [(r[0], r[1]) for r in awkward()] + extra
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(4)
    # a long text whose windows are too many to count one by one here: a piece that holds what it shares stands for it
    long = next(t for i, t in texts if i == 14)
    rows = [(i, (t if i != 14 else long[:60_000] or "").encode() if t else b"") for i, t in texts]
    table = table.where("doc_id IS NULL OR doc_id <> 14").union(spark.createDataFrame([(14, long[:60_000])], "doc_id long, text string"))
    want = sorted(repr((i, x)) for (i, _), x in zip(rows, brute_removed([b for _, b in rows]), strict=True))
    got = op02_suffix_dedup.drop_repeats(spark, table).collect()
    assert sorted(repr((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))) for r in got) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert op02_suffix_dedup.drop_repeats(spark, none).count() == 0


def test_suffix_dedup_of_a_very_long_text(spark):
    """Twice one random passage in a text of 240 KB: only the passages go."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh ijkl") for _ in range(n))
    passage = some(700)
    text = some(100_000) + "1" + passage + "2" + some(140_000) + "3" + passage + "4"
    (row,) = op02_suffix_dedup.drop_repeats(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(text), 1400, 2) and row["kept"].decode() == text.replace(passage, "")


def test_bucket_refinement():
    import numpy as np

    rng = random.Random(11)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(3))) * 300 + bytes([rng.choice(b"ab")]) * rng.randrange(300) for _ in range(40)] + [b"", b"a" * 399]
    at = np.r_[0, np.cumsum([len(r) for r in rows])]
    start, place = op02_suffix_dedup.refined(np.frombuffer(b"".join(rows), np.uint8), at)
    n = op02_suffix_dedup.LENGTH
    windows = {int(at[k]) + i: r[i : i + n] for k, r in enumerate(rows) for i in range(len(r) - n + 1)}
    assert sorted(windows) == start.tolist()
    names = {}
    assert all(names.setdefault(p, windows[s]) == windows[s] for s, p in zip(start.tolist(), place.tolist(), strict=True)) and len(names) == len({*windows.values()})


def test_suffix_blocks(monkeypatch):
    import numpy as np

    raw = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = op02_suffix_dedup.anchors(raw, np.array([0, 1800, 5000]))
    monkeypatch.setattr(op02_suffix_dedup, "BLOCK", 700)
    cut = op02_suffix_dedup.anchors(raw, np.array([0, 1800, 5000]))
    cover = lambda a: {(int(d), i) for d, lo, hi in zip(*a[:3], strict=True) for i in range(lo, hi + 1)}
    assert cover(whole) == cover(cut) == {(0, i) for i in range(1401)} | {(1, i) for i in range(2801)}


def brute_components(rows, width, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, none, width, percent, monkeypatch):
    monkeypatch.setattr(op03_ngram_join, "PAIRS", 3)
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)] for _ in range(6)]
    for i in range(100, 220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = "new" + str(rng.randrange(9))
        rows.append((i, " ".join(w)))
    table = docs.where("doc_id IS NOT NULL").select("doc_id", "text").union(spark.createDataFrame(rows[-120:], "doc_id long, text string"))
    got = op03_ngram_join.similar(spark, table, width, percent).collect()
    assert len(got) == table.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, width, percent)
    assert op03_ngram_join.similar(spark, none).count() == 0
    assert op03_ngram_join.similar(spark, docs).count() == len(awkward())


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_quality(spark, docs, none):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries()["op4_quality"](spark, d).collect()}
    known = [(i, q) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall() if got[i]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == q for i, q in known) >= 0.9 * len(known)
    labels = spark.createDataFrame([(1, 1), (1, 1), (99, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert op04_quality.score(spark, docs, labels).count() == len(awkward())
    assert {r["score"] for r in op04_quality.score(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert op04_quality.score(spark, none, labels).count() == 0
    assert op04_quality.keep(spark, docs, labels.limit(0)).count() == len(awkward())


def test_exact_dedup(spark, docs, none):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in awkward():
        groups[key(r[1])].append(r[0])
    for split in (None, 0, 5, 10**9):
        got = op05_exact_dedup.exact_dedup(spark, docs, split).collect()
        assert len(got) == len(awkward())
        for r in got:
            own = next(g for g in groups.values() if r["doc_id"] in g and len(g) == r["group_size"] and min((x for x in g if x is not None), default=None) == r["keep_id"])
            assert r["kept"] == (r["doc_id"] == min((x for x in own if x is not None), default=None))
    assert op05_exact_dedup.exact_dedup(spark, none).count() == 0


def test_perfect_hash():
    import numpy as np

    words = np.frombuffer(random.Random(3).randbytes(32 * 5000), np.uint8).reshape(-1, 32)
    sizes, bits, slot = op05_exact_dedup.build(words[:4000])
    assert sorted(slot) == list(range(4000)) and (op05_exact_dedup.lookup(words[:4000], sizes, bits) == slot).all()


def test_mixing(spark, docs, none):
    rows = op06_mixing.sized(docs)
    got = op06_mixing.mix_sources(spark, rows).collect()
    assert len(got) == len(awkward()) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in awkward())
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, op06_mixing.mix_sources(spark, rows.repartition(7)).collect()))
    assert op06_mixing.mix_sources(spark, op06_mixing.sized(none)).count() == 0


def test_water_fill():
    assert op06_mixing.water_fill([100, 10, 10], [5, 2, 1], 180, 2) == pytest.approx([140, 20, 20])
    assert op06_mixing.water_fill([10, 10, 0], [1, 1, 1], 100, 2) == [20, 20, 0]
    out = op06_mixing.water_fill([50, 300, 900, 20], [5, 2, 1, 5], 1.5 * 1270, 2)
    assert sum(out) == pytest.approx(1905) and all(t <= 2 * s for t, s in zip(out, [50, 300, 900, 20], strict=True))


def test_licenses(spark, docs, none):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/x", "code"), ("a/b/c/y", "(c) all rights reserved. more"), ("top", None), ("z/w", "Licensed under the Apache License, Version 2.0!"), ("z/v/u", "no"), (None, "MIT License")], "path string, text string")
    F = __import__("pyspark").sql.functions
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in op07_licenses.scan(spark, files).collect()}
    # a source file speaks for itself only
    assert got == {"a/LICENSE": ("MIT", None), "a/b/x": ("MIT", "a"), "a/b/c/y": ("proprietary", None), "top": (None, None), "z/w": ("Apache-2.0", None), "z/v/u": (None, None), None: (None, None)}
    assert op07_licenses.scan(spark, docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))).count() >= len(awkward())
    assert op07_licenses.scan(spark, none.withColumn("path", F.lit("a"))).count() == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and op08_pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark, docs, none):
    rng = random.Random(4)
    parts = ["a@b.co", "a@b", "@", "x.y@z-1.org.", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "+49 30 123456", "+1", "4111 1111 1111 1111", "4111-1111-1111-1111", "12", " ", "  ", "-", ".", "é", "0001.1.1.1", "@a.b", "+1+2 (3) 4567890", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert op08_pii.base_spans(text) == plain_base(text), text
    for r in op08_pii.find_pii(spark, docs).collect():
        assert set(r["spans"].split(",")) - {""} or not r["n_email"]
    got = by_id(op08_pii.find_pii(spark, docs))
    assert [got[15][f"n_{k}"] for k in op08_pii.KINDS[:4]] == [1, 1, 1, 1] and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert op08_pii.find_pii(spark, none).count() == 0


def spans_of(field, *texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return op08_pii.found_spans(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], op08_pii.Reader(field))


def plain_viterbi(field, tokens):
    """Best tags of one chain, by features as strings and every step."""
    import numpy as np

    e = np.array([field.weight[[field.index[f] for f in fs if f in field.index]].sum(0) for fs in op08_pii.word_features(tokens)])
    e[0, 2::2] -= 30
    best, back = e[0], []
    for x in e[1:]:
        both = best[:, None] + field.step
        back.append(both.argmax(0))
        best = both.max(0) + x
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def plain_spans(field, text):
    """Spans of the field by plain_viterbi over whole lines, and base spans."""
    base = plain_base(text)
    out = []
    for line in re.finditer(r"[^\n]+", text):
        found = list(WORD.finditer(line[0]))
        spans = []
        for m, tag in zip(found, plain_viterbi(field, [m[0] for m in found]) if found else [], strict=True):
            _, a, b = op08_pii.core(m[0])
            if tag % 2:
                spans.append([line.start() + m.start() + a, (tag - 1) // 2, line.start() + m.start() + b])
            elif tag:
                spans[-1][2] = line.start() + m.start() + b
        out += [tuple(x) for x in spans if not any(x[0] < y[2] and y[0] < x[2] for y in base)]
    return base, sorted({*base, *out})


def test_field():
    field = op08_pii.train()
    good = sum(plain_viterbi(field, w) == t for w, t in op08_pii.labelled())
    assert good >= 0.95 * len(op08_pii.labelled())
    ((_, spans),) = spans_of(field, "please write to Mr. Carl Fox or carl (at) fox.example.com, ok")
    assert op08_pii.written(spans) == "name:20:28,email:32:57"


def test_field_like_plain_viterbi(monkeypatch):
    """All lines of any length, wherever they stand, against Viterbi over each whole line."""
    field = op08_pii.train()
    rng = random.Random(13)
    words = [w for line in op08_pii.LABELLED.split("\n") for w in line.split() if w not in ("]",) and w[0] != "["] + ["a@b.co", "10.0.0.1", "Ünal", "\"Otto", "NAME:", "MR.", "fe80::1", "x" * 60, "+49 30 1234567", "é"]
    texts = ["", "   \n ", "555-0134"]
    for n in (1, 2, 5, 30, 253, 255, 256, 257, 600, 5_000):
        texts += [" ".join(rng.choice(words) for _ in range(n)), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(n))]
    want = [plain_spans(field, t) for t in texts]
    assert spans_of(field, *texts) == want and sum(len(a) - len(b) for b, a in want) > 200
    monkeypatch.setattr(op08_pii, "BLOCK", 7)
    assert spans_of(field, *texts) == want
    # one sentence is read alike wherever it stands in a long line, and long words by their whole shape
    for n in (0, 240, 253, 256, 300):
        ((_, spans),) = spans_of(field, "and " * n + "my name is Peter Miller and I agree")
        assert op08_pii.written(spans) == f"name:{4 * n + 11}:{4 * n + 23}"
    assert op08_pii.shape("a" * 50 + "1") != op08_pii.shape("a" * 50)


def test_pii_of_a_very_long_text():
    """Linear in the text: a megabyte with 30,000 spans of both kinds."""
    import time

    text = "mail a@b.co or anna (at) mail.example.org and " * 25_000
    t = time.time()
    ((base, spans),) = spans_of(op08_pii.train(), text)
    assert len(base) == 25_000 and len(spans) >= 50_000 and time.time() - t < 60


def test_decontamination(spark, docs, none):
    items = [(1, LONG), (2, "one"), (3, "B C D"), (4, None), (5, "!!"), (6, " ".join(LONG.split()[100:110])), (7, "zzz " + " ".join(LONG.split()[:9])), (1, LONG)]
    rng = random.Random(9)
    table = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    extra = [(None, LONG), (None, LONG + " and " + LONG), (6, "another text under the id of a copy"), (30, " ".join(rng.choice(["w1", "w2", "w3"]) for _ in range(3_000)) + " " + LONG), (31, "a " * 500 + LONG + " one" * 300)]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for i, t in [(r[0], r[1]) for r in awkward()] + extra:
        w = word.findall((t or "").translate(low))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(map(str, ids)), bool(hit)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in op09_decontamination.decontaminate(spark, all_docs, table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    plain = op09_decontamination.decontaminate(spark, all_docs, table.where("item_id IN (1, 6, 7)")).where("contaminated")
    assert plain.count() == sum(bool({"1", "6", "7"} & {*x[3]}) for x in want)
    assert op09_decontamination.decontaminate(spark, none, table).count() == 0
    assert op09_decontamination.decontaminate(spark, docs, table.limit(0)).where("contaminated").count() == 0


def test_language(spark, docs, none):
    d = "/root/testdata/sf0.01"
    got = by_id(queries()["op10_language_id"](spark, d))
    known = [(i, x) for i, x in duckdb.sql(f"SELECT doc_id, lang FROM '{d}/documents.parquet' WHERE lang IS NOT NULL").fetchall() if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == x for i, x in known) >= 0.97 * len(known)
    learned = op10_language_id.train(docs.select("doc_id", "text", "lang"))
    out = by_id(op10_language_id.identify(docs, learned))
    assert out[0]["lang_pred"] == out[2]["lang_pred"] == "und" and out[6]["lang_pred"] == "en"
    assert op10_language_id.identify(none, learned).count() == 0
    assert op10_language_id.train(none.select("doc_id", "text", "lang")) == {}


def test_language_of_long_texts_and_sizes(spark):
    """A language whose texts are all long is learned; languages are those of the smallest plain zstandard encoding."""
    import zstandard

    words = {"en": "the house of my father stands near the river and we went there".split(), "de": "das haus meines vaters steht nahe am fluss und wir gingen dorthin".split()}
    rng = random.Random(8)
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, say("en", 5_000), "en") for i in range(5)] + [(9, say("de", 30), "de"), (None, say("de", 30), "xx")]
    learned = op10_language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "de"} and len(learned["en"]) <= 5 * (op10_language_id.PIECE + 1)
    texts = [(100 + i, say(("en", "de")[i % 2], n)) for i, n in enumerate((3, 5, 40, 60, 4_000, 5_000))]
    got = by_id(op10_language_id.identify(spark.createDataFrame(texts, "doc_id long, text string"), learned))
    for i, t in texts:
        sizes = {}
        for lang, d in learned.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=op10_language_id.LEVEL, dict_data=z, write_content_size=False, write_dict_id=False).compress(op10_language_id.letters(t).encode()))
        assert sizes[got[i]["lang_pred"]] == min(sizes.values()) and got[i]["lang_pred"] == ("en", "de")[i % 2]


def plain_exact(rows):
    """Of (doc_id, text) rows those that the exact stage keeps."""
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[key(t)].append((i is None, i or 0, t is not None, t or ""))
    return sorted(repr((None if x[0] else x[1], x[3] if x[2] else None)) for x in map(min, groups.values()))


def plain_hits(rows, items):
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(low))
    windows = {tuple(w[k : k + 10]) for w in map(cut, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    return {t for _, t in rows if any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_pipeline(spark, none, tmp_path):
    """Each stage on all that the one before kept, against brute force; rows with null ids and repeated ids included."""
    pipeline = importlib.import_module("corpus_pipeline")
    bench = [" ".join(f"bench{i}" for i in range(20)), "short item here"]
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = [(50, bench[0][:80]), (51, bench[0].upper() + " and more"), (None, "x " + bench[0]), (52, "a short  item here"), (53, "a long item"), (6, "another text"), (6, "another text"), (None, LONG + "\t"), (None, "no id"), (None, LONG.replace("w7 ", "w "))]
    rows = [*awkward(), *((i, t, "en", "s1", 0, 1, 1, 1, 1, 1, "x") for i, t in more)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    stage = dict(pipeline.STAGES)
    of = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = op04_quality.keep(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert stage["quality"](spark, docs, str(tmp_path)).count() == kept.count() > 0
    for start in (docs, kept):
        before = of(start)
        exact = stage["exact_dedup"](spark, start, str(tmp_path))
        assert exact.schema == docs.schema and sorted(map(repr, of(exact))) == plain_exact(before)
    before = of(exact)
    near = stage["near_dedup"](spark, exact, str(tmp_path))
    # without an id a row comes after all that have one; two texts of id 6 share their fate
    ids = {t: i if i is not None else 10**6 + k for k, (i, t) in enumerate(before)}
    root = brute_components([(ids[t], t) for _, t in before if t != "another text"], 5, 80)
    left = of(near)
    assert near.schema == docs.schema and {t for _, t in left} == {t for _, t in before if t == "another text" or root[ids[t]][1] == ids[t]}
    clean = stage["decontamination"](spark, near, str(tmp_path))
    hits = plain_hits(left, bench)
    assert clean.schema == docs.schema and len(hits) >= 3 and sorted(map(repr, of(clean))) == sorted(repr(x) for x in left if x[1] not in hits)
    mix = stage["mixing"](spark, clean, str(tmp_path))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in mix.collect()) == sorted((i or -1, len(WORD.findall(t or ""))) for i, t in of(clean))
    for name, f in pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0, name


def test_mixing_targets(spark):
    """Targets and source sizes from the words of the texts alone; null source last."""
    rng = random.Random(15)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["b", "a", "B", None, "é", "ab"])) for i in range(300)] + [(900, None, "a"), (901, "x y", "tiny"), (902, "", "void")]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), {s for s in order if size[s]}
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * per > 2 * size[s]}
        for s in over or free:
            target[s] = 2 * size[s] if over else weight[s] * per
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    got = op06_mixing.mix_sources(spark, op06_mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target.get(r["source"], 0)) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target.get(s, 0)) <= 1 for s in order)


def test_pooling_by_hand():
    """Means of vectors, squares and neighbours' products, one word at a time, and scores of a given network."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(op04_quality.ROWS, op04_quality.DIM)).astype(np.float32)
    texts = [b"one two, two three", b"", b"alone", "ünd so weiter ... ok".encode()]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = op04_quality.pool(np.frombuffer(b"".join(texts), np.uint8), at, vectors)
    net = op04_quality.Network(rng.normal(size=96), np.full(96, 2.0), rng.normal(size=(96, 4)), rng.normal(size=4), rng.normal(size=4), 0.1, 1.7)
    for t, row in zip(texts, got, strict=True):
        raw = np.frombuffer(t, np.uint8)
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", t)
        v = [vectors[int(op04_quality.SpanHash(np.frombuffer(w, np.uint8))(np.array([0]), np.array([len(w)]))[0] % np.uint64(op04_quality.ROWS))].astype(float) for w in words]
        want = np.zeros(96)
        if v:
            want[:32], want[32:64] = np.mean(v, 0), np.mean([x * x for x in v], 0)
            want[64:] = np.sum([a * b for a, b in zip(v, v[1:])], 0) / max(1, len(v) - 1)
        assert len(raw) == len(t) and np.allclose(row, want, atol=1e-5)
        hidden = [max(0.0, sum((want[i] - net.mean[i]) / 2 * net.w1[i, j] for i in range(96)) + net.b1[j]) for j in range(4)]
        logit = sum(h * w for h, w in zip(hidden, net.w2)) + 0.1
        assert net.score(want[None])[0] == pytest.approx(1 / (1 + np.exp(-logit / 1.7)))


def licenses_of(spark, texts):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r["file"]: r["license"] for r in op07_licenses.stated(spark, files.withColumn("file", files["path"])).collect()}
    return [got.get(str(i)) for i in range(len(texts))]


def test_license_titles_headers_and_texts(spark):
    mit = "MIT License\n\nCopyright (c) 2024 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n"
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# tail\n"
    cases = [
        ("MIT License", "MIT"), (mit, "MIT"), (mit[mit.index("Permission"):], "MIT"), ("code\n\n * Licensed under the Apache\n * License, Version\n * 2.0.\n", "Apache-2.0"),
        ("GNU General Public License, version 3", "GPL"), ("GNU Lesser General Public License, version 3", "LGPL"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL"),
        ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL"), (gnu.format(""), "GPL"), (gnu.format("Lesser "), "LGPL"), (gnu.format("Affero "), "AGPL"),
        ("License", None), ("the license of a driver", None), ("fahren mit dem Bus", None), ("all the rights of a person", None),
    ]
    words = ["fahren mit dem bus und mit dem rad." for _ in range(40)] + ["the end of the day is near, and the night is long." for _ in range(40)]
    assert licenses_of(spark, [t for t, _ in cases] + words)[: len(cases)] == [x for _, x in cases]
    assert licenses_of(spark, ["Mit."] + ["a license"] * 20) == [None] * 21


def plain_licenses(files):
    """Best licence and cosine of each path, and the nearest one whether it is named or not, by every statement against every template."""
    import math

    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    df = collections.Counter(w for t in files.values() for w in {*words(t or "")})
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1

    def vector(bag):
        v = {w: bag.count(w) * idf(w) for w in bag}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    templates = [(name.rpartition("/")[0], vector(bag), {*bag} & op07_licenses.NAMES) for name, bag in op07_licenses._templates().items()]
    out, near = {}, {}
    for path, text in files.items():
        low = (text or "").lower()
        blocks = re.split(r"\n(?:[^a-z\n]*\n)+", low)
        some = re.split(r"[.!?]+(?=\s|$)|\n", low) + blocks + [x for b in blocks for x in re.split(r"[.!?]+(?=\s|$)", b)]
        if re.search(op07_licenses.LICENSE_FILE, path.rpartition("/")[2]):
            some.append(re.sub(r"(?m)^\W*(?:\(c\)|copyright)\b.*$", "", low))
        for bag in map(words, some):
            v = vector(bag)
            for name, t, names in templates:
                cosine = round(sum(x * t[w] for w, x in v.items() if w in t), 6)
                if len(v.keys() & t.keys()) > 1 and names <= v.keys() and cosine >= op07_licenses.THRESHOLD and (-cosine, name) < out.get(path, (0, "")):
                    out[path] = (-cosine, name)
                if cosine >= op07_licenses.THRESHOLD and (-cosine, name) < near.get(path, (0, "")):
                    near[path] = (-cosine, name)
    return ({path: (name, -c) for path, (c, name) in found.items()} for found in (out, near))


def test_licenses_like_plain_cosines(spark):
    rng = random.Random(6)
    texts = [x for some in op07_licenses.TEMPLATES.values() for x in some]
    files = {"n": None, "e": "", "tag.c": "// SPDX-License-Identifier: BSD-3-Clause\nint x;", "asf.py": texts[7], "mit/LICENSE": f"The MIT License (MIT)\n\nCopyright (c) 2020 A Person\n\n{texts[5]}"}
    for i in range(150):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(["house", "the", "license", "of", "mit", "zzz"])]
        sep = rng.choice([" ", " ", "\n", "\n# "])
        files[rng.choice(["d/LICENSE.", "d/COPYING-", "d/f"]) + str(i)] = "some code here.\n\n" * rng.randrange(2) + sep.join(w) + "\n\nthe end of the file" * rng.randrange(2)
    want, near = plain_licenses(files)
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r["file"]: r for r in op07_licenses.stated(spark, table.withColumn("file", table["path"])).collect()}
    assert {p: (r["nearest"], r["nearest_cosine"]) for p, r in got.items()} == {p: (name, pytest.approx(c, abs=2e-6)) for p, (name, c) in near.items()} and len(near) > len(want)
    got = {p: r for p, r in got.items() if r["license"]}
    assert {p: r["license"] for p, r in got.items()} == {p: name for p, (name, _) in want.items()} and len(want) > 100
    assert all(r["cosine"] == pytest.approx(want[p][1], abs=2e-6) for p, r in got.items())
    assert want["tag.c"][0] == "BSD-3-Clause" and want["asf.py"][0] == "Apache-2.0" and want["mit/LICENSE"][0] == "MIT"


def test_license_prefilter_follows_from_the_threshold(spark):
    texts = ["Redistributed under the BSD", "Released under the MIT", "Subject to the terms of the Mozilla Public\nhat of mine", "no"]
    assert licenses_of(spark, texts) == ["BSD", "MIT", "MPL", None]
    for n, df in ((0, {}), (10_000, {"the": 5_000, "of": 4_000, "mit": 3_000, "license": 7, "rights": 900})):
        rows, idf = op07_licenses.vectors(n, df)
        some = op07_licenses.needed(rows, idf)
        for name in {r[0] for r in rows}:  # without a needed word no statement reaches the threshold
            assert sum(x * x for t, w, x in rows if t == name and w not in some) ** 0.5 < op07_licenses.THRESHOLD
