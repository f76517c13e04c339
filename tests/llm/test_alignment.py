"""Cross-tokenizer alignment against byte offsets and counts in plain Python, with another library's encoder for A."""

import collections
import hashlib
import os
import random

import pytest

from pkgloom.llm import op11_alignment as op

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk long, pair long, docs long, pairs long, place int"


@pytest.fixture(scope="module")
def encoders():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{op.VOCABULARIES}/{op.NAMES[0]}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{op.VOCABULARIES}/{op.NAMES[1]}")


def groups_of(encoders, text):
    """Groups ([A ids], [B ids]) by the places where tokens of both end."""
    a, b = encoders
    if not text:
        return []
    e = a.encode(f" {text}", add_special_tokens=False)
    # the byte-level alphabet, as the library's decoder sees it: one character a byte
    sizes = [[len(t) for t in e.tokens], []]
    said = b""
    for i in b.encode(text):
        raw = bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        sizes[1].append(len(raw))
        said += raw
    if said != f" {text}".encode() or sum(sizes[0]) != len(said):
        return []
    ends = [[sum(s[: k + 1]) for k in range(len(s))] for s in sizes] if len(said) < 3000 else [list(__import__("itertools").accumulate(s)) for s in sizes]
    cuts, out = sorted(set(ends[0]) & set(ends[1])), []
    ids, at = (e.ids, b.encode(text)), [0, 0]
    for c in cuts:
        upto = [__import__("bisect").bisect_right(ends[k], c) for k in (0, 1)]
        out.append(tuple(list(ids[k][at[k] : upto[k]]) for k in (0, 1)))
        at = upto
    return out


def brute(encoders, rows):
    found = [(i, groups_of(encoders, t)) for i, t in rows]
    linked = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    docs = collections.Counter(p for own in linked for p in own)
    most = collections.defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (i, g), own in zip(found, linked, strict=True):
        name = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(n for (x, y), n in own.items() if docs[x, y] == most[x])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * docs[p] for p, n in own.items()), hashlib.sha256(name.encode()).hexdigest() if g else ""))
    return sorted(map(repr, out)), docs, most


def awkward():
    rng = random.Random(6)
    odd = [None, "", " ", "\n\n\t ", "a" * 3000, " " * 3001, "<|endoftext|> <s></s><unk><0x41>", "a▁b", "\u0000x", "日本語のテキスト、漢字かな交じり文。", "🙂🙃 áé ﬁ½ Ⅷ", "naïve  çà  et là", "x\r\ny", "१२३ 123456789", "’s 's 'S don't"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(rng.randrange(400))) for _ in range(60)]
    odd += [" ".join(rng.choice("le the der un on ion heit tion ﷺ 🙂🙂 --- 3.14".split()) for _ in range(6000))]
    return [(i, t) for i, t in enumerate(odd)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None), (-5, "le the der")]


@pytest.mark.parametrize(("chunk", "piece"), [(op.CHUNK, op.PIECE_BYTES), (500, 2000)])
def test_alignment(spark, encoders, chunk, piece, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "PIECE_BYTES", piece)
    rows = awkward()
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], SCHEMA).repartition(4)
    found, counts, kept = op.align(spark, table)
    want, docs, most = brute(encoders, rows)
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert {(r["a"], r["b"]): (r["docs"], r["best"]) for r in counts.collect()} == {(x, y): (n, n == most[x]) for (x, y), n in docs.items()}
    assert chunk > 500 or kept[0].count() > 4


def test_given_documents(spark, encoders):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in op.op11_alignment(spark, SF).collect()) == brute(encoders, rows)[0]


def test_spans(spark, encoders):
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 500]
    got = op.aligned(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(repr((i, groups_of(encoders, t))) for i, t in rows)
    assert sorted(repr((r["doc_id"], [(g["a"], g["b"]) for g in r["groups"]])) for r in got) == want
    for r in got:
        at = [0, *(g["end"] for g in r["groups"])]
        assert [g["start"] for g in r["groups"]] == at[:-1]


def test_no_documents(spark):
    found, counts, _ = op.align(spark, spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and counts.count() == 0
    found, counts, _ = op.align(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(tuple(r)[:7] for r in found.collect()) == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)] and counts.count() == 0


def test_transducer(monkeypatch):
    t = op.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"abc"])
    assert t.groups([0, 1], [0, 1]) == (["0,1|0,1"], [(0, 2, 2)])
    for memo in (op.MEMO, 0):
        monkeypatch.setattr(op, "MEMO", memo)
        assert t.groups([0, 1, 3, 2], [2, 3]) == (["0,1,3|2", "2|3"], [(0, 3, 1)])
    for a, b in (([0], [0]), ([0, 3], [2]), ([2], [3, 0]), ([0, 1], [3, 3]), ([], [0]), ([1], [])):
        with pytest.raises(op.Mismatch):
            t.groups(a, b)


def test_links(encoders, monkeypatch):
    """Wide groups, and a memo that starts anew, give the same links."""
    import numpy as np

    tools = op.Tools(*op.read_vocabularies())
    texts = [t for _, t in awkward()]
    plain = op.aligned_texts(tools, texts)
    monkeypatch.setattr(op, "MEMO", 50)
    assert [(a.tolist(), *rest) for a, *rest in op.aligned_texts(tools, texts)] == [(a.tolist(), *rest) for a, *rest in plain]
    want = {}
    for d, (_, _, names, _) in enumerate(plain):
        for g in names:
            x, y = ([int(i) for i in side.split(",")] for side in g.split("|"))
            for p in x:
                for q in y:
                    want[d, p << op.SHIFT | q] = want.get((d, p << op.SHIFT | q), 0) + 1
    n = np.array([len(f[2]) for f in plain])
    for wide in (op.WIDE, 3, 1):
        monkeypatch.setattr(op, "WIDE", wide)
        ids = (np.concatenate([np.array(f[k], np.int64) for f in plain]) for k in (0, 1))
        doc, pair, times = op.links(*ids, *op.group_sizes(n, [f[3] for f in plain]), np.repeat(np.arange(len(plain)), n))
        assert {(d, p): t for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True)} == want


def test_words(encoders, monkeypatch):
    """B by words that are kept, and anew, gives the ids of whole texts."""
    tools = op.Tools(*op.read_vocabularies())
    assert tools.by_words
    rng = random.Random(12)
    some = [" ", "  ", "a", "bc ", "\n", "\t", "\u00a0", "\x1c", "\x85", "é", "日本", "1", "12", "'s", "'", ".", "🙂", "▁", "<s>", "\u3000", " the", "\r\n", "ion", " heit"]
    texts = [t for _, t in awkward() if t] + ["x" + "".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    want = encoders[1].encode(texts, num_threads=1)
    for keep in (op.WORDS, 100):
        monkeypatch.setattr(op, "WORDS", keep)
        assert [x for k in range(0, len(texts), 700) for x in tools.encode_b(texts[k : k + 700])] == want
    tools.by_words = False
    assert tools.encode_b(texts[:500]) == want[:500]


def test_encoder_for_every_character(encoders):
    """The encoder of A gives the ids of the vocabulary's own library around every character."""
    tools = op.Tools(*op.read_vocabularies())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts = [f" a{x}a {x} 1{x}1  {x}{x}!{x}! '{x}s{x}\n{x} {x}  " for x in map(chr, points[k : k + 4000])]
        assert [e.ids for e in encoders[0].encode_batch_fast(texts, add_special_tokens=False)] == [tools.a.encode_ordinary(x) for x in texts]
