"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both token rows of a text spell the same bytes. The transducer reads them side by side and knows only which side leads and
the bytes by which it does, a suffix of that side's last token. The side that lags gives the next token; when no byte dangles, a
group closes. Moves are memoised by the dangling bytes and the next token. An A and a B token of one group are linked.

How many documents hold a pair linked is counted over all documents. A task packs its documents into chunks: the distinct
pairs of the chunk with the number of its documents that hold each, and each document's links as places in that list. Only
the lists are shuffled to be summed; the sums go back to the chunks that need them, and are added up by document there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, drop, pieces, stored, table

#: Where the vocabulary files are, and their names.
VOCABULARIES, NAMES = "/opt/tokenizers", ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Distinct pairs of documents, summed over them, in a chunk, about; it bounds a task's memory.
CHUNK = 3_000_000
#: A chunk's distinct pairs that are shuffled as one batch.
BATCH = 100_000
#: Moves, and words with their B ids, that are kept before the memos start anew.
MEMO, WORDS = 2_000_000, 600_000
#: Groups with more links than this count their distinct tokens first.
WIDE = 4_096
#: Bits of a B id in a pair.
SHIFT = 20

# fixed value: how the byte-level vocabulary cuts text into words
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Mismatch(ValueError):
    """The two rows of tokens spell different bytes."""


# ---- vocabularies


def read_vocabularies(folder: str = VOCABULARIES, names: tuple[str, str] = NAMES) -> tuple[bytes, bytes]:
    """The two files, of a fixed size of some MB, which tasks get by broadcast."""
    out = []
    for name in names:
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return tuple(out)


def byte_level(vocabulary: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Bytes that print stand for themselves, others for the next characters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    known = json.loads(vocabulary)["model"]["vocab"]
    out = [b""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = bytes(byte_of[c] for c in piece)
    return out


class Tools:
    """The encoders A and B of a task, and their tokens' bytes."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece
        import tiktoken

        self.a_bytes = byte_level(vocabulary)
        self.a = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        #: without a piece that has a space after another character, B's tokens of a word don't depend on the words beside it
        self.by_words = all("▁" not in p.lstrip("▁") for p in piece)
        self.words: dict[str, tuple[int, ...]] = {}
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """B ids of each text. Words between single spaces are encoded once and kept, as B puts a space before each by itself;
        texts with other spaces, or B's sign for one, are encoded whole."""
        cut = [t.split(" ") for t in texts]
        whole = [i for i, words in enumerate(cut) if not self.by_words or "" in words or "▁" in texts[i]]
        out = dict(zip(whole, self.b.encode([texts[i] for i in whole], num_threads=1), strict=True)) if whole else {}
        own = set().union(*(words for i, words in enumerate(cut) if i not in out))
        new = [w for w in own if w not in self.words]
        self.words.update(zip(new, map(tuple, self.b.encode(new, num_threads=1) if new else []), strict=True))
        known = self.words
        found = [out[i] if i in out else list(chain.from_iterable([known[w] for w in words])) for i, words in enumerate(cut)]
        if len(known) > WORDS:
            self.words = {}
        return found

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[int]]]:
        """A ids and B ids of each text with a space before it; none where the text is null or empty, or A spells other bytes."""
        full = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        out: list[tuple[np.ndarray, list[int]]] = [(none, [])] * len(texts)
        for i, b in zip(full, self.encode_b([texts[i] for i in full]), strict=True):
            text = f" {texts[i]}"
            a = self.a.encode_to_numpy(text, disallowed_special=())
            # tokens are pieces of the text in order, so they spell it if they are as long
            if self.a_sizes[a].sum() == len(text.encode()):
                out[i] = (a, b)
        return out


@lru_cache(maxsize=1)
def _tools(vocabulary: bytes, model: bytes) -> Tools:
    return Tools(vocabulary, model)


# ---- the transducer


class Transducer:
    """States are numbers: 0 nothing dangles, above 0 A leads, below 0 B leads."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self._forget()

    def _forget(self) -> None:
        #: state and next token (of the side that lags): state
        self.moves: dict[int, int] = {}
        #: A and B token where nothing dangles: state, or the closed group's name
        self.pairs: dict[int, int | str] = {}
        self.states: dict[tuple[bool, bytes], int] = {}
        self.dangling: list[bytes] = [b""]

    def _state(self, a_leads: bool, rest: bytes) -> int:
        if not rest:
            return 0
        if (a_leads, rest) not in self.states:
            self.states[a_leads, rest] = len(self.dangling) * (1 if a_leads else -1)
            self.dangling.append(rest)
        return self.states[a_leads, rest]

    def _moved(self, a_leads: bool, rest: bytes, token: bytes) -> int:
        """The state after the side that lags gives token."""
        if rest.startswith(token):
            return self._state(a_leads, rest[len(token) :])
        if token.startswith(rest):
            return self._state(not a_leads, token[len(rest) :])
        raise Mismatch

    def _pair(self, a: int, b: int) -> int | str:
        state = self._moved(True, self.a_bytes[a], self.b_bytes[b])
        self.pairs[a << SHIFT | b] = state or f"{a}|{b}"
        return self.pairs[a << SHIFT | b]

    def _move(self, state: int, token: int) -> int:
        a_leads = state > 0
        self.moves[state << SHIFT | token] = out = self._moved(a_leads, self.dangling[abs(state)], (self.b_bytes if a_leads else self.a_bytes)[token])
        return out

    def groups(self, a: list[int], b: list[int]) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The groups' names `a1,a2|b1` in order, and which of them have more than one A or B token (number, A tokens, B
        tokens); Mismatch if a and b spell different bytes."""
        if len(self.moves) + len(self.pairs) > MEMO:
            self._forget()
        pairs, moves, names, wide = self.pairs, self.moves, [], []
        next_a, next_b = iter(a), iter(b)
        try:
            for x, y in zip(next_a, next_b, strict=True):
                try:
                    state = pairs[x << SHIFT | y]
                except KeyError:
                    state = self._pair(x, y)
                if state.__class__ is str:
                    names.append(state)
                    continue
                own_a, own_b = [x], [y]
                while state:
                    if state > 0:
                        token = next(next_b)
                        own_b.append(token)
                    else:
                        token = next(next_a)
                        own_a.append(token)
                    try:
                        state = moves[state << SHIFT | token]
                    except KeyError:
                        state = self._move(state, token)
                wide.append((len(names), len(own_a), len(own_b)))
                names.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
        except (StopIteration, ValueError):
            # one side ends before the other, or a Mismatch, which is a ValueError
            raise Mismatch from None
        return names, wide


# ---- links of documents


def group_sizes(n_groups: np.ndarray, wide: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens of each group of the documents, one after the other."""
    p, q = np.ones(n_groups.sum(), np.int64), np.ones(n_groups.sum(), np.int64)
    if some := [np.array(w) + (at, 0, 0) for w, at in zip(wide, np.cumsum(n_groups) - n_groups, strict=True) if w]:
        at, p_wide, q_wide = np.concatenate(some).T
        p[at], q[at] = p_wide, q_wide
    return p, q


def links(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each document (document, pair, times linked), sorted; p and q are the groups' sizes, doc whose they
    are. At most 2^23 documents."""
    at_a, at_b, n = np.cumsum(p) - p, np.cumsum(q) - q, p * q
    one, some = np.flatnonzero(n == 1), np.flatnonzero((n > 1) & (n <= WIDE))
    # groups of one token each; all pairs of tokens of larger ones; of the largest, the pairs of distinct tokens
    keys = [doc[one] << 40 | a[at_a[one]] << SHIFT | b[at_b[one]]]
    group = np.repeat(some, n[some])
    i, j = np.divmod(np.arange(len(group)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]), q[group])
    keys.append(doc[group] << 40 | a[at_a[group] + i] << SHIFT | b[at_b[group] + j])
    key = np.sort(np.concatenate(keys))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, times = key[head], np.diff(np.append(head, len(key)))
    if len(most := np.flatnonzero(n > WIDE)):
        keys, many = [key], [times]
        for g in most:
            x, nx = np.unique(a[at_a[g] : at_a[g] + p[g]], return_counts=True)
            y, ny = np.unique(b[at_b[g] : at_b[g] + q[g]], return_counts=True)
            keys.append((doc[g] << 40 | x[:, None] << SHIFT | y[None, :]).ravel())
            many.append(np.outer(nx, ny).ravel())
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, place, np.concatenate(many))
    return key >> 40, key & ((1 << 40) - 1), times


def _pack(values: np.ndarray, kind=np.uint32) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 1)


def _unpack(raw: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind).astype(np.int64)


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.int64())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("pairs", pa.binary()), ("held", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
_CHUNK_DDL = "chunk long, pairs binary, held binary, docs binary, places binary, times binary"


def _chunk(number: int, docs: list[dict], pair: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    """A chunk's row: its distinct pairs (steps of the sorted list), how many documents hold each, the documents, and their
    pairs as steps through places in the list."""
    own = np.concatenate([np.zeros(0, np.int64), *pair])
    known, place, held = np.unique(own, return_inverse=True, return_counts=True)
    sizes = np.array([len(p) for p in pair], np.int64)
    step = np.diff(place, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[first] = place[first]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS) as out:
        out.write_table(pa.Table.from_pylist(docs, schema=_DOCS))
    row = {"chunk": number, "pairs": _pack(np.diff(known, prepend=0), np.int64), "held": _pack(held), "docs": zstandard.compress(sink.getvalue().to_pybytes(), 1), "places": _pack(step), "times": _pack(np.concatenate([np.zeros(0, np.int64), *times]))}
    return pa.RecordBatch.from_pylist([row], schema=_CHUNK)


def aligned_texts(tools: Tools, texts: list[str | None]) -> list[tuple[np.ndarray, list[int], list[str], list[tuple[int, int, int]]]]:
    """A ids, B ids, and of the transducer the groups' names and which are wide; all empty for a text without tokens."""
    out = []
    for a, b in tools.encode(texts):
        try:
            out.append((a, b, *tools.transducer.groups(a.tolist(), b)))
        except Mismatch:
            out.append((a[:0], [], [], []))
    return out


def chunks(docs: DataFrame, vocabularies: Broadcast) -> DataFrame:
    """docs (doc_id, text) as rows of chunks; a piece of the texts is aligned at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number = _tools(*vocabularies.value), TaskContext.get().partitionId() << 32
        rows, pair, times, size = [], [], [], 0
        for batch in batches:
            for some, _, _ in pieces(batch, "text", PIECE_BYTES):
                found = aligned_texts(tools, some.column(1).to_pylist())
                n_groups = np.array([len(f[2]) for f in found], np.int64)
                doc = np.repeat(np.arange(len(found)), n_groups)
                ids = (np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in (0, 1))
                which, own, many = links(*ids, *group_sizes(n_groups, [f[3] for f in found]), doc)
                edge = np.searchsorted(which, np.arange(len(found) + 1))
                for k, (doc_id, f) in enumerate(zip(some.column(0).to_pylist(), found, strict=True)):
                    mine = slice(edge[k], edge[k + 1])
                    pair.append(own[mine])
                    times.append(many[mine])
                    name = hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f[2] else ""
                    rows.append({"doc_id": doc_id, "n_a": len(f[0]), "n_b": len(f[1]), "n_groups": len(f[2]), "n_links": int(many[mine].sum()), "groups_sha256": name, "pairs": len(pair[-1])})
                size += len(own)
                if size >= CHUNK:
                    yield _chunk(number, rows, pair, times)
                    rows, pair, times, size, number = [], [], [], 0, number + 1
        if rows:
            yield _chunk(number, rows, pair, times)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK_DDL)


# ---- counts over all documents


def listed(cut: DataFrame) -> DataFrame:
    """(chunk, place, pair, held) of every distinct pair of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, held = np.cumsum(_unpack(raw, np.int64)), _unpack(held)
                for at in range(0, len(pair), BATCH):
                    n = len(pair[at : at + BATCH])
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(n, chunk)), "place": pa.array(np.arange(at, at + n, dtype=np.int32)), "pair": pa.array(pair[at : at + n]), "held": pa.array(held[at : at + n])})

    return cut.select("chunk", "pairs", "held").mapInArrow(run, "chunk long, place int, pair long, held long")


def pair_counts(cut: DataFrame) -> DataFrame:
    """(a, b, pair, docs, best): how many documents hold the pair linked, and whether no pair of its A id is in more."""
    counts = listed(cut).groupBy("pair").agg(F.sum("held").alias("docs")).withColumn("a", F.shiftright("pair", SHIFT).cast("int"))
    # an A id meets each B id once at most
    most = F.max("docs").over(W.partitionBy("a"))
    return counts.select("a", F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "pair", "docs", (F.col("docs") == most).alias("best"))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of the chunks with what the counts of their links add up to."""

    def one(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            raise ValueError("counts of a chunk that is not there")
        row, known = own.iloc[0], known.sort_values("place")
        docs = pa.ipc.open_stream(zstandard.decompress(row["docs"])).read_all().to_pandas()
        sizes = docs.pop("pairs").to_numpy(np.int64)
        step, times = _unpack(row["places"]), _unpack(row["times"])
        first = np.cumsum(sizes) - sizes
        whole = np.cumsum(step)
        # steps begin anew in each document
        before = np.repeat(np.where(first > 0, np.append(0, whole)[first], 0), sizes)
        place = whole - before
        upto_best = np.append(0, np.cumsum(times * known["best"].to_numpy(bool)[place])) if len(place) else np.zeros(1, np.int64)
        upto_docs = np.append(0, np.cumsum(times * known["docs"].to_numpy(np.int64)[place])) if len(place) else np.zeros(1, np.int64)
        docs["n_best"], docs["count_sum"] = (u[first + sizes] - u[first] for u in (upto_best, upto_docs))
        docs["doc_id"] = docs["doc_id"].astype("Int64")
        return docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    needs = listed(cut).select("chunk", "place", "pair").join(counts.select("pair", "docs", "best").hint("merge"), "pair").select("chunk", "place", "docs", "best")
    return cut.select("chunk", "docs", "places", "times").groupBy("chunk").cogroup(needs.groupBy("chunk")).applyInPandas(one, _RESULT)


def align(spark: SparkSession, docs: DataFrame, folder: str = VOCABULARIES, names: tuple[str, str] = NAMES) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One row for each row of docs (doc_id, text), pair_counts(), and the stored tables that both read.

    Texts that are null or empty, or that a tokenizer spells in other bytes, have no tokens: zeros and an empty digest. Each
    text is encoded whole. Rows that repeat an id, or have none, are rows like others; an empty table gives no rows; other columns are not read.
    """
    cut = stored(spark, chunks(docs, spark.sparkContext.broadcast(read_vocabularies(folder, names))))
    counts = stored(spark, pair_counts(cut))
    return scored(cut, counts), counts, [cut, counts]


_GROUPS = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"


def aligned(spark: SparkSession, docs: DataFrame, folder: str = VOCABULARIES, names: tuple[str, str] = NAMES) -> DataFrame:
    """The groups of each text: where they begin and end in its bytes (a space goes before the text, at byte 0), and their A and B ids."""
    vocabularies = spark.sparkContext.broadcast(read_vocabularies(folder, names))
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(group))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(*vocabularies.value)
        for batch in batches:
            for some, _, _ in pieces(batch, "text", PIECE_BYTES):
                out = []
                for doc_id, (a, b, names, wide) in zip(some.column(0).to_pylist(), aligned_texts(tools, some.column(1).to_pylist()), strict=True):
                    found, start, i, j, sizes = [], 0, 0, 0, {g: (p, q) for g, p, q in wide}
                    for g in range(len(names)):
                        p, q = sizes.get(g, (1, 1))
                        end = start + sum(len(tools.a_bytes[x]) for x in a[i : i + p])
                        found.append({"start": start, "end": end, "a": a[i : i + p].tolist(), "b": b[j : j + q]})
                        start, i, j = end, i + p, j + q
                    out.append({"doc_id": doc_id, "groups": found})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _GROUPS)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, kept = align(spark, table(spark, sf_dir, "documents"))
    out = stored(spark, found)
    drop(*kept)
    return out
