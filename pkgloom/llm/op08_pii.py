"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field, trained on the small labelled table below, tags the words of a text and
adds spans of kinds that it knows where no base span lies: addresses, numbers and names in forms that the patterns do
not take. Every line of a text is one chain, decoded whole, whatever its length. A word's features depend on the word and
its neighbours alone, so each different word is weighed once; where no span can outweigh plain words the best path is
known to be plain, and Viterbi runs, in numpy batches, over the stretches between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, pieces, runs, table

#: Bytes of words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
KINDS = ("email", "ip", "card", "phone", "name")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive where giving back digits cannot help, so that long runs of digits cost no more than their length
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @, so that long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as listed, end) of the patterns' matches that hold, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


#: The labelled table: words of a sentence, those of a span between [kind and ].
LABELLED = """
write to [email anna.berg at mail.example.org ] for details
send it to [email j_doe (at) example.net ] today
contact [email info [at] firma.example.de ] or call
mail [email max.muster@localhost ] please
IT WAS AT HOME AND ON THE WAY
token = "db561b7668c4feec1c529" Words come next
say token = "976d63bcc718c8af69164ec84259a9ab832af580" Other of it
call [phone 555-0134 ] now
call me on [phone (555) 010-9988 ] after five
tel [phone 020 7946 0018 ] or come by
phone: [phone 030-901820 ] ask for her
fax [phone 555.010.7788 ] works too
ring [phone 01632 960 123 ] tonight
the host [ip 2001:db8::ff00:42:8329 ] did not answer
ping [ip fe80::1ff:fe23:4567:890a ] first
server [ip 2001:db8:85a3::8a2e:370:7334 ] is down
card [card 4111/1111/1111/1111 ] was used
pay with [card 5500.0000.0000.0004 ] please
Mr. [name John Smith ] came home
Mrs. [name Mary Jones ] and the dog
Dr. [name Anna Berg ] said so
my name is [name Peter Miller ] and I agree
name: [name Clara Weiss ] signed here
Ms. [name Lena Roth ] wrote the text
dear Mr. [name Brown ] thank you
Mr. [name Alexander Hoffmann ] and others
my name is [name Christopher Lee ] and so on
Mrs. [name Katharina Rodriguez ] came late
the price was 12.50 and then 13.00 again
in 1998 and 2004 there were 12 of them
version 2.0 of the licence was out in 2004
see page 12 and table 3.1 for the 25 rows
it is 10:30 now and 11:45 then
about 1,000 people and 25,000 more came
from 3 to 5 of the 10 were here
chapter 1.2.3 and part 4.5.6 of it
on 2021-03-04 or 04.03.2021 it rained
sold 100% of 20 units at $15 each
token = "87e15d78b9d8ef29b6c1" was read
key 3e5cb3f9186ce4f749644b4847d287be is set
id 4670349892180623 and 12345678 were there
the number 6571637841803456 is not one
look at the sky and at the sea
they met at home at night
thanks to all of them for this
@user said so and @other did not
The Mr. and the name of it
score 3-2 and 10-8 in 2 games
From then on. They met in 1998
It was so. Nobody There had 12 of them
The number 12345678 Theme was in
At. Then Other came of 25
And. Nothing Else came at 10:30
In the end. Most Of Them left 3 of it
5077083268371396 Table One was there
On Monday. Some Went to 7 of them
Chapter. Summary then 40 more
87e15d78b9d8ef29b6c1 Print of the
Das ist so. Eine Zahl wie 238
Les Autres. Elle Avait 25 ans
met at The Hague with 12 men
then At Noon the 3 came
The End. Appendix
Contents. Introduction
Yes. Thanks
Summary. Overview of it
Preface. Thanks to all
Überblick. Einleitung
Paris. Évry
Monday. Tuesday then
There. Somewhere near
Seven. Eight and nine
House. Gardens and a wall
Water. Electricity
Green. Yellow
Today. Tomorrow we go
Where. Nowhere
Los Otros fueron at the sea
It rained. Then It Stopped and all went home
Many Of The Rules Were Changed that year
We said: Yes, and the answer was No
room 101-102 is at the end
a1 b2 c3 and x86 or h264
"""

_LEFT, _RIGHT = "\"'<{|", "\"'>}|,;.!?:*#$%&"
_CUES = frozenset("mr. mrs. ms. dr. name name: is at (at) [at] mail tel phone phone: call fax ring card host server ping".split())
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


class _Shapes(dict):
    """Of each character X, x or d for letters and digits, others as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        return out


_SHAPES = _Shapes()


def shape(word: str) -> str:
    """X, x and d for letters and digits, other characters as they are; runs of up to four kept."""
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", word.translate(_SHAPES))


def core(token: str) -> tuple[str, int, int]:
    """A token without the marks around it, and where that begins and ends in it."""
    a, b = 0, len(token)
    while b - a > 1 and token[a] in _LEFT:
        a += 1
    end = b
    while b - a > 1 and token[b - 1] in _RIGHT:
        b -= 1
    if token[a : b + 1].lower() in _CUES:
        b = min(b + 1, end)
    return token[a:b], a, b


def _key(token: str) -> tuple[str, str]:
    """What a token's features depend on: its shape, and itself where it is a cue."""
    low = core(token)[0].lower() if len(token) < 12 else ""
    return token.translate(_SHAPES), low if low in _CUES else ""


def _about(token: str) -> list[str]:
    word, _, b = core(token)
    s = shape(word)
    digits = sum(c.isdigit() for c in word)
    low = word.lower()
    out = [f"s={s}", f"r={re.sub(r'(.)\1+', r'\1', s)}", f"d={min(digits, 8) if digits < 9 else '9-11' if digits < 12 else '12-19' if digits < 20 else '20+'}"]
    out += [f"c={c}" for c in "@:./-()" if c in word]
    out += [f"w={low}"] if low in _CUES else []
    out += ["stop"] if {*token[b:]} & {*".!?"} else []
    out += ["title"] if s[:1] == "X" and s[1:].strip("x+") == "" and len(s) > 1 else []
    return out


def word_features(tokens: list[str]) -> list[list[str]]:
    own = [_about(w) for w in tokens]
    edge = ["edge"]
    return [["1", *own[i], *(f"-{f}" for f in (own[i - 1] if i else edge)), *(f"+{f}" for f in (own[i + 1] if i + 1 < len(own) else edge))] for i in range(len(tokens))]


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.strip().split("\n"):
        words, tags, kind, first = [], [], None, False
        for w in line.split():
            if w[0] == "[" and w[1:] in KINDS:
                kind, first = w[1:], True
            elif w == "]":
                kind = None
            else:
                words.append(w)
                tags.append(TAGS.index(f"{'B' if first else 'I'}-{kind}") if kind else 0)
                first = False
        out.append((words, tags))
    return out


class Field:
    """Weights by feature and tag, and between tags; a feature that training did not see has none."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, step: np.ndarray):
        self.index, self.weight, self.step = index, weight, step
        allowed = np.where(step > -30, step, -np.inf) - step[0, 0]
        #: The most that a step within a span gains over one between plain words, and that its way in and out does.
        self.within = float(allowed[1:, 1:].max())
        self.around = max(0.0, float(allowed[0, 1:].max())) + max(0.0, float(allowed[1:, 0].max()))

    def of_token(self, token: str) -> np.ndarray:
        """What a token adds to the tags of itself, of the next one and of the one before."""
        about = _about(token)
        return np.array([self.weight[[self.index[f] for f in fs if f in self.index]].sum(0) for fs in (["1", *about], [f"-{f}" for f in about], [f"+{f}" for f in about])])

    def emit(self, table: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores by tag of the tokens which, rows of table (of_token()), in chains that begin where first says."""
        last = np.r_[first[1:], True]
        e = table[which, 0]
        e[1:] += np.where(first[1:, None], 0.0, table[which[:-1], 1])
        e[:-1] += np.where(last[:-1, None], 0.0, table[which[1:], 2])
        for edge, name in ((first, "-edge"), (last, "+edge")):
            if name in self.index:
                e[edge] += self.weight[self.index[name]]
        e[first, 2::2] -= 30  # an I can't come first
        return e

    def open_words(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where a tag other than O is possible on the best path: a span there could outweigh plain words.

        A span gains at most what its words do, with a step between each two and the way in and out; the most that a span
        through a word gains is the largest run of gains that ends there plus the largest that begins there.
        """
        gain = e[:, 1:].max(1) - e[:, 0] + self.within
        # taken off between two chains, so that no run goes on over it
        drop = 1.0 + np.add.reduceat(np.maximum(gain, 0), np.flatnonzero(first)).max()

        def ending(g: np.ndarray, begins: np.ndarray) -> np.ndarray:
            total = np.cumsum(g - drop * begins)
            return total - np.minimum.accumulate(total - g)

        right = ending(gain[::-1], np.r_[first[1:], True][::-1])[::-1]
        return ending(gain, first) + right - gain + self.around - self.within > -1e-4

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tag of every word."""
        out = np.zeros(len(e), np.int64)
        if not len(e):
            return out
        active = self.open_words(e, first)
        new = active & np.r_[True, ~active[:-1] | first[1:]]
        start = np.flatnonzero(new)
        end = np.flatnonzero(active & np.r_[~active[1:] | first[1:], True]) + 1
        length = end - start
        after = np.r_[first[1:], True][end - 1]  # a stretch that ends its chain is followed by nothing, else by O
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            some = order[at : at + max(1, min(512, (1 << 16) // max(1, length[order[min(len(order), at + 512) - 1]])))]
            at += len(some)
            self._viterbi(e, start[some], length[some], first[start[some]], after[some], out)
        return out

    def _viterbi(self, e: np.ndarray, start: np.ndarray, length: np.ndarray, opens: np.ndarray, closes: np.ndarray, out: np.ndarray) -> None:
        """Best tags of the stretches of e, which stand between words of tag O or at an end of their chain."""
        best = e[start] + np.where(opens[:, None], 0.0, self.step[0])
        back = np.zeros((length.max(), len(start), len(TAGS)), np.int8)
        for t in range(1, length.max()):
            all_steps = best[:, :, None] + self.step
            back[t] = all_steps.argmax(1)
            best = np.where((t < length)[:, None], all_steps.max(1) + e[np.minimum(start + t, start + length - 1)], best)
        tag = (best + np.where(closes[:, None], 0.0, self.step[:, 0])).argmax(1)
        for t in range(length.max() - 1, -1, -1):
            here = t < length
            out[start[here] + t] = tag[here]
            tag = np.where(here, back[t, np.arange(len(start)), tag], tag)


def train(rounds: int = 200, l2: float = 0.02) -> Field:
    """Adam on the log likelihood of the labelled table, by forward-backward; the same weights each time."""
    rows = [(word_features(w), t) for w, t in labelled()]
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in rows for x in fs for f in x}))}
    n, t_max, k = len(rows), max(len(t) for _, t in rows), len(TAGS)
    x, mask, y = np.zeros((n, t_max, len(index))), np.zeros((n, t_max), bool), np.zeros((n, t_max), np.int64)
    for i, (fs, tags) in enumerate(rows):
        mask[i, : len(tags)], y[i, : len(tags)] = True, tags
        for t, f in enumerate(fs):
            x[i, t, [index[z] for z in f]] = 1
    flat_x, truth = x[mask], np.eye(k)[y[mask]]
    both = mask[:, 1:] & mask[:, :-1]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    # an I needs its B or I before it
    barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in TAGS] for a in TAGS])
    par = [np.zeros((len(index), k)), np.zeros((k, k))]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis, keepdims=True)
        return np.log(np.exp(z - top).sum(axis)) + top.squeeze(axis)

    for r in range(1, rounds + 1):
        step = np.where(barred, -30.0, par[1])
        e = np.zeros((n, t_max, k))
        e[mask] = flat_x @ par[0]
        e[:, 0, [TAGS.index(t) for t in TAGS if t[0] == "I"]] -= 30
        a, b = e.copy(), np.zeros_like(e)
        for t in range(1, t_max):
            a[:, t] = np.where(mask[:, t, None], lse(a[:, t - 1, :, None] + step, 1) + e[:, t], a[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], lse(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(a[:, -1], 1)
        node = np.exp(a + b - z[:, None, None])[mask]
        edge = np.zeros((k, k))
        for t in range(1, t_max):
            p = np.exp(a[:, t - 1, :, None] + step + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            edge += p[mask[:, t]].sum(0)
        grads = [flat_x.T @ (node - truth) + l2 * par[0], np.where(barred, 0, edge - pairs) + l2 * par[1]]
        for p, g, mm, vv in zip(par, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            p -= 0.05 * (mm / (1 - 0.9**r)) / (np.sqrt(vv / (1 - 0.999**r)) + 1e-8)
    return Field(index, par[0], np.where(barred, -30.0, par[1]))


#: Different words that are known between batches, and words that are decoded at once (or one line, if it has more).
WORDS_KEPT, BLOCK = 500_000, 1 << 18


class Reader:
    """The field's spans of texts as flat bytes; each different word is looked at once."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[int, int] = {}
        self.keys: dict[tuple[str, str], int] = {}
        self.table = np.zeros((0, 3, len(TAGS)))
        self.trims = np.zeros((0, 2), np.int64)

    def _look_up(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of the table of each word."""
        key, at, inverse = np.unique(SpanHash(raw)(start, end), return_index=True, return_inverse=True)
        if len(self.known) > WORDS_KEPT:
            self.__init__(self.field)
        new, trims = [], []
        for k, i in zip(key.tolist(), at.tolist(), strict=True):
            if k not in self.known:
                token = raw[start[i] : end[i]].tobytes().decode("utf-8", "replace")
                known = _key(token)
                if known not in self.keys:
                    _, a, b = core(token)
                    self.keys[known] = len(self.keys)
                    new.append(self.field.of_token(token))
                    trims.append((a, len(token) - b))
                self.known[k] = self.keys[known]
        if new:
            self.table, self.trims = np.concatenate([self.table, new]), np.concatenate([self.trims, trims])
        return np.array([self.known[k] for k in key.tolist()], np.int64)[inverse]

    def spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, kind and end (code points of the row) of the spans, in order."""
        start, end = runs(NOT_SPACE[raw], at)
        if not len(start):
            return tuple(np.zeros((4, 0), np.int64))
        row = np.searchsorted(at, start, "right") - 1
        lines = np.cumsum(raw == 10)[start]
        first = np.r_[True, (row[1:] != row[:-1]) | (lines[1:] != lines[:-1])]
        which = self._look_up(raw, start, end)
        heads, tags, i = np.r_[np.flatnonzero(first), len(first)], np.zeros(len(first), np.int8), 0
        while i < len(first):
            j = max(int(heads[np.searchsorted(heads, i + BLOCK, "right") - 1]), int(heads[np.searchsorted(heads, i, "right")]))
            tags[i:j] = self.field.decode(self.field.emit(self.table, which[i:j], first[i:j]), first[i:j])
            i = j
        point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        begin = np.flatnonzero(tags % 2 == 1)
        # a span goes on over the I tags behind its B
        stop = np.flatnonzero(np.r_[(tags % 2 == 1) | (tags == 0), True])
        last = stop[np.searchsorted(stop, begin, "right")] - 1
        base = point[at[:-1]][row[begin]]
        return row[begin], point[start[begin]] + self.trims[which[begin], 0] - base, (tags[begin] - 1) // 2, point[end[last]] - self.trims[which[last], 1] - base


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of spans (start, kind, end) that touch no base span; base is sorted."""
    starts = np.array([x[0] for x in base], np.int64)
    reach = np.maximum.accumulate(np.array([0, *(x[2] for x in base)], np.int64))
    return [x for x in spans if reach[np.searchsorted(starts, x[2], "left")] <= x[0]]


def found_spans(raw: np.ndarray, at: np.ndarray, reader: Reader) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans with the field's added where they touch no base span."""
    extra: list[list[tuple[int, int, int]]] = [[] for _ in at[1:]]
    for i, a, k, b in zip(*(x.tolist() for x in reader.spans(raw, at)), strict=True):
        extra[i].append((a, k, b))
    base = [base_spans(raw[i:j].tobytes().decode("utf-8", "replace")) for i, j in zip(at[:-1], at[1:], strict=True)]
    return [(b, sorted({*b, *apart(e, b)})) for b, e in zip(base, extra, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(spark: SparkSession, docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data of each row of docs (doc_id, text); spans in code points, end exclusive.

    Null counts as empty and has none; rows that repeat are read alike; empty tables are fine, and other columns are not
    read. Only the trained weights travel to the tasks.
    """
    weights = spark.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights.value)
        for batch in batches:
            for part, raw, at in pieces(batch, "text"):
                got = found_spans(raw, at, reader)
                out = {"doc_id": part.column(0)}
                out |= {f"n_{KINDS[j]}": pa.array([sum(s[1] == j for s in b) for b, _ in got], pa.int64()) for j in range(4)}
                out |= {"base_sha256": pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()), "spans": pa.array([written(a) for _, a in got], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, table(spark, sf_dir, "documents"))
