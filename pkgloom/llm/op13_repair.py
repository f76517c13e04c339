"""Repair of conversation structure by signature deduplication.

Every conversation becomes a compact string, its signature: one letter for each turn, which says the role and the fault.
Each distinct signature is solved once, by memoised recursion over its suffixes; the audits are joined back to the
conversations that have the signature, and their edits are replayed on the turns.

Roles alternate as `(s?(ua)+)?` after the repair (s system, u user, a assistant). A blank turn, and one whose role and text
came before, must go; one whose text breaks off may stay at a price. Edits: K keep, R give the other role, D delete,
I insert an empty turn. Of the cheapest audits the least by its letters is taken.

Texts are shuffled once, for the replay; what is counted, ordered and solved holds digests in place of texts. A long
conversation is cut over tasks, in segments of at most SEGMENT rows; only its signature, a byte a turn, comes to one place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_skewed, stored, table

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a segment.
SEGMENT = 4096
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What a turn that breaks off costs if it stays.
CUT = 5
#: Before the first turn, after a system turn, a user turn and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 40


# ---- one signature


def _inserted(base: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    """The best choice of each state, if turns may be inserted before; two in a row lead back to the state."""
    return tuple(min(own, *((base[_NEXT[s]][0] + COST["I"], "I"), (base[_NEXT[_NEXT[s]]][0] + 2 * COST["I"], "I"))) for s, own in enumerate(base))


@lru_cache(maxsize=100_000)
def _step(letter: str, tail: tuple[int, ...]) -> tuple[tuple[int, ...], str, int]:
    """From the costs of what follows a turn, by state: the costs from the turn on, the first edits, and what was taken off the costs."""
    base, role, more = [], letter.lower(), CUT if letter.isupper() else 0
    for state in range(4):
        ways = [(COST["D"] + tail[state], "D")]
        if letter != "x":
            after = SYSTEM if state == START and role == "s" else _NEXT[state] if role == "sua"[_NEXT[state] - 1] else None
            if after is not None:
                ways.append((more + tail[after], "K"))
            ways.append((COST["R"] + more + tail[_NEXT[state]], "R"))
        base.append(min(ways))
    best = _inserted(base)
    off = min(c for c, _ in best)
    return tuple(c - off for c, _ in best), "".join(e for _, e in best), off


@lru_cache(maxsize=10_000)
def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of a signature: letters s, u, a, o (another role), capital where the turn breaks off, x where it must go.

    best(i) = _step(letter i, best(i + 1)) is memoised by its arguments, which are few: costs count from the least one. The
    recursion is unrolled from the end, so that a long signature needs no deep stack.
    """
    last = _inserted([(0, ""), (_FAR, ""), (_FAR, ""), (0, "")])
    costs, total, edits = tuple(c for c, _ in last), 0, ["".join(e or "." for _, e in last)]
    for letter in reversed(signature):
        costs, own, off = _step(letter, costs)
        total += off
        edits.append(own)
    total += costs[START]
    audit, state = [], START
    for i, letter in enumerate([*signature, ""]):
        own = edits[len(signature) - i]
        while own[state] == "I":
            audit.append("I")
            state = _NEXT[state]
        if letter:
            audit.append(own[state])
            if own[state] != "D":
                state = SYSTEM if state == START and own[state] == "K" and letter in "sS" else _NEXT[state]
    return total, "".join(audit)


# ---- turns to signatures


def faulty(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, n copies) with what is ordered and solved in place of the text: known (the turn has a
    number), digest (of role and text), letter (no repeats seen yet), cut and blank."""
    rest = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    blank, cut = rest == "", ~F.substring(rest, -1, 1).isin(".", "!", "?")
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(blank, "x").when(cut, F.upper(plain)).otherwise(plain)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return turns.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", digest.alias("digest"), letter.alias("letter"), blank.alias("blank"), "n", "text")


_KEY = ["conv_id", "known", "turn", "role", "digest"]
_ENTRY = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("n", pa.int64())])
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("signature", pa.string()), ("entries", pa.list_(_ENTRY)), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
])
_SEGMENT_DDL = (
    "conv_id long, part int, seg int, signature string, entries array<struct<turn:long,role:string,digest:binary,n:long>>, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, low long, high long, turns long"
)


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _segment(conv, part: int, seg: int, rows: list[tuple]) -> dict:
    """The segment of sorted rows (turn, role, digest, letter, blank, n, first)."""
    letters, counts, roles, illegal, before = [], {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0, None
    for _, role, _, letter, blank, n, first in rows:
        if not n:
            continue
        fine = 0 if blank or not first else 1
        letters.append((letter if fine else "") + "x" * (n - fine))
        counts["blank" if blank else "duplicate"] += n - fine
        counts["truncated"] += fine * letter.isupper()
        roles.append(role[:1])
        illegal += (before is not None and not _legal(before + role[:1])) + (n - 1) * (not _legal(2 * role[:1]))
        before = role[:1]
    turns = [r[0] for r in rows if r[5] and r[0] is not None]
    entries = [{"turn": r[0], "role": r[1], "digest": r[2], "n": r[5]} for r in rows if r[5]]
    ends = {"head": roles[0] if roles else None, "tail": roles[-1] if roles else None, "low": min(turns, default=None), "high": max(turns, default=None)}
    return {"conv_id": conv, "part": part, "seg": seg, "signature": "".join(letters), "entries": entries, "illegal": illegal, "turns": len(set(turns))} | counts | ends


def segments(turns: DataFrame) -> DataFrame:
    """The conversations of turns in order, cut into segments; rows with no copies leave their conversation an empty one."""
    rows = faulty(turns).drop("text").groupBy(*_KEY, "letter", "blank").agg(F.sum("n").alias("n"))
    # a role and text at several turns: all but the first are repeats
    again = rows.where("n > 0").groupBy("conv_id", "digest").agg(F.min(F.struct("known", "turn")).alias("at"), F.count("*").alias("c")).where("c > 1")
    again = again.select(F.col("conv_id").alias("c_id"), F.col("digest").alias("c_digest"), "at")
    rows = rows.join(again.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest")), "left")
    rows = rows.withColumn("first", F.col("at").isNull() | (F.struct("known", "turn") == F.col("at")))
    rows = rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, seg, held, out = TaskContext.get().partitionId(), None, -1, [], []
        for batch in batches:
            for i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (i != conv or len(held) == SEGMENT):
                    out.append(_segment(conv, part, seg, held))
                    held = []
                if not held:
                    conv, seg = i, seg + 1
                held.append(tuple(row))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)
                    out = []
        if held:
            out.append(_segment(conv, part, seg, held))
        yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)

    return rows.select("conv_id", "turn", "role", "digest", "letter", "blank", "n", "first").mapInArrow(run, _SEGMENT_DDL)


def conversations(cut: DataFrame) -> DataFrame:
    """A row for each conversation of the segments: conv_id, signature, its counts, and its segments (part, seg, size of the signature) in order."""
    numbers = ("signature", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns")
    whole = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seg", *numbers))).alias("segs"))
    turns, timed = F.filter("segs", lambda s: s["head"].isNotNull()), F.filter("segs", lambda s: s["low"].isNotNull())

    def borders(parts, bad):
        """At how many borders of parts bad holds."""
        at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(at, lambda i: bad(F.get(parts, i - 1), F.get(parts, i)))).cast("long")

    def total(name: str):
        return F.aggregate("segs", F.lit(0).cast("long"), lambda x, s: x + s[name])

    illegal = total("illegal") + borders(turns, lambda a, b: ~F.concat(a["tail"], b["head"]).isin("su", "ua", "au"))
    distinct = total("turns") - borders(timed, lambda a, b: a["high"] == b["low"])
    span = F.array_max(F.transform("segs", lambda s: s["high"])) - F.array_min(F.transform("segs", lambda s: s["low"])) + 1
    return whole.select(
        "conv_id", F.array_join(F.transform("segs", lambda s: s["signature"]), "").alias("signature"), F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"),
        *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")), illegal.alias("illegal"),
        F.transform("segs", lambda s: F.struct(s["part"].alias("part"), s["seg"].alias("seg"), F.length(s["signature"]).alias("size"))).alias("segs"),
    )


# ---- audits


def solved(whole: DataFrame) -> DataFrame:
    """signature, uses (conversations that have it), cost, audit of every distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"signature": batch.column(0), "uses": batch.column(1), "cost": pa.array([c for c, _ in found], pa.int64()), "audit": pa.array([a for _, a in found], pa.string())})

    return whole.groupBy("signature").agg(F.count("*").alias("uses")).mapInArrow(run, "signature string, uses long, cost long, audit string")


def audited(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The conversations with cost and audit, the edits of their turns (by _KEY), and the stored tables that both read."""
    cut = stored(spark, segments(turns))
    whole = stored(spark, conversations(cut))
    ways = stored(spark, solved(whole))
    plans = stored(spark, join_skewed(whole, ways, "signature", F.col("conv_id"), whole.count()))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each segment: the edits of its turns, inserted ones with the turn after them, at the end with the last one."""
        for batch in batches:
            out = []
            for audit, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = [m.end() for m in re.finditer("[KRD]", audit)]
                if ends:
                    ends[-1] = len(audit)
                upto, at = 0, 0
                for s in segs:
                    if s["size"]:
                        upto += s["size"]
                        out.append({"part": s["part"], "seg": s["seg"], "edits": audit[at : ends[upto - 1]]})
                        at = ends[upto - 1]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("edits", pa.string())]))

    def of_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, entries, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = [m.end() for m in re.finditer("[KRD]", edits)]
                ends[-1] = len(edits)
                copies, at = 0, 0
                for e in entries:
                    copies += e["n"]
                    out.append({"conv_id": conv, "turn": e["turn"], "role": e["role"], "digest": e["digest"], "edits": edits[at : ends[copies - 1]]})
                    at = ends[copies - 1]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("edits", pa.string())]))

    pieces = plans.select("audit", "segs").mapInArrow(slices, "part int, seg int, edits string")
    edits = cut.select("part", "seg", "conv_id", "entries").join(pieces.hint("merge"), ["part", "seg"]).select("conv_id", "entries", "edits")
    edits = edits.mapInArrow(of_turns, "conv_id long, turn long, role string, digest binary, edits string")
    return plans, edits, [cut, whole, ways, plans]


# ---- replay

_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def replay(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position, edit (K, R or I), role, text; a conversation's in order in one partition, which
    holds nothing but the turn it is at."""
    rows = faulty(turns).where("n > 0").select(*_KEY, F.lit(1).alias("kind"), "text", F.lit(None).cast("string").alias("edits"))
    rows = edits.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "edits").union(rows)
    rows = rows.repartition("conv_id").sortWithinPartitions(*_KEY, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place, todo, nothing = None, START, 0, "", True
        for batch in batches:
            out = []
            for i, role, kind, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if nothing or i != conv:
                    conv, state, place, nothing = i, START, 0, False
                if kind == 0:
                    todo = own
                    continue
                for e in todo:
                    if e != "D":
                        after = SYSTEM if e == "K" and state == START and role[:1] == "s" else _NEXT[state]
                        out.append({"conv_id": conv, "position": place, "edit": e, "role": role if e == "K" else _NAME[after], "text": "" if e == "I" else text})
                        state, place = after, place + 1
                todo = ""
            yield pa.RecordBatch.from_pylist(out, schema=_TURN)

    return rows.select("conv_id", "role", "kind", "text", "edits").mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and repaired turns (replay()) of turns
    (conv_id, turn, role, text, and n: copies of the row, 0 to leave it out), and the stored tables that both read.

    Null roles and texts are one space. Rows go by turn, null ones first, then by role and a digest of role and text; repeated
    rows are repeated turns. A role that is empty, or begins with no s, u or a, can only be changed or deleted. All rows without
    a conv_id are one conversation; an empty table gives none; other columns are not read.
    """
    space = F.lit(" ")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.col("n").cast("long").alias("n"))
    plans, edits, kept = audited(spark, turns)
    return plans.drop("signature", "uses", "segs"), replay(turns, edits), kept


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the digest of its `role:text`, joined by newlines; conversations without turns have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            out = []
            for i, place, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = i, hashlib.sha256()
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _pairs(out)
        yield _pairs([(conv, sha.hexdigest())] if sha else [])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "repaired_sha256": pa.array([r[1] for r in rows], pa.string())})


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a checksum of `conv_id:turn`, and n, the copies of each."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, turns, kept = repair(spark, damaged(table(spark, sf_dir, "conversations")))
    sums = digests(turns).select(F.col("conv_id").alias("of"), "repaired_sha256")
    out = audits.join(sums.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    out = stored(spark, out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))
    drop(*kept)
    return out


def _way(cost: str, edit: str, after: str, line: str = "''") -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{edit}' || {after}.a, 't': {line} || {after}.t}}"


def _kept(initial: str, after: str) -> str:
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    return f"CASE WHEN initial = '{initial}' AND NOT must THEN {_way('5 * cut', 'K', after, 'chr(10) || role || chr(58) || text')} ELSE {never} END"


def _given(role: str, after: str) -> str:
    line = f"chr(10) || '{role}:' || text"
    return f"CASE WHEN must THEN {_way('1000000000', 'R', after, line)} ELSE {_way('1 + 5 * cut', 'R', after, line)} END"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _sql() -> str:
    """The same by plain recursion from the last turn on: of each state the least (cost, audit) with the text it gives."""
    crc = "list_reduce([4294967295::UBIGINT] || list_transform(string_split(k, ''), lambda ch: ascii(ch)::UBIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
    insert_user, insert_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT *, xor(4294967295::UBIGINT, {crc}) % 20 AS d FROM k),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest, role[1] AS initial FROM r),
f AS (SELECT *, rest = '' AS blank, rest <> '' AND again AS duplicate, rest <> '' AND NOT again AND rest[-1] NOT IN ('.', '!', '?') AS truncated FROM n),
g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, blank OR duplicate AS must, CAST(truncated AS INTEGER) AS cut FROM f),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
  count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS last FROM g GROUP BY conv_id),
w AS (
  SELECT conv_id, last AS i, {{'c': 0, 'a': '', 't': ''}} AS f0, {{'c': 10, 'a': 'II', 't': {insert_user} || {insert_assistant}}} AS f1, {{'c': 5, 'a': 'I', 't': {insert_assistant}}} AS f2, {{'c': 0, 'a': '', 't': ''}} AS f3 FROM c
  UNION ALL
  SELECT conv_id, i, {_least("b0", _way("5", "I", "g2", insert_user))}, {_least("b1", _way("5", "I", "g2", insert_user))}, g2, g3 FROM (
    SELECT *, {_least("b2", _way("5", "I", "b3", insert_assistant))} AS g2, {_least("b3", _way("5", "I", "b2", insert_user))} AS g3 FROM (
      SELECT w.conv_id, w.i - 1 AS i, {_least(_way("2", "D", "f0"), _kept("s", "f1"), _kept("u", "f2"), _given("user", "f2"))} AS b0, {_least(_way("2", "D", "f1"), _kept("u", "f2"), _given("user", "f2"))} AS b1,
        {_least(_way("2", "D", "f2"), _kept("a", "f3"), _given("assistant", "f3"))} AS b2, {_least(_way("2", "D", "f3"), _kept("u", "f2"), _given("user", "f2"))} AS b3
      FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i))),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.f0.c, 0) AS BIGINT) AS cost, coalesce(w.f0.a, '') AS audit, sha256(coalesce(w.f0.t[2:], '')) AS repaired_sha256
FROM o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 0
"""


ORACLE = _sql()
