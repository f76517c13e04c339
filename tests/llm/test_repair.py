"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pkgloom.llm import common, op13_repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, n int, letter string"


def cheapest(turns):
    """Cost and audit of turns (initial, must go, breaks off): the first goal that a search by (cost, audit) takes out."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        # what may still come depends on the place, the last role and whether there is one
        if (i, out[-1:]) in seen or not re.match("(s?(ua)*u?)?$", out):
            continue
        seen.add((i, out[-1:]))
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, out + r))
        if i < len(turns):
            initial, must, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
            if not must:
                if initial:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, out + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, out + r))
    raise AssertionError


def brute(rows):
    """conv_id: what op13 gives for it."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            digest = hashlib.sha256(f"{len('user' if d == 4 else role)}:{'user' if d == 4 else role}{text}".encode()).digest()
            own += [((turn is not None, turn or 0, "user" if d == 4 else role, digest), turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        own.sort(key=lambda r: r[0])
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            rest = text.rstrip(op13_repair.BLANKS)
            fault = 0 if not rest else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault in (0, 1), fault == 2))
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest(kinds)
        left, said = iter(own), []
        for e in audit:
            row = next(left) if e != "I" else None
            if e != "D":
                now = "user" if not said or said[-1][0][:1] in "sa" else "assistant"
                said.append((row[2] if e == "K" else now, row[3] if row else ""))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def found(spark, turns):
    audits, repaired, _ = op13_repair.repair(spark, op13_repair.damaged(turns))
    sums = {r["conv_id"]: r["repaired_sha256"] for r in op13_repair.digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums.get(r["conv_id"], nothing)) for r in audits.collect()}


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair(spark, segment, monkeypatch):
    monkeypatch.setattr(op13_repair, "SEGMENT", segment)
    monkeypatch.setattr(common, "HOT_KEYS", 4)  # the signature of many alike conversations is a hot one
    rng = random.Random(segment)
    said = [None, "", " \t\n", "yes.", "no", "Why?", "a. b", "é!", "x\ny.", "z." * 50_000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "s"]
    rows = [(c, rng.choice([None, t, t, t, t, rng.randrange(9)]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(said), "x", 7, "x") for c in [*range(60), None] for t in range(rng.randrange(1, 14))]
    rows += [(c, t, ("user", "assistant")[t % 2], "fine." if t < 2 else f"fine {t}.", "x", 7, "x") for c in range(100, 140) for t in range(2)]
    rows += [(200, t, ("user", "assistant")[t % 2], rng.choice(said[3:6]) * t, "x", 7, "x") for t in range(90)] + rows[:5] * 2
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(spark, turns) == brute(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(spark, none) == {}
    (row,) = found(spark, spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)).items()
    assert row == (None, brute([(None, None, None, None)])[None])


def test_long_signature():
    cost, audit = op13_repair.solve("ua" * 100_000 + "x")
    assert cost == 2 and audit == "K" * 200_000 + "D"
    rng = random.Random(3)
    for _ in range(300):
        turns = [(rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(9))]
        letters = "".join("x" if must else r.upper() if cut else r for r, must, cut in turns)
        assert op13_repair.solve(letters) == cheapest([(r if r != "o" else "t", must, cut) for r, must, cut in turns])
