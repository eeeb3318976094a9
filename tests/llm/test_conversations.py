"""Conversation repair against all edits of small conversations, and its cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np

from trawlwork.llm.conversations import cheapest_edits, damaged, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, code string, copies int, again int, part string"


def table(spark, rows):
    """Rows of (conv_id, turn, role, text) with further columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "k", "c", 7, 8, "p") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def brute(rows):
    """Every mixture of edits of one conversation's rows, the cheapest of those that are right, its letters least."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    choices, counts, seen = [], [0, 0, 0], set()
    for _, _, role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        seen.add((role, text))
        fault = 0 if blank else 1 if again else 2 if cut else None
        if fault is not None:
            counts[fault] += 1
        own = [("D", 2, None)]
        if fault not in (0, 1):
            own += [("K", 5 * (fault == 2), (role, text))] + [("R", 1 + 5 * (fault == 2), (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    gap = [((), 0)] + [(c, 5 * len(c)) for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*choices):
        base = sum(e[1] for e in edits)
        if best is not None and base > best[0][0]:
            continue
        for holes in itertools.product(gap if len(rows) <= 3 else gap[:3], repeat=len(rows) + 1):
            cost = base + sum(h[1] for h in holes)
            if best is not None and cost > best[0][0]:
                continue
            audit, kept = "", []
            for hole, edit in itertools.zip_longest(holes, edits):
                audit += "I" * len(hole[0]) + (edit[0] if edit else "")
                kept += [(r, "") for r in hole[0]] + ([edit[2]] if edit and edit[2] else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[0]):
                best = ((cost, audit), kept)
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    (cost, audit), kept = best
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def some(seed=3, convs=40):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "What?", "cut off", "", " \t", "done.  ", ". no", None]
    roles = ["system", "user", "assistant", "tool", "", None, "ursula"]
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(1, 5))):
            turn = [t, t, t + 3, None, 0][int(rng.integers(0, 5))]
            rows.append((c if c else None, turn, roles[min(int(rng.integers(0, 9)), 6)] if rng.random() < 0.4 else ("user", "assistant")[t % 2], texts[int(rng.integers(0, 9))]))
    return [*rows, *rows[:5]]


def expected(rows):
    ids, after = {r[0] for r in rows}, damage(rows)
    return {c: brute([r for r in after if r[0] == c]) for c in ids}


def test_against_all_edits(spark):
    rows = [r for r in some() if r[0] is None or r[0] % 7 or r[1] != 0]
    want = expected(rows)
    for limit in (2048, 1):  # whole conversations, and all of them by slices
        out = repair_conversations(damaged(table(spark, rows)), long_rows=limit).collect()
        assert len(out) == len(want)
        assert {r[0]: tuple(r[1:]) for r in out} == want


def test_slices_equal_the_whole(monkeypatch, spark):
    from trawlwork.llm import conversations

    rng = np.random.default_rng(5)
    rows = [(1, i // 2, ("user", "assistant", "system")[int(rng.integers(0, 3))], f"t{rng.integers(0, 300)}{'.' * int(rng.integers(0, 2))}") for i in range(700)]
    rows += [(2, None, "user", "same.")] * 400 + [(2, 5, "user", "same.")] * 300 + [(3, 1, "user", "x" * 200_000 + "."), (4, 1, "user", "a."), (4, 2, "assistant", "b.")]
    whole = {r[0]: r for r in repair_conversations(table(spark, rows)).collect()}
    monkeypatch.setattr(conversations, "SLICE_ROWS", 16)
    sliced = {r[0]: r for r in repair_conversations(table(spark, rows), long_rows=50, long_bytes=100_000).collect()}
    assert whole == sliced and whole[2].audit.count("D") == 700 and whole[4].audit == "KK"
    messages = repair_conversations(table(spark, rows), messages=True, long_rows=50).collect()
    for c, report in whole.items():
        own = sorted((m for m in messages if m.conv_id == c), key=lambda m: m.place)
        assert "".join(m.edit for m in own) == report.audit
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in own if m.edit != "D").encode()).hexdigest() == report.repaired_sha256


def test_numbers_of_long_conversations():
    rng = np.random.default_rng(6)
    codes = bytes(int(x) for x in rng.choice([1, 2, 3, 2, 3, 6, 7, 0, 8], 2000))
    from trawlwork.llm.conversations import _finished, _forward

    assert cheapest_edits(codes) == _finished(len(codes), _forward(codes, 0))


def test_empty_and_lost(spark):
    assert repair_conversations(damaged(table(spark, []))).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair_conversations(damaged(table(spark, [(lost, 0, "user", "x.")]))).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
