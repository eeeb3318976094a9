"""Repair of conversation structure: the cheapest edits that make roles alternate, found as one integer minimum.

The edits of a conversation are a path through a layered graph: one layer per row, one node per state of the grammar
``(s?(ua)+)?`` of role initials. An edge is a whole number. Its high digits are the cost; below them every row has a slot
of two digits of its own for the letters of its edit (an insertion may come before the row), and the end has one too; what
a slot does not use is zero. No slot's letters begin another's, so the order of these numbers is the order by cost, then
by audit letters, and the ordinary minimum over the graph decides everything.

Slots are fixed places, so the numbers of consecutive slices of a conversation can be joined: a conversation too long for
one task is cut into slices whose numbers from every state to every state are made side by side. Only the digest of its
repaired text has to see the rows one after another, and streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlwork.llm.common import broadcast_if_small
from trawlwork.plans.lineage import cut
from trawlwork.plans.skew import lookup_join

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Audit letters as digits, in the order of their characters.
LETTERS = "\0DIKR"
_DIGIT = {letter: i for i, letter in enumerate(LETTERS)}
_SLOT_BITS = 6
#: States: nothing yet, after the leading s, after u, after a. What a state's next initial leads to.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Ends: the letters and the cost that a state still needs to be complete.
_END = (("", 0), ("II", 2 * INSERT), ("I", INSERT), ("", 0))
#: Rows and bytes of a conversation that one task repairs as a whole; longer ones go by slices of this many rows.
LONG_ROWS, LONG_BYTES = 2048, 8 << 20
SLICE_ROWS = 512

SPACE = r"\x20\x09-\x0D"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _slot(letters: str) -> int:
    return sum(_DIGIT[x] << (3 * (1 - i)) for i, x in enumerate(letters))


@lru_cache(maxsize=64)
def _edges(code: int) -> list[tuple[int, int, int, int]]:
    """``(from, to, cost, slot)`` of a row: ``code`` is its initial (0 other, 1 s, 2 u, 3 a), plus 4 if it is truncated, plus 8 if it must go."""
    initial, fault = " sua"[code & 3], TRUNCATED if code & 4 else 0
    found = []
    for state in range(4):
        for before, paid, at in [("", 0, state), *(("I", INSERT, to) for c, to in _NEXT[state].items() if c != "s")]:
            found.append((state, at, paid + DELETE, _slot(before + "D")))
            if code & 8:
                continue
            if initial in _NEXT[at]:
                found.append((state, _NEXT[at][initial], paid + KEEP + fault, _slot(before + "K")))
            found += [(state, to, paid + REROLE + fault, _slot(before + "R")) for c, to in _NEXT[at].items() if c != "s"]
    return found


def _forward(codes: bytes, start: int) -> list[int | None]:
    """For every state the least number of a path over the rows from ``start``; slots lie above each other, the last lowest."""
    width = _SLOT_BITS * len(codes)
    least: list[int | None] = [None] * 4
    least[start] = 0
    for i, code in enumerate(codes):
        place = _SLOT_BITS * (len(codes) - 1 - i)
        after: list[int | None] = [None] * 4
        for a, b, cost, slot in _edges(code):
            if least[a] is not None:
                value = least[a] + (cost << width) + (slot << place)
                if after[b] is None or value < after[b]:
                    after[b] = value
        least = after
    return least


def slice_numbers(codes: bytes) -> list[list[int | None]]:
    """The least numbers of a slice from every state to every state."""
    return [_forward(codes, state) for state in range(4)]


def _joined(left: tuple[int, list], right: tuple[int, list]) -> tuple[int, list]:
    """The numbers of two consecutive slices, as ``(rows, numbers)``."""
    (n, a), (m, b) = left, right
    low, keep = _SLOT_BITS * m, (1 << _SLOT_BITS * n) - 1
    wide = [[None if x is None else ((x >> _SLOT_BITS * n) << _SLOT_BITS * (n + m)) + ((x & keep) << low) for x in row] for row in a]
    keep = (1 << low) - 1
    add = [[None if y is None else ((y >> low) << _SLOT_BITS * (n + m)) + (y & keep) for y in row] for row in b]
    out = [[min((wide[p][k] + add[k][q] for k in range(4) if wide[p][k] is not None and add[k][q] is not None), default=None) for q in range(4)] for p in range(4)]
    return n + m, out


def joined_slices(slices: list[tuple[int, list]]) -> tuple[int, list]:
    """Neighbours are joined pairwise, so that every digit is moved once per doubling."""
    while len(slices) > 1:
        slices = [_joined(*slices[i : i + 2]) if i + 1 < len(slices) else slices[i] for i in range(0, len(slices), 2)]
    return slices[0]


def _finished(n: int, numbers: list[int | None]) -> tuple[int, str]:
    """Cost and audit of the least number with its end."""
    width = _SLOT_BITS * (n + 1)
    ends = []
    for number, (letters, cost) in zip(numbers, _END, strict=True):
        if number is not None:
            whole = ((number >> _SLOT_BITS * n) << width) + ((number & ((1 << _SLOT_BITS * n) - 1)) << _SLOT_BITS)
            ends.append(whole + (cost << width) + _slot(letters))
    best = min(ends)
    digits = oct((1 << width) | (best & ((1 << width) - 1)))[3:]  # three bits a digit, after a leading one
    return best >> width, "".join(LETTERS[int(d)] for d in digits if d != "0")


@lru_cache(maxsize=1 << 15)
def _small(codes: bytes) -> tuple[int, str]:
    return _finished(len(codes), _forward(codes, 0))


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """``(cost, audit)`` of a conversation whose rows have these codes."""
    if len(codes) <= 32:
        return _small(codes)
    parts = [codes[i : i + SLICE_ROWS] for i in range(0, len(codes), SLICE_ROWS)]
    n, numbers = joined_slices([(len(p), slice_numbers(p)) for p in parts])
    return _finished(n, numbers[0])


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of every letter in order; deleted rows keep their role and text. Roles follow from the place:
    what is left is ``uaua...``, after an s if its number is odd."""
    place = -((len(audit) - audit.count("D")) % 2)  # the leading s stands at -1
    for letter in audit:
        wanted = "user" if place % 2 == 0 else "assistant"
        if letter == "I":
            yield letter, wanted, ""
        else:
            role, text = next(rows)
            yield letter, wanted if letter == "R" else role, text
        place += letter != "D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)`` after the damage that the crc32 of ``conv_id:turn`` modulo 20 names.

    Nulls are one space, in the names too. 0 drops the row (it stays with ``alive`` false, so that its conversation is not
    lost), 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role ``user``.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        named("role").alias("role"),
        named("text").alias("text"),
        (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20).alias("damage"),
    )
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("damage") != 0).alias("alive"), F.explode(times))
    return rows.drop("col")


def _coded(rows: DataFrame) -> DataFrame:
    """With ``key`` (null ids too have one), ``blank`` and ``code``: the code of :func:`_edges`, blank rows must go."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code = code + F.when(blank, 8).when(~ended, 4).otherwise(0)
    return rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))).withColumn("code", code.cast("int"))


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _one(rows: list[tuple]) -> tuple[list, str]:
    """Summary and codes of one conversation's rows ``(turn, role, text, code)`` in order."""
    seen, codes, counts = set(), bytearray(), [0, 0, 0]
    for _, role, text, code in rows:
        again = (role, text) in seen
        seen.add((role, text))
        if not code & 8:
            counts[1] += again
            counts[2] += bool(code & 4) and not again
            code = code & 3 | 8 if again else code
        else:
            counts[0] += 1
        codes.append(code)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest_edits(bytes(codes))
    return [gaps, *counts, _illegal("".join(" sua"[c & 3] for c in codes)), cost, audit]


def _hashed(messages: Iterator[tuple[str, str, str]]) -> str:
    digest, first = hashlib.sha256(), True
    for edit, role, text in messages:
        if edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    return digest.hexdigest()


class _Output:
    """Collects rows into batches of a stated schema: reports, or the messages themselves."""

    def __init__(self, messages: bool):
        self.messages = messages
        kinds = [("conv_id", pa.int64())]
        if messages:
            kinds += [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        else:
            kinds += [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", ")] + [("repaired_sha256", pa.string())]
        self.schema = pa.schema(kinds)
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, conv_id: int | None, summary: list, edits: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        if not self.messages:
            self.rows.append((conv_id, *summary, _hashed(edits)))
            self.size += len(summary[-1])
            yield from self.full()
            return
        for place, (edit, role, text) in enumerate(edits):
            self.rows.append((conv_id, place, edit, role, text))
            self.size += len(text)
            yield from self.full()

    def full(self, least: int = 4096) -> Iterator[pa.RecordBatch]:
        if self.rows and (len(self.rows) >= least or self.size > 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def _schema(messages: bool) -> str:
    return "conv_id long, place long, edit string, role string, text string" if messages else f"conv_id long, {SUMMARY}, repaired_sha256 string"


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _whole(rows: DataFrame, messages: bool) -> DataFrame:
    """Conversations that fit a task: dealt by id, sorted, repaired one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, now = _Output(messages), [], None

        def done() -> Iterator[pa.RecordBatch]:
            summary = _one(held)
            return out.add(now[1], summary, edited(summary[-1], iter([(r[1], r[2]) for r in held])))

        for key, conv_id, turn, role, text, code, alive in _runs(batches, ["key", "conv_id", "turn", "role", "text", "code", "alive"]):
            if now is None or key != now[0]:
                if now is not None:
                    yield from done()
                now, held = (key, conv_id), []
            if alive:
                held.append((turn, role, text, code))
        if now is not None:
            yield from done()
        yield from out.full(1)

    dealt = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return dealt.select("key", "conv_id", "turn", "role", "text", "code", "alive").mapInArrow(run, _schema(messages))


def _in_slices(rows: DataFrame, messages: bool) -> DataFrame:
    """Conversations too long for a task. Equal rows are one row with a count; first occurrences are minima of their own."""
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    alike = cut(rows.withColumn("mark", mark).groupBy("key", "conv_id", "turn", "role", "text", "code", "mark").agg(F.count(F.lit(1)).alias("copies")), "alike-rows")
    begins = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = alike.groupBy("key", "mark").agg(F.min(begins).alias("first"))
    known = lookup_join(alike, first, ["key", "mark"]).withColumn("again", F.col("first") != begins)
    order = ["key", "turn", "role", "text"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = known.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "conv_id", "code", "copies", "again")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "piece", "rows", "blank", "duplicate", "truncated", "initials", "illegal", "numbers"]
        state = {"now": None, "codes": bytearray(), "piece": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            codes, now = bytes(state["codes"]), state["now"]
            if codes:
                initials = "".join(" sua"[c & 3] for c in codes)
                faults = [sum(bool(c & 16) for c in codes), sum(bool(c & 32) for c in codes), sum(bool(c & 4) for c in codes)]
                numbers = ["" if x is None else format(x, "x") for row in slice_numbers(bytes(c & 15 for c in codes)) for x in row]
                values = [now[0], now[1], state["piece"], len(codes), *faults, initials[0] + initials[-1], _illegal(initials), numbers]
                kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)
                state["piece"] += 1
            state["codes"] = bytearray()

        for key, part, code, copies, again in _runs(batches, ["key", "part", "code", "copies", "again"]):
            if state["now"] != (key, part):
                yield from flush()
                state["now"] = (key, part)
            # Beside the code: 16 marks a blank row, 32 a duplicate.
            repeated = code | 16 if code & 8 else code & 3 | 8 | 32
            for k in range(copies):
                state["codes"].append(code | 16 if code & 8 else repeated if again or k else code)
                if len(state["codes"]) >= SLICE_ROWS:
                    yield from flush()
        yield from flush()

    kinds = "key string, part long, piece long, rows long, blank long, duplicate long, truncated long, initials string, illegal long, numbers array<string>"
    pieces = cut(placed.mapInArrow(slices, kinds), "slices")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            n, numbers = joined_slices([(r[1], [[int(x, 16) if x else None for x in r[7][4 * p : 4 * p + 4]] for p in range(4)]) for r in held])
            cost, audit = _finished(n, numbers[0])
            illegal = sum(r[6] for r in held) + sum(_illegal(a[5][1] + b[5][0]) for a, b in zip(held[:-1], held[1:], strict=True))
            values = [held[0][0], *(sum(r[k] for r in held) for k in (2, 3, 4)), illegal, cost, audit]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for row in _runs(batches, ["key", "rows", "blank", "duplicate", "truncated", "initials", "illegal", "numbers"]):
            if held and held[0][0] != row[0]:
                yield done()
                held = []
            held.append(row)
        if held:
            yield done()

    stitched = pieces.repartition("key").sortWithinPartitions("key", "part", "piece").mapInArrow(stitch, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    turns = alike.groupBy("key", "conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))
    heads = cut(stitched.join(gaps, "key"), "audits")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's head, then its rows in order: only the audit is held."""
        out, rows = _Output(messages), _runs(batches, ["key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "role", "text", "copies"])

        def following() -> Iterator[tuple[str, str]]:
            for row in rows:
                for _ in range(row[11]):
                    yield row[9], row[10]
                count[0] -= row[11]
                if not count[0]:
                    return

        for head in rows:
            count = [len(head[8]) - head[8].count("I")]
            yield from out.add(head[1], list(head[2:9]), edited(head[8], following()))
        yield from out.full(1)

    summary = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    empty = {"turn": "long", "role": "string", "text": "string", "copies": "long"}
    before = heads.select("key", "conv_id", F.lit(0).alias("kind"), *summary, *(F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    after = alike.select("key", "conv_id", F.lit(1).alias("kind"), *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in summary), *empty)
    return before.unionByName(after).repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "text").mapInArrow(stream, _schema(messages))


def repair_conversations(rows: DataFrame, messages: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The cheapest repair of every conversation in ``rows(conv_id, turn, role, text)``; further columns are ignored, but
    a column ``alive`` that is false takes a row out and leaves its conversation.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per conversation, or
    with ``messages`` ``(conv_id, place, edit, role, text)``, one row per letter of the audit: kept, reroled, inserted and
    deleted ones. Rows are taken by turn, nulls first, those of one turn by role and text. A null id is a conversation like
    any other; null roles and texts are one space. A conversation without rows has zeros, an empty audit and the digest of
    the empty text. No rows give no rows. Conversations beyond ``long_rows`` rows or ``long_bytes`` bytes go through slices,
    with the same result; of these, one task holds the audit and the slices' numbers, never the texts.
    """
    names = ["conv_id", "turn", "role", "text"]
    alive = F.coalesce(F.col("alive"), F.lit(True)) if "alive" in rows.columns else F.lit(True)
    kinds = ["long", "long", "string", "string"]
    filled = [F.col(c).cast(t) if c in ("conv_id", "turn") else F.coalesce(F.col(c).cast(t), F.lit(" ")) for c, t in zip(names, kinds, strict=True)]
    coded = _coded(rows.select(*(c.alias(n) for c, n in zip(filled, names, strict=True)), alive.alias("alive")))
    living = coded.filter("alive")
    sizes = living.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("key"), "long-conversations")
    # One row for every conversation, whatever is left of it: a hot id combines before its shuffle.
    marks = coded.select("key", "conv_id").distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("alive"), "key", F.lit(0).alias("code")
    )
    everything = living.unionByName(marks)
    if long.isEmpty():
        return _whole(everything, messages)
    few = broadcast_if_small(long)
    return _whole(everything.join(few, "key", "left_anti"), messages).unionByName(_in_slices(living.join(few, "key", "left_semi"), messages))
