"""Repair of conversations: the cheapest edits that leave an optional system
message and pairs of a user and an assistant message.

Every edit sequence is one integer: its high digits are the cost, its low digits
the audit letters, three bits each from the left of a fixed width and zeros after
the last one. Of all sequences the smallest integer is the cheapest one, and among
those the one with the least letters, so that a shortest path over the rows
(states: nothing yet, after system, after user, after assistant) with ``min`` over
integers decides everything.

Rows are sorted into ranges, so a conversation of any length is spread over tasks.
A task gives the whole result of a conversation that lies inside its range, and
for the first and last one a table of the cheapest edits from each state to each
state; these tables, two a task at most, are joined to paths. Every ``SEGMENT``
rows the letters so far are replaced by their rank among the four states: all have
a letter for each row and end with one, so none is the start of another and later
letters cannot change their order. The integers therefore stay short.

A last pass brings the texts in order, once, and applies the letters to them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import materialise

DELETE, INSERT, KEEP, REROLE = "1", "2", "3", "4"  # octal digits of the audit letters D, I, K, R
LETTERS = str.maketrans("1234", "DIKR")
DIGITS = str.maketrans("DIKR", "1234")
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SEGMENT = 32
WIDTH = 2 * SEGMENT  # at most one insertion and one edit for each row
LENGTH_BITS = 16
RANK_AT = 3 * WIDTH + LENGTH_BITS
COST_AT = RANK_AT + 2
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WORD = r"[^\x20\x09-\x0D]"


def _edit(weight: int, digit: str, cost: int) -> int:
    """The sequence with one more letter. Its length is kept in the lowest digits,
    where it cannot decide: equal letters have equal lengths."""
    place = WIDTH - 1 - (weight & ((1 << LENGTH_BITS) - 1))
    return weight + (cost << COST_AT) + (int(digit) << (3 * place + LENGTH_BITS)) + 1


def _least(found: dict[int, int], state: int, weight: int) -> None:
    if state not in found or weight < found[state]:
        found[state] = weight


def _with_insert(weights: dict[int, int]) -> dict[int, int]:
    """With one message inserted or none. Two in a row are never cheapest: they
    lead back to the same state, or follow a system message that could be deleted
    for less."""
    out = dict(weights)
    for state, weight in weights.items():
        _least(out, NEXT[state], _edit(weight, INSERT, INSERT_COST))
    return out


class Paths:
    """Cheapest edits of consecutive rows from one state to each state."""

    def __init__(self, start: int):
        self.weights = {start: 0}
        self.ranked = [start]
        self.rows = 0
        self.done: list[dict[int, tuple[int, str]]] = []

    def add(self, initial: str, doomed: bool, truncated: bool) -> None:
        if self.rows == SEGMENT:
            self._cut()
        self.rows += 1
        extra = TRUNCATED_COST * truncated
        after: dict[int, int] = {}
        for state, weight in self.weights.items():
            _least(after, state, _edit(weight, DELETE, DELETE_COST))
        if not doomed:
            for state, weight in _with_insert(self.weights).items():
                follows = NEXT[state]
                if initial == "s" and state == BEGIN:
                    _least(after, SYSTEM, _edit(weight, KEEP, KEEP_COST + extra))
                if initial == ("a" if follows == ASSISTANT else "u"):
                    _least(after, follows, _edit(weight, KEEP, KEEP_COST + extra))
                _least(after, follows, _edit(weight, REROLE, REROLE_COST + extra))
        else:  # an insertion may stand before any row
            for state, weight in _with_insert(self.weights).items():
                _least(after, state, _edit(weight, DELETE, DELETE_COST))
        self.weights = after

    def _pieces(self, weights: dict[int, int]) -> dict[int, tuple[int, str]]:
        """By state: the state at the last cut, and the letters since."""
        out = {}
        for state, weight in weights.items():
            length = weight & ((1 << LENGTH_BITS) - 1)
            digits = format((weight >> LENGTH_BITS) & ((1 << (3 * WIDTH)) - 1), "o").zfill(WIDTH)
            out[state] = (self.ranked[(weight >> RANK_AT) & 3], digits[:length])
        return out

    def _cut(self) -> None:
        self.done.append(self._pieces(self.weights))
        ranked = sorted(self.weights, key=lambda s: self.weights[s] & ((1 << COST_AT) - 1))
        self.weights = {s: ((self.weights[s] >> COST_AT) << COST_AT) | (i << RANK_AT) for i, s in enumerate(ranked)}
        self.ranked, self.rows = ranked, 0

    def ends(self) -> dict[int, tuple[int, str]]:
        """By last state: the cost and the letters, as octal digits."""
        out = {}
        for state, (before, digits) in self._pieces(self.weights).items():
            parts = [digits]
            for pieces in reversed(self.done):
                before, digits = pieces[before]
                parts.append(digits)
            out[state] = (self.weights[state] >> COST_AT, "".join(reversed(parts)))
        return out


def cheapest(ends: list[tuple[int, str]]) -> tuple[int, str]:
    """The least of (cost, octal digits) as integers of one width."""
    width = max(len(digits) for _, digits in ends)
    return min(ends, key=lambda e: (e[0] << (3 * width)) | int("0" + e[1].ljust(width, "0"), 8))


def closed(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest whole path: it ends before anything or after an assistant."""
    found = [ends[s] for s in (BEGIN, ASSISTANT) if s in ends]
    if USER in ends:
        cost, digits = ends[USER]
        found.append((cost + INSERT_COST, digits + INSERT))
    return cheapest(found)


class Run:
    """Consecutive rows of one conversation in one task."""

    def __init__(self, conv, key: tuple, opened: bool):
        self.conv, self.key = conv, key
        self.paths = {s: Paths(s) for s in (range(4) if opened else (BEGIN,))}
        self.stats = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0}
        self.first_initial = self.last_initial = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut_off: bool, copies: int) -> None:
        for i in range(copies):
            fault = BLANK if blank else DUPLICATE if again or i else TRUNCATED if cut_off else None
            if fault:
                self.stats[fault] += 1
            for path in self.paths.values():
                path.add(initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED)
            if self.last_initial is None:
                self.first_initial = initial
            elif self.last_initial + initial not in LEGAL:
                self.stats["illegal"] += 1
            self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0

    def state(self) -> str:
        """What the join of several runs needs."""
        ends = {s: p.ends() for s, p in self.paths.items()}
        kept = ("stats", "first_initial", "last_initial", "first_turn", "last_turn", "turns")
        return json.dumps({"ends": ends} | {name: getattr(self, name) for name in kept})


COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
_KEY = ("_late", "_turn", "role", "_digest")


def _finished(conv, gaps: int, stats: dict, found: tuple[int, str]) -> tuple:
    cost, digits = found
    return (conv, gaps, stats[BLANK], stats[DUPLICATE], stats[TRUNCATED], stats["illegal"], cost, digits.translate(LETTERS))


def _runs(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each run: counts and audit of a whole conversation, or the state
    of one that may go on in other tasks."""
    names = ("conv", *COUNTS, "audit", *_KEY, "state")
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))
        out.clear()
        return batch

    def open_row(run: Run) -> tuple:
        return (run.conv, *[None] * (len(COUNTS) + 1), *run.key, run.state())

    run: Run | None = None
    number = 0
    for batch in batches:
        columns = batch.to_pydict()
        rows = zip(*(columns[c] for c in ("conv", *_KEY, "_initial", "_blank", "_again", "_cut_off", "_copies")), strict=True)
        for conv, late, turn, role, digest, initial, blank, again, cut_off, copies in rows:
            if run is None or conv != run.conv:
                if run is not None:
                    whole = number > 1  # the first run may have begun elsewhere
                    if whole:
                        out.append((*_finished(run.conv, run.gaps(), run.stats, closed(run.paths[BEGIN].ends())), *[None] * 5))
                    else:
                        out.append(open_row(run))
                    if len(out) >= 5_000:
                        yield flushed()
                number += 1
                run = Run(conv, (late, turn, role, digest), number == 1)
            run.add(turn if late else None, initial, blank, again, cut_off, copies)
    if run is not None:
        out.append(open_row(run))
    if out:
        yield flushed()


def _joined(table: pa.Table, kind: pa.DataType) -> pa.Table:
    """The runs of one conversation, in order, as one path."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["_late"], r["_turn"], r["role"], r["_digest"]))
    ends: dict[int, tuple[int, str]] = {BEGIN: (0, "")}
    stats = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0}
    first = last = before = None
    turns = 0
    for row in rows:
        run = json.loads(row["state"])
        found: dict[int, list[tuple[int, str]]] = {}
        for start, so_far in ends.items():
            for end, (cost, digits) in run["ends"].get(str(start), {}).items():
                found.setdefault(int(end), []).append((so_far[0] + cost, so_far[1] + digits))
        ends = {state: cheapest(choices) for state, choices in found.items()}
        for name, count in run["stats"].items():
            stats[name] += count
        if before is not None and before + run["first_initial"] not in LEGAL:
            stats["illegal"] += 1
        before = run["last_initial"]
        if run["turns"]:
            turns += run["turns"] - (run["first_turn"] == last)
            first = run["first_turn"] if first is None else first
            last = run["last_turn"]
    row = _finished(rows[0]["conv"], last - first + 1 - turns if turns else 0, stats, closed(ends))
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string()]
    return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["conv", *COUNTS, "audit"])


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _rows(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Own columns under own names; a null role or text is one space. The order is
    by turn, nulls first, then role and digest of the text."""
    number = F.col(f"`{turn}`").cast("long")
    said = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return messages.select(
        F.col(f"`{conv}`").alias("conv"),
        number.isNotNull().alias("_late"),
        F.coalesce(number, F.lit(0)).cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        said.alias("text"),
        F.unhex(F.sha2(said, 256)).alias("_digest"),
    )


def plans(messages: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Per conversation of ``messages``: ``conv``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``.

    Equal rows are merged before they move, and whether a text was said earlier is
    found by a join on (conversation, role, digest); texts themselves do not move.
    A null conversation is a conversation; no rows give no rows.
    """
    rows = _rows(messages, conv, turn, role, text)
    spoken = rows.withColumn("_blank", ~F.col("text").rlike(WORD)).withColumn(
        "_cut_off", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    )
    merged = materialise(
        spoken.groupBy("conv", *_KEY).agg(F.count(F.lit(1)).alias("_copies"), F.max("_blank").alias("_blank"), F.max("_cut_off").alias("_cut_off")),
        "repair-rows",
    )
    place = F.struct("_late", "_turn")
    firsts = merged.groupBy("conv", "role", "_digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    firsts = firsts.select(*(F.col(c).alias(f"f_{c}") for c in ("conv", "role", "_digest", "_first")))
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("_digest") == F.col("f__digest"))
    again = F.coalesce(F.col("f__first") < place, F.lit(False))
    known = merged.join(firsts, same, "left").select(
        "conv", *_KEY, F.substring("role", 1, 1).alias("_initial"), "_blank", again.alias("_again"), "_cut_off", "_copies"
    )
    ordered = known.repartitionByRange("conv", *_KEY).sortWithinPartitions("conv", *_KEY)
    field = ordered.schema["conv"].dataType
    name, kind = field.simpleString(), _arrow(field)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    shape = f"conv {name}, {counts}, audit string"
    runs = materialise(
        ordered.mapInArrow(lambda b: _runs(b, kind), f"{shape}, _late boolean, _turn long, role string, _digest binary, state string"),
        "repair-runs",
    )
    opened = runs.where("state is not null").groupBy("conv").applyInArrow(lambda t: _joined(t, kind), shape)
    return runs.where("state is null").select("conv", *COUNTS, "audit").unionByName(opened)


def _applied(batches: Iterator[pa.RecordBatch], kind: pa.DataType, digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by conversation, its plan before its messages."""
    heads = ["conv", *COUNTS, "audit", "repaired_sha256"] if digests else ["conv", "place", "role", "text"]
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()] if digests else [kind, pa.int64(), pa.string(), pa.string()]
    out: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], heads)
        out.clear()
        held = 0
        return batch

    plan: tuple | None = None
    digest, at, state, place = hashlib.sha256(), 0, BEGIN, 0

    def say(role: str, text: str) -> None:
        nonlocal place, held
        if digests:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        else:
            out.append((plan[0], place, role, text))
            held += len(text) + 50
        place += 1

    def insertions() -> None:
        nonlocal at, state
        while at < len(plan[-1]) and plan[-1][at] == "I":
            state = NEXT[state]
            say("user" if state == USER else "assistant", "")
            at += 1

    def finish() -> None:
        nonlocal held
        if plan is not None:
            insertions()
            if digests:
                out.append((*plan, digest.hexdigest()))
                held += len(plan[-1]) + 200

    for batch in batches:
        columns = batch.to_pydict()
        for row in zip(*(columns[c] for c in ("_message", "conv", *COUNTS, "audit", "role", "text")), strict=True):
            if not row[0]:
                finish()
                plan, digest, at, state, place = row[1 : 3 + len(COUNTS)], hashlib.sha256(), 0, BEGIN, 0
            else:
                insertions()
                letter, (role, text) = plan[-1][at], row[-2:]
                at += 1
                if letter != "D":
                    state = SYSTEM if letter == "K" and state == BEGIN and role[:1] == "s" else NEXT[state]
                    say(role if letter == "K" else "user" if state == USER else "assistant", text)
            if held > 4 << 20:
                yield flushed()
    finish()
    if out:
        yield flushed()


def _apply(messages: DataFrame, made: DataFrame, digests: bool, **columns) -> DataFrame:
    rows = _rows(messages, **columns)
    field = rows.schema["conv"].dataType
    name, kind = field.simpleString(), _arrow(field)
    shape = f"conv {name}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    both = (
        made.withColumn("_message", F.lit(False))
        .unionByName(rows.withColumn("_message", F.lit(True)), allowMissingColumns=True)
        .repartition("conv")
        .sortWithinPartitions("conv", "_message", *_KEY)
        .select("_message", "conv", *COUNTS, "audit", "role", "text")
    )
    return both.mapInArrow(lambda b: _applied(b, kind, digests), shape if digests else f"conv {name}, place long, role string, text string")


def _plans_of_all(messages: DataFrame, every: DataFrame | None, conv: str, **columns) -> DataFrame:
    made = plans(messages, conv=conv, **columns)
    if every is None:
        return made
    names = every.select(F.col(f"`{conv}`").alias("_every")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    whole = names.join(made, F.col("_every").eqNullSafe(F.col("conv")), "left")
    return whole.select(F.col("_every").alias("conv"), *zero, F.coalesce("audit", F.lit("")).alias("audit"))


def repaired(messages: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The repaired messages: the conversation, ``place`` (from 0), ``role``, ``text``."""
    names = {"conv": conv, "turn": turn, "role": role, "text": text}
    return _apply(messages, plans(messages, **names), False, **names).withColumnRenamed("conv", conv)


def repair_report(messages: DataFrame, every: DataFrame | None = None, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Per conversation its faults, the cheapest edits and ``repaired_sha256``.

    ``every`` names conversations to report besides those of ``messages``; one
    without rows has zeros, an empty audit and the digest of an empty text. Rows of
    one turn are taken by role, then by the SHA-256 of their text; equal rows are
    rows of their own, all but the first of them duplicates. A null conversation id
    is a conversation, a null turn comes first, a null role or text is one space.
    Texts move once and are hashed as they pass; a digest of one conversation is
    one task's work, as SHA-256 has no parallel form. Other columns are not read.
    """
    names = {"conv": conv, "turn": turn, "role": role, "text": text}
    made = _plans_of_all(messages, every, **names)
    return _apply(messages, made, True, **names).withColumnRenamed("conv", conv)


def damaged(messages: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Messages with seeded faults: crc32 of ``conv:turn`` modulo 20 drops a row (0),
    empties its text (1), removes its ``.``, ``!`` and ``?`` (2), repeats it (3) or
    makes it the user's (4). Nulls are one space, but for the columns conv and turn
    themselves, which stay null."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    said = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    rows = messages.where(draw != 0).select(
        F.col(f"`{conv}`"),
        F.col(f"`{turn}`"),
        F.when(draw == 4, "user").otherwise(spaced(role)).alias(role),
        said.alias(text),
        F.explode(F.array_repeat(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")
