"""Repair of the role structure of conversations by depth-first branch-and-bound.

A repaired conversation has the role initials `(s?(ua)+)?`. Rows are kept (0), given the role that is due (3) or deleted (4, the only choice for
blank and duplicate rows), rows without text are inserted (3), and a truncated row that stays costs 3 more. The search holds its open nodes on
an explicit stack. A node is (rows done, what the last role was); it is dropped if a suffix bound shows that it cannot reach the
incumbent, or if the node's table holds a prefix with a smaller (cost, audit). When the stack is empty, the incumbent is proved best.
Of equally cheap audits the ASCII-least wins; two audits of one cost over the same rows are never each other's prefix, so parts may be
compared and joined.

Rows are sorted by conversation and turn over range partitions. A conversation of at most SEGMENT_ROWS rows inside a partition is repaired in
its task. Any other is cut into segments: first occurrences of its messages are found by an aggregation, every segment is searched from each
state it may be entered in, and the segments of a conversation are joined in order, by the best (cost, audit) of each state. The edited
segments are hashed in order, as a hash over a whole text has to be. No task holds more than a segment's texts.

Rows of one turn go by role and then by the MD5 of their text; null turns come first. A null role or text is one space; an empty role cannot be kept.
Repeated rows are duplicates of the first. A null conv_id is a conversation. A conversation without rows has zeros, an empty audit
and the hash of nothing. Very long texts are read whole, a row at a time. An empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import SPACES, stage

SEGMENT_ROWS = 64
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = ("user", "user", "assistant", "user")
THEN = (USER, USER, ASSISTANT, USER)
# Inserts that complete a conversation which ends in each state.
CLOSING = (0, 2, 1, 0)
LEGAL = ("su", "ua", "au")
# A prefix to any state can go on like one to any other: an insert for the parity, a deleted system row, the inserts that close it.
SLACK = INSERT + DELETE + TRUNCATED + 2 * INSERT
# Where the inserts that close a conversation are put: behind all its segments.
LAST_PART = (1 << 31) - 1
BLANK = "".join(chr(i) for i in range(256) if SPACES[i])
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, held: the rows with the contract's damage; held is false for dropped ones, which only name their conversation."""
    blank = F.lit(" ")
    dealt = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), dealt.alias("_dealt"))
    text = F.when(F.col("_dealt") == 1, "").when(F.col("_dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("_dealt") != 0).alias("held"), F.explode(F.when(F.col("_dealt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def suffix_bounds(rows: str) -> list[tuple[int, int, int, int]]:
    """What the rows from each place on cost at least, by state: system rows may stand anywhere and the end may be open, all else holds."""
    user = assistant = 0  # the bound where that role is due
    out = [(0, 0, 0, 0)]
    for code in reversed(rows):
        low, stays = code.lower(), 0 if code.islower() else TRUNCATED
        costs = []
        for due, own, other in (("u", user, assistant), ("a", assistant, user)):
            cost = DELETE + own
            if code != "d":
                cost = min(cost, stays + (0 if low == due else RELABEL) + other)
                if low == "s":
                    cost = min(cost, stays + own)
            costs.append(cost)
        user, assistant = min(costs[0], INSERT + costs[1]), min(costs[1], INSERT + costs[0])
        out.append((user, user, assistant, user))
    return out[::-1]


@functools.lru_cache(maxsize=200_000)
def search(rows: str, entry: int = START, closed: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) over the rows: with `closed` that of a whole conversation, else one for each state it may end in.

    A row is a letter: d must be deleted; s, u, a, x for other roles; a capital for a truncated one.
    """
    n, bound = len(rows), suffix_bounds(rows)
    ends: dict[int, tuple[int, str]] = {}
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        place, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bound[place][state]
            if least > best[0] + (0 if closed else SLACK) or closed and least == best[0] and audit > best[1][:len(audit)]:
                continue
        node = (place, state)
        if node in table and table[node] <= (cost, audit):
            continue
        table[node] = (cost, audit)
        if place == n and (not closed or not CLOSING[state]):
            ends[state] = (cost, audit)
            best = (cost, audit) if best is None else min(best, (cost, audit))
            continue
        due, then = DUE[state][0], THEN[state]
        out = [(cost + INSERT + bound[place][then], "I", place, then, cost + INSERT)]
        if place < n:
            code = rows[place]
            out.append((cost + DELETE + bound[place + 1][state], "D", place + 1, state, cost + DELETE))
            if code != "d":
                low = code.lower()
                stays = cost + (TRUNCATED if code != low else 0)
                if low == due:
                    out.append((stays + bound[place + 1][then], "K", place + 1, then, stays))
                elif low == "s" and state == START:
                    out.append((stays + bound[place + 1][SYSTEM], "K", place + 1, SYSTEM, stays))
                out.append((stays + RELABEL + bound[place + 1][then], "R", place + 1, then, stays + RELABEL))
        out.sort(reverse=True)  # the child that promises most is taken next
        stack += [(p, s, c, audit + letter) for _, letter, p, s, c in out]
    return {ASSISTANT: best} if closed else ends


def named(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


class Facts(NamedTuple):
    codes: str
    blank: int
    duplicate: int
    truncated: int
    illegal: int


def facts(rows: list[Row], first: set[int] | None = None) -> Facts:
    """The letters and counts of consecutive rows; `first` holds the places of first occurrences, else they are told from these rows alone."""
    seen: set[tuple[str, str]] = set()
    codes, blank, duplicate, truncated = [], 0, 0, 0
    for i, row in enumerate(rows):
        end = row.text.rstrip(BLANK)
        again = (row.role, row.text) in seen if first is None else i not in first
        seen.add((row.role, row.text))
        if not end:
            blank += 1
            codes.append("d")
        elif again:
            duplicate += 1
            codes.append("d")
        else:
            code = row.role[:1] if row.role[:1] in ("s", "u", "a") else "x"
            cut = end[-1] not in ".!?"
            truncated += cut
            codes.append(code.upper() if cut else code)
    illegal = sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return Facts("".join(codes), blank, duplicate, truncated, illegal)


def edited(rows: list[Row], audit: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        kept_system = letter == "K" and row.role[:1] == "s"
        out.append((row.role if letter == "K" else DUE[state], row.text if row else ""))
        state = SYSTEM if kept_system else THEN[state]
    return out


def joined(lines: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in lines)


def cut(rows: DataFrame, with_lines: bool) -> DataFrame:
    """Results of the conversations inside a partition; segments (part, seg, turns, roles, texts) of the others; with_lines: the repaired rows as well."""
    ordered = rows.withColumn("_hash", F.md5("text")).withColumn("_row", F.monotonically_increasing_id())
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "_hash", "_row"]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", "held")
    line = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        held: list[Row] = []
        here, split, kind = None, True, None
        out: list[dict] = []

        def segment() -> dict:
            nonlocal seg
            seg += 1
            return {"conv_id": here, "part": part, "seg": seg, "turns": [r.turn for r in held], "roles": [r.role for r in held],
                    "texts": [r.text for r in held]}

        def whole() -> dict:
            f = facts(held)
            cost, audit = search(f.codes)[ASSISTANT]
            turns = [r.turn for r in held if r.turn is not None]
            lines = edited(held, audit)
            row = {"conv_id": here, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **f._asdict(), "cost": cost, "audit": audit,
                   "repaired_sha256": hashlib.sha256(joined(lines).encode()).hexdigest()}
            del row["codes"]
            return row | ({"lines": [{"role": a, "text": b} for a, b in lines]} if with_lines else {})

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            fields = [("conv_id", kind), ("part", pa.int32()), ("seg", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                      ("texts", pa.list_(pa.string())), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      ("audit", pa.string()), ("repaired_sha256", pa.string()), ("lines", line)]
            return pa.RecordBatch.from_pylist(out, pa.schema(fields))

        started = False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            turn = batch["turn"].cast(pa.int64())
            for conv, t, role, text, there in zip(batch["conv_id"].to_pylist(), turn.to_pylist(), batch["role"], batch["text"], batch["held"].to_pylist(), strict=True):
                if started and conv != here:
                    out.append(segment() if split else whole())
                    held, split = [], False
                here, started = conv, True
                if there:
                    if len(held) == SEGMENT_ROWS:
                        out.append(segment())
                        held, split = [], True
                    held.append(Row(t, role.as_py(), text.as_py()))
            yield batch_of(out)
            out = []
        if started:  # the next partition may go on with it
            yield batch_of([segment()])
    return ordered.mapInArrow(run, named(rows) + ", part int, seg int, turns array<long>, roles array<string>, texts array<string>, "
                              + RESULT + ", lines array<struct<role:string,text:string>>")


def searched(segments: DataFrame) -> DataFrame:
    """Each segment's counts, first and last values, and its ends from each state it may be entered in (segments: with `first`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for i in range(len(batch)):
                turns, roles, texts, first = (batch[c][i].as_py() for c in ("turns", "roles", "texts", "first"))
                rows = [Row(*r) for r in zip(turns, roles, texts, strict=True)]
                f = facts(rows, set(first or ()))
                known = [t for t in turns if t is not None]
                ends = [search(f.codes, entry, False) for entry in range(4)]
                row = (f.blank, f.duplicate, f.truncated, f.illegal, len(rows), roles[0] if rows else None, roles[-1] if rows else None,
                       known[0] if known else None, known[-1] if known else None, len(set(known)),
                       [ends[a][b][0] if b in ends[a] else None for a in range(4) for b in range(4)],
                       [ends[a][b][1] if b in ends[a] else None for a in range(4) for b in range(4)])
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "part", "seg")), *(pa.array(out[n], k) for n, k in zip(names, kinds, strict=True))],
                                             ["conv_id", "part", "seg", *names])
    names = ["blank", "duplicate", "truncated", "illegal", "n_rows", "head", "tail", "low", "high", "n_turns", "costs", "audits"]
    return segments.mapInArrow(run, named(segments) + ", part int, seg int, blank long, duplicate long, truncated long, illegal long, n_rows long, head string, tail string, "
                               "low long, high long, n_turns long, costs array<long>, audits array<string>")


class Fold:
    """The segments of one conversation, joined in order; segments on which the best ways to all states agree are given out at once."""

    def __init__(self, conv):
        self.conv, self.sums, self.illegal, self.tail = conv, [0, 0, 0], 0, None
        self.low = self.high = None
        self.n_turns, self.cost, self.entry = 0, 0, START
        self.done: list[str] = []  # the audit up to the segments still open
        self.open: list[tuple[int, int]] = []  # their (part, seg)
        self.ways = {START: (0, "", ())}  # state: cost, audit and (entry, exit, audit) of the open segments

    def add(self, row: dict) -> Iterator[dict]:
        for i, name in enumerate(("blank", "duplicate", "truncated")):
            self.sums[i] += row[name]
        self.illegal += row["illegal"]
        if row["n_rows"]:
            if self.tail is not None and self.tail[:1] + row["head"][:1] not in LEGAL:
                self.illegal += 1
            self.tail = row["tail"]
        if row["low"] is not None:
            self.n_turns += row["n_turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        ways: dict[int, tuple[int, str, tuple]] = {}
        for state, (cost, audit, steps) in self.ways.items():
            for end in range(4):
                more, letters = row["costs"][4 * state + end], row["audits"][4 * state + end]
                if more is not None:
                    way = (cost + more, audit + letters, (*steps, (state, end, letters)))
                    if end not in ways or way[:2] < ways[end][:2]:
                        ways[end] = way
        least = min(w[0] for w in ways.values())
        self.ways = {end: w for end, w in ways.items() if w[0] <= least + SLACK}
        self.open.append((row["part"], row["seg"]))
        yield from self.agreed()

    def agreed(self) -> Iterator[dict]:
        n = 0
        sample = next(iter(self.ways.values()))[2]
        while n < len(sample) and all(w[2][n] == sample[n] for w in self.ways.values()):
            n += 1
        for (part, seg), (entry, _, letters) in zip(self.open[:n], sample[:n], strict=True):
            self.done.append(letters)
            yield {"conv_id": self.conv, "part": part, "seg": seg, "entry": entry, "edits": letters}
        size = sum(len(step[2]) for step in sample[:n])
        self.open = self.open[n:]
        self.ways = {end: (cost, audit[size:], steps[n:]) for end, (cost, audit, steps) in self.ways.items()}

    def finish(self) -> Iterator[dict]:
        cost, _, end = min((cost + INSERT * CLOSING[end], audit + "I" * CLOSING[end], end) for end, (cost, audit, _) in self.ways.items())
        self.ways = {end: self.ways[end]}
        yield from self.agreed()
        closing = "I" * CLOSING[end]
        yield {"conv_id": self.conv, "part": LAST_PART, "seg": 0, "entry": end, "edits": closing}
        blank, duplicate, truncated = self.sums
        yield {"conv_id": self.conv, "gaps": self.high - self.low + 1 - self.n_turns if self.n_turns else 0, "blank": blank, "duplicate": duplicate,
               "truncated": truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.done) + closing}


def folded(found: DataFrame) -> DataFrame:
    """A row for each segment (part, seg, entry, edits) and one for each conversation (counts, cost, audit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            shape = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()), ("seg", pa.int32()), ("entry", pa.int32()), ("edits", pa.string()),
                               *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
            out: list[dict] = []
            for row in batch.to_pylist():
                if fold is None or fold.conv != row["conv_id"]:
                    if fold is not None:
                        out += fold.finish()
                    fold = Fold(row["conv_id"])
                out += fold.add(row)
            yield pa.RecordBatch.from_pylist(out, shape)
        if fold is not None:
            yield pa.RecordBatch.from_pylist(list(fold.finish()), shape)
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(
        run, named(found) + ", part int, seg int, entry int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited_segments(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id, part, seg and the (role, text) lines that each segment's edits leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for i in range(len(batch)):
                roles, texts, edits, entry = (batch[c][i].as_py() for c in ("roles", "texts", "edits", "entry"))
                rows = [Row(None, *r) for r in zip(roles or (), texts or (), strict=True)]
                lines.append([{"role": a, "text": b} for a, b in edited(rows, edits, entry)])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "part", "seg")), pa.array(lines, kind)], ["conv_id", "part", "seg", "lines"])
    chosen = steps.filter("part is not null").select("conv_id", "part", "seg", "entry", "edits")
    return chosen.join(segments.drop("conv_id"), ["part", "seg"], "left").mapInArrow(
        run, named(steps) + ", part int, seg int, lines array<struct<role:string,text:string>>")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and the hash of its lines, read in order, a segment at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, here, state, empty = False, None, None, True
        for batch in batches:
            done: list[tuple] = []
            kind = batch.schema.field("conv_id").type
            for conv, text in zip(batch["conv_id"].to_pylist(), batch["lines"], strict=True):
                if not started or conv != here:
                    if started:
                        done.append((here, state.hexdigest()))
                    started, here, state, empty = True, conv, hashlib.sha256(), True
                text = text.as_py()
                if text:
                    state.update((("" if empty else "\n") + joined([(t["role"], t["text"]) for t in text])).encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([here], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(run, named(lines) + ", repaired_sha256 string")


def solved(rows: DataFrame, with_lines: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations repaired within their tasks, the summaries of the cut ones, and the edited segments of these."""
    rows = rows.select("conv_id", "turn", "role", "text", *(["held"] if "held" in rows.columns else [F.lit(True).alias("held")]))
    parts = stage(cut(rows, with_lines), "talk-parts")
    segments = parts.filter("part is not null").select("conv_id", "part", "seg", "turns", "roles", "texts")
    said = segments.select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "said"))
    message = F.md5(F.concat(F.length("said.roles").cast("string"), F.lit(":"), F.col("said.roles"), F.col("said.texts")))
    first = said.groupBy("conv_id", message).agg(F.min(F.struct("part", "seg", "at")).alias("first")).select("first.*")
    first = first.groupBy("part", "seg").agg(F.collect_list("at").alias("first"))
    found = stage(searched(segments.join(first, ["part", "seg"], "left")), "talk-found")
    steps = stage(folded(found), "talk-steps")
    return parts.filter("part is null"), steps.filter("part is null"), edited_segments(steps, segments)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (rows: conv_id, turn, role, text; held)."""
    whole, summary, lines = solved(rows, False)
    columns = [c.split(" ")[0] for c in RESULT.split(", ")]
    hashed = digests(lines).toDF("_conv", "_sha256")
    joined_up = summary.drop("repaired_sha256").join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv"))) \
        .select("conv_id", *columns[:-1], F.col("_sha256").alias("repaired_sha256"))
    return whole.select("conv_id", *columns).union(joined_up)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, part, seg, place, role, text; in a conversation ordered by (part, seg, place)."""
    whole, _, lines = solved(rows, True)
    every = whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seg"), "lines").union(lines.select("conv_id", "part", "seg", "lines"))
    return every.select("conv_id", "part", "seg", F.posexplode("lines").alias("place", "line")).select("conv_id", "part", "seg", "place", "line.role", "line.text")
