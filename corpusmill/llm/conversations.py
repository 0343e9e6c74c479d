"""Conversation structure repair by iterative-deepening A* over edits.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Edits are Keep (0), Rerole to user
or assistant (1), Delete (2; the only one for blank and duplicate rows) and Insert of an empty user or
assistant text (5); a truncated row that stays costs 5 more. The role that an insert or rerole gives
follows from what was kept before, so the edits' initials tell the whole repair.

The search goes depth first through the edits in ASCII order under a cost bound, which rises to the
least cost that a failed search saw beyond it. A transposition table keeps, for every state that
failed (row, role before it), the least cost known to be needed from there; it cuts later visits and
bounds the next depth. The first path that accepts is the cheapest, and the least in ASCII order.

Rows are sorted by range of (conversation, turn, role, text), so a long conversation spreads over tasks.
A task cuts what it sees of a conversation into segments of bounded size. A conversation that is one
segment, with its neighbours in the same task, is searched at once. Otherwise each segment is searched
for every pair of states before and after it, segments are composed in order into the run that a task
saw, and runs (a conversation has at most one per task) into the conversation; the states chosen go
back to the segments. Inserts count with the row that follows, so audits of one start differ before
either ends, and comparing audits segment by segment is comparing them whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import lookup_join, stored

# A segment ends after so many rows or bytes of text.
SEGMENT_ROWS = 100
SEGMENT_BYTES = 4 << 20
LONGEST = (1 << 63) - 1

BLANKS = r"\x20\x09-\x0D"
# States: nothing yet, after system, after user, after assistant.
STATES = 4
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))  # by Insert and Rerole
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
# What ends a conversation in each state.
TAILS = ("", "II", "I", "")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


# --- search ---------------------------------------------------------------------------------------


def cheapest(roles: list[str], cut: list[bool], entry: int, ends: list[float]) -> tuple[float, str]:
    """Cost and initials of the cheapest edits of rows that may stay, ASCII-least among equals.

    ``roles`` are initials, ``cut`` marks truncated rows, ``ends`` is what each state costs after the last
    row (infinite if it must not be reached). Some end must be reachable.
    """
    n = len(roles)
    least = [0] * (n + 1)  # every truncated row costs a deletion at least
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if cut[i] else 0)
    failed: dict[tuple[int, int], float] = {}
    path: list[str] = []

    def visit(i: int, state: int, left: float) -> float | None:
        """None if a path within ``left`` was found, else the least cost needed as far as known."""
        if i == n:
            return None if ends[state] <= left else ends[state]
        known = failed.get((i, state), least[i])
        if known > left:
            return known
        given = GIVEN[state][0]
        extra = CUT if cut[i] else 0
        moves = [("D", DELETE, i + 1, state), ("I", INSERT, i, given)]
        if (state, roles[i]) in KEPT:
            moves.append(("K", extra, i + 1, KEPT[state, roles[i]]))
        moves.append(("R", REROLE + extra, i + 1, given))
        need = math.inf
        for edit, cost, j, after in moves:
            rest = visit(j, after, left - cost)
            if rest is None:
                path.append(edit)
                return None
            need = min(need, cost + rest)
        failed[i, state] = need = max(need, known)
        return need

    bound: float = least[0]
    while True:
        need = visit(0, entry, bound)
        if need is None:
            cost = bound
            return cost, "".join(reversed(path))
        if need == math.inf:
            raise ValueError("no end can be reached")
        bound = need


def state_after(edits: str, roles: list[str], entry: int = 0) -> int:
    """The state that edits of rows that may stay lead to."""
    state, rows = entry, iter(roles)
    for edit in edits:
        role = "" if edit == "I" else next(rows)
        if edit != "D":
            state = KEPT[state, role] if edit == "K" else GIVEN[state][0]
    return state


def reachable(roles: list[str], entry: int, end: int) -> bool:
    """Whether rows that may stay can lead from one state to another, with no insert after the last."""
    return entry == end or bool(roles) and end >= 2 or (entry, end) == (0, 1) and "s" in roles


@dataclass
class Row:
    """Rows of one turn, role and text: one that may stay unless ``live`` is false, then ``dead`` to delete."""

    role: str
    text: str
    live: bool
    cut: bool
    dead: int


def with_deletions(edits: str, rows: list[Row]) -> str:
    """The forced deletions put between the edits of the rows that may stay; they come before inserts."""
    out, at = [], 0
    for row in rows:
        if row.live:
            end = at
            while edits[end] == "I":
                end += 1
            out.append(edits[at:end + 1])
            at = end + 1
        out.append("D" * row.dead)
    return "".join(out) + edits[at:]


def repaired(rows: list[Row], audit: str, entry: int) -> list[tuple[str, str]]:
    """Roles and texts that the edits leave."""
    out, state = [], entry
    units = ((row, j == 0 and row.live) for row in rows for j in range(row.dead + row.live))
    for edit in audit:
        given, role = GIVEN[state]
        if edit == "I":
            out.append((role, ""))
            state = given
            continue
        row, _ = next(units)
        if edit == "K":
            out.append((row.role, row.text))
            state = KEPT[state, row.role[:1]]
        elif edit == "R":
            out.append((role, row.text))
            state = given
    return out


# --- composing ------------------------------------------------------------------------------------


@dataclass
class Facts:
    """Counts over consecutive rows, with what is needed to join them to the rows beside them."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None
    first_role: str | None = None
    last_role: str | None = None

    def joined(self, other: Facts) -> Facts:
        if self.first_role is None:
            return other
        across = (self.last_role, other.first_role) not in LEGAL
        # rows go by turn, so equal turns lie side by side
        same = self.most is not None and self.most == other.least
        return Facts(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
                     self.illegal + other.illegal + across, self.turns + other.turns - same,
                     other.least if self.least is None else self.least,
                     self.most if other.most is None else other.most, self.first_role, other.last_role)

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, LONGEST)


@dataclass
class Span:
    """Cheapest edits over consecutive rows between all states.

    ``cost[a][b]`` is infinite where b can't be reached; ``rank[a]`` orders the ends of a by their edits' initials.
    """

    cost: list[list[float]] = field(default_factory=lambda: [
        [0 if a == b else math.inf for b in range(STATES)] for a in range(STATES)])
    rank: list[list[int]] = field(default_factory=lambda: [[0] * STATES for _ in range(STATES)])

    def joined(self, other: Span) -> tuple[Span, list[list[int]]]:
        """This span followed by another, and the state between them for each start and end."""
        out, between = Span(), [[0] * STATES for _ in range(STATES)]
        for a in range(STATES):
            for b in range(STATES):
                out.cost[a][b], _, between[a][b] = min(
                    (self.cost[a][m] + other.cost[m][b], self.rank[a][m], m) for m in range(STATES))
            keys = [(self.rank[a][m], other.rank[m][b]) for b, m in enumerate(between[a])]
            order = sorted(set(keys))
            out.rank[a] = [order.index(key) for key in keys]
        return out, between

    def end(self, entry: int = 0) -> tuple[float, int]:
        """Cost with its tail, and the last state, of the cheapest whole."""
        cost, _, state = min((self.cost[entry][b] + INSERT * len(TAILS[b]), self.rank[entry][b], b)
                             for b in range(STATES))
        return cost, state


def span_of(rows: list[Row]) -> tuple[Span, list[list[str | None]]]:
    """A segment's span, with the audits."""
    span, audits = Span(), [[None] * STATES for _ in range(STATES)]
    roles, cut = [r.role[:1] for r in rows if r.live], [r.cut for r in rows if r.live]
    dead = DELETE * sum(r.dead for r in rows)
    for a in range(STATES):
        for b in range(STATES):
            if reachable(roles, a, b):
                cost, edits = cheapest(roles, cut, a, [0 if s == b else math.inf for s in range(STATES)])
                span.cost[a][b], audits[a][b] = cost + dead, with_deletions(edits, rows)
            else:
                span.cost[a][b] = math.inf
        order = sorted(x for x in audits[a] if x is not None)
        span.rank[a] = [STATES if x is None else order.index(x) for x in audits[a]]
    return span, audits


def _flat(rows: list[list]) -> list:
    return [None if x == math.inf else x for row in rows for x in row]


def _square(values: list, none: float | None = None) -> list[list]:
    cells = [none if x is None else x for x in values]
    return [cells[i:i + STATES] for i in range(0, STATES * STATES, STATES)]


# --- rows to segments -----------------------------------------------------------------------------

FACTS = "blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, " \
        "first_role string, last_role string"
FACT_NAMES = [f.split()[0] for f in FACTS.split(", ")]
ROWS = "array<struct<role:string,text:string,live:boolean,cut:boolean,dead:long>>"
# ``kind``: a whole conversation with its repaired rows, a segment, or the run that ends a task's segments.
SEGMENTS = (f"conv_id long, kind string, run long, segment long, {FACTS}, cost array<long>, rank array<long>, "
            f"between array<long>, audits array<string>, rows {ROWS}")
NAMES = ["conv_id", "kind", "run", "segment", *FACT_NAMES, "cost", "rank", "between", "audits", "rows"]
ROW_TYPE = pa.struct([("role", pa.string()), ("text", pa.string()), ("live", pa.bool_()), ("cut", pa.bool_()),
                      ("dead", pa.int64())])
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * 7, pa.string(), pa.string(),
         *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.list_(ROW_TYPE)]


SOLVED = ("conv_id long, run long, entry long, exit long, tail string, cost long, blank long, duplicate long, "
          "truncated long, illegal long, gaps long")
SOLVED_TYPE = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64())
                         for f in SOLVED.split(", ")])
CHOSEN = "segment long, entry long, exit long, tail string"
CHOSEN_TYPE = pa.schema([("segment", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("tail", pa.string())])


class Run:
    """What one task sees of one conversation, row after row."""

    def __init__(self, conv_id: int | None, number: int, whole: bool):
        self.conv_id, self.number, self.whole = conv_id, number, whole
        self.rows, self.bytes, self.facts, self.all_facts, self.span = [], 0, Facts(), Facts(), Span()
        self.segments = 0

    def add(self, turn, role: str, text: str, copies: int, blank: bool, again: bool, cut: bool) -> Iterator[tuple]:
        if len(self.rows) >= SEGMENT_ROWS or self.rows and self.bytes + len(text) > SEGMENT_BYTES:
            yield self.segment()
        live = not blank and not again
        dead = copies - live
        self.rows.append(Row(role, text, live, live and cut, dead))
        self.bytes += len(text)
        initial = role[:1]
        self.facts = self.facts.joined(Facts(
            copies if blank else 0, 0 if blank else dead, int(live and cut), copies - 1, int(turn is not None), turn,
            turn, initial, initial))

    def segment(self) -> tuple:
        """Close a segment; its position gives its number, so numbers go up along the table."""
        own, audits = span_of(self.rows)
        self.span, between = self.span.joined(own)
        row = (self.conv_id, "segment", self.number, self.number + self.segments, *[None] * len(FACT_NAMES),
               None, None, _flat(between), [x for a in audits for x in a], [vars(r) for r in self.rows])
        self.all_facts = self.all_facts.joined(self.facts)
        self.rows, self.bytes, self.facts = [], 0, Facts()
        self.segments += 1
        return row

    def close(self, last: bool) -> Iterator[tuple]:
        if self.whole and not last and not self.segments:
            roles, cut = [r.role[:1] for r in self.rows if r.live], [r.cut for r in self.rows if r.live]
            cost, edits = cheapest(roles, cut, 0, [INSERT * len(t) for t in TAILS])
            cost += DELETE * sum(r.dead for r in self.rows)
            audit = with_deletions(edits, self.rows) + TAILS[state_after(edits, roles)]
            facts = [getattr(self.facts, name) for name in FACT_NAMES]
            yield (self.conv_id, "whole", self.number, self.number, *facts, [cost], None, None, [audit],
                   [{"role": role, "text": text} for role, text in repaired(self.rows, audit, 0)])
            return
        if self.rows:
            yield self.segment()
        facts = [getattr(self.all_facts, name) for name in FACT_NAMES]
        yield (self.conv_id, "run", self.number, self.number, *facts, _flat(self.span.cost), _flat(self.span.rank),
               None, None, None)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    run, number, held, out = None, 0, 0, []

    def emitted() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(TYPES)], NAMES)
        out.clear()
        held = 0
        return batch

    columns = ["conv_id", "turn", "role", "text", "copies", "blank", "again", "cut"]
    for batch in batches:
        for conv_id, *rest in zip(*[batch.column(c).to_pylist() for c in columns]):
            if run is None or conv_id != run.conv_id:
                if run is not None:
                    out.extend(run.close(False))
                    number += run.segments + 1
                run = Run(conv_id, base + number, run is not None)
            out.extend(run.add(*rest))
            held += len(rest[2])
            if out and held >= 2 * SEGMENT_BYTES:
                yield emitted()
        if out:
            yield emitted()
    if run is not None:
        out.extend(run.close(True))
        yield emitted()


def _key(column: str) -> list[Column]:
    return [F.col(column).isNull().alias("_none"), F.coalesce(F.col(column), F.lit(0)).alias("_conv")]


def _with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and each one's first fault.

    Equal rows are counted before they travel. A text seen at an earlier turn is found by its first turn
    per conversation, role and text; only those that occur at several turns are joined back.
    """
    equal = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumns({"blank": ~F.col("text").rlike(f"[^{BLANKS}]"),
                                 "cut": ~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"),
                                 "mark": F.unhex(F.md5("text"))}), "conversation-rows")
    said = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    often = stored(equal.filter("not blank").select(*_key("conv_id"), "role", "mark", said.alias("said"))
                   .groupBy("_none", "_conv", "role", "mark").agg(F.min("said").alias("first"),
                                                                  F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").drop("n"), "conversation-repeats")
    keyed = equal.select("*", *_key("conv_id"))
    found = lookup_join(keyed, often, ["_none", "_conv", "role", "mark"], "left", spread=["turn"])
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return found.select("conv_id", "turn", "role", "text", "copies", "blank", again.alias("again"), "cut")


# --- segments to conversations --------------------------------------------------------------------


def _resolve(table: pa.Table) -> pa.Table:
    """States before and after each run of one conversation, and its report beside the last."""
    runs = sorted(table.to_pylist(), key=lambda r: r["run"])
    span, facts, betweens = Span(), Facts(), []
    for r in runs:
        span, between = span.joined(Span(_square(r["cost"], math.inf), _square(r["rank"])))
        betweens.append(between)
        facts = facts.joined(Facts(*[r[name] for name in FACT_NAMES]))
    cost, state = span.end()
    report = {"tail": TAILS[state], "cost": cost, "gaps": facts.gaps(),
              **{name: getattr(facts, name) for name in FACT_NAMES[:4]}}
    out = []
    for r, between in zip(reversed(runs), reversed(betweens)):
        before = between[0][state]
        out.append({"conv_id": r["conv_id"], "run": r["run"], "entry": before, "exit": state, **report})
        report, state = {"tail": ""}, before
    return pa.Table.from_pylist(out, SOLVED_TYPE)


def _choose(table: pa.Table) -> pa.Table:
    """States before and after each segment of one run, from the run's own and the states between."""
    segments = sorted(table.to_pylist(), key=lambda r: -r["segment"])
    start, state, tail, out = segments[0]["entry"], segments[0]["exit"], segments[0]["tail"], []
    for r in segments:
        before = _square(r["between"])[start][state]
        out.append({"segment": r["segment"], "entry": before, "exit": state, "tail": tail})
        state, tail = before, ""
    return pa.Table.from_pylist(out, CHOSEN_TYPE)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, audits = [], []
        for rows, audit, entry in zip(*[batch.column(c).to_pylist() for c in ("rows", "audit", "entry")]):
            left = repaired([Row(**r) for r in rows], audit, entry)
            turns.append([{"role": role, "text": text} for role, text in left])
            audits.append(audit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("segment"), pa.array(audits, pa.string()),
             pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
            ["conv_id", "segment", "audit", "turns"])


TURNS = "array<struct<role:string,text:string>>"


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Reports and repaired rows of conversations.

    Reports: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation.
    Repaired rows: ``conv_id, segment, whole, turns``, arrays of (role, text) in order of ``segment``; ``whole`` if
    there is only one.

    Rows go by turn (nulls first), then role and text. A null role or text is one space; a null id is a
    conversation of its own; null turns count neither as gaps nor as turns. The first fault of a row
    counts: blank, duplicate (role and text seen earlier; equal rows are duplicates of each other), truncated.
    Roles count by their first character, of which s, u and a can be kept. An empty table gives no rows. Other
    columns are not read. ``audit`` is one character an edit, whatever the conversation's length.
    """
    source = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    segments = stored(_with_faults(source).repartitionByRange(*order).sortWithinPartitions(*order)
                      .mapInArrow(_segments, SEGMENTS), "conversation-segments")

    runs = segments.filter("kind = 'run'").select("conv_id", "run", *FACT_NAMES, "cost", "rank")
    solved = stored(runs.groupBy("conv_id").applyInArrow(_resolve, SOLVED),  # at most one run per task
                    "conversation-runs")
    parts = segments.filter("kind = 'segment'")
    chosen = parts.select("run", "segment", "between").join(solved.select("run", "entry", "exit", "tail"), "run")
    states = chosen.groupBy("run").applyInArrow(_choose, CHOSEN)  # narrow rows, at most those of one task
    audit = F.concat(F.get("audits", (F.col("entry") * STATES + F.col("exit")).cast("int")), "tail")
    mended = stored(parts.select("conv_id", "segment", "audits", "rows").join(states, "segment")
                    .select("conv_id", "segment", "rows", "entry", audit.alias("audit"))
                    .mapInArrow(_apply, f"conv_id long, segment long, audit string, turns {TURNS}"), "conversation-parts")

    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = segments.filter("kind = 'whole'")
    wide = [F.col(c).cast("decimal(20,0)") for c in ("most", "least", "turns")]
    apart = F.least(wide[0] - wide[1] + 1 - wide[2], F.lit(LONGEST).cast("decimal(20,0)")).cast("long")
    gaps = F.when(F.col("most").isNull(), F.lit(0).cast("long")).otherwise(apart)
    at_once = whole.withColumns({"gaps": gaps, "cost": F.get("cost", F.lit(0)), "audit": F.get("audits", F.lit(0))})
    audits = mended.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "audit"))).alias("parts"))
    longer = (solved.filter("cost is not null").alias("s")
              .join(audits.alias("a"), F.col("s.conv_id").eqNullSafe(F.col("a.conv_id")))
              .select("s.*", F.array_join(F.col("a.parts.audit"), "").alias("audit")))
    reports = at_once.select(*columns).unionByName(longer.select(*columns))
    as_turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    turns = (whole.select("conv_id", "segment", F.lit(True).alias("whole"), as_turns.alias("turns"))
             .unionByName(mended.select("conv_id", "segment", F.lit(False).alias("whole"), "turns")))
    return reports, turns


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of consecutive rows of one conversation, joined by newlines."""
    current, digest, first = None, None, True

    def row(conv_id, digest):
        return pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([digest.hexdigest()])],
                                          ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv_id, text, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "n")]):
            if digest is None or conv_id != current:
                if digest is not None:
                    yield row(current, digest)
                current, digest, first = conv_id, hashlib.sha256(), True
            if n:
                digest.update(("" if first else "\n").encode() + text.encode())
                first = False
    if digest is not None:
        yield row(current, digest)


def repaired_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of each conversation's ``role:text`` rows joined by newlines.

    The texts of a conversation in several segments pass through one task, a row at a time, as a SHA-256
    can't be computed in parts. Null ids are a conversation. An empty table gives no rows.
    """
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    joined = turns.select("conv_id", "segment", "whole", text.alias("text"), F.size("turns").alias("n"))
    single = joined.filter("whole").select("conv_id", F.sha2("text", 256).alias("repaired_sha256"))
    several = joined.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return single.unionByName(several.mapInArrow(_hashes, "conv_id long, repaired_sha256 string"))


# --- damage ---------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user. Nulls
    are one space in the key, role and text; ids and turns stay null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (rows.select("conv_id", "turn", fault.alias("fault"),
                        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
                        .alias("text"))
            .filter("fault <> 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))))
            .select("conv_id", "turn", "role", "text"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation's report and digest after ``damage`` and ``repair_conversations``.

    One without rows after the damage has zeros, an empty audit and the digest of nothing. Nulls, ties, repeated
    rows and empty tables as in these two.
    """
    reports, turns = repair_conversations(damage(conversations))
    digests = repaired_digests(turns)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = [F.col("i.conv_id").eqNullSafe(F.col(f"{t}.conv_id")) for t in ("r", "d")]
    joined = (ids.alias("i").join(reports.alias("r"), same[0], "left").join(digests.alias("d"), same[1], "left"))
    zeros = [F.coalesce(F.col(f"r.{c}"), F.lit(0).cast("long")).alias(c)
             for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *zeros, F.coalesce("r.audit", F.lit("")).alias("audit"),
                         F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
