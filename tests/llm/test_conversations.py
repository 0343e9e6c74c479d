import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import conversations
from corpusmill.llm.conversations import (TAILS, Row, Span, cheapest, damage, damaged_and_repaired, reachable,
                                          repair_conversations, repaired, span_of, state_after)

WELL_FORMED = re.compile(r"(s?(ua)+)?")
KEEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def dijkstra(rows):
    """Cheapest audit, ASCII-least, and repaired rows of (role, text, fault); written apart from the operator."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, left = heapq.heappop(queue)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(left)
        given = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[given]
        heapq.heappush(queue, (cost + 5, audit + "I", i, given, (*left, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, left))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, given, (*left, (name, text))))
                if (last, role[:1]) in KEEPS:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*left, (role, text))))


def brute(rows):
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest) per conversation."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role if role is not None else " ", " " if text is None else text))
    out = Counter()
    for conv, talk in talks.items():
        talk.sort()
        seen, faults = set(), []
        for _, _, role, text in talk:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = {t for has, t, *_ in talk if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, left = dijkstra(faults)
        assert WELL_FORMED.fullmatch("".join(r[:1] for r, _ in left))
        count = Counter(f for *_, f in faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[(conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)] += 1
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def talk(conv, n, seed, spread=1):
    rng = random.Random(seed)
    roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * n
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "system", "tool", "u", "", None]) if rng.random() < 0.2 else roles[i]
        text = rng.choice(["", " \n", None, "ok.", "ok.", "cut"]) if rng.random() < 0.25 else f"text {rng.random()}."
        rows.append((conv, None if rng.random() < 0.02 else rng.randrange(n * spread) if spread > 1 else i, role, text))
    return rows


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows],
                                 "conv_id long, turn long, role string, text string, cost string, run long")
    reports, turns = repair_conversations(docs)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.repaired_digests(turns).collect()}
    return Counter((*r, digests[r.conv_id]) for r in reports.collect())


@pytest.fixture(scope="module")
def rows():
    out = [r for i in range(150) for r in talk(i, i % 9, 1000 + i, 1 + i % 2)]
    out += talk(900, 260, 5) + talk(901, 120, 6, 3) + talk(None, 12, 7)
    out += [(902, 0, "user", "same.")] * 30 + [(902, t, "user", "same.") for t in range(5, 40)]
    out += [(903, t, "assistant", "") for t in range(7)] + [(904, None, "user", "a."), (904, None, "assistant", "b.")]
    out += [(905, 2**62, "user", "far."), (905, -2**62, "assistant", "apart"), (906, 0, "user", "long " * 300_000 + ".")]
    return out


def test_search_agrees_with_shortest_paths():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice("sua?"), "x", rng.choice(["", "", "", "blank", "truncated"])) for _ in range(rng.randrange(12))]
        kept = [Row(r, t, f != "blank", f == "truncated", int(f == "blank")) for r, t, f in rows]
        live = [r for r in kept if r.live]
        cost, edits = cheapest([r.role for r in live], [r.cut for r in live], 0, [5 * len(t) for t in TAILS])
        audit = conversations.with_deletions(edits, kept) + TAILS[state_after(edits, [r.role for r in live])]
        want = dijkstra(rows)
        assert (cost + 2 * sum(r.dead for r in kept), audit) == want[:2]
        assert [r for r, _ in repaired(kept, audit, 0)] == [
            {"s": "s", "u": "u", "a": "a"}.get(r, r) for r, _ in want[2]]


def test_segments_compose_to_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        rows = [Row(rng.choice("ssuuuaaa?"), "x", rng.random() < 0.9, rng.random() < 0.1, rng.randrange(2))
                for _ in range(rng.randrange(1, 25))]
        rows = [Row(r.role, r.text, r.live, r.cut and r.live, r.dead if r.live else 1) for r in rows]
        cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(4)]})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        span, betweens, audits = Span(), [], []
        for part in parts:
            own, audit = span_of(part)
            span, between = span.joined(own)
            betweens.append(between)
            audits.append(audit)
        cost, state = span.end()
        out = TAILS[state]
        for between, audit in zip(reversed(betweens), reversed(audits)):
            before = between[0][state]
            out, state = audit[before][state] + out, before
        units = [(r.role, "x", "truncated" if r.cut and j == 0 else "blank" if j or not r.live else "")
                 for r in rows for j in range(r.dead + r.live)]
        assert (cost, out) == dijkstra(units)[:2]


def test_reachable_states():
    assert reachable([], 2, 2) and not reachable([], 2, 3) and not reachable(["u"], 0, 1) and reachable(["s"], 0, 1)
    assert not reachable(["s"], 2, 1) and not reachable(["s"], 3, 0) and reachable(["?"], 3, 2)


def test_repairs_agree_with_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_small_segments_give_the_same(spark, rows, monkeypatch):
    # workers are forked before the patch, so the size travels with the function
    text = conversations._segments

    def small(batches):
        conversations.SEGMENT_ROWS = 4
        try:
            yield from text(batches)
        finally:
            conversations.SEGMENT_ROWS = 100

    monkeypatch.setattr(conversations, "_segments", small)
    assert found(spark, rows) == brute(rows)


def test_damage(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in damage(docs).collect()) == Counter(damaged(rows))


def test_damaged_and_repaired(spark, rows):
    gone = [(5000 + i, t, "user", "x.") for i in range(60) for t in range(1)]
    every = rows + gone
    docs = spark.createDataFrame([(*r, "x") for r in every],
                                 "conv_id long, turn long, role string, text string, audit string")
    want = brute(damaged(every))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in {r[0] for r in every} - {w[0] for w in want}:
        want[(conv, *nothing)] += 1
    assert any(w[1:] == nothing for w in want)
    assert Counter(tuple(r) for r in damaged_and_repaired(docs).collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    reports, turns = repair_conversations(docs)
    assert reports.count() == turns.count() == damaged_and_repaired(docs).count() == 0
