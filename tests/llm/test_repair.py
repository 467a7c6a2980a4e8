"""Conversation repair against enumeration of all edits, and the query against a plain-Python version."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from faultloom.llm import queries, repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SAID = ["Hello.", "Why?", "no end", "", " \t\n", "Ends! \r\n", "a", " x", " . y"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = text.rstrip(repair.BLANKS)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows):
    """(cost, audit) by trying every edit sequence with at most two insertions at a place."""
    kinds = faults(rows)
    gaps = [("", 0), ("u", 5), ("a", 5), ("ua", 10), ("au", 10)]
    options = []
    for (role, _), fault in zip(rows, kinds):
        extra = 5 if fault == "truncated" else 0
        stays = [] if fault in ("blank", "duplicate") else [("K", role[:1] or "x", extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append([("D", "", 2), *stays])
    best = None
    for edits in itertools.product(*options):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            initials = fill[0][0] + "".join(e[1] + f[0] for e, f in zip(edits, fill[1:]))
            if LEGAL.match(initials):
                audit = "I" * len(fill[0][0]) + "".join(e[0] + "I" * len(f[0]) for e, f in zip(edits, fill[1:]))
                found = (sum(e[2] for e in edits) + sum(f[1] for f in fill), audit)
                best = found if best is None or found < best else best
    return best


def searched(rows):
    """(cost, audit, repaired turns) by a best-first search over whole prefixes."""
    kinds = faults(rows)
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        to, name = (2, "user") if state != 2 else (3, "assistant")
        heapq.heappush(queue, (cost + 5, audit + "I", i, to, (*out, (name, ""))))
        if i < len(rows):
            (role, text), fault = rows[i], kinds[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                heapq.heappush(queue, (cost + 1 + extra, audit + "R", i + 1, to, (*out, (name, text))))
                kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                if kept:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, kept, (*out, (role, text))))


def codes(rows):
    initials = ["s", "u", "a", ""]
    return bytes(
        0 if f in ("blank", "duplicate") else 1 + 2 * initials.index(r[:1] if r[:1] in "sua" else "") + (f == "truncated")
        for (r, _), f in zip(rows, faults(rows))
    )


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(SAID) + rng.choice(["", str(rng.randrange(9)) + "."]))
            for _ in range(n)]


def test_walk_by_enumeration():
    rng = random.Random(2)
    for n in (0, 1, 2, 2, 3, 3, 3):
        for _ in range(4):
            rows = random_rows(rng, n)
            cost, audit = enumerated(rows)
            assert searched(rows)[:2] == (cost, audit)
            assert repair.walk(codes(rows), repair.END, 0, True)[0] == audit


def test_walk_by_search():
    rng = random.Random(3)
    for n in [*range(4, 40), 200, 500]:
        rows = random_rows(rng, n)
        assert repair.walk(codes(rows), repair.END, 0, True)[0] == searched(rows)[1]


def test_segments_combine():
    rng = random.Random(4)
    for _ in range(30):
        rows = random_rows(rng, 60)
        code, cuts = codes(rows), sorted(rng.sample(range(61), 3))
        parts = [code[a:b] for a, b in itertools.pairwise([0, *cuts, 60])]
        ends = [repair.END]
        for part in reversed(parts[1:]):
            m = repair.matrix(part)
            ends.insert(0, tuple(min(m[4 * s + t] + ends[0][t] for t in range(4)) for s in range(4)))
        state, out = 0, ""
        for i, (part, end) in enumerate(zip(parts, ends)):
            edits, state = repair.walk(part, end, state, i == len(parts) - 1)
            out += edits
        assert out == searched(rows)[1]


def brute(conversations):
    """The contract in plain Python."""
    by_conv = {}
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = by_conv.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = set()
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [r[1:] for r in rows]
        kinds, turns = faults(said), {r[0] for r in rows} - {None}
        cost, audit, left = searched(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    out = queries.QUERIES["op12_conversation_repair"](spark, sf_dir).collect()
    assert {tuple(r) for r in out} == brute([(r.conv_id, r.turn, r.role, r.text) for r in rows])
    assert len(out) == len({r.conv_id for r in rows})


@pytest.mark.parametrize("parts", [1, 8])
def test_hot_and_odd_conversations(spark, parts):
    rng = random.Random(parts)
    rows = []
    for conv in [None, *range(60)]:
        rows += [(conv, rng.choice([None, rng.randrange(12)]), *said) for said in random_rows(rng, rng.randrange(12))]
    rows += [(7, t, *said) for t, said in enumerate(random_rows(rng, 3000))]  # most rows
    rows += [(8, 5, "user", "the same")] * 500
    rows += [(9, 1, None, None), (9, None, None, "x."), (10, -3, "assistant", "z" * 400000)]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, n long, code string, part string")
    out = repair.report(table.repartition(parts)).collect()
    assert {tuple(r) for r in out} == brute(rows) and len(out) == len({r[0] for r in rows})


def test_edits(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Yes."), (2, 0, "user", " ")]
    turns = spark.createDataFrame([(*r, 1) for r in rows] + [(3, 0, "user", "gone", 0)], "conv_id long, turn long, role string, text string, n long")
    rows = repair.repair(turns).collect()
    out = [(r.conv_id, r.step, r.edit, r.fault, r.role, r.text) for r in sorted(rows, key=lambda r: (r.conv_id, r.step))]
    assert out == [
        (1, 0, "K", None, "system", "Be kind."), (1, 1, "K", None, "user", "Hi."), (1, 2, "D", "duplicate", None, None),
        (1, 3, "R", None, "assistant", "Yes."), (2, 0, "D", "blank", None, None), (3, 0, None, None, None, None),
    ]
    assert repair.digests(repair.repair(turns.limit(0))).collect() == []
