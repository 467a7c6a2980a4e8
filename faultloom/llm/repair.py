"""Conversation structure repair: the cheapest edits that make turns alternate, by dynamic programming.

The role initials of a repaired conversation are ``(s?(ua)+)?``. Edits and their costs: K keep 0, R set the
role to user or assistant 1, D delete 2, I insert an empty user or assistant turn 5. Blank and repeated
turns must be deleted; a truncated turn that stays costs 5 more. Of the cheapest edit sequences the one whose
initials are least in ASCII is taken.

Costs to the end are computed backwards, one vector of four states (nothing yet, after s, after u, after a)
per turn. Vectors are stored only at every square root of the number of turns; walking forward, each block's
vectors are computed again from the checkpoint at its end, and an edit is tight if it leads from one vector
to the next at its cost.

Turns are dealt to tasks by ranges of (conversation, turn, role, text), so a conversation with most of the
rows is cut into segments, at most one per task. A segment is a 4 x 4 matrix of least costs; matrices of a
conversation combine backwards to the vector at each segment's end and states go forward through them. The
table for that has at most two rows per task, as only a task's first and last segment can go on elsewhere.
Equal rows are combined before any shuffle and travel as one row with their number.

Defined cases: a null role or text is one blank. Turns are in order of turn (null first), then role, then
text. A null conversation id is a conversation. A role whose first letter is not s, u or a (or none) can't be
kept. Where no turn stands (number 0) in a conversation, or in a task's segment of it,
there is one row without an edit. Other columns are ignored. The
digest of a conversation is one hash over all its turns, which stream through one task in order.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import settle, small_batches

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: states: nothing yet, after s, after u, after a
_FAR = 1 << 60
_NEXT = (2, 2, 3, 2)  # where a user or assistant turn leads, whichever the state asks for
_NAMES = ("user", "user", "assistant", "user")
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
#: costs from the end of a conversation: what is missing is inserted
END = (0, 2 * INSERT, INSERT, 0)
#: code of a turn: 0 must go, else 1 + 2 * place of its initial in _KEPT + (1 if truncated)
_INITIALS = list(_KEPT)
_OF_CODE = [None] + [(_KEPT[i], TRUNCATED * t) for i in _INITIALS for t in (0, 1)]


# --- the dynamic programme --------------------------------------------------------

def _with_inserts(b: tuple) -> tuple:
    second = min(b[2], INSERT + b[3])
    return (min(b[0], INSERT + second), min(b[1], INSERT + second), second, min(b[3], INSERT + b[2]))


def _back(code: int, after: tuple) -> tuple:
    """Least costs before a turn from those after it."""
    if not code:
        return _with_inserts(tuple(DELETE + c for c in after))
    kept, extra = _OF_CODE[code]
    return _with_inserts(tuple(
        min(DELETE + after[s], REROLE + extra + after[_NEXT[s]], _FAR if kept[s] is None else KEEP + extra + after[kept[s]])
        for s in range(4)
    ))


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before these turns to each state after them, row by row."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else _FAR for s in range(4))
        for code in reversed(codes):
            v = tuple(min(c, _FAR) for c in _back(code, v))
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: bytes, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of these turns and the state they lead to.

    end: costs after them; last: nothing follows, so what is missing is inserted.
    """
    n = len(codes)
    size = max(1, math.isqrt(max(n - 1, 0)) + 1)
    checkpoints = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = _back(codes[i], v)
        if i % size == 0:
            checkpoints[i] = v
    out = []
    for a in range(0, n, size):
        b = min(a + size, n)
        vectors = [checkpoints[b]]
        for i in range(b - 1, a - 1, -1):
            vectors.append(_back(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(a, b):
            here, after, code = vectors[i - a], vectors[i - a + 1], codes[i]
            kept, extra = _OF_CODE[code] if code else (None, 0)
            while True:
                cost = here[state]
                if cost == DELETE + after[state]:
                    out.append("D")
                    break
                if cost == INSERT + here[_NEXT[state]]:
                    out.append("I")
                    state = _NEXT[state]
                    continue
                if kept[state] is not None and cost == KEEP + extra + after[kept[state]]:
                    out.append("K")
                    state = kept[state]
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
    if last:
        missing = END[state] // INSERT
        out.append("I" * missing)
        state = 0 if state == 0 else 3
    return "".join(out), state


# --- segments -----------------------------------------------------------------------

def _code() -> Column:
    initial = F.substring("role", 1, 1)
    place = F.lit(_INITIALS.index(""))
    for name in _INITIALS[:-1]:
        place = F.when(initial == name, _INITIALS.index(name)).otherwise(place)
    return F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(
        1 + 2 * place + F.when(F.col("fault") == "truncated", 1).otherwise(0)
    ).cast("int")


_TURN = "conv_id long, turn long, role string, text string, n long, fault string, code int"
_ORDERED = f"{_TURN}, part long, seg long, at long, edge boolean, codes binary"
_ORDERED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()),
    ("fault", pa.string()), ("code", pa.int32()), ("part", pa.int64()), ("seg", pa.int64()), ("at", pa.int64()),
    ("edge", pa.bool_()), ("codes", pa.binary()),
])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns with their segment and place, and at a segment's end a row (at -1) with all its codes."""
    part = TaskContext.get().partitionId()
    seg, at, conv, codes = -1, 0, None, bytearray()

    def closed(edge: bool) -> pa.RecordBatch:
        row = dict(conv_id=conv, part=part, seg=seg, at=-1, edge=edge, codes=bytes(codes))
        return pa.RecordBatch.from_pylist([row], schema=_ORDERED_ARROW)

    for batch in batches:
        convs, counts, kinds = (batch.column(c).to_pylist() for c in ("conv_id", "n", "code"))
        opens = [i for i in range(len(convs)) if (convs[i] != convs[i - 1] if i else seg < 0 or convs[0] != conv)]
        bounds = [*([] if 0 in opens else [0]), *opens, len(convs)]
        for a, b in itertools.pairwise(bounds):
            if a in opens:
                if seg >= 0:
                    yield closed(seg == 0)
                seg, at, conv, codes = seg + 1, 0, convs[a], bytearray()
            for n, code in zip(counts[a:b], kinds[a:b]):
                # all but the first of equal turns are repeats
                codes += bytes([code]) + bytes(n - 1) if n else b""
            piece, size = batch.slice(a, b - a), b - a
            const = lambda value, kind: pa.array([value] * size, kind)  # noqa: B023
            yield pa.RecordBatch.from_arrays([
                *piece.columns, const(part, pa.int64()), const(seg, pa.int64()), pa.array(range(at, at + size), pa.int64()),
                const(None, pa.bool_()), const(None, pa.binary()),
            ], schema=_ORDERED_ARROW)
            at += size
    if seg >= 0:
        yield closed(True)


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f[["conv_id", "part", "seg"]].assign(matrix=[matrix(c) for c in f["codes"]])


def _ends(f: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of every segment of a conversation."""
    f = f.sort_values(["part", "seg"])
    after, out = END, []
    for m in reversed(f["matrix"].tolist()):
        out.append(list(after))
        after = tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4))
    last = [False] * (len(f) - 1) + [True]
    return pd.DataFrame({"part": f["part"], "seg": f["seg"], "end": out[::-1], "last": last})


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        exits = [[walk(c, tuple(map(int, e)), s, z)[1] for s in range(4)] for c, e, z in zip(f["codes"], f["end"], f["last"])]
        yield f[["conv_id", "part", "seg", "end", "last"]].assign(exits=exits)


def _entries(f: pd.DataFrame) -> pd.DataFrame:
    """The state that leads into every segment of a conversation."""
    f = f.sort_values(["part", "seg"])
    state, entry = 0, []
    for exits in f["exits"]:
        entry.append(state)
        state = int(exits[state])
    return f[["part", "seg", "end", "last"]].assign(entry=entry)


def _walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        walks = []
        for codes, end, last, entry in zip(f["codes"], f["end"], f["last"], f["entry"]):
            known = end is not None
            walks.append(walk(codes, tuple(map(int, end)) if known else END, int(entry) if known else 0, bool(last) if known else True)[0])
        yield f[["conv_id", "part", "seg"]].assign(
            edits=walks, entry=[0 if e is None else int(x) for e, x in zip(f["end"], f["entry"])]
        )


# --- repair --------------------------------------------------------------------------

_EDITS = (
    "conv_id long, part long, step long, edit string, fault string, turn long, old_role string, role string, text string"
)
_EDITS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("fault", pa.string()),
    ("turn", pa.int64()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string()),
])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each segment on its turns; a segment's edits come before its turns."""
    conv = part = None
    edits, k, state, step = "", 0, 0, 0
    any_ = True

    def inserts(upto_end: bool) -> list[dict]:
        nonlocal k, state, step, any_
        out = []
        while k < len(edits) and edits[k] == "I":
            out.append(dict(conv_id=conv, part=part, step=step, edit="I", role=_NAMES[state], text=""))
            state, k, step, any_ = _NEXT[state], k + 1, step + 1, True
        if upto_end and not any_:
            out.append(dict(conv_id=conv, part=part, step=step))
        return out

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["at"] < 0:
                out += inserts(True)
                conv, part, edits, state = row["conv_id"], row["part"], row["edits"], row["entry"]
                k, step, any_ = 0, 0, False
                continue
            for copy in range(row["n"]):
                out += inserts(False)
                edit, role, text = edits[k], row["role"], row["text"]
                if edit == "R":
                    role, state = _NAMES[state], _NEXT[state]
                elif edit == "K":
                    state = _KEPT[role[:1]][state]
                else:
                    role = text = None
                fault = row["fault"] if copy == 0 or row["fault"] == "blank" else "duplicate"
                out.append(dict(conv_id=conv, part=part, step=step, edit=edit, fault=fault, turn=row["turn"],
                                old_role=row["role"], role=role, text=text))
                k, step, any_ = k + 1, step + 1, True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_EDITS_ARROW)
    out = inserts(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_EDITS_ARROW)


def repair(turns: DataFrame) -> DataFrame:
    """All edits of all conversations, in order of (conv_id, part, step).

    turns: conv_id, turn, role, text, and n, how often the row stands (0: not at all). Gives edit (K R D I;
    null in the row of a segment without turns), the turn's fault (blank, duplicate, truncated or
    null), its old role, and the role and text that stay (null for D).
    """
    small_batches(turns.sparkSession)
    c = F.col
    rows = turns.select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"),
        *[F.when(c("n") > 0, F.coalesce(c(x).cast("string"), F.lit(" "))).alias(x) for x in ("role", "text")],
        c("n").cast("long").alias("n"),
    )
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), c("role"), c("text")), 256)
    distinct = settle(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", key), "turns")
    first = distinct.where("n > 0").groupBy(c("conv_id").alias("_conv"), c("key").alias("_key")).agg(F.min(F.struct("turn")).alias("_first"))
    # the null-safe key as one value: a join on it can be split where it is skewed
    both = lambda conv, k: F.sha2(F.concat_ws(":", F.coalesce(c(conv).cast("string"), F.lit("-")), c(k)), 256)
    first = first.select(both("_conv", "_key").alias("_both"), "_first")
    kept = F.rtrim(c("text"), F.lit(BLANKS))
    ended = F.substring(kept, -1, 1).isin(".", "!", "?")
    fault = (
        F.when(kept == "", "blank").when(~c("_first.turn").eqNullSafe(c("turn")), "duplicate").when(~ended, "truncated")
    )
    told = (
        distinct.withColumn("_both", both("conv_id", "key")).join(first, "_both", "left")
        .withColumn("fault", F.when(c("n") > 0, fault)).withColumn("code", _code())
        .select("conv_id", "turn", "role", "text", "n", "fault", "code")
    )
    order = ("conv_id", "turn", "role", "text")
    ordered = settle(told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, _ORDERED), "ordered")

    segments = ordered.where("at < 0").select("conv_id", "part", "seg", "edge", "codes")
    edges = segments.where("edge").drop("edge")
    ends = settle(
        edges.mapInPandas(_matrices, "conv_id long, part long, seg long, matrix array<long>")
        .groupBy("conv_id").applyInPandas(_ends, "part long, seg long, end array<long>, last boolean"),
        "ends",
    )
    entries = settle(
        edges.join(ends, ["part", "seg"])
        .mapInPandas(_exits, "conv_id long, part long, seg long, end array<long>, last boolean, exits array<int>")
        .groupBy("conv_id").applyInPandas(_entries, "part long, seg long, end array<long>, last boolean, entry int"),
        "entries",
    )
    walks = segments.join(entries, ["part", "seg"], "left").select(
        "conv_id", "part", "seg", "codes", "end", "last", F.coalesce("entry", F.lit(0)).alias("entry")
    ).mapInPandas(_walks, "conv_id long, part long, seg long, edits string, entry int")
    wanted = ["conv_id", "part", "seg", "at", "turn", "role", "text", "n", "fault", "edits", "entry"]
    marks = walks.select("*", F.lit(-1).cast("long").alias("at"))
    both_ = ordered.where("at >= 0").unionByName(marks, allowMissingColumns=True).select(*wanted)
    return both_.repartition("part", "seg").sortWithinPartitions("part", "seg", "at").mapInArrow(_apply, _EDITS)


# --- the query -----------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of rows damaged by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("n"),
    )


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its edits come one after another and are never held together."""
    state = None

    def closed() -> dict:
        s = state
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        return dict(conv_id=s["conv"], gaps=gaps, **{f: s[f] for f in ("blank", "duplicate", "truncated", "illegal", "cost")},
                    audit="".join(s["audit"]), repaired_sha256=s["hash"].hexdigest())

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if state is None or state["conv"] != r["conv_id"]:
                if state:
                    out.append(closed())
                state = dict(conv=r["conv_id"], blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit=[], turns=0,
                             low=0, high=0, before=None, any=False, hash=hashlib.sha256())
            s, edit = state, r["edit"]
            if edit is None:
                continue
            s["audit"].append(edit)
            s["cost"] += _COST[edit] + (TRUNCATED if edit != "D" and r["fault"] == "truncated" else 0)
            if r["fault"]:
                s[r["fault"]] += 1
            if edit != "I":
                initial = r["old_role"][:1]
                s["illegal"] += s["before"] is not None and s["before"] + initial not in ("su", "ua", "au")
                s["before"] = initial
                turn = r["turn"]
                if turn is not None and (not s["turns"] or turn != s["high"]):
                    s["low"] = s["low"] if s["turns"] else turn
                    s["high"], s["turns"] = turn, s["turns"] + 1
            if edit != "D":
                s["hash"].update((b"\n" if s["any"] else b"") + f"{r['role']}:{r['text']}".encode())
                s["any"] = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
    if state:
        yield pa.RecordBatch.from_pylist([closed()], schema=_DIGEST)


def digests(edits: DataFrame) -> DataFrame:
    """What was wrong with each conversation, what the repair costs, its edits and a hash of what it leaves."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "step").mapInArrow(_digests, schema)


def report(conversations: DataFrame) -> DataFrame:
    """op12: repairs of all damaged conversations."""
    return digests(repair(damage(conversations)))
