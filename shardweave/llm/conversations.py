"""Repair of conversation structure: the cheapest edits after which a system turn at most and then pairs of user and
assistant turns are left.

Rows are sorted by conversation and turn into range partitions and read as a stream.  A conversation that lies
inside one partition and has at most ``FRAGMENT`` rows is repaired at once.  What touches the edge of a partition,
and every longer conversation, is cut into fragments: each fragment is searched once for every pair of grammar
states it may be entered and left in, and a last step over these small tables picks the path.  No task holds the
texts of a long conversation; the only things of its length in one place are its search tables and its audit string.

The search is iterative-deepening A*: depth first in ASCII order of the edits' initials under a cost bound that
rises to the least cost a failed search leaves possible, with a table of what each failed state needs at least.
The bound reaches the least cost before it passes it, so the first accepting path is the cheapest and, among the
cheapest, the first in ASCII order.

Null roles and texts count as one space; null turns sort first and take no part in gaps; a null conversation id is a
conversation.  Rows with the same turn are taken in order of role and text.  Repeated rows are duplicates.  A
conversation without rows that are alive costs nothing.  An empty table gives no rows.  Columns that are not named
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shardweave.llm.shared import stored

#: Rows and characters of a fragment; conversations beyond either are cut.
FRAGMENT = 128
FRAGMENT_CHARS = 8 << 20
#: Results of one Arrow batch.
ROWS_OUT, CHARS_OUT = 2_000, 8 << 20

SPACES = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3

# Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60

Row = tuple[str, bool, bool]  # initial of the role, has to go, is cut short


# --- one fragment ---------------------------------------------------------------------


def faults(rows: list[tuple[str, str]], known: Iterable[bytes] = ()) -> tuple[list[Row], tuple[int, int, int]]:
    """(rows for the search, (blank, duplicate, truncated)); ``known`` are marks of earlier fragments."""
    seen, out, counts = set(known), [], [0, 0, 0]
    for role, text in rows:
        body = text.rstrip(SPACES)
        if not body:
            fault = 0
        elif (m := mark(role, text)) in seen:
            fault = 1
        else:
            seen.add(m)
            fault = 2 if body[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        out.append((role[:1], fault in (0, 1), fault == 2))
    return out, (counts[0], counts[1], counts[2])


def mark(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _edits(rows: list[Row], i: int, state: int, states: tuple[int, ...]) -> list[tuple[str, int, int, int]]:
    """(initial, cost, next row, next state) of every edit that leads to one of ``states``, in ASCII order of the initials."""
    return [e for e in _all_edits(rows, i, state) if e[3] in states]


def _all_edits(rows: list[Row], i: int, state: int) -> list[tuple[str, int, int, int]]:
    wanted = ASSISTANT if state == USER else USER
    if i == len(rows):
        return [("I", INSERT, i, wanted)]
    initial, gone, short = rows[i]
    found = [("D", DELETE, i + 1, state), ("I", INSERT, i, wanted)]
    if not gone:
        extra = CUT_SHORT if short else 0
        after = _AFTER.get((state, initial))
        if after is not None:
            found.append(("K", KEEP + extra, i + 1, after))
        found.append(("R", REROLE + extra, i + 1, wanted))
    return found


def cheapest(rows: list[Row], start: int, goals: tuple[int, ...], needs: dict[tuple[int, int], int] | None = None) -> tuple[int, str] | None:
    """(cost, initials) of the cheapest edits that lead from ``start`` to one of ``goals``, the least in ASCII order
    among equally cheap ones; None if there are none.  ``needs`` is the table of failed states, which other
    starts may share."""
    # no edit leads back to the states before the first user turn
    early = max(goals) <= SYSTEM
    if early and start not in goals and (start != START or not any(initial == "s" and not gone for initial, gone, _ in rows)):
        return None
    states = tuple(range(max(goals) + 1)) if early else (START, SYSTEM, USER, ASSISTANT)
    needs = {} if needs is None else needs
    floor = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        floor[i] = floor[i + 1] + (DELETE if rows[i][1] else CUT_SHORT if rows[i][2] else 0)
    edits: dict[tuple[int, int], list[tuple[str, int, int, int]]] = {}

    def opened(i: int, state: int, budget: int) -> list:
        if (i, state) not in edits:
            edits[i, state] = _edits(rows, i, state, states)
        return [i, state, budget, 0, _NEVER]

    while True:
        bound = needs.get((0, start), floor[0])
        trail, stack = [], [opened(0, start, bound)]
        while stack:
            frame = stack[-1]
            i, state, budget, k, least = frame
            if i == len(rows) and state in goals:
                return bound - budget, "".join(trail)
            options = edits[i, state]
            if k < len(options):
                frame[3] += 1
                letter, cost, j, after = options[k]
                need = cost + needs.get((j, after), floor[j])
                if need > budget:
                    frame[4] = min(least, need)
                else:
                    trail.append(letter)
                    stack.append(opened(j, after, budget - cost))
            else:
                stack.pop()
                needs[i, state] = max(least, needs.get((i, state), 0))
                if stack:
                    trail.pop()
                    stack[-1][4] = min(stack[-1][4], stack[-1][2] - budget + needs[i, state])


def edited(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The rows after the edits."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        wanted = "assistant" if state == USER else "user"
        role, text = (wanted, "") if letter == "I" else rows[i]
        if letter == "R":
            role = wanted
        i += letter != "I"
        state = _AFTER[state, role[:1]]
        out.append((role, text))
    return out


def shown(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _measures(rows: list[tuple[int | None, str, str]]) -> dict:
    """What two neighbouring fragments can be joined from: turns and initials at the ends, counts between."""
    turns = sorted({t for t, _, _ in rows if t is not None})
    initials = [role[:1] for _, role, _ in rows]
    return {
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


# --- the stream over sorted rows ------------------------------------------------------


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, bool]]:
    """(id, rows, whole) of runs of rows with the same id; long runs come in several parts."""
    current, rows, chars, begun, cut, seen = None, [], 0, False, False, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "alive")]
        for conv, turn, role, text, alive in zip(*columns):
            if begun and conv != current:
                yield current, rows, not cut and seen > 0
                rows, chars, cut, seen = [], 0, False, seen + 1
            elif len(rows) >= FRAGMENT or chars > FRAGMENT_CHARS:
                yield current, rows, False
                rows, chars, cut = [], 0, True
            current, begun = conv, True
            if alive:
                rows.append((turn, role, text))
                chars += len(role) + len(text)
    if begun:
        yield current, rows, False


def _walk(kind: pa.DataType):
    turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema(
        [("conv", kind), ("at", pa.int64()), ("whole", pa.bool_()), *[(n, pa.int64()) for n in numbers], ("audit", pa.string()), ("repaired", pa.string()), ("rows", pa.list_(turn))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        out, chars = [], 0
        for conv, rows, whole in _conversations(batches):
            row = {"conv": conv, "at": at, "whole": whole}
            at += 1
            if whole:
                plain = [(role, text) for _, role, text in rows]
                marked, counts = faults(plain)
                m = _measures(rows)
                cost, audit = cheapest(marked, START, ENDS)
                values = (_gaps(m["low"], m["high"], m["turns"]), *counts, m["illegal"], cost)
                row |= dict(zip(numbers, values)) | {"audit": audit, "repaired": shown(edited(plain, audit))}
            else:
                row["rows"] = [{"turn": t, "role": r, "text": x} for t, r, x in rows]
            out.append(row)
            chars += sum(len(x) for _, _, x in rows)
            if len(out) >= ROWS_OUT or chars > CHARS_OUT:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# --- conversations in fragments -------------------------------------------------------

_TABLE = "array<struct<enter:int,leave:int,cost:long,audit:string>>"
_MEASURE = "low long, high long, turns long, illegal long, first string, last string, blank long, duplicate long, truncated long"


def _per_row(fn, inputs: list[str], schema: pa.Schema):
    """An Arrow function that applies ``fn`` to each row's inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # one row at a time: a fragment may hold megabytes
                values = [batch.column(c)[k].as_py() for c in inputs]
                yield pa.RecordBatch.from_pylist([fn(*values)], schema)

    return run


def _marks(conv, at, rows) -> dict:
    found = {mark(r["role"], r["text"]) for r in rows if r["text"].rstrip(SPACES)}
    return {"conv": conv, "at": at, "marks": sorted(found)}


def _searched(conv, at, rows, known) -> dict:
    plain = [(r["role"], r["text"]) for r in rows]
    marked, counts = faults(plain, known or ())
    table = []
    for leave in range(4):
        needs: dict[tuple[int, int], int] = {}
        for enter in range(4):
            found = cheapest(marked, enter, (leave,), needs)
            if found is not None:
                table.append({"enter": enter, "leave": leave, "cost": found[0], "audit": found[1]})
    m = _measures([(r["turn"], r["role"], r["text"]) for r in rows])
    return {"conv": conv, "at": at, "table": table} | m | dict(zip(("blank", "duplicate", "truncated"), counts))


def _joined(conv, parts) -> dict:
    """The cheapest way through the fragments' tables, and the sums of what they measured."""
    # best[j][state]: (cost, audit of fragment j, state after it) of the cheapest way from there to the end
    best: list[dict[int, tuple[int, str, int]]] = [{}] * len(parts) + [{s: (0, "", s) for s in ENDS}]

    def letters(j: int, state: int) -> Iterator[str]:
        while j < len(parts):
            _, audit, state = best[j][state]
            yield from audit
            j += 1

    def before(j: int, a: tuple[int, str, int], b: tuple[int, str, int]) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        pairs = zip_longest(chain(a[1], letters(j + 1, a[2])), chain(b[1], letters(j + 1, b[2])), fillvalue="")
        return next((x < y for x, y in pairs if x != y), False)

    for j in range(len(parts) - 1, -1, -1):
        found: dict[int, tuple[int, str, int]] = {}
        for e in parts[j]["table"]:
            rest = best[j + 1].get(e["leave"])
            if rest is not None:
                way = (e["cost"] + rest[0], e["audit"], e["leave"])
                if e["enter"] not in found or before(j, way, found[e["enter"]]):
                    found[e["enter"]] = way
        best[j] = found
    state, pieces = START, []
    for j, part in enumerate(parts):
        _, audit, after = best[j][state]
        pieces.append({"at": part["at"], "enter": state, "edits": audit})
        state = after
    total = {n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
    held = [p for p in parts if p["first"] is not None]
    total["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(held, held[1:]))
    timed = [p for p in parts if p["low"] is not None]
    total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    gaps = _gaps(timed[0]["low"], timed[-1]["high"], total.pop("turns")) if timed else 0
    total.pop("turns", None)
    return {"conv": conv, "gaps": gaps, "cost": best[0][START][0], "audit": "".join(p["edits"] for p in pieces), "pieces": pieces} | total


def _repaired(conv, at, rows, enter, edits) -> dict:
    done = edited([(r["role"], r["text"]) for r in rows], edits, enter)
    return {"conv": conv, "at": at, "rows_left": len(done), "text": shown(done)}


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str, alive: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, parts) of all conversations.

    Reports: ``conv`` and its gaps, blank, duplicate, truncated, illegal, cost, audit and ``repaired``, the repaired
    conversation as lines ``role:text``.  ``repaired`` is null for conversations in parts (conv, at, rows_left, text):
    their lines are the texts of their parts in order of ``at``.  Rows that are not ``alive`` count for nothing,
    but their conversation is in the result.
    """
    space = F.lit(" ")
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), (F.lit(True) if alive is None else alive).alias("alive"),
    )
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "tie")]
    ranged = named.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    kind = named.schema["conv"].dataType
    id_type = kind.simpleString()
    numbers = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    part = "array<struct<turn:long,role:string,text:string>>"
    arrow_id = to_arrow_type(kind)
    walked = stored(ranged.mapInArrow(_walk(arrow_id), f"conv {id_type}, at long, whole boolean, {numbers}, repaired string, rows {part}"), "conversations")
    results = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = walked.where("whole").select(*results, "repaired")
    cut = walked.where("not whole").select("conv", "at", "rows")

    # rows that an earlier fragment of the conversation has too
    binary = pa.list_(pa.binary())
    marks = cut.mapInArrow(_per_row(_marks, ["conv", "at", "rows"], pa.schema([("conv", arrow_id), ("at", pa.int64()), ("marks", binary)])), f"conv {id_type}, at long, marks array<binary>")
    each = stored(marks.select("conv", "at", F.explode("marks").alias("mark")), "conversation-marks")
    first = each.groupBy("conv", "mark").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv").alias("__conv"), F.col("mark").alias("__mark"), "first_at")
    again = each.join(first, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("mark") == F.col("__mark")) & (F.col("at") > F.col("first_at")))
    known = again.groupBy(F.col("at").alias("__at")).agg(F.collect_list("mark").alias("known"))

    schema = pa.schema(
        [("conv", arrow_id), ("at", pa.int64()), ("table", pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
        + [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _MEASURE.split(", ")]
    )
    inputs = cut.join(known, F.col("at") == F.col("__at"), "left")
    searched = inputs.mapInArrow(_per_row(_searched, ["conv", "at", "rows", "known"], schema), f"conv {id_type}, at long, table {_TABLE}, {_MEASURE}")
    fields = [c for c in schema.names if c not in ("conv", "at")]
    parts = searched.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", *fields))).alias("parts"))
    piece = "array<struct<at:long,enter:int,edits:string>>"
    out = pa.schema(
        [("conv", arrow_id), *[(n, pa.int64()) for n in results[1:-1]], ("audit", pa.string())]
        + [("pieces", pa.list_(pa.struct([("at", pa.int64()), ("enter", pa.int32()), ("edits", pa.string())])))]
    )
    paths = stored(parts.mapInArrow(_per_row(_joined, ["conv", "parts"], out), f"conv {id_type}, {numbers}, pieces {piece}"), "conversation-paths")
    chosen = paths.select(F.inline("pieces")).withColumnRenamed("at", "__at")
    text_schema = pa.schema([("conv", arrow_id), ("at", pa.int64()), ("rows_left", pa.int64()), ("text", pa.string())])
    texts = cut.join(chosen, F.col("at") == F.col("__at")).mapInArrow(
        _per_row(_repaired, ["conv", "at", "rows", "enter", "edits"], text_schema), f"conv {id_type}, at long, rows_left long, text string"
    )
    reports = whole.unionByName(paths.select(*results, F.lit(None).cast("string").alias("repaired")))
    return reports, texts


def text_digests(parts: DataFrame) -> DataFrame:
    """(conv, sha256) of the parts' texts joined by newlines in their order; a part without rows adds nothing.

    The parts of a conversation go through one task as a stream; only one of them is in memory.
    """
    kind = parts.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, begun, filled = None, hashlib.sha256(), False, False
        for batch in batches:
            for k in range(batch.num_rows):
                conv = batch.column("conv")[k].as_py()
                if begun and conv != current:
                    yield pa.RecordBatch.from_pylist([{"conv": current, "sha256": digest.hexdigest()}], schema)
                    digest, filled = hashlib.sha256(), False
                current, begun = conv, True
                if batch.column("rows_left")[k].as_py():
                    digest.update((("\n" if filled else "") + batch.column("text")[k].as_py()).encode())
                    filled = True
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv": current, "sha256": digest.hexdigest()}], schema)

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, sha256 string")
