"""Conversation repair against a shortest-path search in plain Python."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from shardweave.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, alive boolean, at long, rows string, conv string"


def brute(rows):
    """(cost, audit) by a best-first search over (cost, audit) itself; rows are (initial, has to go, cut short)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        wanted = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", i, wanted))
        if i < len(rows):
            initial, gone, short = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not gone:
                after = {"s": 1 if state == 0 else None, "u": None if state == 2 else 2, "a": 3 if state == 2 else None}.get(initial)
                if after is not None:
                    heapq.heappush(heap, (cost + 3 * short, audit + "K", i + 1, after))
                heapq.heappush(heap, (cost + 3 + 3 * short, audit + "R", i + 1, wanted))


def random_rows(draw, n):
    return [(draw.choice("uuaasx"), draw.random() < 0.15, draw.random() < 0.2) for _ in range(n)]


def test_search_equals_brute_force():
    draw = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 6] * 60 + [20, 40]:
        rows = [(i, g, s and not g) for i, g, s in random_rows(draw, n)]
        assert conv.cheapest(rows, 0, (0, 3)) == brute(rows)
    assert conv.cheapest([("u", False, False)] * 120, 0, (0, 3)) == brute([("u", False, False)] * 120)


def report(rows):
    """The result for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = None
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = brute(marked)
    lines, i, wanted = [], 0, "user"
    for e in audit:
        if e != "D":
            role, text = (wanted, "") if e == "I" else (wanted if e == "R" else rows[i][1], rows[i][2])
            lines.append(f"{role}:{text}")
            wanted = "assistant" if role[0] == "u" else "user"
        i += e != "I"
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def found(spark, data, partitions):
    df = spark.createDataFrame([(c, t, r, x, a, 7, "?", "?") for c, t, r, x, a in data], SCHEMA).repartition(partitions)
    reports, parts = conv.repair(df, "conv_id", "turn", "role", "text", F.col("alive"))
    digests = {r.conv: r.sha256 for r in conv.text_digests(parts).collect()}
    out = {}
    for r in reports.collect():
        assert r.conv not in out
        digest = digests[r.conv] if r.repaired is None else hashlib.sha256(r.repaired.encode()).hexdigest()
        out[r.conv] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest)
    return out


def talks(seed):
    draw = random.Random(seed)
    data = []
    for c in range(60):
        n = draw.choice([1, 2, 3, 4, 5, 6, 7, 8])
        for t in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "", "Bot"]) if draw.random() < 0.3 else ("user", "assistant")[t % 2]
            text = draw.choice(["Fine.", "Same.", "cut", " \t", "", "Ok!\n", "é?", "日本"]) if draw.random() < 0.4 else f"Text {draw.random()}."
            data.append((c, t if draw.random() < 0.9 else None, role, text, draw.random() < 0.9))
    data += [(None, 1, "user", "A.", True), (None, 2, "assistant", "B.", True), (900, 1, "user", "gone", False)]
    data += [(901, 2, None, None, True), (901, 1, "user", "Q?", True)]
    return data


def want(data):
    groups = {}
    for c, t, r, x, a in data:
        groups.setdefault(c, []).extend([(t, " " if r is None else r, " " if x is None else x)] if a else [])
    return {c: report(rows) for c, rows in groups.items()}


@pytest.mark.parametrize("seed,partitions,fragment", [(1, 1, 128), (2, 4, 128), (3, 3, 3), (4, 4, 1)])
def test_equals_brute_force(spark, seed, partitions, fragment, monkeypatch):
    monkeypatch.setattr(conv, "FRAGMENT", fragment)  # short fragments: most conversations take the way of long ones
    data = talks(seed)
    data += [data[3]] * 5
    assert found(spark, data, partitions) == want(data)


def test_long_conversation(spark):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["Yes.", "no", "", f"T {t}.", f"T {t}."]), True) for t in range(700)]
    rows += [(2, 5, "user", "Again. " * 50_000, True)] * 40
    assert found(spark, rows, 3) == want(rows)


def test_empty_table(spark):
    assert found(spark, [], 1) == {}
