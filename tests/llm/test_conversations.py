"""op11: edits against a plain shortest-path search, chunks against whole conversations, odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from cases import SF
from proofweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit) by uniform-cost search over whole audits; least letters among equal costs."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        new = next(x for x in step[state].values() if x != "s")
        heapq.heappush(heap, (cost + 3, audit + "I", at, new))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, new))
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1]))


def report(rows):
    """The contract, read plainly; rows: (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own, kind = groups[conv], zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
        faults, seen = [], set()
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute([(r, f) for (_, r, _), f in zip(own, faults)])
        lines, at, state = [], 0, ""
        for letter in audit:
            new = "assistant" if state == "u" else "user"
            if letter == "K":
                lines.append(f"{own[at][1]}:{own[at][2]}")
                state = own[at][1][:1]
            elif letter in "IR":
                lines.append(f"{new}:{own[at][2] if letter == 'R' else ''}")
                state = new[0]
            at += letter != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_prices_and_letters_are_those_of_a_plain_search():
    r = random.Random(5)
    fault = {"0": "blank", "=": "duplicate"}
    for _ in range(3000):
        shape = "".join(r.choice("suaSUA-_0=uaua") for _ in range(r.randint(0, 9)))
        rows = [(c.lower().replace("_", "-"), fault.get(c, "truncated" if c in "SUA_" else "")) for c in shape]
        assert C.solved(shape) == brute(rows), shape


def test_prices_are_feasible_and_some_arc_is_tight():
    r = random.Random(6)
    for _ in range(200):
        shape = "".join(r.choice("suaSUA-_0=") for _ in range(40))
        value = C.prices(shape)
        for place in range(41):
            for state in range(4):
                sums = [cost + value[p][s] for _, cost, p, s in C.arcs(shape, place, state, True)] + ([(0, C._FAR, C._FAR, 0)[state]] if place == 40 else [])
                assert value[place][state] == min(sums)


def test_given_tables(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(C.repairs(C.damaged(table))) == report([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def odd():
    r = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "Übung", "unit"]
    texts = ["Yes.", "No!", "cut off", "", None, " \t\n", "why?  ", "é 日本.", "same."]
    rows = [(c, r.choice([None, 0, 1, 2, 5, 9, -3]), r.choice(roles), r.choice(texts)) for c in (1, 2, 3, None) for _ in range(12)]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(6)] * 2
    rows += [(100 + c, c, "user", "alone.") for c in range(40)]  # some are dropped whole
    rows += [(8, 0, "user", "long " * 100_000 + "."), (9, None, None, None)]
    return rows


def test_odd_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in odd()], SCHEMA + ", shape string, part long")
    assert found(C.repairs(C.damaged(df))) == report(odd())


def test_one_conversation_in_many_chunks(spark):
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice([f"a{t}.", f"b{t}", "again.", ""])) for t in range(900)]
    rows += [(c, t, "user", f"{t}.") for c in (0, 2) for t in range(3)] + [(1, None, "system", "You help.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (7, 64):
        assert found(C.repairs(C.damaged(df), chunk_rows=size)) == report(rows)


def test_equal_rows_of_one_conversation_are_split(spark):
    rows = [(1, 3, "user", "the same.")] * 3000
    df = spark.createDataFrame(rows, SCHEMA)
    parts = C.chunks(C.damaged(df), 100)
    assert parts.count() >= 30 and max(len(p.roles) for p in parts.collect()) <= 100
    assert found(C.repairs(C.damaged(df), chunk_rows=100)) == report(rows)


def test_empty(spark):
    assert C.repairs(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
