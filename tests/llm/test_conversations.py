"""Repair of conversations against a search over whole strings of edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from lakemill.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, edit int, part string"
NONE = hashlib.sha256().hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(name).encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 and text is not None else text
        out += [] if fault == 0 else [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row[1:2]) + tuple((x is not None, x or "") for x in row[2:])


def cheapest(rows, faults):
    """(cost, edits) by values of (cost, edits) from the end; edits compare as strings."""
    next_role = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, "")}
    for _ in range(3):
        for state, to in next_role.items():
            if to in best:
                best[state] = min(best.get(state, (9e9, "")), (2 + best[to][0], "I" + best[to][1]))
    for (_, _, role, _), fault in reversed(list(zip(rows, faults))):
        now, first = {}, (role or "")[:1]
        for state, to in next_role.items():
            options = [(3 + best[state][0], "D" + best[state][1])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options.append((2 + more + best[to][0], "R" + best[to][1]))
                if first == to or (state == "" and first == "s"):
                    options.append((more + best[first][0], "K" + best[first][1]))
            now[state] = min(options)
        for _ in range(3):
            for state, to in next_role.items():
                now[state] = min(now[state], (2 + now[to][0], "I" + now[to][1]))
        best = now
    return best[""]


def brute(ids, rows):
    out = []
    for conv in ids:
        own = sorted([r for r in rows if r[0] == conv], key=key)
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = re.sub("[ \t-\r]", "", text or "")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [(r[2] or "")[:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(own, faults)
        lines, state, at = [], "", 0
        for edit in audit:
            to = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if edit == "I":
                lines.append(f"{to}:")
                state = to[0]
                continue
            if edit != "D":
                role = own[at][2] if edit == "K" else to
                lines.append(f"{role}:{own[at][3]}")
                state = role[0]
            at += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "open", " ", "", None, "Why?\n", "Long\tone. "]) if rng.random() < 0.3 else f"Words {rng.randint(0, 10**6)}{rng.choice(['.', '', '?  '])}"
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else rng.choice([None, 3]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [2, 1024])
def test_reports_equal_a_search_over_strings(spark, chunk):
    rows = conversations(1, 60, 12) + conversations(2, 1, 400)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    ids = {r[0] for r in rows}
    assert found(cr.with_empty(df, cr.reports(cr.repair(df, chunk=chunk)))) == brute(ids, rows)
    broken = cr.damaged(df)
    assert found(cr.with_empty(df, cr.reports(cr.repair(broken, chunk=chunk)))) == brute(ids, damage(rows))


def test_one_conversation_over_many_partitions_with_stretches_that_must_go(spark):
    """Speculative vectors are wrong here: legal turns end in an open one, and stretches of copies lie between chunks."""
    rows = []
    for turn in range(300):
        rows.append((1, turn, "user" if turn % 2 else "assistant", f"Turn {turn}."))
        rows += [(1, turn, "user", "Again.")] * (40 if turn in (60, 150, 151) else 0)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(cr.reports(cr.repair(df, chunk=4))) == brute({1}, rows)
    turns = cr.repair(df, chunk=4).orderBy("place").collect()
    assert [t["place"] for t in turns] == list(range(len(turns)))
    assert sum(t["edit"] == "D" for t in turns if t["text"] == "Again.") >= 119


def test_empty_table_and_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.with_empty(empty, cr.reports(cr.repair(empty))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.", 1, "x")], SCHEMA)
    assert found(cr.with_empty(df, cr.reports(cr.repair(cr.damaged(df))))) == [(gone, 0, 0, 0, 0, 0, 0, "", NONE)]


def test_very_long_texts_and_equal_rows(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)] + [(2, 0, "user", "Same.")] * 500
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(cr.reports(cr.repair(df, chunk=8))) == brute({1, 2}, rows)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = cr.op12_conversation_repair(spark, sf)
    assert df.columns == ["conv_id", *[n for n, _ in cr.REPORT]]
    assert found(df) == brute({r[0] for r in rows}, damage(rows))
