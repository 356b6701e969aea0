"""Conversation repair against plain restatements: all edit sequences, and whole results on odd rows."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from mnemolith.llm.conversation_repair import damaged, repaired, undamaged
from mnemolith.llm.repair_automaton import GONE, RepairAutomaton, symbol

SCHEMA = "conv_id long, turn long, role string, text string, copies string, first int, h long, part int"
SPACES = " \t\n\x0b\x0c\r"


@cache
def cheapest(rows, state=0, inserted=0):
    """``(cost, letters)`` for rows ``(initial, must go, truncated)``; states as text of what came last."""
    out = [(0, "")] if not rows and state in (0, "a") else []
    fits = "a" if state == "u" else "u"
    if rows:
        initial, must_go, truncated = rows[0]
        options = [("D", 2, state)]
        if not must_go:
            extra = 5 if truncated else 0
            if initial == fits or initial == "s" and state == 0:
                options.append(("K", extra, initial))
            options.append(("R", 1 + extra, fits))
        out += [(c + more, letter + rest) for letter, c, to in options for more, rest in cheapest(rows[1:], to)[:1]]
    if inserted < 3:
        out += [(5 + more, "I" + rest) for more, rest in cheapest(rows, fits, inserted + 1)[:1]]
    return [min(out)] if out else []


def test_edits_are_the_cheapest_and_least():
    automaton, chance = RepairAutomaton(), random.Random(3)
    for _ in range(5000):
        rows = tuple((chance.choice("suax"), chance.random() < 0.2, chance.random() < 0.2) for _ in range(chance.randrange(10)))
        symbols = [GONE if must_go else symbol(initial, cut) for initial, must_go, cut in rows]
        cost, letters, tail = automaton.repair(symbols, [1] * len(rows))
        assert [(cost, "".join(letters) + tail)] == cheapest(rows), rows
    assert len(automaton.vectors) < 60  # the lazily made states stay few


def restated(rows, damage=True):
    """Results by conversation, one row after the other."""
    by = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        own = by.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        own.extend([(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            end = text.rstrip(SPACES)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            faults.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for dated, t, _, _ in own if dated]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        if len(own) < 400:
            ((cost, audit),) = cheapest(tuple(faults))
        else:
            cost, letters, tail = RepairAutomaton().repair([GONE if g else symbol(i, t) for i, g, t in faults], [1] * len(own))
            audit = "".join(letters) + tail
        lines, state, i = [], "", 0
        for letter in audit:
            fits = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(f"{fits}:")
            elif letter != "D":
                lines.append(f"{own[i][2] if letter == 'K' else fits}:{own[i][3]}")
            state = lines[-1][0] if letter != "D" else state
            i += letter != "I"
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(spark, rows, damage=True):
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    found = repaired((damaged if damage else undamaged)(df)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("damage", [True, False])
def test_whole_results_on_odd_rows(spark, damage):
    chance = random.Random(5)
    texts = ["Hello.", "What?", "no end", "", " \n", None, "Yes! ", "ünï 漢字。", "a\nb.", "Hello."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "a"]
    rows = [(c, chance.choice([*range(6), None, -3, 40]), chance.choice(roles), chance.choice(texts)) for c in [*range(60), None] for _ in range(chance.randrange(1, 9))]
    rows += [(100, k, "user" if k % 2 else "assistant", f"Turn {k}" + chance.choice([".", "", "?"])) for k in range(30)]
    rows += [(101, 1, "user", "The same."), (101, 1, "user", "The same.")] * 20 + [(102, None, None, None)] + [(103, 0, "user", "x" * 500_000 + ".")]
    assert results(spark, rows, damage) == restated(rows, damage)


def test_a_conversation_over_many_partitions(spark):
    chance = random.Random(6)
    rows = [(1, k, chance.choice(["user", "assistant", "assistant", "system"]), f"Turn {k % 7000} of a long talk" + chance.choice(".!?,")) for k in range(12_000)]
    rows += [(c, k, ("user", "assistant")[k % 2], f"Turn {k}.") for c in (0, 2, 3) for k in range(6)]
    rows += [(2, 9, "user", "Again and again.")] * 3000
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = results(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    expected = restated(rows)
    assert {c: r for c, r in found.items()} == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repaired(damaged(df)).count() == 0
