"""Cheapest edits that give a conversation its structure, by lazy weighted determinisation.

The automaton over a conversation's rows has four states: nothing yet, after a
system row, after a user's, after an assistant's. A row is kept, given the other
role, or deleted, and rows may be inserted; each edit has its cost. The costs of
the four states after some rows, less their least, are one state of the
determinised automaton. There are few such vectors (states that can no longer be
on a cheapest path are cut), so each is made once, when it is first met, and its
transitions are kept in a table: a conversation's cost is one scan of the table.
A trace back over tight arcs then finds the states that lie on cheapest paths,
and is kept in tables too; going forward through them by the least letter gives
the edits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A row that must go, whatever its role.
GONE = 0
#: Other rows are ``1 + 2 * initial + truncated``.
INITIALS = "sua"
OTHER = len(INITIALS)


def symbol(initial: str, truncated: bool) -> int:
    """The automaton's symbol of a row that may stay."""
    at = INITIALS.find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else OTHER) + truncated


def _next(state: int) -> int:
    """Where a user's or assistant's row leads, whichever of them fits the state."""
    return ASSISTANT if state == USER else USER


def _moves(state: int, sym: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that use up a row."""
    out = [("D", DELETE, state)]
    if sym != GONE:
        initial, extra = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
        fits = state == NOTHING if initial == 0 else initial == (2 if state == USER else 1)
        if fits:
            out.append(("K", KEEP + extra, SYSTEM if initial == 0 else _next(state)))
        out.append(("R", REROLE + extra, _next(state)))
    return out


def _normal(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    """Costs with insertions made where they help, without hopeless states, less their least."""
    for _ in range(2):
        for state in range(4):
            to = _next(state)
            costs[to] = min(costs[to], costs[state] + INSERT)
    # From a finished pair a system row can be deleted, so that an untouched start is worth two at most, and an open system row nothing.
    done = costs[ASSISTANT]
    if costs[NOTHING] > done + DELETE:
        costs[NOTHING] = NEVER
    if costs[SYSTEM] > done:
        costs[SYSTEM] = NEVER
    least = min(costs)
    return least, tuple(c if c == NEVER else c - least for c in costs)


class RepairAutomaton:
    """The determinised automaton, as far as conversations have led it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        offset, start = _normal([0, NEVER, NEVER, NEVER])
        assert offset == 0
        self.start = self._id(start)
        self.traced = lru_cache(maxsize=1 << 16)(self._traced)
        self.stepped = lru_cache(maxsize=1 << 16)(self._stepped)

    def _id(self, vector: tuple[int, ...]) -> int:
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (3 + 2 * len(INITIALS)))
        return self.ids[vector]

    def _transition(self, at: int, sym: int) -> tuple[int, int]:
        costs = [NEVER] * 4
        for state, cost in enumerate(self.vectors[at]):
            if cost != NEVER:
                for _, more, to in _moves(state, sym):
                    costs[to] = min(costs[to], cost + more)
        least, vector = _normal(costs)
        found = self.table[at][sym] = (self._id(vector), least)
        return found

    def _inserting(self, at: int, marked: int) -> int:
        """``marked`` and the states that lead into it by tight insertions."""
        vector = self.vectors[at]
        for _ in range(2):
            for state in range(4):
                if vector[state] != NEVER and marked >> _next(state) & 1 and vector[state] + INSERT == vector[_next(state)]:
                    marked |= 1 << state
        return marked

    def _traced(self, at: int, sym: int, marked: int) -> int:
        """States before a row that lie on cheapest paths to the ``marked`` ones after it."""
        to, more = self.table[at][sym]
        before, after, out = self.vectors[at], self.vectors[to], 0
        for state in range(4):
            if before[state] != NEVER and any(marked >> q & 1 and before[state] + cost == after[q] + more for _, cost, q in _moves(state, sym)):
                out |= 1 << state
        return self._inserting(at, out)

    def _stepped(self, at: int, sym: int, here: int, marked: int, state: int) -> tuple[str, int]:
        """The least letters from ``state`` through one row, and the state after it."""
        to, more = self.table[at][sym]
        before, after, letters = self.vectors[at], self.vectors[to], ""
        while True:
            options = [(letter, q) for letter, cost, q in _moves(state, sym) if marked >> q & 1 and before[state] + cost == after[q] + more]
            q = _next(state)
            if here >> q & 1 and before[state] + INSERT == before[q]:
                options.append(("I", q))
            letter, state = min(options)
            letters += letter
            if letter != "I":
                return letters, state

    def repair(self, symbols: Sequence[int], runs: Sequence[int]) -> tuple[int, list[str], str]:
        """Cost, the letters up to each run, and those after the last, of rows ``symbols`` that come ``runs`` times.

        Only rows that must go may come more than once; their letter stands once
        for the run.
        """
        at, total, path = self.start, 0, []
        table = self.table
        for sym, run in zip(symbols, runs, strict=True):
            path.append(at)
            at, more = table[at][sym] or self._transition(at, sym)
            total += more + (run - 1) * DELETE
        final = self.vectors[at]
        least = min(final[NOTHING], final[ASSISTANT])
        masks = [0] * (len(path) + 1)
        masks[-1] = self._inserting(at, sum(1 << q for q in (NOTHING, ASSISTANT) if final[q] == least))
        for i in range(len(path) - 1, -1, -1):
            masks[i] = self.traced(path[i], symbols[i], masks[i + 1])
        state, letters = NOTHING, []
        for i, start in enumerate(path):
            some, state = self.stepped(start, symbols[i], masks[i], masks[i + 1], state)
            letters.append(some)
        tail = ""
        while state not in (NOTHING, ASSISTANT) or final[state] != least:
            state = _next(state)
            tail += "I"
        return total + least, letters, tail


def rendered(rows: Sequence[tuple[str, str]], letters: Sequence[str], tail: str, state: int = NOTHING) -> tuple[list[str], int]:
    """``role:text`` of what the edits leave, and the state after it."""
    out = []
    for (role, text), some in zip(rows, letters, strict=True):
        for letter in some:
            if letter == "D":
                continue
            if letter == "K":
                out.append(f"{role}:{text}")
                state = SYSTEM if role[:1] == "s" else _next(state)
            else:
                state = _next(state)
                out.append(f"{'user' if state == USER else 'assistant'}:{'' if letter == 'I' else text}")
    for _ in tail:
        state = _next(state)
        out.append(f"{'user' if state == USER else 'assistant'}:")
    return out, state
