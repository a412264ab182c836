"""One deterministic automaton for many patterns.

Patterns are parsed to a nondeterministic automaton; its deterministic states
are made as texts need them (subset construction over classes of characters)
and kept. ``longest`` runs from a place and gives, for each pattern that
matches there, its longest end.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P


#: Places at which runs are remembered.
STRIDE = 256


class Automaton:
    def __init__(self, patterns: list[str]):
        self.step: list[list[tuple[frozenset[int] | None, bool, int]]] = []  # state -> (characters, negated, next)
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}
        starts = []
        for k, p in enumerate(patterns):
            a = self._state()
            b = self._build(P.parse(p), a)
            self.accept[b] = k
            starts.append(a)
        self.start = self._closure(starts)
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._number(self.start)
        self.first = frozenset(ch for ch in map(chr, range(128)) if self._next(self.begin, ch) >= 0)

    def _state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def _build(self, tree, at: int) -> int:
        """Add the pattern from state ``at``; the state it ends in."""
        for op, arg in tree:
            if op is C.LITERAL:
                to = self._state()
                self.step[at].append((frozenset([arg]), False, to))
            elif op is C.NOT_LITERAL:
                to = self._state()
                self.step[at].append((frozenset([arg]), True, to))
            elif op is C.ANY:
                to = self._state()
                self.step[at].append((frozenset([10]), True, to))
            elif op is C.IN:
                to = self._state()
                chars, negated = set(), False
                for kind, x in arg:
                    if kind is C.NEGATE:
                        negated = True
                    elif kind is C.LITERAL:
                        chars.add(x)
                    elif kind is C.RANGE:
                        chars.update(range(x[0], x[1] + 1))
                    elif x is C.CATEGORY_SPACE:
                        chars.update(map(ord, " \t\r\n\f\v"))
                    elif x is C.CATEGORY_DIGIT:
                        chars.update(range(48, 58))
                    elif x is C.CATEGORY_WORD:
                        chars.update(c for c in range(128) if chr(c).isalnum() or c == 95)
                    else:
                        raise ValueError(f"class {x} is not supported")
                self.step[at].append((frozenset(chars), negated, to))
            elif op is C.SUBPATTERN:
                to = self._build(arg[3], at)
            elif op is C.BRANCH:
                to = self._state()
                for part in arg[1]:
                    a = self._state()
                    self.free[at].append(a)
                    self.free[self._build(part, a)].append(to)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, part = arg
                to = at
                for _ in range(least):
                    to = self._build(part, to)
                if most is C.MAXREPEAT:
                    a = self._state()
                    self.free[to].append(a)
                    b = self._build(part, a)
                    self.free[b].append(a)
                    to = a
                else:
                    end = self._state()
                    self.free[to].append(end)
                    for _ in range(most - least):
                        to = self._build(part, to)
                        self.free[to].append(end)
                    to = end
            else:
                raise ValueError(f"{op} is not supported")
            at = to
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _number(self, states: frozenset[int]) -> int:
        if not states:
            return -1
        n = self.states.get(states)
        if n is None:
            n = self.states[states] = len(self.sets)
            self.sets.append(states)
            self.ends.append(tuple(sorted({self.accept[s] for s in states if s in self.accept})))
            self.moves.append({})
        return n

    def _next(self, state: int, ch: str) -> int:
        code = ord(ch)
        to = [n for s in self.sets[state] for chars, negated, n in self.step[s] if (code in chars) != negated]
        n = self.moves[state][ch] = self._number(self._closure(to))
        return n

    def longest(self, text: str, at: int, memo: dict[tuple[int, int], dict[int, int]] | None = None) -> dict[int, int]:
        """For each pattern that matches at this place, where its longest match ends.

        Runs of a text that share ``memo`` don't repeat what another has run from the
        same state at the same place, so long matches cost no more than their text.
        """
        state, found, moves = self.begin, {}, self.moves
        passed: list[tuple[tuple[int, int], dict[int, int]]] = []
        p, size = at, len(text)
        while p < size:
            if memo is not None and p > at:
                known = memo.get((state, p))
                if known is not None:
                    found |= known
                    break
                passed.append(((state, p), found))
                found = {}
            for p in range(p, min(size, (p | STRIDE - 1) + 1)):  # noqa: B020
                ch = text[p]
                to = moves[state].get(ch)
                state = self._next(state, ch) if to is None else to
                if state < 0:
                    break
                for k in self.ends[state]:
                    found[k] = p + 1
            if state < 0:
                break
            p += 1
        for key, before in reversed(passed):
            memo[key] = found
            found = before | found
        return found

    def starts(self) -> re.Pattern:
        """Pattern of the characters that a match may begin with, at the begin of a word or at a sign."""
        word = "".join(sorted(c for c in self.first if c.isalnum() or c == "_"))
        rest = "".join(sorted(re.escape(c) for c in self.first if not (c.isalnum() or c == "_")))
        return re.compile(f"(?<![A-Za-z0-9_])[{word}]" + (f"|[{rest}]" if rest else ""))
