"""Deterministic automata over bytes: several regexes in one, by subset construction and minimisation, as transition arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a lane of a scan, lanes at most, and the number of lanes from which array operations pay.
LANE_BYTES, MOST_LANES, FEW_LANES = 1024, 4096, 128
#: An automaton with more states than this is refused: its rules should be told apart by shorter heads.
MOST_STATES = 60_000

ALL_BYTES = (1 << 256) - 1


def _mask(values: range | bytes) -> int:
    return sum(1 << v for v in values)


class _Parser:
    """Regexes of ASCII characters, classes, groups, | ? * + {m,n} and backslashes (xHH, or a literal) as nested tuples."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"the regex {self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} in the regex {self.text!r}")
        return tree

    def either(self) -> tuple:
        ways = [self.sequence()]
        while self.peek() == "|":
            self.take()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", ways)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("then", parts)

    def atom(self) -> tuple:
        char = self.take()
        if char == "(":
            tree = self.either()
            if self.take() != ")":
                raise ValueError(f"a group is not closed in the regex {self.text!r}")
            return tree
        return ("byte", self.members() if char == "[" else self.cased(_mask([self.code(char)])))

    def code(self, char: str) -> int:
        if char == "\\":
            char = self.take()
            if char == "x":
                return int(self.take() + self.take(), 16)
        if ord(char) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(char)

    def members(self) -> int:
        inverted = self.peek() == "^"
        if inverted:
            self.take()
        found = 0
        while (char := self.take()) != "]":
            low = high = self.code(char)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            found |= _mask(range(low, high + 1))
        found = self.cased(found)
        return ALL_BYTES & ~found if inverted else found

    def cased(self, found: int) -> int:
        if not self.any_case:
            return found
        capitals = _mask(range(65, 91))
        return found | (found & capitals) << 32 | (found & capitals << 32) >> 32

    def repeated(self, tree: tuple) -> tuple:
        while (char := self.peek()) and char in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(char, (0, 0))
            if char == "{":
                body = ""
                while (char := self.take()) != "}":
                    body += char
                low, comma, high = body.partition(",")
                low, high = int(low), int(high) if high else None if comma else int(low)
            tree = ("times", tree, low, high)
        return tree


class _Threads:
    """An automaton with several ways on from a state: for each state its moves (byte mask, state), a mask of None takes no byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[int | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, at: int) -> int:
        """Adds what tree matches from state at; gives the state where it ends."""
        kind = tree[0]
        if kind == "byte":
            end = self.state()
            self.moves[at].append((tree[1], end))
        elif kind == "then":
            end = at
            for part in tree[1]:
                end = self.add(part, end)
        elif kind == "or":
            end = self.state()
            for way in tree[1]:
                self.moves[self.add(way, at)].append((None, end))
        else:
            _, part, low, high = tree
            for _ in range(low):
                at = self.add(part, at)
            end = self.state()
            if high is None:
                again = self.state()
                self.moves[at].append((None, again))
                self.moves[self.add(part, again)].append((None, again))
                self.moves[again].append((None, end))
            else:
                for _ in range(high - low):
                    self.moves[at].append((None, end))
                    at = self.add(part, at)
                self.moves[at].append((None, end))
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for mask, to in self.moves[left.pop()]:
                if mask is None and to not in found:
                    found.add(to)
                    left.append(to)
        return frozenset(found)


@dataclass
class Automaton:
    """table[state, classes[byte]] is the next state; state 0 is the first, those from first_accept on accept the rules in the bits of accepts."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    first_accept: int
    dead: int  # the state that nothing leaves and that accepts nothing; -1 if there is none

    @property
    def resets(self) -> np.ndarray:
        """Flags of the bytes that lead from every state to the first: no match goes over them."""
        return (self.table == 0).all(axis=0)[self.classes]


def compiled(patterns: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """The automaton of (regex, any case) rules: accepts has bit i where rule i ends. anywhere: rules may begin at any byte.

    Of states that no continuation tells apart one is kept.
    """
    threads = _Threads()
    first, ends = threads.state(), {}
    for bit, (pattern, any_case) in enumerate(patterns):
        start = threads.state()
        threads.moves[first].append((None, start))
        ends[threads.add(_Parser(pattern, any_case).whole(), start)] = 1 << bit

    masks = sorted({m for moves in threads.moves for m, _ in moves if m is not None})
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> byte & 1 for m in masks), len(kinds)) for byte in range(256)], np.uint8)
    samples = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]

    begin = threads.closure({first})
    numbers, sets, rows = {begin: 0}, [begin], []
    while len(rows) < len(sets):
        moves = [m for s in sets[len(rows)] for m in threads.moves[s] if m[0] is not None]
        row = []
        for byte in samples:
            after = threads.closure({to for mask, to in moves if mask >> byte & 1}) | (begin if anywhere else frozenset())
            if after not in numbers:
                numbers[after] = len(sets)
                sets.append(after)
            row.append(numbers[after])
        rows.append(row)
        if len(sets) > MOST_STATES:
            raise ValueError(f"these rules need more than {MOST_STATES} states")
    accepts = np.array([sum({ends[s] for s in found if s in ends}) for found in sets], np.int64)
    return _minimised(classes, np.array(rows, np.int64), accepts)


def _minimised(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Parts the states by what they accept, then by where each byte leads, until nothing changes."""
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    samples = np.unique(part, return_index=True)[1]
    # the first state comes first and accepting ones last
    order = sorted(range(len(samples)), key=lambda p: (p != part[0], accepts[samples[p]] != 0)) if not accepts[0] else list(range(len(samples)))
    if accepts[0]:
        order.sort(key=lambda p: p != part[0])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table, accepts = place[part[table[samples[order]]]], accepts[samples[order]]
    stays = (table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0)
    return Automaton(classes, table, accepts, int((accepts == 0).sum()), int(np.flatnonzero(stays)[0]) if stays.any() else -1)


def hits(automaton: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the bytes: (places of last bytes, in order; bits of the rules that end there).

    The bytes are parted into lanes at bytes over which no match goes; all lanes move on by a byte with one array operation.
    """
    width = automaton.table.shape[1]
    flat = (automaton.table * width).ravel()
    limit = automaton.first_accept * width
    symbols = automaton.classes[data]
    lanes = min(MOST_LANES, len(data) // LANE_BYTES)
    starts = np.zeros(1, np.int64)
    if lanes > FEW_LANES:
        safe = np.flatnonzero(automaton.resets[data])
        at = np.searchsorted(safe, np.arange(1, lanes) * len(data) // lanes)
        starts = np.unique(np.concatenate([starts, safe[at[at < len(safe)]]]))
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    open_lanes = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), "left").tolist()  # how many are longer than each length

    places, states = [], []
    state, step = np.zeros(len(starts), np.int64), 0
    while step < len(open_lanes) and open_lanes[step] > FEW_LANES:
        n = open_lanes[step]
        state = flat.take(state[:n] + symbols.take(starts[:n] + step))
        found = np.flatnonzero(state >= limit)
        if len(found):
            places.append(starts[found] + step)
            states.append(state[found])
        step += 1
    table = flat.tolist()
    for lane in range(open_lanes[step] if step < len(open_lanes) else 0):
        now, at, own, reached = int(state[lane]), int(starts[lane]) + step, [], []
        for place, symbol in enumerate(symbols[at : int(starts[lane] + lengths[lane])].tolist(), at):
            now = table[now + symbol]
            if now >= limit:
                own.append(place)
                reached.append(now)
        places.append(np.array(own, np.int64))
        states.append(np.array(reached, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, states = np.concatenate(places), np.concatenate(states)
    order = np.argsort(places, kind="stable")
    return places[order], automaton.accepts[states[order] // width]
