"""Probabilistic automata learned from examples by merging compatible states of a prefix tree.

A small model: it is fitted on a bounded sample of strings and applied inside Spark tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

#: Characters of tokens; anything else counts as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Classes of segments (the narrowest that holds all of a segment's characters), and the number of characters in each.
CLASSES = {"d": 10, "x": 16, "l": 26, "m": 36, "w": 52, "a": 62}
_SHARE = {k: math.log(n) for k, n in CLASSES.items()}
_ANY = math.log(len(ALPHABET))
_FITS = [(k, re.compile(v)) for k, v in (("d", "[0-9]+"), ("x", "[0-9a-f]+|[0-9A-F]+"), ("l", "[a-z]+|[A-Z]+"), ("m", "[0-9a-z]+|[0-9A-Z]+"), ("w", "[A-Za-z]+"))]
_SEGMENT = re.compile("[A-Za-z0-9]+")


def segment_class(segment: str) -> str:
    """d: digits, x: hexadecimal digits, l: letters, m: letters and digits (each of one case); w: letters of both cases, a: any."""
    return next((k for k, fits in _FITS if fits.fullmatch(segment)), "a")


def markers(samples: list[str], length: int = 4, least: int = 5, share: float = 0.25) -> frozenset[str]:
    """Prefixes that belong to a format: `least` samples or more start alike for `length` characters or more.

    Such a prefix goes on as long as the next character is that of `share` of the samples that have it. All shorter
    prefixes of a marker are listed as well.
    """
    count = Counter(s[:n] for s in samples for n in range(1, len(s) + 1) if n <= 64)
    found: set[str] = set()
    grown = [p for p, n in count.items() if len(p) == length and n >= least]
    while grown:
        prefix = grown.pop()
        found.add(prefix)
        grown += [prefix + c for c in ALPHABET if count[prefix + c] >= max(least, share * count[prefix])]
    return frozenset(p[:n] for p in found for n in range(1, len(p) + 1))


def symbols(text: str, literal: frozenset[str] = frozenset()) -> list[str]:
    """What an automaton reads: a marker's characters and those between segments as they are ("=" and the character), others as
    the class of their segment."""
    out = [f"={c}" for c in text]
    for m in _SEGMENT.finditer(text):
        out[m.start() : m.end()] = [segment_class(m[0])] * (m.end() - m.start())
    for i, c in enumerate(text):
        if text[: i + 1] not in literal:
            break
        out[i] = f"={c}"
    return out


@dataclass
class _State:
    count: int = 0  # strings that reach the state
    ends: int = 0  # strings that end here
    to: dict[str, int] = field(default_factory=dict)
    via: dict[str, int] = field(default_factory=dict)  # strings that leave by a symbol
    access: tuple[str, ...] = ()  # of a red state: the symbols that lead here from the root


@dataclass
class Automaton:
    """For each state: log-probability of the end, by symbol the log-probability and the next state, the same for any other symbol."""

    states: list[tuple[float, dict[str, tuple[float, int]], tuple[float, int]]]
    literal: frozenset[str] = frozenset()

    def score(self, text: str, least: float = -math.inf) -> float:
        """Log-likelihood of the text, its end included; -inf as soon as it is known to be below `least`.

        A class's probability is shared by its characters. A symbol that a state has not seen is taken as the character itself if the
        state has seen that; else it is one unseen outcome, shared by all characters, and the state's likeliest successor follows.
        """
        at, total = 0, 0.0
        for c, char in zip(symbols(text, self.literal), text):
            _, seen, other = self.states[at]
            if c not in seen:
                c = f"={char}"
            step = seen.get(c)
            if step is None:
                total += other[0] - _ANY
                at = other[1]
            else:
                total += step[0] - _SHARE.get(c, 0.0)
                at = step[1]
            if total < least:
                return -math.inf
        return total + self.states[at][0]


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA (Carrasco and Oncina, 1994): red states are kept, blue ones merge with a red one or become red.

    Blue states are taken by the length of their access string, then by its symbols; red ones in the order in which they became
    red. Two states are compatible if their frequencies of ending and of every symbol differ by no more than the Hoeffding bound
    at confidence alpha, and so do their successors'.
    """
    literal = markers(samples)
    states = [_State()]
    for text in samples:
        at = 0
        states[0].count += 1
        for c in symbols(text, literal):
            nxt = states[at].to.get(c)
            if nxt is None:
                nxt = len(states)
                states.append(_State())
                states[at].to[c] = nxt
            states[at].via[c] = states[at].via.get(c, 0) + 1
            at = nxt
            states[at].count += 1
        states[at].ends += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > spread * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo, seen = deque([(a, b)]), set()
        while todo:
            a, b = todo.popleft()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            x, y = states[a], states[b]
            if differ(x.ends, x.count, y.ends, y.count):
                return False
            for c in {*x.via, *y.via}:
                if differ(x.via.get(c, 0), x.count, y.via.get(c, 0), y.count):
                    return False
                if c in x.to and c in y.to:
                    todo.append((x.to[c], y.to[c]))
        return True

    blue: list[tuple[int, tuple[str, ...], int, str]] = []

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a; what hangs on a red state then is blue."""
        todo = deque([(a, b)])
        while todo:
            a, b = todo.popleft()
            x, y = states[a], states[b]
            x.count += y.count
            x.ends += y.ends
            for c, n in y.via.items():
                x.via[c] = x.via.get(c, 0) + n
            for c, t in y.to.items():
                if c in x.to:
                    todo.append((x.to[c], t))
                else:
                    x.to[c] = t
                    if a in member:
                        wait(a, c)

    def wait(source: int, c: str) -> None:
        access = (*states[source].access, c)
        heapq.heappush(blue, (len(access), access, source, c))

    red, member = [0], {0}
    for c in states[0].to:
        wait(0, c)
    while blue:
        _, access, source, c = heapq.heappop(blue)
        b = states[source].to[c]
        if b in member:
            continue
        for r in red:
            if compatible(r, b):
                states[source].to[c] = r
                fold(r, b)
                break
        else:
            red.append(b)
            member.add(b)
            states[b].access = access
            for s in states[b].to:
                wait(b, s)
    number = {r: i for i, r in enumerate(red)}
    out = []
    for r in red:
        s = states[r]
        n = s.count + len(s.via) + 2  # one more of each outcome that was seen, and of an unseen one
        likeliest = min(s.via, key=lambda c: (-s.via[c], c)) if s.via else None
        other = number[s.to[likeliest]] if likeliest is not None else number[r]
        out.append((math.log((s.ends + 1) / n), {c: (math.log((k + 1) / n), number[s.to[c]]) for c, k in s.via.items()}, (math.log(1 / n), other)))
    return Automaton(out, literal)
