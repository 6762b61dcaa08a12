"""Weighted finite-state transducers over the tropical semiring: weights add along a path, and the smallest sum counts.

A machine has numbered states; an arc reads a label, writes a label and weighs something. ``EPS`` as a label reads or
writes nothing. These are the plain definitions: composition pairs states, and the shortest path settles them in the
order of their weight. ``sentencepiece_fst`` composes its machines ahead of time with ``compose`` and searches the
composition with each text by position, which gives the same paths.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

EPS = ""
INFINITE = float("inf")


@dataclass
class Machine:
    """arcs[state] has (label read, label written, weight, next state); ``finals`` has the weight of ending in a state."""

    start: int = 0
    arcs: list[list[tuple[Hashable, Hashable, float, int]]] = field(default_factory=lambda: [[]])
    finals: dict[int, float] = field(default_factory=dict)

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, at: int, reads: Hashable, writes: Hashable, weight: float, to: int) -> None:
        self.arcs[at].append((reads, writes, weight, to))


def linear(labels: Iterable[Hashable]) -> Machine:
    """The machine that reads and writes one sequence."""
    m = Machine()
    at = m.start
    for x in labels:
        to = m.state()
        m.arc(at, x, x, 0.0, to)
        at = to
    m.finals[at] = 0.0
    return m


def compose(a: Machine, b: Machine) -> Machine:
    """What ``a`` writes is read by ``b``; states are the pairs that can be reached. Arcs of infinite weight are left out."""
    m = Machine()
    number = {(a.start, b.start): 0}
    wait = [(a.start, b.start)]
    read: dict[int, dict[Hashable, list[tuple]]] = {}
    written: dict[int, dict[Hashable, list[tuple]]] = {}

    def by_label(index: dict, arcs: list[tuple], state: int, label: int) -> dict[Hashable, list[tuple]]:
        if state not in index:
            index[state] = {}
            for arc in arcs:
                index[state].setdefault(arc[label], []).append(arc)
        return index[state]

    while wait:
        p, q = wait.pop()
        here = number[p, q]
        if p in a.finals and q in b.finals:
            m.finals[here] = a.finals[p] + b.finals[q]
        ours, theirs = by_label(written, a.arcs[p], p, 1), by_label(read, b.arcs[q], q, 0)
        moves = [(EPS, writes, w, (p, to)) for _, writes, w, to in theirs.get(EPS, ())]
        moves += [(reads, EPS, w, (to, q)) for reads, _, w, to in ours.get(EPS, ())]
        for label in ours if len(ours) < len(theirs) else theirs:
            if label != EPS:
                moves += [(reads, writes, w + v, (to, on)) for reads, _, w, to in ours.get(label, ()) for _, writes, v, on in theirs.get(label, ())]
        for reads, writes, w, pair in moves:
            if w == INFINITE:
                continue
            if pair not in number:
                number[pair] = m.state()
                wait.append(pair)
            m.arc(here, reads, writes, w, number[pair])
    return m


def invert(m: Machine) -> Machine:
    """The same paths with what is read and what is written exchanged."""
    return Machine(m.start, [[(writes, reads, w, to) for reads, writes, w, to in arcs] for arcs in m.arcs], dict(m.finals))


def lightest_writings(m: Machine, at: int) -> dict[Hashable, tuple[Hashable, ...]]:
    """For each label that can be read next in a state, what is written up to and with it on the lightest path: the arcs that read nothing, removed."""
    best: dict[int, tuple[float, tuple]] = {at: (0.0, ())}
    out: dict[Hashable, tuple[float, tuple]] = {}
    heap = [(0.0, at)]
    settled = set()
    while heap:
        w, here = heapq.heappop(heap)
        if here in settled:
            continue
        settled.add(here)
        so_far = best[here][1]
        for reads, writes, v, to in m.arcs[here]:
            found, key, text = (best, to, so_far) if reads == EPS else (out, reads, so_far)
            if w + v < found.get(key, (INFINITE,))[0]:
                found[key] = w + v, text if writes == EPS else (*text, writes)
                if reads == EPS:
                    heapq.heappush(heap, (w + v, to))
    return {label: text for label, (_, text) in out.items()}


def shortest_path(m: Machine) -> tuple[float, list[Hashable]]:
    """(weight, labels written) of the lightest path from the start to an end; weights aren't negative. (inf, []) if there is none."""
    best = {m.start: 0.0}
    back: dict[int, tuple[int, Hashable]] = {}
    heap = [(0.0, m.start)]
    settled = set()
    while heap:
        w, at = heapq.heappop(heap)
        if at in settled:
            continue
        settled.add(at)
        for _, writes, v, to in m.arcs[at]:
            if w + v < best.get(to, INFINITE):
                best[to], back[to] = w + v, (at, writes)
                heapq.heappush(heap, (w + v, to))
    ends = [(best[s] + w, s) for s, w in m.finals.items() if s in best]
    if not ends or min(ends)[0] == INFINITE:
        return INFINITE, []
    weight, at = min(ends)
    out = []
    while at != m.start or at in back:
        at, writes = back[at]
        if writes != EPS:
            out.append(writes)
        if at == m.start:
            break
    return weight, out[::-1]
