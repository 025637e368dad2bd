"""Regular expressions over bytes as minimal deterministic automata in transition arrays."""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# the functions below travel with the job: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALL_BYTES = (1 << 256) - 1


@dataclass
class Automaton:
    """step[state, byte_class[b]]: the next state; accepts[state]: a bit per pattern; state 0 is the start."""

    byte_class: np.ndarray
    step: np.ndarray
    accepts: np.ndarray

    def rows(self) -> list[list]:
        """The same transitions as linked lists: row[b] is the next row, or None if no match can follow; row[256] has the bits."""
        rows: list[list] = [[] for _ in self.accepts]
        idle = (self.step == np.arange(len(self.step))[:, None]).all(axis=1) & (self.accepts == 0)
        for state, (nexts, bits) in enumerate(zip(self.step[:, self.byte_class].tolist(), self.accepts.tolist())):
            rows[state].extend(None if idle[x] else rows[x] for x in nexts)
            rows[state].append(bits)
        return rows


class _Nfa:
    """Thompson construction; `backwards` builds the automaton of the reversed language."""

    def __init__(self, backwards: bool):
        self.backwards, self.empty, self.on = backwards, [], []

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, tree, start: int) -> int:
        """Append a parsed pattern behind a state; returns the state behind it."""
        for op, arg in reversed(list(tree)) if self.backwards else tree:
            start = self._item(op, arg, start)
        return start

    def _item(self, op, arg, start: int) -> int:
        if op is kind.SUBPATTERN:
            return self.add(arg[-1], start)
        if op is kind.BRANCH:
            out = self.state()
            for branch in arg[1]:
                self.empty[self.add(branch, start)].append(out)
            return out
        if op is kind.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                start = self.add(inner, start)
            if high is kind.MAXREPEAT:
                loop, out = self.state(), self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                self.empty[loop].append(out)
                return out
            out = self.state()
            for _ in range(high - low):
                self.empty[start].append(out)
                start = self.add(inner, start)
            self.empty[start].append(out)
            return out
        out = self.state()
        self.on[start].append((_bytes_of(op, arg), out))
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _bytes_of(op, arg) -> int:
    """The set of bytes that one element matches, as a 256-bit mask."""
    if op is kind.LITERAL or op is kind.NOT_LITERAL:
        if arg > 127:
            raise ValueError("patterns are limited to ASCII")
        return 1 << arg if op is kind.LITERAL else ALL_BYTES ^ (1 << arg)
    if op is kind.IN:
        mask, negate = 0, False
        for what, value in arg:
            if what is kind.NEGATE:
                negate = True
            elif what is kind.LITERAL:
                mask |= _bytes_of(what, value)
            elif what is kind.RANGE:
                mask |= sum(_bytes_of(kind.LITERAL, b) for b in range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a pattern: {what}")
        return ALL_BYTES ^ mask if negate else mask
    raise ValueError(f"not supported in a pattern: {op}")


def compile_patterns(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    anywhere: a match may begin at any byte, else only at the first. The empty match is not reported.
    """
    nfa = _Nfa(backwards)
    starts = [nfa.state() for _ in patterns]
    ends = {nfa.add(parser.parse(p), s): i for i, (p, s) in enumerate(zip(patterns, starts))}
    masks = sorted({m for edges in nfa.on for m, _ in edges})
    keys = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    classes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    byte_class = np.array([classes[k] for k in keys], np.int64)
    sample = [int(np.argmax(byte_class == c)) for c in range(len(classes))]

    closed = {s: nfa.closure([s]) for edges in nfa.on for _, s in edges}
    begin = nfa.closure(starts)
    numbers, todo, step = {begin: 0}, [begin], []
    for now in todo:
        row = []
        for b in sample:
            to = set(begin) if anywhere else set()
            for s in now:
                for mask, x in nfa.on[s]:
                    if mask >> b & 1:
                        to |= closed[x]
            to = frozenset(to)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        step.append(row)
    accepts = np.array([sum(1 << ends[s] for s in now if s in ends) for now in todo], np.int64)
    return _minimal(byte_class, np.array(step, np.int64), accepts)


def _minimal(byte_class: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states that no input tells apart, by refining the partition by accept bits until it is stable."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first, kind="stable")  # blocks in the order of their first state, so the start stays 0
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return Automaton(byte_class, rank[block[step[keep]]], accepts[keep])
