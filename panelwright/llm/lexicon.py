"""A minimal acyclic transducer: frequent words share prefixes and suffixes and map to their token ids."""

from __future__ import annotations

import numpy as np


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = self.words = 0

    def key(self) -> tuple:
        return self.final, *((b, id(s)) for b, s in self.edges.items())


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``words`` (word to its ids) as the content of a file that ``Lexicon`` maps.

    Words go in sorted order; each state that can't change any more is replaced by an equal one, so
    the automaton is minimal. A word's output is found by its number: each transition carries the
    count of words that sort before those behind it, and the sum along a word's path is its place
    in the table of ids.
    """
    register: dict[tuple, _State] = {}
    root, path_states, previous = _State(), [], b""
    path_states.append(root)

    def settle(depth: int) -> None:
        for k in range(len(path_states) - 1, depth, -1):
            state = path_states.pop()
            byte = previous[k - 1]
            path_states[-1].edges[byte] = register.setdefault(state.key(), state)

    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            state = _State()
            path_states[-1].edges[byte] = state
            path_states.append(state)
        path_states[-1].final = True
        previous = word
    settle(0)

    states, stack = [root], [root]
    root.number = 0
    seen = {id(root)}
    while stack:
        for state in stack.pop().edges.values():
            if id(state) not in seen:
                seen.add(id(state))
                state.number = len(states)
                states.append(state)
                stack.append(state)

    def count(state: _State) -> int:  # as deep as the longest word
        if not state.words:
            state.words = state.final + sum(map(count, state.edges.values()))
        return state.words

    count(root)
    keys, targets, skips = [], [], []
    for state in states:
        ahead = int(state.final)
        for byte, target in sorted(state.edges.items()):
            keys.append(state.number << 8 | byte)
            targets.append(target.number)
            skips.append(ahead)
            ahead += target.words
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]).astype(np.int64)
    arrays = [np.array(x, np.int64)[order] for x in (keys, targets, skips)]
    arrays += [np.array([s.final for s in states], np.int64), offsets, np.array([i for w in ordered for i in words[w]], np.int64)]
    return b"".join(a.tobytes() for a in (np.array([len(a) for a in arrays], np.int64), *arrays))


class Lexicon:
    """A compiled lexicon, memory-mapped: all workers of an executor share its pages."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        stops = 6 + np.cumsum(data[:6])
        self.keys, self.targets, self.skips, self.finals, self.offsets, self.ids = np.split(data[: stops[-1]], [6, *stops[:-1]])[1:]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for one that isn't in the lexicon; all words walk one byte at a time."""
        numbers = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return numbers
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(lengths > 0)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            wanted = state << 8 | flat[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[edge] == wanted
            live, edge = live[there], edge[there]
            state, total = self.targets[edge], total[there] + self.skips[edge]
            step += 1
            ends = lengths[live] == step
            won = ends & (self.finals[state] == 1)
            numbers[live[won]] = total[won]
            live, state, total = live[~ends], state[~ends], total[~ends]
        return numbers
