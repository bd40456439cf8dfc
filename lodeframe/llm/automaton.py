"""A generalised suffix automaton of word runs, bounded in depth, as arrays.

States are the classes of substrings (of at most ``depth`` words) that end at the same positions; a state's
suffix link leads to the class of the longest suffix that ends at more of them. The usual construction adds
one word after the other; here each depth's substrings are numbered by sorting pairs (number of the
substring without its last word, last word), and classes are merged where a longer substring occurs as
often as its suffix, so that numpy does all the work. States, links and transitions are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Automaton:
    """``word[i]`` in ``range(n_words)`` are the words of all runs, one after the other; ``run`` tells a word's run.

    ``count`` (number of end positions), ``length`` and ``shortest`` (words of a state's longest and shortest
    substring), ``link`` (a state; 0 is the root) and ``end`` (one end position) have an entry for each state.
    ``begin`` and ``target``, ``label`` are the transitions: those of state s are begin[s] up to begin[s + 1]."""

    def __init__(self, word: np.ndarray, run: np.ndarray, n_words: int, depth: int) -> None:
        n = len(word)
        number = [np.zeros(n, np.int64)]  # of the substring of d words that ends at a position; -1 if the run is shorter
        count, where = [np.array([n])], [np.zeros(1, np.int64)]
        for d in range(1, depth + 1):
            inside = np.zeros(n, bool)
            inside[d - 1 :] = run[d - 1 :] == run[: n - d + 1]
            at = np.flatnonzero(inside)
            before = number[d - 1][at - 1] if d > 1 else np.zeros(len(at), np.int64)
            _, first, own, many = np.unique(before * n_words + word[at], return_index=True, return_inverse=True, return_counts=True)
            number.append(np.full(n, -1, np.int64))
            number[d][at] = own
            count.append(many)
            where.append(at[first])
        # the state of each substring, from the longest ones down; the root is state 0
        state, next_ = [np.zeros(0, np.int64)] * (depth + 1), 1
        shortest, length, total, end = [], [], [], []
        for d in range(depth, 0, -1):
            state[d] = np.full(len(count[d]), -1, np.int64)
            if d < depth and len(count[d + 1]):
                suffix = number[d][where[d + 1]]
                same = count[d + 1] == count[d][suffix]
                state[d][suffix[same]] = state[d + 1][same]
            new = np.flatnonzero(state[d] < 0)
            state[d][new] = np.arange(next_, next_ + len(new))
            next_ += len(new)
            length.append(np.full(len(new), d))
            total.append(count[d][new])
            end.append(where[d][new])
        self.length = np.concatenate([[0], *length])
        self.count = np.concatenate([[n], *total])
        self.end = np.concatenate([[0], *end])
        self.shortest = np.full(next_, depth + 1)
        self.shortest[0] = 0
        for d in range(1, depth + 1):
            np.minimum.at(self.shortest, state[d], d)
        self.link = np.zeros(next_, np.int64)
        for d in range(2, depth + 1):
            some = np.flatnonzero(self.shortest == d)
            self.link[some] = state[d - 1][number[d - 1][self.end[some]]]
        arcs = [np.stack([np.zeros(len(where[1]), np.int64), word[where[1]], state[1]], axis=1)] if depth else []
        for d in range(1, depth):
            to = where[d + 1]
            arcs.append(np.stack([state[d][number[d][to - 1]], word[to], state[d + 1]], axis=1))
        all_ = np.concatenate(arcs)
        _, first = np.unique(all_[:, 0] * n_words + all_[:, 1], return_index=True)
        self.label, self.target = all_[first, 1], all_[first, 2]
        self.begin = np.searchsorted(all_[first, 0], np.arange(next_ + 1))
        self.depth = depth

    def substrings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each number of words up to the depth, all different substrings (a row of words each) and their states:
        the paths from the root, each walked once."""
        path, at = np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
        for _ in range(self.depth):
            fan = self.begin[at + 1] - self.begin[at]
            arc = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.begin[at], fan)
            path = np.concatenate([np.repeat(path, fan, axis=0), self.label[arc][:, None]], axis=1)
            at = self.target[arc]
            yield path, at
