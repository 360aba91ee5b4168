"""A BK-tree over words under Levenshtein distance, searched for many words at once."""

from __future__ import annotations

import numpy as np


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with 0, lengths)."""
    n = np.array([len(w) for w in words], np.int32)
    out = np.zeros((len(words), max(1, int(n.max(initial=0)))), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, n


def distances(word: str, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Levenshtein distance of one word to each row."""
    steps = np.arange(codes.shape[1] + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (len(codes), len(steps)))
    for i, c in enumerate(word, 1):
        new = np.empty((len(codes), len(steps)), np.int16)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != ord(c)), out=new[:, 1:])
        # Insertions run along the row: a running minimum of value - position.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(codes)), lens]


class BKTree:
    """Each node's children hang at their distance to it; subtrees that the triangle inequality rules out aren't entered."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []
        if not self.words:
            return
        codes, lens = encode(self.words)
        todo = [(np.arange(len(self.words)), -1, 0)]
        while todo:
            ids, parent, edge = todo.pop()
            me, root = len(self.nodes), int(ids[len(ids) // 2])
            self.nodes.append((root, []))
            if parent >= 0:
                self.nodes[parent][1].append((edge, me))
            ids = ids[ids != root]
            if len(ids):
                d = distances(self.words[root], codes[ids], lens[ids])
                todo += [(ids[d == e], me, int(e)) for e in np.unique(d)]

    def search(self, queries: list[str], most: np.ndarray) -> list[list[tuple[int, str]]]:
        """For each query all (distance, word) with distance <= most, nearest first."""
        found: list[list[tuple[int, str]]] = [[] for _ in queries]
        if not self.nodes or not queries:
            return found
        codes, lens = encode(queries)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            k, act = stack.pop()
            word, kids = self.nodes[k]
            d = distances(self.words[word], codes[act], lens[act])
            for q, e in zip(act[d <= most[act]].tolist(), d[d <= most[act]].tolist()):
                found[q].append((e, self.words[word]))
            for edge, kid in kids:
                near = act[np.abs(d - edge) <= most[act]]
                if len(near):
                    stack.append((kid, near))
        for f in found:
            f.sort()
        return found
