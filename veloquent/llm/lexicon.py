"""A minimal acyclic automaton over byte strings whose words carry lists of ids, in one memory-mapped file."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np


class Builder:
    """Builds the automaton from words in ascending order, sharing equal suffixes as soon as they are complete."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.final: list[bool] = [False]
        self.known: dict[tuple, int] = {}
        self.path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word, not yet shared
        self.last: bytes | None = None

    def add(self, word: bytes) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must be distinct and ascending")
        common = 0
        if self.last is not None:
            for a, b in zip(word, self.last):
                if a != b:
                    break
                common += 1
        self._share(common)
        node = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            self.edges.append({})
            self.final.append(False)
            child = len(self.edges) - 1
            self.edges[node][byte] = child
            self.path.append((node, byte, child))
            node = child
        self.final[node] = True
        self.last = word

    def _share(self, down_to: int) -> None:
        while len(self.path) > down_to:
            parent, byte, child = self.path.pop()
            key = (self.final[child], tuple(self.edges[child].items()))
            twin = self.known.setdefault(key, child)
            if twin != child:
                self.edges[parent][byte] = twin

    def finish(self) -> dict[str, np.ndarray]:
        """Arrays: sorted edge keys (state * 256 + byte), their targets, and the words each edge passes over.

        Adding up what a word's edges pass over gives the word's place in the order, and so its output.
        """
        self._share(0)
        order, number = [0], {0: 0}
        for s in order:
            for t in self.edges[s].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, ready = stack.pop()
            if s in below:
                continue
            if ready:
                below[s] = int(self.final[s]) + sum(below[t] for t in self.edges[s].values())
            else:
                stack.append((s, True))
                stack += [(t, False) for t in self.edges[s].values() if t not in below]
        keys, targets, skips = [], [], []
        for s in order:
            passed = int(self.final[s])
            for byte, t in sorted(self.edges[s].items()):
                keys.append(number[s] * 256 + byte)
                targets.append(number[t])
                skips.append(passed)
                passed += below[t]
        return {"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32), "final": np.array([self.final[s] for s in order], bool)}


def write(path: str, words: Sequence[bytes], outputs: Sequence[Sequence[int]], extra: dict[str, np.ndarray]) -> None:
    """The automaton of ``words`` (any order) with an id list each, and further arrays, as one file."""
    order = sorted(range(len(words)), key=words.__getitem__)
    b = Builder()
    for i in order:
        b.add(words[i])
    arrays = b.finish() | extra
    arrays["ids"] = np.array([x for i in order for x in outputs[i]], np.int32)
    arrays["offsets"] = np.cumsum([0, *(len(outputs[i]) for i in order)]).astype(np.int64)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [str(a.dtype), at, len(a)]
        at += (a.nbytes + 15) // 16 * 16
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b" " * (-(8 + len(text)) % 16))
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 16))


class Lexicon:
    """The file, mapped: processes of a machine share its pages and none of them parses it."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        start = (8 + n + 15) // 16 * 16
        self.arrays = {}
        for k, (dtype, at, length) in json.loads(raw[8 : 8 + n].tobytes()).items():
            size = np.dtype(dtype).itemsize * length
            self.arrays[k] = raw[start + at : start + at + size].view(dtype)
        self.keys, self.targets, self.skips, self.final = (self.arrays[k] for k in ("keys", "targets", "skips", "final"))
        self.ids, self.offsets = self.arrays["ids"], self.arrays["offsets"]

    def places(self, words: Iterable[bytes]) -> np.ndarray:
        """The place of each word in the order, -1 for words that are not there; all words walk together."""
        words = list(words)
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.arange(len(words))
        state = np.zeros(len(words), np.int64)
        place = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = lengths[live] == step
            ended = live[done]
            ok = self.final[state[ended]]
            out[ended[ok]] = place[ended[ok]]
            live = live[~done]
            if not len(live):
                break
            want = state[live] * 256 + data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            live, at = live[hit], at[hit]
            place[live] += self.skips[at]
            state[live] = self.targets[at]
            step += 1
        return out

    def output(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()
