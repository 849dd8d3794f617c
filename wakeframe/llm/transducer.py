"""Minimal acyclic transducers: sorted terms to lexicographic ordinals, and back.

Terms come in ascending byte order; a state is closed when the next term leaves it, and equal closed states
become one. The output of an arc is the number of terms that sort before everything behind it, so the outputs
on a term's way add up to its ordinal. States are numbered so that arcs are one sorted array of keys
``state * 256 + byte``, which many words are looked up in at once, one byte of each word at a time.
"""

from __future__ import annotations

import io

import numpy as np

# Beyond so many bytes of a term, states are its own and are not compared: such tails hardly ever repeat.
SHARED_BYTES = 4096


class Builder:
    """Feed ``add`` with ascending distinct terms (bytes), then take ``finish``."""

    def __init__(self):
        self.last = b""
        self.terms = 0
        # The open states along the last term: [final, bytes of arcs, targets, terms behind each target].
        self.open = [[False, [], [], []]]
        self.known: dict[tuple, int] = {}
        self.size: list[int] = []  # terms accepted from each closed state
        self.final: list[bool] = []
        self.arc_from, self.arc_byte, self.arc_to, self.arc_out = [], [], [], []

    def _close(self, depth: int) -> int:
        """The number of the closed form of the deepest open state."""
        final, labels, targets, counts = self.open.pop()
        mark = (final, *labels, *targets) if depth <= SHARED_BYTES else None
        if mark in self.known:
            return self.known[mark]
        number, before = len(self.final), int(final)
        for byte, to, n in zip(labels, targets, counts):
            self.arc_from.append(number)
            self.arc_byte.append(byte)
            self.arc_to.append(to)
            self.arc_out.append(before)
            before += n
        self.final.append(final)
        self.size.append(before)
        if mark is not None:
            self.known[mark] = number
        return number

    def _shrink(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            byte = self.last[len(self.open) - 2]
            number = self._close(len(self.open) - 1)
            _, labels, targets, counts = self.open[-1]
            labels.append(byte)
            targets.append(number)
            counts.append(self.size[number])

    def add(self, term: bytes) -> None:
        if self.terms and term <= self.last:
            raise ValueError("terms must ascend")
        shared, top = 0, min(len(term), len(self.last))
        while shared < top and term[shared] == self.last[shared]:
            shared += 1
        self._shrink(shared)
        self.open.extend([False, [], [], []] for _ in range(len(term) - shared))
        self.open[-1][0] = True
        self.last = term
        self.terms += 1

    def finish(self) -> bytes:
        """The transducer as bytes for ``Transducer``."""
        self._shrink(0)
        root = self._close(0)
        key = np.array(self.arc_from, np.int64) * 256 + np.array(self.arc_byte, np.int64)
        order = np.argsort(key, kind="stable")
        out = io.BytesIO()
        np.savez(
            out, key=key[order], to=np.array(self.arc_to, np.int64)[order], out=np.array(self.arc_out, np.int64)[order],
            final=np.array(self.final, bool), root=np.int64(root), terms=np.int64(self.terms),
        )
        return out.getvalue()


class Transducer:
    def __init__(self, data: bytes):
        made = np.load(io.BytesIO(data))
        self.key, self.to, self.out, self.final = made["key"], made["to"], made["out"], made["final"]
        self.root, self.terms = int(made["root"]), int(made["terms"])
        self.bytes = len(data)

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ordinal of each byte range of ``data``, -1 where it is no term."""
        found = np.full(len(start), -1, np.int64)
        word = np.arange(len(start))
        state, total, at = np.full(len(start), self.root), np.zeros(len(start), np.int64), start.astype(np.int64)
        while len(word):
            done = at == end[word]
            if done.any():
                ends = done & self.final[state]
                found[word[ends]] = total[ends]
                word, state, total, at = word[~done], state[~done], total[~done], at[~done]
            if not len(word) or not len(self.key):
                break
            wanted = state * 256 + data[at]
            arc = np.searchsorted(self.key, wanted)
            arc[arc == len(self.key)] = 0
            live = self.key[arc] == wanted
            word, arc, at = word[live], arc[live], at[live] + 1
            state, total = self.to[arc], total[live] + self.out[arc]
        return found

    def term(self, ordinal: int) -> bytes:
        """The term with this ordinal."""
        if not 0 <= ordinal < self.terms:
            raise IndexError(ordinal)
        state, left, made = self.root, ordinal, bytearray()
        while left or not self.final[state]:
            low, high = np.searchsorted(self.key, (state * 256, state * 256 + 256))
            arc = low + int(np.searchsorted(self.out[low:high], left, "right")) - 1
            made.append(int(self.key[arc]) & 255)
            left -= int(self.out[arc])
            state = int(self.to[arc])
        return bytes(made)
