"""Run-length index of a repetitive collection of short strings, in one task's memory."""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Run-compressed Burrows-Wheeler transform that answers which document has a string of ``length`` bytes first.

    Rows are the suffixes of all strings in order, each up to its string's
    end, equal ones by the string's number.  A run is a stretch of rows with
    one preceding byte whose suffixes share their first ``length`` bytes (or
    are shorter than that).  It keeps its first row, where that row's
    preceding byte leads to, and a sampled text position: that of the string
    of lowest owner among all rows that share those bytes.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int):
        """text: the strings' bytes, none 0, each followed by a 0; size: their lengths, with the 0; owner: a number for each, ascending or not."""
        n, self.length, self.owner, self.size = len(text), length, owner, size - 1
        self.start = np.cumsum(size) - size
        string = np.repeat(np.arange(len(size), dtype=np.int32), size)
        left = (self.start + size)[string] - np.arange(n)  # bytes to the string's end, with the 0
        order, same = self._sorted(text, left, int(size.max()), length)
        border = np.append(True, ~same)
        before = text[order - 1]
        self.run_first = np.flatnonzero(border | np.append(True, before[1:] != before[:-1]))
        run_size = np.diff(self.run_first, append=n)
        char = before[self.run_first]
        by_char = np.argsort(char, kind="stable")
        self.leads = np.empty(len(char), np.int64)
        self.leads[by_char] = np.cumsum(run_size[by_char]) - run_size[by_char]  # rows start with 0 bytes, then 1s ..., so counts before are rows
        # The sample: in each stretch of rows that share ``length`` bytes, where the lowest owner has them.
        begin = np.flatnonzero(border)
        by = self.owner[string[order]]
        low = np.minimum.reduceat(by, begin)
        group = np.cumsum(border) - 1
        first = np.flatnonzero(by == low[group])
        at = np.zeros(len(begin), np.int64)
        at[group[first][::-1]] = order[first][::-1]
        self.sample = at[group[self.run_first]]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray, longest: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in order of the bytes to their string's end, and whether neighbours share ``length`` bytes."""
        n = len(text)
        used = np.flatnonzero(np.bincount(text, minlength=256))
        bits = 7 if len(used) <= 128 else 8
        code = np.zeros(256, np.int64)
        code[used] = np.arange(len(used))
        width = 63 // bits
        padded = np.concatenate([code[text], np.zeros(width, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = (key << bits) | np.where(left > k, padded[k : n + k], 0)
        at_length = None
        while width < longest:
            rank = np.unique(key, return_inverse=True)[1]

            def behind(k: int, rank=rank) -> np.ndarray:
                """Ranks of what is k bytes on, 0 beyond the string's end."""
                out = np.zeros(n, np.int64)
                out[: max(n - k, 0)] = rank[k:] + 1
                out[left <= k] = 0
                return out

            three = int(rank.max()) + 2 < 1 << 21  # ranks of 21 bits
            if at_length is None and width * (3 if three else 2) >= length:
                at_length = rank * np.int64(n + 2) + behind(length - width)
                if three and 2 * width < length:
                    at_length = (rank << 42) | (behind(width) << 21) | behind(length - width)
            key = (rank << 42) | (behind(width) << 21) | behind(2 * width) if three else rank * np.int64(n + 2) + behind(width)
            width *= 3 if three else 2
        order = np.argsort(key, kind="stable")
        at_length = np.where(left > length, at_length, -1 - np.arange(n))[order]
        return order, at_length[1:] == at_length[:-1]

    def stream(self, strings: np.ndarray) -> np.ndarray:
        """Whether lower owners have them too, for the ``length`` bytes from each place of the given strings (numbers).

        Each string is followed from its end to its start, a byte a step: a
        row's run tells where the row of one byte more is, and its sample
        where a match of ``length`` bytes stands first.  Result: a row for
        each string, a column for each start.
        """
        size = self.size[strings]
        found = np.zeros((len(strings), max(int(size.max()) - self.length + 1, 0) if len(strings) else 0), bool)
        live, row = np.arange(len(strings)), strings.astype(np.int64)  # the rows of the ends come first, in the strings' order
        for k in range(int(size.max()) + 1 if len(strings) else 0):
            run = np.searchsorted(self.run_first, row, side="right") - 1
            if k >= self.length:
                source = np.searchsorted(self.start, self.sample[run], side="right") - 1
                found[live, size[live] - k] = self.owner[source] < self.owner[strings[live]]
            go = size[live] > k
            live, row, run = live[go], row[go], run[go]
            row = self.leads[run] + row - self.run_first[run]
        return found
