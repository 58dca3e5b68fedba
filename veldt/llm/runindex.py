"""A run-length index of a bundle of short strings: run-compressed BWT with sampled run ends.

Suffixes are sorted as wholes of their strings, ties by string. The index keeps the runs of the BWT,
the suffix positions at the ends of each run, and for each interval of suffixes that share `depth`
bytes the least label of the strings in it. Matching statistics of patterns are streamed right to
left through the runs, all patterns side by side: a symbol that continues the match is an LF step,
one that doesn't jumps to the run end, above or below, whose suffix shares more with the match.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, depth: int):
        """Strings buffer[starts:ends], each with one byte behind it, the last too; one label each."""
        self.depth = depth
        n, s = len(buffer), len(starts)
        string = np.searchsorted(starts, np.arange(n), side="right") - 1
        symbols = buffer.astype(np.int64) + s
        symbols[ends] = np.arange(s)  # the byte behind a string ends it, and differs from all others
        self.text = buffer
        self.rest = ends[string] - np.arange(n)  # bytes left in its string
        suffixes = _sorted_suffixes(symbols)
        plain = np.where(symbols < s, 0, symbols - s + 1)
        bwt = plain[suffixes - 1]
        new = np.ones(n, bool)
        new[1:] = bwt[1:] != bwt[:-1]
        self.run_start = np.flatnonzero(new)
        self.run_char = bwt[self.run_start]
        run_end = np.append(self.run_start[1:], n) - 1
        self.at_start, self.at_end, self.run_end = suffixes[self.run_start], suffixes[run_end], run_end
        lengths = run_end - self.run_start + 1
        # occurrences of a run's symbol in the runs before it, and symbols smaller than each
        by_char = np.lexsort((np.arange(len(lengths)), self.run_char))
        before = np.cumsum(lengths[by_char]) - lengths[by_char]
        sizes = np.bincount(self.run_char, lengths, 258).astype(np.int64)
        self.smaller = np.cumsum(sizes) - sizes
        self.before = np.empty(len(lengths), np.int64)
        self.before[by_char] = before - self.smaller[self.run_char[by_char]]
        self.keys = self.run_char[by_char] * len(lengths) + by_char
        self.by_char = by_char
        # intervals of suffixes that share `depth` bytes
        full = self.rest[suffixes] >= depth
        same = np.zeros(n, bool)
        rows = np.flatnonzero(full[1:] & full[:-1]) + 1
        window = np.lib.stride_tricks.sliding_window_view(self.text, depth) if n >= depth else np.zeros((0, depth), np.uint8)
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            same[part] = (window[suffixes[part]] == window[suffixes[part - 1]]).all(1)
        self.interval = np.flatnonzero(~same)
        self.least = np.minimum.reduceat(labels[string[suffixes]], self.interval)

    def stream(self, starts: np.ndarray, ends: np.ndarray, text: np.ndarray):
        """Yield (patterns, their position, row, matched suffix) right to left, one position at a time.

        `row` is a BWT row whose suffix, at the position given, is the longest match of the pattern
        from here on.
        """
        runs = len(self.run_start)
        order = np.argsort(-(ends - starts), kind="stable")
        row = np.zeros(len(starts), np.int64)
        at = np.full(len(starts), self.at_start[0])
        length = np.zeros(len(starts), np.int64)
        longest = int((ends - starts).max(initial=0))
        sizes = (ends - starts)[order]
        for step in range(1, longest + 1):
            live = order[: np.searchsorted(-sizes, -step, side="right")]
            place = ends[live] - step
            char = text[place].astype(np.int64) + 1
            run = np.searchsorted(self.run_start, row[live], side="right") - 1
            hit = self.run_char[run] == char
            if not hit.all():
                miss = np.flatnonzero(~hit)
                who, c = live[miss], char[miss]
                after = np.searchsorted(self.keys, c * runs + run[miss])
                up, down = after - 1, np.minimum(after, runs - 1)
                has_up = (up >= 0) & (self.run_char[self.by_char[np.maximum(up, 0)]] == c)
                has_down = (after < runs) & (self.run_char[self.by_char[down]] == c)
                up_run, down_run = self.by_char[np.maximum(up, 0)], self.by_char[down]
                shared_up = np.where(has_up, self._shared(at[who], self.at_end[up_run], length[who]), -1)
                shared_down = np.where(has_down, self._shared(at[who], self.at_start[down_run], length[who]), -1)
                upward = shared_up >= shared_down
                run[miss] = np.where(upward, up_run, down_run)
                row[who] = np.where(upward, self.run_end[up_run], self.run_start[down_run])
                at[who] = np.where(upward, self.at_end[up_run], self.at_start[down_run])
                length[who] = np.maximum(np.where(upward, shared_up, shared_down), 0)
                lost = ~(has_up | has_down)  # the symbol is nowhere: begin again behind it
                if lost.any():
                    gone = who[lost]
                    row[gone], at[gone], length[gone] = 0, self.at_start[0], 0
                    keep = np.ones(len(live), bool)
                    keep[miss[lost]] = False
                    live, place, char, run = live[keep], place[keep], char[keep], run[keep]
            row[live] = self.smaller[char] + self.before[run] + row[live] - self.run_start[run]
            at[live] -= 1
            length[live] += 1
            yield live, place, row[live], at[live], length[live]

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, at most `most` and `depth` of them."""
        limit = np.minimum(np.minimum(most, self.depth), np.minimum(self.rest[a], self.rest[b]))
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(limit > 0)
        k = 0
        while len(live):
            live = live[self.text[a[live] + k] == self.text[b[live] + k]]
            k += 1
            out[live] = k
            live = live[limit[live] > k]
        return out

    def least_label(self, rows: np.ndarray) -> np.ndarray:
        """Least label of the strings that hold the first `depth` bytes of these rows' suffixes."""
        return self.least[np.searchsorted(self.interval, rows, side="right") - 1]


def _sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix trebling and doubling; every string ends in a symbol of its own."""
    n = len(symbols)
    top = int(symbols.max()) + 2

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        order = np.argsort(keys)
        own = keys[order]
        step = np.zeros(n, np.int64)
        step[1:] = own[1:] != own[:-1]
        np.cumsum(step, out=step)
        rank = np.empty(n, np.int64)
        rank[order] = step
        return order, rank, int(step[-1]) + 1

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: n - by] = values[by:] + 1
        return out

    if top < 1 << 21:
        keys, width = ((symbols + 1) << 42) + (shifted(symbols, 1) << 21) + shifted(symbols, 2), 3
    else:
        keys, width = symbols * top + shifted(symbols, 1), 2
    order, rank, distinct = ranked(keys)
    while distinct < n:
        order, rank, distinct = ranked(rank * (n + 1) + (shifted(rank, width) if width < n else 0))
        width *= 2
    return order
