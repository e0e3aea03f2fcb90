"""Induced suffix sorting with common-prefix values, its queues kept on disk.

:func:`windows_repeated` sorts the suffixes of one shard of text by induction. *Stars* are the
suffixes that are smaller than their right neighbour and whose left neighbour is not. They are
named by the text up to the next star and sorted through the string of those names, which is the
recursion. Two sweeps then give all other suffixes: upwards, each suffix that has been sorted
places its left neighbour if that one is larger than it; downwards, if it is smaller. What a sweep
still has to visit lies in a priority queue of tuples (symbol, arrival, position, common prefix),
popped a symbol at a time in blocks.

The common prefix of two neighbours of a queue is one more than the least common prefix between
the suffixes that placed them, so it is carried along and no text is read again; only the stars,
and the two suffixes where a symbol's falling and rising suffixes meet, are compared directly.

Common prefixes stop at ``length``: ties beyond it may be in any order. Queues and sorted runs over
``memory`` bytes go to an unnamed scratch file of the task (gone when the task ends, also when it
dies; no other task reads it), as does the text. The names of the stars (16 bytes a star, about
six bytes a byte of text) stay in memory.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

BLOCK = 1 << 18  # tuples handled at once
MEMORY = 64 << 20  # bytes of queued tuples in memory
BASE = 1 << 23  # star names up to here are sorted in memory, longer strings of names by induction


class Runs:
    """Tuples (position, common prefix) by symbol, in order of arrival, beyond ``memory`` on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.parts, self.file, self.end = memory, 0, {}, None, 0

    def add(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if part is not None and isinstance(part[0], np.ndarray):
                    pos, lcp = part
                    os.pwrite(self.file.fileno(), pos.astype(np.int64).tobytes() + lcp.tobytes(), self.end)
                    parts[i] = (self.end, len(pos))
                    self.end += 9 * len(pos)
        self.held = 0

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            self.held -= part[0].nbytes + part[1].nbytes
            return part
        at, n = part
        raw = os.pread(self.file.fileno(), 9 * n, at)
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n).copy()

    def pop(self, symbol: int):
        """The symbol's tuples in order of arrival, also those added meanwhile, in blocks."""
        parts, at = self.parts.get(symbol, []), 0
        while at < len(parts):
            got, n = [], 0
            while at < len(parts) and n < BLOCK:
                part, parts[at] = parts[at], None
                got.append(self._load(part))
                n += len(got[-1][0])
                at += 1
            if at > 64:
                del parts[:at]
                at = 0
            yield _joined(got)
        self.parts.pop(symbol, None)

    def pop_reversed(self, symbol: int):
        """Blocks of the symbol's tuples from the last to the first, each in order of arrival."""
        parts = self.parts.get(symbol, [])
        while parts:
            got, n = [], 0
            while parts and n < BLOCK:
                got.append(self._load(parts.pop()))
                n += len(got[-1][0])
            yield _joined(got[::-1])
        self.parts.pop(symbol, None)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    pos, lcp = zip(*parts)
    return np.concatenate(pos), np.concatenate(lcp)


class Queue(Runs):
    """Runs popped by symbol, least (or, ``descending``, greatest) first."""

    def __init__(self, memory: int, descending: bool):
        super().__init__(memory)
        self.sign, self.heap = -1 if descending else 1, []

    def push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples ordered by symbol."""
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        at = [0, *cuts.tolist(), len(symbols)]
        for a, b in zip(at[:-1], at[1:]):
            s = int(symbols[a])
            if s not in self.parts:
                heapq.heappush(self.heap, self.sign * s)
            for i in range(a, b, BLOCK):
                self.add(s, pos[i:min(b, i + BLOCK)], lcp[i:min(b, i + BLOCK)])

    def least(self):
        while self.heap and self.sign * self.heap[0] not in self.parts:
            heapq.heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None


class Carry:
    """Least common prefix, per symbol, over the tuples visited since the last one that placed it."""

    def __init__(self, symbols: int, length: int):
        self.least, self.length = np.zeros(symbols, np.uint8), length

    def placed(self, lcp: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefixes of the tuples placed by the visited ones at ``at`` (ordered by symbol,
        then by visit) with the one placed before in the same queue."""
        n = len(lcp)
        head = np.minimum.accumulate(lcp)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        out = np.empty(len(at), np.uint8)
        if len(at):
            first = np.empty(len(at), bool)
            first[0], first[1:] = True, symbols[1:] != symbols[:-1]
            out[first] = np.minimum(self.least[symbols[first]], head[at[first]])
            rest = np.flatnonzero(~first)
            if len(rest):
                lo, hi = at[rest - 1] + 1, at[rest]
                step = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
                table, k = lcp, 0
                while len(rest):
                    mine = step == k
                    a, b = lo[mine], hi[mine] - (1 << k) + 1
                    out[rest[mine]] = np.minimum(table[a], table[b])
                    more = ~mine
                    rest, lo, hi, step = rest[more], lo[more], hi[more], step[more]
                    if len(rest):
                        table = np.minimum(table[:-(1 << k)], table[(1 << k):])
                        k += 1
        np.minimum(self.least, head[-1], out=self.least)
        if len(at):
            last = np.empty(len(at), bool)
            last[-1], last[:-1] = True, first[1:]
            end = at[last]
            self.least[symbols[last]] = np.where(end + 1 < n, tail[np.minimum(end + 1, n - 1)], 255)
        return np.minimum(out.astype(np.int64) + 1, self.length).astype(np.uint8)


def stars(t: np.ndarray) -> np.ndarray:
    """Positions of the stars of ``t``, whose end counts as the least symbol."""
    n = len(t)
    if n < 2:
        return np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])
    head = t[starts]
    rising = np.zeros(len(starts), bool)
    rising[:-1] = head[:-1] < head[1:]
    return starts[1:][rising[1:] & ~rising[:-1]]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, at most ``length`` (t: bytes, padded by 8)."""
    words = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
    out = np.full(len(a), length, np.uint8)
    live = np.arange(len(a))
    end = len(t) - 8
    for j in range(0, length, 8):
        x = words[np.minimum(a[live] + j, end)] ^ words[np.minimum(b[live] + j, end)]
        odd = x != 0
        y = x[odd]
        same = (np.frexp((y & (~y + np.uint64(1))).astype(np.float64))[1] - 1) >> 3
        out[live[odd]] = np.minimum(j + same, length)
        live = live[~odd]
        if not len(live):
            break
    return out


def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> None:
    """Split the groups of equal rank among ``live`` by ``key``; a rank is its group's first place."""
    r = rank[live]
    if r[0] == r[-1] and (r == r[0]).all():
        order = np.argsort(key)
    elif key.dtype == np.int64 and len(rank) < 1 << 31 and int(key.max()) < 1 << 32:
        order = np.argsort((r << 32) | (key + 1))
    else:
        order = np.lexsort((key, r))
    r, k = r[order], key[order]
    new_group = np.empty(len(r), bool)
    new_group[0], new_group[1:] = True, r[1:] != r[:-1]
    new_key = new_group.copy()
    new_key[1:] |= k[1:] != k[:-1]
    place = np.arange(len(r))
    base = np.maximum.accumulate(np.where(new_group, place, 0))
    rank[live[order]] = r + np.maximum.accumulate(np.where(new_key, place, 0)) - base


def names(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the texts from each star up to and with the next one; a text that goes on is less
    than an equal one that has ended there."""
    size = np.append(at[1:] + 1, len(t)) - at
    rank = np.zeros(len(at), np.int64)
    small = t.dtype == np.uint8
    unit, live, r = 7 if small else 1, np.arange(len(at)), 0
    if small:
        words = np.ndarray((len(t),), ">u8", np.concatenate([t, np.zeros(8, np.uint8)]), strides=(1,))
        fill = np.array([(1 << 8 * (8 - i)) - 256 for i in range(8)], np.uint64)  # 255 for what lies beyond the end
    while len(live):
        q, left = at[live] + unit * r, np.clip(size[live] - unit * r, 0, unit)
        q = np.minimum(q, len(t) - 1)
        if small:
            got = words[q].astype(np.uint64) | fill[left]
            key = (got & ~np.uint64(255)) | (7 - left).astype(np.uint64)
        else:
            key = np.where(left > 0, t[q], np.iinfo(np.int64).max)
        _refine(rank, live, key)
        r += 1
        live = live[size[live] >= unit * r]
    return rank


def _ranks_in_memory(rank: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of the string of names, by doubling the names compared."""
    n, step = len(rank), 1
    while step < reach:
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        if not len(live):
            break
        nxt = live + step
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        _refine(rank, live, key)
        step *= 2
    return np.argsort(rank, kind="stable")


def star_order(t: np.ndarray, at: np.ndarray, length: int, memory: int, base: int) -> np.ndarray:
    """Indices of the stars ``at``, their suffixes in order (ties beyond ``length`` in any order)."""
    rank = names(t, at)
    if len(at) <= base:
        return _ranks_in_memory(rank, length)
    if len(np.unique(rank)) == len(rank):
        return np.argsort(rank)
    found = []
    induce(rank, length, lambda pos, lcp: found.append(pos), memory, base)
    return np.concatenate(found)[::-1]


def induce(t: np.ndarray, length: int, visit, memory: int = MEMORY, base: int = BASE,
           wanted: np.ndarray | None = None) -> None:
    """Visit the suffixes of ``t`` from the greatest to the least, in blocks (positions, common
    prefixes with the one visited before).

    ``wanted``: (first, last) rows of position ranges; suffixes that neither lie in one nor are
    needed to place one may be left out. Common prefixes are carried for texts of bytes only."""
    n, small = len(t), t.dtype == np.uint8
    at = stars(t)
    order = star_order(t, at, length, memory, base) if len(at) else np.empty(0, np.int64)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]) if small else None
    if wanted is not None and len(at):  # a star places the suffixes back to the star before it
        before = np.concatenate([[-1], at[:-1]])
        i = np.searchsorted(wanted[:, 0], at, "left") - 1  # the range that starts before the star
        use = (i >= 0) & (wanted[np.maximum(i, 0), 1] >= before)
        order = order[use[order]]
    seeds = at[order]
    lcp = np.zeros(len(seeds), np.uint8)
    if small and len(seeds) > 1:
        for a in range(1, len(seeds), BLOCK):
            b = min(len(seeds), a + BLOCK)
            lcp[a:b] = common(padded, seeds[a - 1:b - 1], seeds[a:b], length)
    kinds = int(t.max()) + 1 if small and n else 1

    def place(queue, carry, pos, lcp, keep):
        prev = pos - 1
        ok = prev >= 0
        sym = t[np.maximum(prev, 0)]
        ok &= keep(sym)
        idx = np.flatnonzero(ok)
        s = sym[idx]
        by = np.argsort(s, kind="stable")
        idx, s = idx[by], s[by]
        got = carry.placed(lcp, idx, s) if small else np.zeros(len(idx), np.uint8)
        if len(idx):
            queue.push(s, prev[idx], got)

    def direct(a, b):
        return common(padded, np.array([a]), np.array([b]), length)[0] if small else 0

    falling, queue, carry = Runs(memory), Queue(memory, False), Carry(kinds, length)
    try:
        if n:  # the end of the text places the last suffix
            place(queue, carry, np.array([n]), np.zeros(1, np.uint8), lambda s: s >= 0)
        symbols = t[seeds]
        done = 0
        while True:
            c, d = queue.least(), int(symbols[done]) if done < len(seeds) else None
            if c is None and d is None:
                break
            s = d if c is None or (d is not None and d < c) else c
            last = None
            for pos, got in queue.pop(s):
                if last is None:
                    got[0] = 0
                last = pos[-1]
                place(queue, carry, pos, got, lambda x: x >= s)
                falling.add(s, pos, got)
            stop = done + int(np.searchsorted(symbols[done:], s, "right")) if done < len(seeds) else done
            for a in range(done, stop, BLOCK):
                b = min(stop, a + BLOCK)
                got = lcp[a:b].copy()
                if a == done:
                    got[0] = 0 if last is None else direct(last, seeds[a])
                place(queue, carry, seeds[a:b], got, lambda x: x >= 0)
            done = stop
        queue.close()
        queue, carry = Queue(memory, True), Carry(kinds, length)
        left = sorted(falling.parts)
        while left or queue.least() is not None:
            c = queue.least()
            s = left[-1] if c is None or (left and left[-1] > c) else c
            last = None
            for pos, got in queue.pop(s):
                if last is None:
                    got[0] = 0
                last = pos[-1]
                visit(pos, got)
                place(queue, carry, pos, got, lambda x: x <= s)
            if left and left[-1] == s:
                left.pop()
                after = None  # common prefix of the run above's first suffix with this run's last
                for pos, up in falling.pop_reversed(s):
                    if after is None:
                        after = 0 if last is None else direct(last, pos[-1])
                    got = np.append(up[1:], np.uint8(after))[::-1]
                    after = up[0]
                    pos = pos[::-1]
                    visit(pos, got)
                    place(queue, carry, pos, got, lambda x: x < s)
    finally:
        falling.close()
        queue.close()


class _Classes:
    """Sums weights over runs of suffixes that share ``length`` bytes; marks those of 2 or more."""

    def __init__(self, weights: np.ndarray, length: int):
        self.mark, self.length, self.weights = np.zeros(len(weights), bool), length, weights
        self.open, self.first, self.low = 0, -1, 255  # weight and first member of the open class

    def visit(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        weight = self.weights[pos]
        at = np.flatnonzero(weight)
        if not len(at):
            self.low = min(self.low, int(lcp.min()))
            return
        low = np.minimum.reduceat(lcp[:at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        low[0] = min(low[0], self.low)
        pos, weight = pos[at], weight[at]
        new = low < self.length
        group = np.cumsum(new)  # 0: the class left open
        total = np.bincount(group, weights=weight, minlength=group[-1] + 1)
        total[0] += self.open
        hit = total[group] >= 2
        self.mark[pos[hit]] = True
        if self.first >= 0 and total[0] >= 2:
            self.mark[self.first] = True
        head = np.flatnonzero(group == group[-1])[0]
        self.open = min(2, total[group[-1]])
        self.first = -1 if self.open >= 2 else (self.first if group[-1] == 0 else pos[head])
        self.low = int(lcp[at[-1] + 1:].min()) if at[-1] + 1 < len(lcp) else 255


def windows_repeated(texts, length: int, memory: int = MEMORY, base: int = BASE) -> list[np.ndarray]:
    """For each (text, weight): the starts of its windows of ``length`` bytes that stand in two or
    more places, a text counting ``weight`` times.

    Texts shorter than ``length`` have no windows. The texts are written to a scratch file one
    after the other; a window never reaches into the next text."""
    sizes, weights = [], []
    with tempfile.TemporaryFile() as f:
        for text, weight in texts:
            f.write(text)
            sizes.append(len(text))
            weights.append(weight)
        f.flush()
        n = sum(sizes)
        if n == 0:
            return [np.empty(0, np.int64) for _ in sizes]
        t = np.memmap(f, np.uint8, "r", shape=(n,))
        ends = np.cumsum(sizes)
        begins = ends - np.array(sizes)
        last = np.maximum(ends - length, begins - 1)  # last window of each text
        spans = np.column_stack([begins, last])[last >= begins]
        weight = np.zeros(n, np.uint8)
        for b, e, w in zip(begins, last + 1, weights):
            weight[b:e] = min(w, 2)
        classes = _Classes(weight, length)
        if len(spans):
            induce(t, length, classes.visit, memory, base, spans)
        return [np.flatnonzero(classes.mark[b:e]) for b, e in zip(begins, ends)]
