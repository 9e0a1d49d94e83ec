"""Suffix order and common prefixes of bytes by external induced sorting.

The suffixes of a text are L (larger than the next) or S (smaller). Where an S follows an L the suffix
is a seed. Sorted seeds induce the L suffixes in an ascending scan and those the S suffixes in a descending
one: each scanned suffix hands the one before it to a priority queue. Keys leave a queue in order and what
is pushed under one first symbol comes in the order of its sources, so a queue is a file of batches for each
symbol, read ``CHUNK`` suffixes at a time. Batches beyond ``HELD`` bytes lie on disk; a shard's queues outgrow that.

What travels is a tuple: the suffix, the length of its common prefix with the one scanned before it (one more
than the least length between the two sources), and the eight symbols before it. The symbol before a suffix
says whether it is L or S and under which key it goes, so the scans don't read the text, but for the next eight
symbols of a run that has used up its own.

Seeds are sorted by naming their substrings, which a first, unsorted pass of induction puts in order, and by
sorting the string of names: of up to ``BASE`` names by doubling, of more by induced sorting again, over names.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import _powers as powers

HELD, BASE, CHUNK = 4 << 20, 1 << 22, 1 << 17
#: Symbols that no text has: not read yet, and before the text's first.
UNREAD, NONE = 0xFE, 0xFF


class Queue:
    """First symbol to batches of columns; beyond ``held`` bytes batches are written to disk."""

    def __init__(self, held: int = HELD):
        self.held, self.size, self.spilled, self.file, self.batches = held, 0, 0, None, {}

    def push(self, symbol: int, *columns: np.ndarray) -> None:
        size = sum(c.nbytes for c in columns)
        entry = columns
        if self.size + size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for c in columns:
                self.file.write(c.tobytes())
            entry = (at, len(columns[0]), [c.dtype for c in columns])
            self.spilled += size
        else:
            self.size += size
        self.batches.setdefault(symbol, []).append(entry)

    def _read(self, entry) -> tuple[np.ndarray, ...]:
        if isinstance(entry[0], np.ndarray):
            self.size -= sum(c.nbytes for c in entry)
            return entry
        at, n, kinds = entry
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)

    def pop(self, symbol: int, most: float = float("inf"), last: bool = False) -> tuple[np.ndarray, ...] | None:
        """The first batches queued under the symbol (the last ones, with ``last``), up to ``most`` rows, in order."""
        waiting = self.batches.get(symbol)
        if not waiting:
            return None
        taken, n, k = [], 0, len(waiting)
        while taken == [] or n < most and len(taken) < k:
            entry = self._read(waiting[-1 - len(taken)] if last else waiting[len(taken)])
            taken.append(entry)
            n += len(entry[0])
        self.batches[symbol] = waiting[: k - len(taken)] if last else waiting[len(taken) :]
        if last:
            taken.reverse()
        return tuple(np.concatenate(c) for c in zip(*taken))


# Names: the string of the seeds' names, an alphabet of any size.


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S, and how often its first symbol follows itself (at most 65535)."""
    n = len(text)
    cut = np.flatnonzero(np.diff(text)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
    small = np.zeros(len(begin), bool)
    small[:-1] = text[begin[:-1]] < text[begin[1:]]  # the last run meets the end, which is less
    return np.repeat(small, end - begin), np.minimum(np.repeat(end, end - begin) - np.arange(n), 65535).astype(np.uint16)


class _Names:
    """One direction of induction; the least common prefix since the last push is kept for each symbol."""

    def __init__(self, text, wanted, top: int, queue: Queue, cap: int):
        self.text, self.wanted, self.queue, self.cap = text, wanted, queue, cap
        self.least = np.full(top + 1, -1, np.int32)

    def __call__(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        lcp = lcp.astype(np.int32)
        before = pos - 1
        at = np.flatnonzero((pos > 0) & self.wanted[before])
        low = np.minimum.accumulate(lcp)
        if not len(at):
            np.minimum(self.least, low[-1], out=self.least)
            return
        before = before[at]
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")  # a radix sort for bytes
        symbols, at, before = symbols[order].astype(np.int64), at[order], before[order]
        first = np.ones(len(at), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        value = np.empty(len(at), np.int32)
        value[first] = np.minimum(self.least[symbols[first]], low[at[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = self._between(lcp, at[rest - 1] + 1, at[rest])
        cut = np.flatnonzero(first)
        ends = np.append(cut[1:], len(at))
        # what follows the last push of each symbol
        np.minimum(self.least, low[-1], out=self.least)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        last = at[ends - 1]
        self.least[symbols[cut]] = np.where(last + 1 < len(lcp), tail[np.minimum(last + 1, len(lcp) - 1)], self.cap)
        value = np.minimum(value + 1, self.cap).astype(np.int16)
        for a, b in zip(cut.tolist(), ends.tolist()):
            self.queue.push(int(symbols[a]), before[a:b], value[a:b])

    @staticmethod
    def _between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a..b], both included, by a sparse table read level by level."""
        out = np.empty(len(a), values.dtype)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        table = values
        for k in range(int(level.max()) + 1):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(table[a[own]], table[b[own] - (1 << k) + 1])
            if len(table) > 1 << k:
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out


def _induce_names(text, small, run, seeds, seed_lcp, cap: int, visit, held: int = HELD) -> None:
    """Both scans. ``visit(pos, lcp)`` sees all suffixes in descending order, each with its prefix in common with the one seen before."""
    n, top = len(text), int(text.max())
    symbols = np.unique(text).tolist()
    queue = Queue(held)
    scan = _Names(text, ~small, top, queue, cap)
    queue.push(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.int16))  # the end induces the last suffix
    scan.least[int(text[n - 1])] = 0
    large = Queue(held)
    bound = np.searchsorted(text[seeds], np.arange(top + 2))
    for c in symbols:
        last = None
        while (batch := queue.pop(c)) is not None:
            large.push(c, *batch)
            last = int(batch[0][-1])
            scan(*batch)
        own = seeds[bound[c] : bound[c + 1]]
        if len(own):
            lcp = seed_lcp[bound[c] : bound[c + 1]].copy()
            lcp[0] = 0 if last is None else min(run[last], run[own[0]], cap)
            scan(own, lcp)
    scan = _Names(text, small, top, queue, cap)
    for c in reversed(symbols):
        last = None
        while (batch := queue.pop(c)) is not None:
            visit(*batch)
            last = int(batch[0][-1])
            scan(*batch)
        batch = large.pop(c)
        if batch is not None:
            pos, lcp = batch[0][::-1], np.append(batch[1][:0:-1], 0)
            lcp = np.concatenate(([0 if last is None else min(run[last], run[pos[0]], cap)], lcp[:-1])).astype(np.int16)
            visit(pos, lcp)
            scan(pos, lcp)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names, in memory: each round sorts what is not told apart yet by twice the length."""
    n, step = len(names), 1
    order = np.argsort(names)
    place = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))  # the place of the first that is alike
    live = place[~(new & np.append(new[1:], True))]
    while len(live):
        own = order[live]
        group, following = rank[own], np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        again = np.argsort(group * (n + 2) + following)
        own, group, following = own[again], group[again], following[again]
        order[live] = own
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        rank[own] = np.maximum.accumulate(np.where(new, live, 0))
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def _sorted_names(names: np.ndarray, held: int) -> np.ndarray:
    """Suffix order of a string of names, by induction from its own seeds."""
    small, run = _types(names)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(seeds) > 1:
        number = np.full(len(names), -1, np.int32)
        number[seeds] = np.arange(len(seeds), dtype=np.int32)
        start, found = seeds[np.argsort(names[seeds], kind="stable")], []
        _induce_names(names, small, run, start, np.zeros(len(start), np.int16), 1, lambda pos, _: found.append(pos[number[pos] >= 0]), held)
        order = number[np.concatenate(found)[::-1]]
        again = _names(names, seeds, order)
        if again.max() < len(seeds) - 1:
            order = _doubled(again) if len(again) <= BASE else _sorted_names(again, held)
        seeds = seeds[order]
    out = []
    _induce_names(names, small, run, seeds, np.zeros(len(seeds), np.int16), 1, lambda pos, _: out.append(pos), held)
    return np.concatenate(out)[::-1]


# Bytes.


def _between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b], both included, by a sparse table read level by level."""
    return _Names._between(values, a, b)


class _Scan:
    """One direction of induction; the least common prefix since the last push is kept for each symbol."""

    def __init__(self, queue: Queue, cap: int):
        self.queue, self.cap, self.least = queue, cap, np.full(256, -1, np.int32)

    def __call__(self, pos: np.ndarray, lcp: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> None:
        lcp = lcp.astype(np.int32)
        at = np.flatnonzero(wanted)
        low = np.minimum.accumulate(lcp)
        if not len(at):
            np.minimum(self.least, low[-1], out=self.least)
            return
        symbols = (before[at] & np.uint64(0xFF)).astype(np.uint8)
        order = np.argsort(symbols, kind="stable")  # a radix sort
        symbols, at = symbols[order].astype(np.int64), at[order]
        first = np.ones(len(at), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        value = np.empty(len(at), np.int32)
        value[first] = np.minimum(self.least[symbols[first]], low[at[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = _between(lcp, at[rest - 1] + 1, at[rest])
        cut = np.flatnonzero(first)
        ends = np.append(cut[1:], len(at))
        # what follows the last push of each symbol
        np.minimum(self.least, low[-1], out=self.least)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        last = at[ends - 1]
        self.least[symbols[cut]] = np.where(last + 1 < len(lcp), tail[np.minimum(last + 1, len(lcp) - 1)], self.cap)
        value = np.minimum(value + 1, self.cap).astype(np.int16)
        pos = pos[at] - 1
        before = (before[at] >> np.uint64(8)) | np.uint64(UNREAD << 56)
        for a, b in zip(cut.tolist(), ends.tolist()):
            self.queue.push(int(symbols[a]), pos[a:b], value[a:b], before[a:b])


def _eight(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The eight symbols before each place, the nearest in the lowest byte."""
    out = np.zeros(len(pos), np.uint64)
    for k in range(8):
        at = pos - (k + 1)
        out |= np.where(at >= 0, text[np.maximum(at, 0)], np.uint8(NONE)).astype(np.uint64) << np.uint64(8 * k)
    return out


def _read(text: np.ndarray, pos: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``before`` with the next eight symbols where none is known any more."""
    unread = np.flatnonzero((before & np.uint64(0xFF)) == UNREAD)
    if len(unread):
        before = before.copy()
        before[unread] = _eight(text, pos[unread])
    return before


def _run(text: np.ndarray, pos: int, cap: int) -> int:
    """How often a suffix's first symbol follows itself."""
    own = text[pos : pos + cap]
    other = np.flatnonzero(own != own[0])
    return int(other[0]) if len(other) else len(own)


def induce(text, seeds, lcp, cap: int, larger, smaller, border, held: int = HELD) -> None:
    """Both scans, from seeds in order and their common prefixes.

    ``larger(pos, lcp)`` sees the L suffixes in ascending order, ``smaller(pos, lcp, seed)`` the S suffixes in
    descending order, ``seed`` telling which are seeds; each with the prefix in common with the one seen before.
    ``border(pos, pos, lcp)`` sees the last L and the first S of each symbol.
    """
    n = len(text)
    symbols = np.flatnonzero(np.bincount(text, minlength=256)).tolist()
    queue, sources = Queue(held), Queue(held)
    scan = _Scan(queue, cap)
    end = np.array([n - 1], np.int32)
    queue.push(int(text[n - 1]), end, np.zeros(1, np.int16), _eight(text, end))  # the end induces the last suffix
    scan.least[int(text[n - 1])] = 0
    bound = np.searchsorted(text[seeds], np.arange(257))
    ends, left = {}, {}
    for c in symbols:
        last, low = None, cap  # low: the least common prefix since the last source kept
        while (batch := queue.pop(c, CHUNK)) is not None:
            pos, common, before = batch
            before = _read(text, pos, before)
            larger(pos, common)
            symbol = before & np.uint64(0xFF)
            at = np.flatnonzero(symbol < c)  # what induces an S later
            if len(at):
                kept = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
                kept[0] = min(kept[0], low)
                sources.push(c, pos[at], kept, before[at])
                low = int(common[at[-1] + 1 :].min(initial=cap))
            else:
                low = min(low, int(common.min()))
            scan(pos, common, before, (symbol >= c) & (symbol < UNREAD))
            last = int(pos[-1])
        ends[c], left[c] = last, low
        for a in range(bound[c], bound[c + 1], CHUNK):
            own = seeds[a : min(a + CHUNK, bound[c + 1])]
            common = lcp[a : a + len(own)].copy()
            if a == bound[c]:
                common[0] = 0 if last is None else min(_run(text, last, cap), _run(text, int(own[0]), cap))
            before = _eight(text, own)
            scan(own, common, before, (before & np.uint64(0xFF)) < UNREAD)
    scan = _Scan(queue, cap)
    for c in reversed(symbols):
        last = None
        while (batch := queue.pop(c, CHUNK)) is not None:
            pos, common, before = batch
            before = _read(text, pos, before)
            symbol = before & np.uint64(0xFF)
            smaller(pos, common, (symbol > c) & (symbol < UNREAD))
            scan(pos, common, before, symbol <= c)
            last = int(pos[-1])
        shared = 0
        if last is not None and ends[c] is not None:
            shared = min(_run(text, last, cap), _run(text, ends[c], cap))
            border(ends[c], last, shared)
        shared = min(shared, left[c])
        while (batch := sources.pop(c, CHUNK, last=True)) is not None:
            pos, common, before = (x[::-1] for x in batch)
            scan(pos, np.append(np.int16(shared), common[:-1]), before, np.ones(len(pos), bool))
            shared = int(common[-1])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each pair of suffixes, up to ``cap``, eight symbols at a time."""
    n = len(text)
    eight = np.ndarray(n + 1, "<u8", np.append(text, np.zeros(8, np.uint8)), strides=(1,))
    most = np.minimum(cap, n - np.maximum(a, b))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, cap, 8):
        differ = eight[a[live] + k] ^ eight[b[live] + k]
        lowest = differ & (~differ + np.uint64(1))
        out[live] += np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        live = live[(differ == 0) & (most[live] > k + 8)]
        if not len(live):
            break
    return np.minimum(out, most).astype(np.int16)


def _seeds(text: np.ndarray) -> np.ndarray:
    """The seeds in the order of the text, told from its end a piece at a time."""
    n, out, small = len(text), [], False  # the last suffix is L
    for b in range(n - 1, 0, -CHUNK):  # suffixes a..b - 1, of which the next one's type is known
        a = max(0, b - CHUNK)
        own, following = text[a:b], text[a + 1 : b + 1]
        place = np.where(own != following, np.arange(b - a), b - a)
        place = np.minimum.accumulate(place[::-1])[::-1]  # where the run of equal symbols ends
        kind = np.append(own < following, small)[place]
        ahead = text[a - 1 : b - 1] if a else np.append(np.uint8(0), text[: b - 1])
        out.append(np.flatnonzero(kind & (ahead > own)).astype(np.int32) + np.int32(a))
        small = bool(kind[0])
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int32)


def _names(text: np.ndarray, seeds: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each seed's substring; ``order``: the seeds' numbers by substring. Equal ones by length and 64-bit hash."""
    ends = np.append(seeds[1:] + 1, len(text))
    value = np.empty(len(seeds), np.uint64)
    for a in range(0, len(seeds), CHUNK):
        b = min(a + CHUNK, len(seeds))
        own = text[seeds[a] : ends[b - 1]]
        up, down = powers(len(own))
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=total[1:])
        x, y = seeds[a:b] - seeds[a], ends[a:b] - seeds[a]
        value[a:b] = (total[y] - total[x]) * down[x]
    size = ends - seeds
    new = (size[order[1:]] != size[order[:-1]]) | (value[order[1:]] != value[order[:-1]])
    new |= (ends[order[1:]] == len(text)) | (ends[order[:-1]] == len(text))  # the end is like nothing else
    names = np.empty(len(seeds), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(new)))
    return names


def sorted_seeds(text: np.ndarray, held: int = HELD) -> np.ndarray:
    """The seeds in suffix order."""
    seeds = _seeds(text)
    if len(seeds) < 2:
        return seeds
    # unsorted seeds under their first symbols put the seeds' substrings in order
    start, found = seeds[np.argsort(text[seeds], kind="stable")], []
    nothing = lambda *_: None
    induce(text, start, np.zeros(len(start), np.int16), 1, nothing, lambda pos, _, seed: found.append(pos[seed]), nothing, held)
    order = np.searchsorted(seeds, np.concatenate(found)[::-1])
    names = _names(text, seeds, order)
    if names.max() == len(seeds) - 1:
        return seeds[order]
    return seeds[_doubled(names) if len(names) <= BASE else _sorted_names(names, held)]


def repeated(text: np.ndarray, length: int, held: int = HELD) -> np.ndarray:
    """For each position of a text of bytes under 0xF6 whether its next ``length`` symbols also start elsewhere in it."""
    marks = np.zeros(len(text), bool)
    if not len(text):
        return marks
    seeds = sorted_seeds(text, held)
    lcp = np.zeros(len(seeds), np.int16)
    lcp[1:] = _common(text, seeds[1:], seeds[:-1], length)

    def marker():
        seen = [np.zeros(1, np.int32)]

        def visit(pos, lcp, *_):
            at = np.flatnonzero(lcp >= length)
            marks[pos[at]] = True
            marks[np.concatenate((seen[0], pos[:-1]))[at]] = True
            seen[0] = pos[-1:]

        return visit

    def border(a, b, lcp):
        if lcp >= length:
            marks[[a, b]] = True

    induce(text, seeds, lcp, length, marker(), marker(), border, held)
    return marks
