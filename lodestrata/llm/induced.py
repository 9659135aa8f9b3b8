"""External induced sorting of the suffixes of an integer string, with their common prefixes.

Suffix tuples and common-prefix values travel through priority queues and stacks that keep a bounded part in memory and the rest on
disk; what must be sorted first, the suffixes at left-most S positions, is named by an external merge sort and, where names
repeat, sorted by the same procedure on the string of names. The string, its types, names and runs are arrays in files that are
mapped into memory, so that the system keeps as much of them there as it can; arrays in memory proper are CHUNK long at most.
Files are temporary ones of the task alone: they are gone with it, and a task that is run again makes its own.
"""

from __future__ import annotations

import heapq
import tempfile
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue, or a run being made, holds in memory; items of an array that are looked at together.
HELD, CHUNK = 100_000, 1 << 20


class Growing:
    """An array in a temporary file, to which parts are appended."""

    def __init__(self, kind: type) -> None:
        self.kind, self.n, self.file = np.dtype(kind), 0, tempfile.TemporaryFile()

    def add(self, part: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(part, self.kind))
        self.n += len(part)

    def mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=self.n) if self.n else np.zeros(0, self.kind)


def on_disk(n: int, kind: type) -> np.ndarray:
    """An array of zeros in a temporary file."""
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=n) if n else np.zeros(0, kind)


def chunks(n: int) -> Iterator[tuple[int, int]]:
    for low in range(0, n, CHUNK):
        yield low, min(low + CHUNK, n)


class DiskQueue:
    """A priority queue of tuples by key, equal keys in order of arrival: a heap of keys, and a line of tuples for each.

    When HELD tuples are in memory, the longest lines' are appended to a file; a line takes its own back, oldest first, as it moves on.
    """

    def __init__(self, width: int, held: int = HELD) -> None:
        self.width, self.held, self.n, self.file = width, held, 0, None
        self.keys: list[int] = []
        self.front: dict[int, deque] = {}
        self.back: dict[int, list] = {}
        self.filed: dict[int, deque] = {}

    def push(self, key: int, item: tuple) -> None:
        line = self.back.get(key)
        if line is None:
            self.back[key] = [item]
            if key not in self.front:
                self.front[key] = deque()
                heapq.heappush(self.keys, key)
        else:
            line.append(item)
        self.n += 1
        if self.n > self.held:
            self._spill()

    def _spill(self) -> None:
        """Write the longest lines' backs, in parts of a quarter of the bound, so that a part that comes back leaves room for others."""
        self.file = self.file or tempfile.TemporaryFile()
        most = max(1, self.held // 4)
        for key in sorted(self.back, key=lambda k: -len(self.back[k])):
            line = self.back.pop(key)
            for k in range(0, len(line), most):
                part = line[k : k + most]
                self.filed.setdefault(key, deque()).append((self.file.seek(0, 2), len(part)))
                self.file.write(np.array(part, np.int64).tobytes())
            self.n -= len(line)
            if 2 * self.n <= self.held:
                break

    def least(self) -> int | None:
        """The least key that has a tuple."""
        return self.keys[0] if self.keys else None

    def pop(self) -> tuple:
        key = self.keys[0]
        line = self.front[key]
        if not line:
            self._advance(key, line)
        self.n -= 1
        item = line.popleft()
        if not line and key not in self.back and key not in self.filed:
            del self.front[key]
            heapq.heappop(self.keys)
        return item

    def _advance(self, key: int, line: deque) -> None:
        if key in self.filed:
            at, n = self.filed[key].popleft()
            if not self.filed[key]:
                del self.filed[key]
            self.file.seek(at)
            line.extend(map(tuple, np.frombuffer(self.file.read(n * self.width * 8), np.int64).reshape(-1, self.width).tolist()))
            self.n += n
        else:
            line.extend(self.back.pop(key))


class DiskStack:
    """Tuples that come back last in, first out; beyond HELD in memory, the older ones are on disk."""

    def __init__(self, width: int, held: int = HELD) -> None:
        self.width, self.held, self.items, self.file, self.sizes = width, held, [], None, []

    def push(self, item: tuple) -> None:
        self.items.append(item)
        if len(self.items) > 2 * self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(np.array(self.items[: self.held], np.int64).tobytes())
            self.sizes.append(self.held)
            del self.items[: self.held]

    def top(self) -> tuple | None:
        if not self.items and self.sizes:
            size = self.sizes.pop() * self.width * 8
            self.file.seek(-size, 2)
            self.items = list(map(tuple, np.frombuffer(self.file.read(size), np.int64).reshape(-1, self.width).tolist()))
            self.file.seek(-size, 2)
            self.file.truncate()
        return self.items[-1] if self.items else None

    def pop(self) -> tuple:
        item = self.top()
        self.items.pop()
        return item


class _Prefixes:
    """Common prefixes of consecutive suffixes of a scan, for minima over all since an earlier one: a stack of falling minima."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.value: list[int] = []
        self.n = 0

    def add(self, value: int) -> None:
        while self.value and self.value[-1] >= value:
            self.value.pop()
            self.at.pop()
        self.value.append(value)
        self.at.append(self.n)
        self.n += 1

    def least_after(self, k: int) -> int:
        """The least common prefix of neighbours from the k-th suffix's on to the last one's."""
        return self.value[bisect_right(self.at, k)]


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one after it. The last character is the only least one."""
    n = len(text)
    up = on_disk(n, np.uint8)
    up[n - 1], carried = 1, True
    for low, high in reversed(list(chunks(n - 1))):
        part = np.asarray(text[low : high + 1])
        differs = np.flatnonzero(part[1:] != part[:-1])
        rises = np.append(part[differs + 1] > part[differs], carried)
        up[low:high] = rises[np.searchsorted(differs, np.arange(high - low))]
        carried = bool(up[low])
    return up


def _runs(text: np.ndarray, deep: int) -> np.ndarray:
    """How often each position's character comes from there on without a break, deep at most."""
    n = len(text)
    out, carried = on_disk(n, np.int32), 0
    for low, high in reversed(list(chunks(n))):
        part = np.asarray(text[low : high + 1])
        own = high - low
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]), own - 1)
        last = ends[np.minimum(np.searchsorted(ends, np.arange(own)), len(ends) - 1)]
        more = carried if high < n and part[own - 1] == part[own] else 0
        out[low:high] = np.minimum(last - np.arange(own) + 1 + np.where(last == own - 1, more, 0), deep)
        carried = int(out[low])
    return out


def _starts(up: np.ndarray) -> np.ndarray:
    """The left-most S positions."""
    out = Growing(np.int64)
    for low, high in chunks(len(up) - 1):
        part = np.asarray(up[low : high + 1])
        out.add(np.flatnonzero((part[1:] == 1) & (part[:-1] == 0)) + low + 1)
    return out.mapped()


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, deep: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, deep at most."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live) and out[live[0]] < deep:
        k = int(out[live[0]])
        x, y = a[live] + k, b[live] + k
        inside = (x < len(text)) & (y < len(text))
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        out[live] += 1
    return out


def _sorted_starts(text: np.ndarray, up: np.ndarray, starts: np.ndarray, held: int) -> np.ndarray:
    """The left-most S positions in the order of their suffixes."""
    parts, own, m = [], [], len(starts)
    for low in range(0, m, held):
        here = np.asarray(starts[low : low + held])
        first, end = int(here[0]), int(starts[low + held]) + 1 if low + held < m else len(text)
        marked = (np.asarray(text[first:end]).astype(np.int64) * 2 + up[first:end]).astype(">u8")  # from one of them to the next, both ends within
        stops = np.append(here[1:], end - 1) + 1
        if own:
            parts.append(_named_run(sorted(own)))
        own = [(marked[a - first : b - first].tobytes(), low + k) for k, (a, b) in enumerate(zip(here.tolist(), stops.tolist(), strict=True))]
    names, name, was = on_disk(m + 1, np.int64), 0, None
    for key, k in heapq.merge(sorted(own), *parts):
        if key != was:
            name, was = name + 1, key
        names[k] = name
    out = on_disk(m, np.int64)
    if name == m:
        for low, high in chunks(m):
            out[np.asarray(names[low:high]) - 1] = starts[low:high]
        return out
    for k, (i, _) in enumerate(induced_order(names, 1, held)):  # the zero at their end comes first
        if k:
            out[k - 1] = starts[i]
    return out


def _named_run(items: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, int]]:
    file = tempfile.TemporaryFile()
    for key, k in items:
        file.write(len(key).to_bytes(8, "little") + k.to_bytes(8, "little") + key)
    file.seek(0)

    def read() -> Iterator[tuple[bytes, int]]:
        with file:
            while head := file.read(16):
                yield file.read(int.from_bytes(head[:8], "little")), int.from_bytes(head[8:], "little")

    return read()


def induced_order(text: np.ndarray, deep: int, held: int = HELD) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the next greater suffix, deep at most and 0 for the greatest) of all suffixes, least first.

    text is of integers, and its last one is smaller than all others.
    """
    n = len(text)
    if n < 2:
        yield from ((k, 0) for k in range(n))
        return
    up = _types(text)
    starts = _starts(up)
    seeds = _sorted_starts(text, up, starts, held) if len(starts) > 1 else starts
    near = on_disk(len(seeds), np.int64)
    for low, high in chunks(len(seeds) - 1):
        near[low + 1 : high + 1] = _common(text, np.asarray(seeds[low:high]), np.asarray(seeds[low + 1 : high + 1]), deep)
    same, chars, is_up, seeds, near = (memoryview(x) for x in (_runs(text, deep), text, up, seeds, near))  # as quick to index as lists

    # Forwards: every L suffix is met through the suffix that follows it in the text.
    queue, seen, last = DiskQueue(2, held), _Prefixes(), {}
    lows = DiskStack(2, held)  # L suffixes for the way back, greatest first
    place, before = 0, -1
    k = 0
    while k < len(seeds) or queue.least() is not None:
        top = queue.least()
        if top is not None and (k == len(seeds) or top <= chars[seeds[k]]):
            c, (i, common) = top, queue.pop()
            lows.push((i, common))
        else:
            i = int(seeds[k])
            c = chars[i]
            common = int(near[k]) if k and chars[before] == c and is_up[before] else min(same[i], same[before], deep) if before >= 0 and chars[before] == c else 0
            k += 1
        seen.add(common)
        if i and not is_up[i - 1]:
            d = chars[i - 1]
            shared = min(deep, 1 + seen.least_after(last[d])) if d in last else 0
            queue.push(d, (i - 1, shared))
            last[d] = place
        place, before = place + 1, i

    # Backwards: every S suffix is met through the one that follows it in the text.
    queue, seen, last = DiskQueue(2, held), _Prefixes(), {}
    out = DiskStack(2, held)
    place, before, carried = 0, -1, 0
    while True:
        low, top = lows.top(), queue.least()
        if low is None and top is None:
            break
        if top is not None and (low is None or -top >= chars[low[0]]):
            c, (i, common) = -top, queue.pop()
            following = 0
        else:
            i, following = lows.pop()
            c = chars[i]
            common = carried if before >= 0 and chars[before] == c and not is_up[before] else min(same[i], same[before], deep) if before >= 0 and chars[before] == c else 0
        carried = following
        seen.add(common)
        out.push((i, common))
        if i and is_up[i - 1]:
            d = chars[i - 1]
            shared = min(deep, 1 + seen.least_after(last[d])) if d in last else 0
            queue.push(-d, (i - 1, shared))
            last[d] = place
        place, before = place + 1, i
    yield n - 1, 0
    while out.top() is not None:
        i, common = out.pop()
        if i != n - 1:
            yield i, common
