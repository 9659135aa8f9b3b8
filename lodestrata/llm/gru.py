"""A gated recurrent language model in numpy: truncated backpropagation, and an output softmax factored by classes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Width of words and of the state; input rows for words outside the vocabulary; steps of one truncated window.
WIDTH, SPARE, STEPS = 24, 64, 16
LARGEST_CLASS, CLASSES = 128, 48
#: States whose classes are scored at once.
BLOCK = 4096
#: Logits between whose negative and itself exponentials and their sums are safe without being drawn to the largest.
SAFE = 60.0


def make_classes(counts: np.ndarray) -> np.ndarray:
    """First word of each class, for words by falling count: classes of equal sums of root counts, of bounded size."""
    share = np.sqrt(counts)
    bound, firsts, held = share.sum() / CLASSES, [0], 0.0
    for k, x in enumerate(share):
        if k > firsts[-1] and (held + x > bound or k - firsts[-1] >= LARGEST_CLASS):
            firsts.append(k)
            held = 0.0
        held += x
    return np.array(firsts)


class Model:
    """Words 0 to n - 1 have outputs; the ids after them, SPARE and one for a text's start, are inputs only. The last class stands
    for all words without an output of their own: how they share its probability is up to the caller."""

    def __init__(self, firsts: np.ndarray, counts: np.ndarray, rest: float, seed: int = 7) -> None:
        self.n, self.firsts = len(counts), firsts
        self.stops = np.append(firsts[1:], self.n)
        self.class_of = np.append(np.repeat(np.arange(len(firsts)), self.stops - firsts), np.full(SPARE + 1, len(firsts))).astype(np.int16)  # as these sort by radix
        rng = np.random.default_rng(seed)
        shapes = {"words": (self.n + SPARE + 1, WIDTH), "inward": (WIDTH, 3 * WIDTH), "onward": (WIDTH, 3 * WIDTH), "gates": (3 * WIDTH,), "classes": (WIDTH, len(firsts) + 1), "members": (self.n, WIDTH)}
        self.p = {k: (rng.standard_normal(s) * (0.3 if k in ("words", "inward", "onward") else 0.0)).astype(np.float32) for k, s in shapes.items()}
        mass = np.append(np.add.reduceat(counts, firsts), rest) if self.n else np.array([1.0])
        self.p["class_bias"] = np.log(np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum()).astype(np.float32)
        self.p["member_bias"] = np.log(np.maximum(counts, 0.5)).astype(np.float32)
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def ready(self) -> Model:
        """What every input adds to the gates, made once for many steps."""
        self.table = self.p["words"] @ self.p["inward"] + self.p["gates"]
        return self

    def step(self, inputs: np.ndarray, h: np.ndarray) -> np.ndarray:
        a = self.table[inputs]
        u = h @ self.p["onward"]
        zr = _sigmoid(a[:, : 2 * WIDTH] + u[:, : 2 * WIDTH])
        new = np.tanh(a[:, 2 * WIDTH :] + zr[:, WIDTH:] * u[:, 2 * WIDTH :])
        return new + zr[:, :WIDTH] * (h - new)

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability after its state; for a target without output, of the last class."""
        order, own, edges = self._by_class(targets)
        rows, targets, out = _with_ones(states[order]), targets[order], np.empty(len(order))
        tops = np.vstack((self.p["classes"], self.p["class_bias"]))
        for low in range(0, len(order), BLOCK):
            at = own[low : low + BLOCK]
            logits = rows[low : low + BLOCK] @ tops
            found = logits[np.arange(len(at)), at]
            top = _exponentials(logits.reshape(-1), np.full(len(at), logits.shape[1]))
            out[low : low + BLOCK] = found - (top + np.log(logits.sum(axis=1)))
        within = self._within(rows, own, edges)
        if len(within.at):
            found = within.flat[within.places(targets)]
            top = _exponentials(within.flat, within.sizes)
            out[within.at] += found - (top + np.log(np.add.reduceat(within.flat, within.firsts)))
        back = np.empty_like(out)
        back[order] = out
        return back

    def _within(self, rows: np.ndarray, own: np.ndarray, edges: np.ndarray) -> _Within:
        """Logits of all members of each row's class, for rows in order of their classes."""
        sizes = np.append(self.stops - self.firsts, 0)[own]
        sizes[sizes == 1] = 0
        at = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)
        members = np.column_stack((self.p["members"], self.p["member_bias"]))
        flat, blocks = np.empty(int(ends[-1]) if len(ends) else 0, np.result_type(rows, members)), []
        for c, a, b in self._inner(edges):
            low, high = int(self.firsts[c]), int(self.stops[c])
            block = flat[ends[b - 1] - (b - a) * (high - low) : ends[b - 1]].reshape(b - a, high - low)
            np.matmul(rows[a:b], members[low:high].T, out=block)
            blocks.append((a, b, low, high, block))
        return _Within(flat, blocks, at, sizes[at], (ends - sizes)[at], self.firsts[own[at]])

    def _by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The targets' places in order of their classes, these classes, and the edges between those with members."""
        own = self.class_of[targets]
        order = np.argsort(own, kind="stable")
        own = own[order]
        return order, own, np.searchsorted(own, np.arange(len(self.firsts) + 1))

    def _inner(self, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """Classes of several words that some targets have, and where these targets begin and end."""
        return [(c, a, b) for c, a, b in zip(range(len(self.firsts)), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a and self.stops[c] - self.firsts[c] > 1]

    def onward(self) -> np.ndarray:
        """What a state adds to the gates, transposed; of the first two gates half, as their tanh wants it."""
        out = self.p["onward"].T.copy()
        out[: 2 * WIDTH] *= 0.5
        return out

    def learn(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray, rate: float = 0.1) -> np.ndarray:
        """One Adagrad step on a window of (steps, texts); returns the state after it, through which no gradient flows back.

        Within a window all arrays are (steps, units, texts), so that each step's work is on whole rows."""
        p, t, b, w = self.p, *inputs.shape, WIDTH
        onward, kind = self.onward(), p["onward"].dtype
        x = p["words"][inputs].transpose(0, 2, 1)
        a = p["inward"].T @ x
        a += p["gates"][:, None]
        a[:, : 2 * w] *= 0.5
        hs, us, zr, ns = (np.empty((t + k, n * w, b), kind) for k, n in ((1, 1), (0, 3), (0, 2), (0, 1)))
        hs[0] = h.T
        for k in range(t):
            _step(a[k], onward, hs[k], us[k], zr[k], ns[k], hs[k + 1])
        at = np.flatnonzero(mask)
        order, own, edges = self._by_class(targets.ravel()[at])
        at = at[order]
        g, back = self._output_gradients(hs[1:].transpose(0, 2, 1).reshape(-1, w)[at], targets.ravel()[at], own, edges)
        d_states = np.zeros((t * b, w), kind)
        d_states[at] = back
        d_states = np.ascontiguousarray(d_states.reshape(t, b, w).transpose(0, 2, 1))
        z, r = zr[:, :w], zr[:, w:]
        to_new, to_z, to_r = (1 - z) * (1 - ns * ns), (hs[:-1] - ns) * (z * (1 - z)), us[:, 2 * w :] * (r * (1 - r))
        d, d_new, dh = np.empty((t, 3 * w, b), kind), np.empty((t, w, b), kind), np.zeros((w, b), kind)
        for k in reversed(range(t)):
            dh += d_states[k]
            new = np.multiply(dh, to_new[k], out=d_new[k])
            np.multiply(dh, to_z[k], out=d[k, :w])
            np.multiply(new, to_r[k], out=d[k, w : 2 * w])
            np.multiply(new, r[k], out=d[k, 2 * w :])
            dh *= z[k]
            dh += p["onward"] @ d[k]
        g["onward"] = (hs[:-1] @ d.transpose(0, 2, 1)).sum(axis=0)
        d[:, 2 * w :] = d_new
        g["inward"] = (x @ d.transpose(0, 2, 1)).sum(axis=0)
        g["gates"] = d.sum(axis=(0, 2))
        rows, sums = _sum_rows(inputs.ravel(), (d.transpose(0, 2, 1) @ p["inward"].T).reshape(-1, w))
        seen = self.seen["words"][rows] + sums * sums
        self.seen["words"][rows] = seen
        p["words"][rows] -= rate * sums / np.sqrt(seen)
        for k, v in g.items():
            room = v * v
            self.seen[k] += room
            np.sqrt(self.seen[k], out=room)
            v *= rate
            v /= room
            p[k] -= v
        return hs[-1].T

    def _output_gradients(self, states: np.ndarray, targets: np.ndarray, own: np.ndarray, edges: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss, for states in order of their targets' classes. Logits of all classes' members lie one after the other, row by
        row, so that all but the products is done once for all classes."""
        p, share, w = self.p, 1 / max(len(targets), 1), WIDTH
        rows = _with_ones(states)
        d = rows @ np.vstack((p["classes"], p["class_bias"]))
        _exponentials(d.reshape(-1), np.full(len(d), d.shape[1]))
        d *= (share / d.sum(axis=1))[:, None]
        d[np.arange(len(own)), own] -= share
        tops, members, back, inner = rows.T @ d, np.zeros((self.n, w + 1), d.dtype), d @ p["classes"].T, np.zeros_like(states)
        within = self._within(rows, own, edges)
        if len(within.at):
            e = within.flat
            _exponentials(e, within.sizes)
            e *= np.repeat(share / np.add.reduceat(e, within.firsts), within.sizes)
            e[within.places(targets)] -= share
            for a, b, low, high, block in within.blocks:
                np.matmul(block.T, rows[a:b], out=members[low:high])
                np.matmul(block, p["members"][low:high], out=inner[a:b])
            back += inner
        return {"classes": tops[:w], "class_bias": tops[w], "members": members[:, :w].copy(), "member_bias": members[:, w].copy()}, back


class _Within(NamedTuple):
    """Logits within classes, row after row, and by class (first and end row, first and end member, these logits); rows that have some, how
    many, where these begin, and the first member of each one's class."""

    flat: np.ndarray
    blocks: list[tuple[int, int, int, int, np.ndarray]]
    at: np.ndarray
    sizes: np.ndarray
    firsts: np.ndarray
    lows: np.ndarray

    def places(self, targets: np.ndarray) -> np.ndarray:
        return self.firsts + targets[self.at] - self.lows


def _with_ones(states: np.ndarray) -> np.ndarray:
    """With a column of ones, for the biases."""
    out = np.ones((len(states), WIDTH + 1), states.dtype)
    out[:, :WIDTH] = states
    return out


def _exponentials(x: np.ndarray, sizes: np.ndarray) -> np.ndarray | float:
    """In place, of runs of such sizes; each run less its largest, which is returned, where values could be too large or small for that."""
    if not len(x) or (x.max() < SAFE and x.min() > -SAFE):
        np.exp(x, out=x)
        return 0.0
    top = np.maximum.reduceat(x, np.cumsum(sizes) - sizes)
    x -= np.repeat(top, sizes)
    np.exp(x, out=x)
    return top


def _step(a: np.ndarray, onward: np.ndarray, h: np.ndarray, u: np.ndarray, zr: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """One step of the states h (units, texts) to out; a is what the inputs add to the gates, of the first two half."""
    np.matmul(onward, h, out=u)
    np.add(a[: 2 * WIDTH], u[: 2 * WIDTH], out=zr)
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    np.multiply(zr[WIDTH:], u[2 * WIDTH :], out=new)
    new += a[2 * WIDTH :]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= zr[:WIDTH]
    out += new


def score(model: Model, texts: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """The natural log-likelihood of each whole text (ids; an empty one has 0): texts of like length run side by side, and each
    one's state is carried on from window to window."""
    out = np.zeros(len(texts))
    onward, halves = model.onward(), model.table.copy()
    halves[:, : 2 * WIDTH] *= 0.5
    for own, sizes, low, ids, mask in _windows(model, texts, lanes, window):
        live, steps = len(sizes), len(mask)
        h = np.zeros((WIDTH, live), halves.dtype) if low == 0 else h[:, :live]
        a = np.ascontiguousarray(halves[ids[:-1]].transpose(0, 2, 1))
        hs, (u, zr, new) = np.empty((steps, WIDTH, live), halves.dtype), (np.empty((n * WIDTH, live), halves.dtype) for n in (3, 2, 1))
        for k in range(steps):
            _step(a[k], onward, h, u, zr, new, hs[k])
            h = hs[k]
        at = np.flatnonzero(mask)
        found = model.log_likelihood(hs.transpose(0, 2, 1).reshape(-1, WIDTH)[at], ids[1:].ravel()[at])
        out[own[:live]] += np.bincount(at % live, weights=found, minlength=live)
    return out


def train(model: Model, texts: list[np.ndarray], lanes: int = 128) -> int:
    """Learn from each text's ids, window by window with the state carried on; returns how many tokens were seen."""
    for _, sizes, low, ids, mask in _windows(model, texts, lanes, STEPS):
        h = np.zeros((len(sizes), WIDTH), np.float32) if low == 0 else h[: len(sizes)]
        h = model.learn(ids[:-1], ids[1:], mask, h)
    return sum(len(x) for x in texts)


def _windows(model: Model, texts: list[np.ndarray], lanes: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Texts that aren't empty, longest first, side by side and window after window: places of the lanes' texts, sizes of those that reach
    into the window, its first token, the ids of these from the one before it on (steps + 1, texts), and which of the others are tokens."""
    start = model.n + SPARE
    order = np.argsort([-len(x) for x in texts], kind="stable")
    order = order[: sum(len(x) > 0 for x in texts)]
    for first in range(0, len(order), lanes):
        own = order[first : first + lanes]
        sizes = np.array([len(texts[k]) for k in own])
        flat = np.concatenate([texts[k] for k in own])
        begins, last = np.cumsum(sizes) - sizes, np.full(len(own), start)
        for low in range(0, int(sizes[0]), window):
            live = int((sizes > low).sum())
            step = np.arange(low, min(low + window, int(sizes[0])))[:, None]
            mask = step < sizes[:live]
            ids = np.empty((len(step) + 1, live), np.int64)
            ids[0] = last[:live]
            ids[1:] = np.where(mask, flat[np.minimum(begins[:live] + step, len(flat) - 1)], start)
            last = ids[-1]
            yield own, sizes[:live], low, ids, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _sum_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sum of each one's rows."""
    order = np.argsort(keys.astype(np.int16) if len(keys) and keys.max() < 1 << 15 else keys, kind="stable")  # short ones sort by radix
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[firsts], np.add.reduceat(rows[order], firsts, axis=0)
