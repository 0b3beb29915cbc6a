"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Symbols are numbered by falling frequency; symbol s is in class ``s // size``. The model gives
log P(symbol) = log P(class | state) + log P(symbol | class, state), so a step costs the classes
plus one class, not all symbols. Documents run side by side in streams, one after the other; the
state is reset where a document begins and carried over every window boundary, so windows bound
backpropagation but not what the model has read. Streams are ragged: memory follows the symbols
held and one window, whatever the longest document. In training a document goes in pieces of
``PIECE`` symbols, as a few very long ones would leave most streams idle; scoring takes it whole.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
TRAIN_STEPS, SCORE_STEPS, STREAMS = 16, 32, 256
PIECE = 2048
LIMIT = F32(60)  # of a softmax's inputs, so that their exponentials stay finite and above 0


def initial(symbols: int, classes: int, hidden: int, counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are the unigram model of ``counts``."""
    rng = np.random.default_rng(seed)
    size = -(-symbols // classes)
    padded = np.full(size * classes, -30.0)
    padded[:symbols] = np.log(counts + 1.0)
    word = padded.reshape(classes, size)
    top = word.max(axis=1, keepdims=True)
    total = np.log(np.exp(word - top).sum(axis=1)) + top[:, 0]
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
    return {
        "E": small(3, symbols + 1, hidden),  # of the reset gate, the update gate and the candidate; the last row starts a document
        "U": small(3, hidden, hidden),
        "b": np.zeros((3, 1, hidden), F32),
        "Wc": np.zeros((hidden, classes), F32),
        "bc": (total - total.max()).astype(F32),
        "Wo": np.zeros((classes, hidden, size), F32),
        "bo": (word - total[:, None]).astype(F32),
    }


class Streams:
    """Documents dealt, longest first, to the shortest of ``n`` streams so far; the longest stream comes first."""

    def __init__(self, docs: list[np.ndarray], start: int, n: int = STREAMS):
        import heapq

        self.start = start
        load = [(0, s, []) for s in range(max(1, min(n, len(docs))))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            total, s, own = load[0]
            own.append(d)
            heapq.heapreplace(load, (total + len(docs[d]), s, own))
        load.sort(key=lambda x: (-x[0], x[1]))
        order = [d for _, _, own in load for d in own]
        sizes = np.array([len(docs[d]) for d in order], np.int64)
        self.length = np.array([total for total, _, _ in load], np.int64)
        self.end = np.cumsum(self.length)
        self.y = np.concatenate([docs[d] for d in order]).astype(np.int32) if order else np.zeros(0, np.int32)
        self.x = np.append(np.int32(start), self.y[:-1])
        self.x[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
        self.owner = np.repeat(np.array(order, np.int64), sizes)

    def windows(self, steps: int):
        """Targets (-1 where a stream has ended), inputs and owners as (step, stream) arrays, one window after the other."""
        for a in range(0, int(self.length.max(initial=0)), steps):
            alive = int((self.length > a).sum())
            at = (self.end - self.length)[:alive] + np.arange(a, min(a + steps, int(self.length[0])))[:, None]
            over = at >= self.end[:alive]
            at[over] = 0
            y, x = self.y[at], self.x[at]
            y[over], x[over] = -1, self.start
            yield y, x, self.owner[at]


def forward(p: dict, x: np.ndarray, h: np.ndarray, start: int) -> tuple[np.ndarray, dict]:
    """States after each step of a window, and what backpropagation needs."""
    (steps, n), hidden = x.shape, h.shape[1]
    gx = np.stack([e[x] for e in p["E"]])
    gx += p["b"][:, None]
    before, out, cand, gh_n = (np.empty((steps, n, hidden), F32) for _ in range(4))
    fresh = x == start
    for t, new in enumerate(fresh.any(axis=1)):
        before[t] = h
        if new:
            before[t, fresh[t]] = 0
        gate = gx[:2, t]  # becomes the reset and the update gate
        gate += np.matmul(before[t], p["U"][:2])
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += F32(1)
        np.reciprocal(gate, out=gate)
        np.matmul(before[t], p["U"][2], out=gh_n[t])
        c = np.multiply(gate[0], gh_n[t], out=cand[t])
        c += gx[2, t]
        np.tanh(c, out=c)
        h = np.subtract(before[t], c, out=out[t])
        h *= gate[1]
        h += c
    return out, {"before": before, "r": gx[0], "z": gx[1], "cand": cand, "gh_n": gh_n}


def _exponentials(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the clipped inputs, in place, and their row sums."""
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], F32)


class Targets:
    """Targets ordered by class, so that each class is one slice."""

    def __init__(self, p: dict, y: np.ndarray):
        classes, size = p["bo"].shape
        c = (y // size).astype(np.int16)
        self.order = np.argsort(c, kind="stable")
        self.c = c[self.order].astype(np.int64)
        self.at = y[self.order] - self.c * size
        edges = np.searchsorted(self.c, np.arange(classes + 1))
        self.slices = [(k, slice(edges[k], edges[k + 1])) for k in range(classes) if edges[k] < edges[k + 1]]
        self.row = np.arange(len(y))

    def inputs(self, p: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of both softmaxes for the ordered states ``h``."""
        a = h @ p["Wc"]
        a += p["bc"]
        b = np.empty((len(h), p["bo"].shape[1]), F32)
        for k, own in self.slices:
            np.matmul(h[own], p["Wo"][k], out=b[own])
            b[own] += p["bo"][k]
        return np.clip(a, -LIMIT, LIMIT, out=a), np.clip(b, -LIMIT, LIMIT, out=b)


def log_probabilities(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target under its state."""
    t = Targets(p, y)
    a, b = t.inputs(p, h[t.order])
    chosen = a[t.row, t.c] + b[t.row, t.at]
    out = np.empty(len(y), F32)
    out[t.order] = chosen - np.log(_exponentials(a)[1]) - np.log(_exponentials(b)[1])
    return out


def gradients(p: dict, x: np.ndarray, y: np.ndarray, h0: np.ndarray, start: int, g: dict) -> tuple[np.ndarray, float, int]:
    """Mean gradients over a window into ``g``; the state after it, the summed loss and the number of targets."""
    (steps, n), hidden = x.shape, h0.shape[1]
    out, kept = forward(p, x, h0, start)
    valid = np.flatnonzero(y.ravel() >= 0)
    t = Targets(p, y.ravel()[valid])
    place, scale = valid[t.order], F32(1 / len(valid))
    h = out.reshape(-1, hidden)[place]
    a, b = t.inputs(p, h)
    loss = -float((a[t.row, t.c] + b[t.row, t.at]).sum())
    for d, at in ((a, t.c), (b, t.at)):
        total = _exponentials(d)[1]
        loss += float(np.log(total).sum())
        d *= (scale / total)[:, None]
        d[t.row, at] -= scale
    one = np.ones(len(h), F32)
    np.matmul(h.T, a, out=g["Wc"])
    np.matmul(one, a, out=g["bc"])
    dh = a @ p["Wc"].T
    g["Wo"][:], g["bo"][:] = 0, 0
    for k, own in t.slices:
        np.matmul(h[own].T, b[own], out=g["Wo"][k])
        np.matmul(one[own], b[own], out=g["bo"][k])
        dh[own] += b[own] @ p["Wo"][k].T
    back_in = np.zeros((steps * n, hidden), F32)
    back_in[place] = dh
    back_in = back_in.reshape(steps, n, hidden)
    before, cand, r, z = (kept[k] for k in ("before", "cand", "r", "z"))
    keep = 1 - z
    of_z = (before - cand) * z
    of_z *= keep
    keep *= 1 - cand * cand
    of_r = kept["gh_n"] * r
    of_r *= 1 - r
    dx, dgh_n = np.empty((3, steps, n, hidden), F32), np.empty((steps, n, hidden), F32)
    back, turned = np.zeros((n, hidden), F32), np.ascontiguousarray(p["U"].transpose(0, 2, 1))
    fresh = x == start
    for s in reversed(range(steps)):
        da = np.add(back, back_in[s], out=back)
        dn = np.multiply(da, keep[s], out=dx[2, s])
        np.multiply(dn, of_r[s], out=dx[0, s])
        np.multiply(da, of_z[s], out=dx[1, s])
        np.multiply(dn, r[s], out=dgh_n[s])
        da *= z[s]
        da += dx[0, s] @ turned[0]
        da += dx[1, s] @ turned[1]
        da += dgh_n[s] @ turned[2]
        da[fresh[s]] = 0
    flat, state = dx.reshape(3, -1, hidden), before.reshape(-1, hidden).T
    for k, d in enumerate((flat[0], flat[1], dgh_n.reshape(-1, hidden))):
        np.matmul(state, d, out=g["U"][k])
    np.matmul(np.ones(flat.shape[1], F32), flat, out=g["b"][:, 0])
    order = np.argsort(x.ravel().astype(np.int16), kind="stable")
    rows, first = np.unique(x.ravel()[order], return_index=True)
    g["E"][:] = 0
    g["E"][:, rows] = np.add.reduceat(np.concatenate([d[order] for d in flat], axis=1), first, axis=0).reshape(-1, 3, hidden).transpose(1, 0, 2)
    return out[-1], loss, len(valid)


def packed(p: dict) -> tuple[np.ndarray, dict]:
    """All weights in one array, and views of it by name."""
    flat, views, at = np.empty(sum(v.size for v in p.values()), F32), {}, 0
    for k in sorted(p):
        views[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        views[k][...] = p[k]
        at += p[k].size
    return flat, views


def train(p: dict, docs: list[np.ndarray], rate: float = 0.02, steps: int = TRAIN_STEPS, n: int = STREAMS, piece: int = PIECE) -> tuple[dict, float, int]:
    """Adam over all windows of ``docs``, in order; the new weights, the summed loss and the number of symbols."""
    start, hidden = p["E"].shape[1] - 1, p["E"].shape[2]
    w, p = packed(p)
    grad, g = packed(p)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    pieces = [d[at : at + piece] for d in docs for at in range(0, len(d), piece)]
    streams = Streams(pieces, start, n)
    h, loss, seen = np.zeros((len(streams.length), hidden), F32), 0.0, 0
    for i, (y, x, _) in enumerate(streams.windows(steps), 1):
        h, lost, m = gradients(p, x, y, h[: x.shape[1]], start, g)
        loss, seen = loss + lost, seen + m
        weight = min(1.0, m / (steps * n))  # narrow windows count less
        mean += F32(0.1) * (grad - mean)
        square += F32(0.01) * (grad * grad - square)
        fix = F32(rate * weight * np.sqrt(1 - 0.99**i) / (1 - 0.9**i))
        w -= fix * mean / (np.sqrt(square) + F32(1e-6))
    return p, loss, seen


def score(p: dict, docs: list[np.ndarray], steps: int = SCORE_STEPS, n: int = STREAMS) -> np.ndarray:
    """Natural log-likelihood of each document."""
    start, hidden = p["E"].shape[1] - 1, p["E"].shape[2]
    streams = Streams(docs, start, n)
    total, h = np.zeros(len(docs)), np.zeros((len(streams.length), hidden), F32)
    for y, x, owner in streams.windows(steps):
        out, _ = forward(p, x, h[: x.shape[1]], start)
        h = out[-1]
        valid = np.flatnonzero(y.ravel() >= 0)
        total += np.bincount(owner.ravel()[valid], log_probabilities(p, out.reshape(-1, hidden)[valid], y.ravel()[valid]), len(docs))
    return total
