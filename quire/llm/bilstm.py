"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy.

Gates and cell use piecewise linear functions (hard sigmoid, hard tanh), which cost a clip. Arrays
are (features, sequences), so that each step works on contiguous rows.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _hard(z):
    return np.clip(0.25 * z + 0.5, 0, 1)


class Tagger:
    """kinds: names of the tags above 0 (outside). hidden: units a direction."""

    def __init__(self, symbols: int, tags: int, hidden: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, tags
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.5, (4 * hidden, symbols))
            self.p[f"u{d}"] = rng.normal(0, 0.35, (4 * hidden, hidden))
            self.p[f"x{d}"][hidden : 2 * hidden] += 1.0  # remember at first
            self.p[f"e{d}"] = rng.normal(0, 0.5, (tags, hidden))
        self.p["bias"] = np.array([2.0] + [-1.0] * (tags - 1))
        self.p["trans"] = np.where(np.eye(tags) > 0, 1.0, -1.0)  # from row to column
        self.p["start"] = np.zeros(tags)

    # --- training -----------------------------------------------------------------------------

    def _run(self, x, d):
        h, (t, n) = self.h, x.shape
        u, wx = self.p[f"u{d}"], self.p[f"x{d}"]
        state, cell, kept = np.zeros((h, n)), np.zeros((h, n)), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[:, x[s]] + u @ state
            g = _hard(z[: 3 * h])
            m = np.clip(z[3 * h :], -1, 1)
            old = cell
            cell = g[h : 2 * h] * old + g[:h] * m
            squashed = np.clip(cell, -1, 1)
            kept.append((s, state, z, g, m, old, cell, squashed))
            state = g[2 * h : 3 * h] * squashed
        return kept, [k[3][2 * h : 3 * h] * k[7] for k in kept]

    def loss(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y (t, n) for symbols x (t, n), and the gradient of each parameter."""
        (t, n), h, k = x.shape, self.h, self.k
        runs = {d: self._run(x, d) for d in "fb"}
        states = {"f": runs["f"][1], "b": runs["b"][1][::-1]}
        e = np.stack([self.p["ef"] @ states["f"][s] + self.p["eb"] @ states["b"][s] for s in range(t)]) + self.p["bias"][:, None]
        a, b = np.zeros((t, k, n)), np.zeros((t, k, n))
        tr = self.p["trans"]
        a[0] = e[0] + self.p["start"][:, None]
        for s in range(1, t):
            a[s] = _lse(a[s - 1][:, None] + tr[:, :, None], 0) + e[s]
        for s in range(t - 2, -1, -1):
            b[s] = _lse(tr[:, :, None] + (e[s + 1] + b[s + 1])[None], 1)
        z = _lse(a[-1], 0)
        cols = np.arange(n)
        gold = self.p["start"][y[0]] + e[0][y[0], cols]
        ge = np.exp(a + b - z)
        gt, gs = np.zeros((k, k)), ge[0].sum(axis=1)
        for s in range(1, t):
            gold = gold + tr[y[s - 1], y[s]] + e[s][y[s], cols]
            gt += np.exp(a[s - 1][:, None] + tr[:, :, None] + (e[s] + b[s])[None] - z).sum(axis=2)
            np.add.at(gt, (y[s - 1], y[s]), -1)
        np.add.at(gs, y[0], -1)
        ge[np.arange(t)[:, None], y, cols[None]] -= 1
        grad = {q: np.zeros_like(v) for q, v in self.p.items()}
        grad["trans"], grad["start"], grad["bias"] = gt, gs, ge.sum(axis=(0, 2))
        for d in "fb":
            kept = runs[d][0]
            back, cellback = np.zeros((h, n)), np.zeros((h, n))
            dzs, olds = np.empty((t, 4 * h, n)), np.empty((t, h, n))
            for s, state, zz, g, m, old, cell, squashed in kept[::-1]:
                dh = self.p[f"e{d}"].T @ ge[s] + back
                dc = cellback + dh * g[2 * h :] * (np.abs(cell) < 1)
                dz = dzs[s]
                dz[:h], dz[h : 2 * h], dz[2 * h : 3 * h], dz[3 * h :] = dc * m, dc * old, dh * squashed, dc * g[:h] * (np.abs(zz[3 * h :]) < 1)
                dz[: 3 * h] *= 0.25 * (np.abs(zz[: 3 * h]) < 2)
                olds[s] = state
                back, cellback = self.p[f"u{d}"].T @ dz, dc * g[h : 2 * h]
            flat = dzs.transpose(1, 0, 2).reshape(4 * h, -1)
            grad[f"e{d}"] = np.tensordot(ge, np.stack(states[d]), ((0, 2), (0, 2)))
            grad[f"u{d}"] = np.tensordot(dzs, olds, ((0, 2), (0, 2)))
            grad[f"x{d}"] = flat @ (x.reshape(-1, 1) == np.arange(self.p[f"x{d}"].shape[1]))
        return float((z - gold).sum() / (t * n)), {q: v / (t * n) for q, v in grad.items()}

    def fit(self, batches, rate: float = 0.02):
        """Adam over (x, y) batches; the last loss."""
        m = {q: np.zeros_like(v) for q, v in self.p.items()}
        v = {q: np.zeros_like(w) for q, w in self.p.items()}
        loss = 0.0
        for i, (x, y) in enumerate(batches, 1):
            loss, grad = self.loss(x, y)
            size = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for q, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.99 * v[q] + 0.01 * g * g
                self.p[q] -= rate * (m[q] / (1 - 0.9**i)) / (np.sqrt(v[q] / (1 - 0.99**i)) + 1e-8)
        return loss

    # --- decoding -----------------------------------------------------------------------------

    def ready(self):
        """Weights as decode() wants them: gates scaled so that a hard sigmoid is one clip."""
        h = self.h
        scale = np.concatenate([np.full(3 * h, 0.25), np.ones(h)])[:, None]
        shift = np.concatenate([np.full(3 * h, 0.5), np.zeros(h)])[:, None]
        pad = np.concatenate([np.full(3 * h, -1e6), np.zeros(h)])[:, None]  # one symbol more shuts all gates: the state is 0 as at a start
        w = {f"x{d}": np.hstack([self.p[f"x{d}"] * scale + shift, pad]).astype(F32) for d in "fb"}
        w |= {f"u{d}": (self.p[f"u{d}"] * scale).astype(F32) for d in "fb"} | {f"e{d}": self.p[f"e{d}"].astype(F32) for d in "fb"}
        return w | {q: self.p[q].astype(F32) for q in ("bias", "trans", "start")} | {"h": h, "k": self.k}


def emissions(w: dict, x: np.ndarray) -> np.ndarray:
    """(t, tags, n) scores of symbols x (t, n)."""
    (t, n), h, k = x.shape, w["h"], w["k"]
    e = np.empty((t, k, n), F32)
    z, u, part = np.empty((4 * h, n), F32), np.empty((4 * h, n), F32), np.empty((k, n), F32)
    state, cell, tmp = np.empty((h, n), F32), np.empty((h, n), F32), np.empty((h, n), F32)
    for d in "fb":
        state[:], cell[:] = 0, 0
        wx, wu, we = w[f"x{d}"], w[f"u{d}"], w[f"e{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(wx, x[s], axis=1, out=z, mode="clip")
            np.dot(wu, state, out=u)
            z += u
            g, m = z[: 3 * h], z[3 * h :]
            np.clip(g, 0, 1, out=g)
            np.clip(m, -1, 1, out=m)
            m *= g[:h]
            cell *= g[h : 2 * h]
            cell += m
            np.clip(cell, -1, 1, out=tmp)
            np.multiply(g[2 * h : 3 * h], tmp, out=state)
            if d == "f":
                np.dot(we, state, out=e[s])
            else:
                np.dot(we, state, out=part)
                e[s] += part
    e += w["bias"][:, None]
    return e


def gains(e: np.ndarray) -> np.ndarray:
    """(t, n): by how much the best other tag leads 0, for emissions e (t, tags, n)."""
    return e[:, 1:].max(axis=1) - e[:, 0]


#: What stands for the gain of a place between two texts.
BETWEEN = -1e5
#: Places whose sums are made at once.
SUMMED = 1 << 20


def open_places(w: dict, gain: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places, in order, where the best path may have a tag other than 0.

    gain has the gains of texts that lie side by side, with BETWEEN between them, begins and ends the first and last
    places of texts. A stretch of other tags can better as many 0 by no more than the sum of its gains and of the best
    transitions into it, within it and out of it. A place is open if the best such sum of any stretch over it isn't
    negative; a stretch of the best path is never worse than as many 0, so the path has 0 at all other places.
    """
    tr, start = w["trans"].astype(float), w["start"].astype(float)
    into, step, leave = tr[0, 1:].max() - tr[0, 0], tr[1:, 1:].max() - tr[0, 0], tr[1:, 0].max() - tr[0, 0]
    g = gain + np.float32(step)
    g[begins] += np.float32(start[1:].max() - start[0] - into)
    g[ends] -= np.float32(leave)
    best = np.empty(len(g), np.float32)  # of stretches that end at a place
    carry = -np.inf
    for i in range(0, len(g), SUMMED):
        total = np.cumsum(g[i : i + SUMMED], dtype=float)
        low = np.minimum.accumulate(np.concatenate([[min(-into, -carry)], total[:-1] - into]))
        best[i : i + SUMMED] = total - low
        carry = float(total[-1] - low[-1])
    found, carry = [], -np.inf
    for i in range((len(g) - 1) // SUMMED * SUMMED, -1, -SUMMED):
        part = g[i : i + SUMMED][::-1]
        total = np.cumsum(part, dtype=float)
        low = np.minimum.accumulate(np.concatenate([[min(0.0, -carry)], total[:-1]]))
        after = total - low
        most = best[i : i + SUMMED] + (after - part)[::-1] + (leave - step)
        found.append(i + np.flatnonzero((most >= -1e-2) & (gain[i : i + SUMMED] > BETWEEN)))
        carry = float(after[-1])
    return np.concatenate([*found[::-1], np.zeros(0, np.int64)]).astype(np.int64)


#: Places of a run that are searched in one go; a longer run is searched in pieces whose ends are settled together.
PIECE = 256
#: Pieces that are searched together.
ABREAST = 512


def best_path(w: dict, at: np.ndarray, e: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The tags of the best path at the open places of texts; those at all other places are 0.

    at has the places in order (texts lie side by side with a place between them), e (m, tags) their emissions, begins
    and ends tell the first and last place of a text. As the path has 0 at all other places, each run of open places is
    searched alone, from 0 (or a text's start) to 0 (or a text's end), and what comes out is the best path of the whole text.
    A run longer than PIECE is cut into pieces: the best scores between the tags at a piece's two ends are found for
    each, these are joined along the run, and the pieces are then searched with their ends known.
    """
    if not len(at):
        return np.zeros(0, np.int8)
    tr, start = w["trans"].astype(float), w["start"].astype(float)
    cut = np.append(True, np.diff(at) != 1)
    within = np.arange(len(at)) - np.flatnonzero(cut)[np.cumsum(cut) - 1]
    first = np.flatnonzero(within % PIECE == 0)
    size = np.diff(np.append(first, len(at)))
    head = cut[first]
    tail = np.append(head[1:], True)
    entry = np.where(begins[first][:, None], start, tr[0])
    leave = np.where(ends[first + size - 1][:, None], 0.0, tr[:, 0])
    part = np.flatnonzero(~(head & tail))
    if len(part):
        between = _between(tr, e, first[part], size[part])
        at_head = np.append(np.flatnonzero(head[part]), len(part))
        for a, b in zip(at_head[:-1].tolist(), at_head[1:].tolist()):
            come, froms, lasts = entry[part[a]], [], []
            for i in range(a, b):
                ways = come[:, None] + between[i]
                froms.append(ways.argmax(axis=0))
                out = ways.max(axis=0)
                ways = out[:, None] + tr
                lasts.append(ways.argmax(axis=0))
                come = ways.max(axis=0)
            last = int((out + leave[part[b - 1]]).argmax())
            for i in range(b - 1, a - 1, -1):
                tag = int(froms[i - a][last])
                entry[part[i]], leave[part[i]] = -np.inf, -np.inf
                entry[part[i], tag] = leave[part[i], last] = 0.0
                if i > a:
                    last = int(lasts[i - 1 - a][tag])
    tags = np.zeros(len(at), np.int8)
    order = np.argsort(-size, kind="stable")
    for i in range(0, len(order), ABREAST):
        some = order[i : i + ABREAST]
        f, n = first[some], (size[some][None] > np.arange(size[some[0]])[:, None]).sum(axis=1)
        best, back = entry[some].T + e[f].T, np.zeros((len(n), len(tr), len(some)), np.int8)
        for s in range(1, len(n)):
            k = n[s]
            ways = best[:, None, :k] + tr[:, :, None]
            back[s, :, :k] = ways.argmax(axis=0)
            best[:, :k] = ways.max(axis=0) + e[f[:k] + s].T
        now = (best + leave[some].T).argmax(axis=0)
        for s in range(len(n) - 1, -1, -1):
            k = n[s]
            tags[f[:k] + s] = now[:k]
            if s:
                now[:k] = back[s, now[:k], np.arange(k)]
    return tags


def _between(tr: np.ndarray, e: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(pieces, tags, tags): the best score of a path through each piece from a tag at its first place to one at its last."""
    k = len(tr)
    out = np.empty((len(first), k, k))
    order = np.argsort(-size, kind="stable")
    for i in range(0, len(order), ABREAST):
        some = order[i : i + ABREAST]
        f, n = first[some], (size[some][None] > np.arange(size[some[0]])[:, None]).sum(axis=1)
        best = np.where(np.eye(k, dtype=bool)[:, :, None], e[f].T[None], -np.inf)  # from, to, piece
        for s in range(1, len(n)):
            now = n[s]
            best[:, :, :now] = (best[:, :, None, :now] + tr[None, :, :, None]).max(axis=1) + e[f[:now] + s].T[None]
        out[some] = best.transpose(2, 0, 1)
    return out


def decode(w: dict, x: np.ndarray) -> dict[int, np.ndarray]:
    """The best tags of each column of symbols x (t, n), a text of its own, that has a tag other than 0."""
    e = emissions(w, x)
    t, n = x.shape
    flat = np.full((n, t + 1), BETWEEN, np.float32)
    flat[:, :t] = gains(e).T
    firsts = np.arange(n) * (t + 1)
    at = open_places(w, flat.reshape(-1), firsts, firsts + t - 1)
    col, row = at // (t + 1), at % (t + 1)
    tags = np.zeros((t, n), np.int8)
    tags[row, col] = best_path(w, at, e[row, :, col], row == 0, row == t - 1)
    return {c: tags[:, c] for c in np.flatnonzero(tags.any(axis=0)).tolist()}


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
