"""A character-level bidirectional LSTM with CRF transitions, forward and backward, in numpy."""
from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 12, 20
CODES = 98  # 0 padding, 1 any other character, 2.. the printable ASCII ones and the newline


def encode(windows: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes [n, width] and lengths."""
    out = np.zeros((len(windows), width), np.int64)
    for i, w in enumerate(windows):
        points = np.frombuffer(w[:width].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out[i, :len(points)] = np.where((points >= 32) & (points < 127), points - 30, np.where(points == 10, 97, 1))
    return out, np.array([min(len(w), width) for w in windows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights, one Adam step on a batch, and Viterbi decoding. `allowed` [labels, labels] and `first` are hard rules."""

    def __init__(self, labels: int, allowed: np.ndarray, first: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        f32 = lambda *shape: (draw.standard_normal(shape) * 0.2).astype(np.float32)
        self.w = {"embed": f32(CODES, EMBED), "out": f32(2 * h, labels), "out_bias": np.zeros(labels, np.float32),
                  "move": np.zeros((labels, labels), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h:2 * h] = 1  # forget gate
            self.w |= {f"in_{d}": f32(EMBED, 4 * h), f"own_{d}": f32(h, 4 * h), f"bias_{d}": bias}
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)
        self.start = np.where(first, 0, -1e4).astype(np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.t = 0

    def _lstm(self, codes: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        h, (n, steps) = HIDDEN, codes.shape
        table = self.w["embed"] @ self.w[f"in_{d}"] + self.w[f"bias_{d}"]
        own = self.w[f"own_{d}"]
        hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((steps, n, h), np.float32)
        saved = []
        for s in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = table[codes[:, s]] + hidden @ own
            gates, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            on = mask[:, s:s + 1]
            cell_new = (f * cell + i * new) * on
            shown = np.tanh(cell_new)
            hidden_new = o * shown * on
            if keep:
                saved.append((s, hidden, cell, i, f, o, new, shown))
            hidden, cell = hidden_new, cell_new
            out[s] = hidden
        return out, saved

    def emissions(self, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._lstm(codes, mask, "f", keep)
        b, sb = self._lstm(codes, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.w["out"] + self.w["out_bias"], both, (sf, sb)

    def step(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rate: float) -> float:
        """One Adam step on the mean negative log likelihood of whole label sequences; gives the loss."""
        n, steps = codes.shape
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        emit, both, saved = self.emissions(codes, mask, keep=True)
        move = self.w["move"] + self.barred
        k = emit.shape[2]
        on = mask.T[:, :, None]
        alpha = np.zeros((steps, n, k), np.float32)
        alpha[0] = emit[0] + self.start
        for s in range(1, steps):
            a = _logsumexp(alpha[s - 1][:, :, None] + move[None], 1) + emit[s]
            alpha[s] = np.where(on[s] > 0, a, alpha[s - 1])
        total = _logsumexp(alpha[-1], 1)
        beta = np.zeros((steps, n, k), np.float32)
        expected = np.zeros((k, k), np.float64)
        for s in range(steps - 2, -1, -1):
            ahead = emit[s + 1] + beta[s + 1]
            beta[s] = np.where(on[s + 1] > 0, _logsumexp(move[None] + ahead[:, None, :], 2), 0)
            joint = np.exp(np.minimum(alpha[s][:, :, None] + move[None] + ahead[:, None, :] - total[:, None, None], 0))
            expected += (joint * on[s + 1][:, :, None]).sum(axis=0)
        share = np.exp(np.minimum(alpha + beta - total[None, :, None], 0)) * on
        hot = (np.eye(k, dtype=np.float32)[labels.T]) * on
        gold_moves = np.zeros((k, k))
        pairs = on[1:, :, 0] > 0
        np.add.at(gold_moves, (labels.T[:-1][pairs], labels.T[1:][pairs]), 1)
        loss = float(total.mean() - (emit * hot).sum() / n - (gold_moves * self.w["move"]).sum() / n)
        g_emit = (share - hot) / n
        grads = {k2: np.zeros_like(v) for k2, v in self.w.items()}
        grads["move"] = ((expected - gold_moves) / n).astype(np.float32) * (self.barred == 0)
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ g_emit.reshape(-1, k)
        grads["out_bias"] = g_emit.sum(axis=(0, 1))
        g_both = g_emit @ self.w["out"].T
        self._back(codes, mask, saved[0], g_both[:, :, :HIDDEN], "f", grads)
        self._back(codes, mask, saved[1], g_both[:, :, HIDDEN:], "b", grads)
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for name, g in grads.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            self.m[name] += 0.1 * (g - self.m[name])
            self.v[name] += 0.01 * (g * g - self.v[name])
            self.w[name] -= (rate * (self.m[name] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[name] / (1 - 0.99 ** self.t)) + 1e-7)).astype(np.float32)
        return loss

    def _back(self, codes, mask, saved, g_out, d, grads):
        h, n = HIDDEN, len(codes)
        own, inner = self.w[f"own_{d}"], self.w[f"in_{d}"]
        g_hidden, g_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        by_code = np.zeros((CODES, 4 * h), np.float32)
        for s, hidden, cell, i, f, o, new, shown in reversed(saved):
            on = mask[:, s:s + 1]
            gh = (g_out[s] + g_hidden) * on
            gc = (g_cell + gh * o * (1 - shown * shown)) * on
            z = np.concatenate([gc * new * i * (1 - i), gc * cell * f * (1 - f), gh * shown * o * (1 - o), gc * i * (1 - new * new)], axis=1)
            grads[f"own_{d}"] += hidden.T @ z
            grads[f"bias_{d}"] += z.sum(axis=0)
            np.add.at(by_code, codes[:, s], z)
            g_hidden, g_cell = z @ own.T, gc * f
        grads[f"in_{d}"] += self.w["embed"].T @ by_code
        grads["embed"] += by_code @ inner.T

    def decode(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels [n, width] and each window's margin of label scores per character (emission of the label less the best other)."""
        n, steps = codes.shape
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        emit, _, _ = self.emissions(codes, mask)
        move = self.w["move"] + self.barred
        best, back = emit[0] + self.start, np.zeros((steps, n, emit.shape[2]), np.int8)
        for s in range(1, steps):
            ways = best[:, :, None] + move[None]
            back[s] = ways.argmax(axis=1)
            best = np.where(mask[:, s:s + 1] > 0, ways.max(axis=1) + emit[s], best)
        labels = np.zeros((n, steps), np.int64)
        at = best.argmax(axis=1)
        rows = np.arange(n)
        for s in range(steps - 1, -1, -1):
            inside = s < lengths
            labels[:, s] = np.where(inside, at, 0)
            if s:
                at = np.where(inside, back[s][rows, at], at)
        own = np.take_along_axis(emit, labels.T[:, :, None], 2)[:, :, 0]
        rest = emit.copy()
        np.put_along_axis(rest, labels.T[:, :, None], -np.inf, 2)
        return labels, (own - rest.max(axis=2)).T
