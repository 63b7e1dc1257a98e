"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Arrays are feature-major, [features, windows]. Gates are hard sigmoids and the
cell's activations the rational tanh of bigru.py; training is backpropagation
through time of the CRF's exact log-likelihood.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.bigru import soft, soft_slope


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class BiLSTMCRF:
    """Tags windows of symbols with one of the labels a position."""

    def __init__(self, symbols: int, labels: int, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.symbols, self.labels, self.hidden = symbols, labels, hidden
        self.w = {"out": rng.normal(0, 0.3, (labels, 2 * hidden)), "bias": np.zeros((labels, 1)), "move": np.zeros((labels, labels)), "start": np.zeros((labels, 1))}
        for way in "fb":
            self.w[f"in_{way}"] = rng.normal(0, 0.3, (4 * hidden, symbols))
            self.w[f"in_{way}"][: 3 * hidden] += 0.5
            self.w[f"rec_{way}"] = rng.normal(0, 0.3, (4 * hidden, hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> list[np.ndarray]:
        h, n = self.hidden, x.shape[1]
        state = cell = np.zeros((h, n), np.float32)
        out = []
        for row in x:
            a = self.w[f"in_{way}"][:, row] + self.w[f"rec_{way}"] @ state
            gates = np.clip(a[: 3 * h], 0, 1)
            cand = soft(a[3 * h :])
            new = gates[h : 2 * h] * cell + gates[:h] * cand
            seen = soft(new)
            if keep is not None:
                keep.append((row, state, cell, a, gates, cand, new, seen))
            state, cell = gates[2 * h :] * seen, new
            out.append(state)
        return out

    def emissions(self, x: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[steps, labels, n] scores of every label, and the states below them."""
        fore = self._run(x, "f", kept["f"] if kept else None)
        back = self._run(x[::-1], "b", kept["b"] if kept else None)[::-1]
        both = np.stack([np.concatenate(p) for p in zip(fore, back)])
        return self.w["out"] @ both + self.w["bias"], both

    def loss_and_slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the label paths y [steps, n] and its derivatives."""
        kept: dict[str, list] = {"f": [], "b": []}
        score, both = self.emissions(x, kept)
        steps, _, n = score.shape
        move, at = self.w["move"], np.arange(n)
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0] + self.w["start"]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, None] + move[:, :, None], 0) + score[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(move[:, :, None] + (score[t + 1] + beta[t + 1])[None], 1)
        whole = log_sum(alpha[-1], 0)
        path = self.w["start"][y[0], 0] + sum(score[t, y[t], at] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        d = np.exp(alpha + beta - whole)
        d_move = np.zeros_like(move)
        for t in range(1, steps):
            d_move += np.exp(alpha[t - 1][:, None] + move[:, :, None] + (score[t] + beta[t])[None] - whole).sum(axis=2)
            np.subtract.at(d_move, (y[t - 1], y[t]), 1)
        for t in range(steps):
            d[t, y[t], at] -= 1
        scale = np.float32(1 / (n * steps))
        d *= scale
        slopes = {"out": np.einsum("tcn,tkn->ck", d, both, optimize=True), "bias": d.sum(axis=(0, 2))[:, None], "move": d_move * scale, "start": d[0].sum(axis=1)[:, None]}
        into = self.w["out"].T @ d
        slopes |= self._back(kept["f"], into[:, : self.hidden], "f") | self._back(kept["b"], into[::-1, self.hidden :], "b")
        return float((whole - path).mean() / steps), slopes

    def _back(self, kept: list, into: np.ndarray, way: str) -> dict:
        h, rec = self.hidden, self.w[f"rec_{way}"]
        d_in, d_rec = np.zeros((self.symbols, 4 * h), np.float32), np.zeros_like(rec)
        d_state = d_cell = np.zeros_like(kept[0][1])
        for (row, state, cell, a, gates, cand, new, seen), d in zip(reversed(kept), into[::-1]):
            d = d + d_state
            c = d_cell + d * gates[2 * h :] * soft_slope(new)
            open_ = (a[: 3 * h] > 0) & (a[: 3 * h] < 1)
            d_a = np.concatenate([np.concatenate([c * cand, c * cell, d * seen]) * open_, c * gates[:h] * soft_slope(a[3 * h :])])
            np.add.at(d_in, row, d_a.T)
            d_rec += d_a @ state.T
            d_state, d_cell = rec.T @ d_a, c * gates[h : 2 * h]
        return {f"in_{way}": d_in.T, f"rec_{way}": d_rec}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.03, seed: int = 5) -> list[float]:
        rng, t, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order, seen = rng.permutation(x.shape[1]), []
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                loss, slopes = self.loss_and_slopes(x[:, pick], y[:, pick])
                seen.append(loss)
                t += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
                now = rate * (1 - epoch / epochs) * min(1, 2 / max(norm, 1e-9))
                for k, g in slopes.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.w[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """[steps, n] labels of each window's best path."""
        score, _ = self.emissions(x)
        steps, _, n = score.shape
        best = score[0] + self.w["start"]
        came = np.zeros(score.shape, np.int8)
        for t in range(1, steps):
            ways = best[:, None] + self.w["move"][:, :, None]
            came[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + score[t]
        out = np.empty((steps, n), np.int64)
        out[-1] = best.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t, out[t], np.arange(n)]
        return out
