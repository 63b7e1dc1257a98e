"""A bidirectional gated recurrent network over bytes, in numpy.

Arrays are feature-major, [features, windows], so that each gate is one
contiguous block. Gates use the hard sigmoid clip(a, 0, 1) and candidates the
rational tanh below; training differentiates exactly these functions.
"""

from __future__ import annotations

import numpy as np

PAD = 0
STEPS = 64


def soft(x: np.ndarray) -> np.ndarray:
    """x (27 + x^2) / (27 + 9 x^2) for |x| <= 3, else the sign: a rational tanh."""
    x = np.clip(x, -3, 3)
    s = x * x
    return x * (27 + s) / (27 + 9 * s)


def soft_slope(x: np.ndarray) -> np.ndarray:
    s = x * x
    return np.where(np.abs(x) < 3, (9 - s) ** 2 / (9 * (3 + s) ** 2), 0).astype(x.dtype)


def cut(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows [STEPS, n] of a byte buffer, padded behind their lengths."""
    at = starts[None, :] + np.arange(STEPS)[:, None]
    inside = np.arange(STEPS)[:, None] < lengths[None, :]
    return np.where(inside, buffer[np.minimum(at, max(len(buffer) - 1, 0))], PAD).astype(np.uint8)


class BiGRU:
    """Labels every byte of a window with one of the classes."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.w = {"out": rng.normal(0, 0.3, (classes, 2 * hidden)), "bias": np.zeros((classes, 1))}
        for way in "fb":
            self.w[f"in_{way}"] = rng.normal(0, 0.3, (3 * hidden, 256))
            self.w[f"in_{way}"][: 2 * hidden] += 0.5
            self.w[f"rec_{way}"] = rng.normal(0, 0.3, (3 * hidden, hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, way: str, keep: list | None = None):
        """States after each step, in the order of reading."""
        h2, n = 2 * self.hidden, x.shape[1]
        into, rec = self.w[f"in_{way}"], self.w[f"rec_{way}"]
        state = np.zeros((self.hidden, n), np.float32)
        gates, mixed = np.empty((3 * self.hidden, n), np.float32), np.empty((3 * self.hidden, n), np.float32)
        for row in x:
            np.take(into, row, axis=1, out=gates, mode="clip")
            np.matmul(rec, state, out=mixed)
            zr = gates[:h2] + mixed[:h2] if keep is not None else np.add(gates[:h2], mixed[:h2], out=gates[:h2])
            opened = np.clip(zr, 0, 1)
            z, r = opened[: self.hidden], opened[self.hidden :]
            a = r * mixed[h2:]
            a += gates[h2:]
            cand = soft(a)
            new = state - cand
            new *= z
            new += cand
            if keep is not None:
                keep.append((row, state, zr, a, cand, mixed[h2:].copy()))
            state = new
            yield state

    def loss_and_slopes(self, x: np.ndarray, label: np.ndarray, lengths: np.ndarray):
        """Mean cross-entropy over the real bytes and its derivative in every weight."""
        steps, n = x.shape
        real = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        total = max(real.sum(), 1)
        kept: dict[str, list] = {"f": [], "b": []}
        fore, back = list(self._run(x, "f", kept["f"])), list(self._run(x[::-1], "b", kept["b"]))[::-1]
        both = np.stack([np.concatenate(p) for p in zip(fore, back)])
        logits = self.w["out"] @ both + self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(n)
        loss = float(-(np.log(p[:, label, at] + 1e-9) * real).sum() / total)
        d = p
        d[:, label, at] -= 1
        d *= real[:, None, :] / total
        slopes = {"out": np.einsum("tcn,tkn->ck", d, both, optimize=True), "bias": d.sum(axis=(0, 2))[:, None]}
        into = self.w["out"].T @ d
        for way, part in (("f", into[:, : self.hidden]), ("b", into[::-1, self.hidden :])):
            slopes |= self._back(kept[way], part, way)
        return loss, slopes

    def _back(self, kept: list, into: np.ndarray, way: str) -> dict:
        h, rec = self.hidden, self.w[f"rec_{way}"]
        d_in, d_rec = np.zeros((256, 3 * h), np.float32), np.zeros_like(rec)
        carried = np.zeros_like(kept[0][1])
        for (row, state, zr, a, cand, mixed), d in zip(reversed(kept), into[::-1]):
            d = d + carried
            opened = np.clip(zr, 0, 1)
            z, r = opened[:h], opened[h:]
            inside = (zr > 0) & (zr < 1)
            d_a = d * (1 - z) * soft_slope(a)
            d_z = d * (state - cand) * inside[:h]
            d_r = d_a * mixed * inside[h:]
            d_mixed = np.concatenate([d_z, d_r, d_a * r])
            np.add.at(d_in, row, np.concatenate([d_z, d_r, d_a]).T)
            d_rec += d_mixed @ state.T
            carried = d * z + rec.T @ d_mixed
        return {f"in_{way}": d_in.T, f"rec_{way}": d_rec}

    def fit(self, x: np.ndarray, label: np.ndarray, lengths: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Backpropagation through time with Adam; returns each epoch's mean loss."""
        rng, t, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order, seen = rng.permutation(x.shape[1]), []
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                loss, slopes = self.loss_and_slopes(x[:, pick], label[pick], lengths[pick])
                seen.append(loss)
                t += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
                now = rate * (1 - epoch / epochs) * min(1, 5 / max(norm, 1e-9))
                for k, g in slopes.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.w[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
            losses.append(float(np.mean(seen)))
        return losses

    def pooled(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over a window's real bytes: class probabilities, and bytes labelled with each class."""
        steps, n = x.shape
        out, h = self.w["out"], self.hidden
        fore = [out[:, :h] @ state for state in self._run(x, "f")]
        mass, votes = np.zeros((self.classes, n), np.float32), np.zeros((self.classes, n), np.float32)
        short = int(lengths.min()) if n else 0
        for t, state in zip(range(steps - 1, -1, -1), self._run(x[::-1], "b")):
            logits = out[:, h:] @ state
            logits += fore[t]
            logits += self.w["bias"]
            top = logits.max(axis=0)
            best = logits == top
            logits -= top
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=0)
            if t >= short:
                real = t < lengths
                logits *= real
                best &= real
            mass += logits
            votes += best
        return mass, votes
