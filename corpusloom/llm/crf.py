"""A linear-chain conditional random field in numpy: training by Adagrad, decoding by Viterbi."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """Weights of features by label, transitions, and starts."""

    def __init__(self, n_features: int, n_labels: int) -> None:
        self.w = np.zeros((n_features, n_labels))
        self.t = np.zeros((n_labels, n_labels))
        self.s = np.zeros(n_labels)

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.w[r].sum(0) for r in rows]) if rows else np.zeros((0, len(self.s)))

    def fit(self, sequences: list[tuple[list[list[int]], list[int], float]], epochs: int = 6, rate: float = 0.4, l2: float = 1e-5) -> "Crf":
        """Maximises the conditional likelihood; each sequence has feature rows, labels and a weight."""
        gw, gt, gs = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6), np.full_like(self.s, 1e-6)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for x in order.permutation(len(sequences)):
                rows, labels, weight = sequences[x]
                e = self.emissions(rows)
                n, k = e.shape
                a, b = np.zeros((n, k)), np.zeros((n, k))
                a[0] = self.s + e[0]
                for i in range(1, n):
                    a[i] = e[i] + _lse(a[i - 1][:, None] + self.t, 0)
                for i in range(n - 2, -1, -1):
                    b[i] = _lse(self.t + (e[i + 1] + b[i + 1])[None, :], 1)
                z = _lse(a[-1], 0)
                p = np.exp(a + b - z)
                d = -p
                d[np.arange(n), labels] += 1
                d *= weight
                if np.abs(d).max() < 1e-3:
                    continue
                for i, r in enumerate(rows):
                    g = d[i] - l2 * self.w[r]
                    gw[r] += g * g
                    self.w[r] += rate * g / np.sqrt(gw[r])
                gs += d[0] ** 2
                self.s += rate * d[0] / np.sqrt(gs)
                if n > 1:
                    dt = np.zeros_like(self.t)
                    for i in range(1, n):
                        dt -= np.exp(a[i - 1][:, None] + self.t + (e[i] + b[i])[None, :] - z)
                        dt[labels[i - 1], labels[i]] += 1
                    dt *= weight
                    gt += dt * dt
                    self.t += rate * dt / np.sqrt(gt)
        return self

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels."""
        if not rows:
            return []
        e = self.emissions(rows)
        score, back = self.s + e[0], []
        for i in range(1, len(rows)):
            step = score[:, None] + self.t
            back.append(step.argmax(0))
            score = step.max(0) + e[i]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
