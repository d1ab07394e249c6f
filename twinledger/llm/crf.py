"""A linear-chain conditional random field over hashed indicator features, in numpy batches."""

from __future__ import annotations

import numpy as np

BUCKETS = 1 << 13


class Crf:
    """Weights: emit[feature, label], move[label, label], first[label]. Sequences are padded to one length."""

    def __init__(self, n_labels: int, banned: np.ndarray, banned_first: np.ndarray):
        self.emit = np.zeros((BUCKETS, n_labels))
        self.move = np.where(banned, -1e4, 0.0)
        self.first = np.where(banned_first, -1e4, 0.0)
        self.free, self.free_first = ~banned, ~banned_first

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(n, t, labels) of features (n, t, f); a negative feature is none."""
        return (self.emit[features] * (features >= 0)[..., None]).sum(2)

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest labels (n, t); what lies past a sequence's length means nothing."""
        e = self.scores(features)
        n, t, _ = e.shape
        best, back = self.first + e[:, 0], np.zeros(e.shape, np.int8)
        last = best.copy()
        for i in range(1, t):
            through = best[:, :, None] + self.move
            back[:, i] = through.argmax(1)
            best = through.max(1) + e[:, i]
            last[lengths > i] = best[lengths > i]
        out = np.zeros((n, t), np.int8)
        label, rows = last.argmax(1), np.arange(n)
        for i in range(t - 1, -1, -1):
            here = lengths > i
            out[here, i] = label[here]
            inner = here & (i > 0)
            label = np.where(inner, back[rows, i, label], label)
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Conditional likelihood by AdaGrad on whole-table gradients from the forward-backward recursion."""
        n, t, width = features.shape
        k = self.emit.shape[1]
        inside = np.arange(t) < lengths[:, None]
        gold = np.eye(k)[labels] * inside[..., None]
        pairs = inside[:, 1:, None, None] * (np.eye(k)[labels[:, :-1]][..., None] * np.eye(k)[labels[:, 1:]][:, :, None, :])
        gold_move, gold_first = pairs.sum((0, 1)), gold[:, 0].sum(0)
        flat, there = features.ravel(), features.ravel() >= 0
        sums = [np.full_like(w, 1e-6) for w in (self.emit, self.move, self.first)]

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        for _ in range(rounds):
            e = self.scores(features)
            fore, aft = np.empty_like(e), np.zeros_like(e)
            fore[:, 0] = self.first + e[:, 0]
            for i in range(1, t):
                step = lse(fore[:, i - 1, :, None] + self.move, 1) + e[:, i]
                fore[:, i] = np.where(inside[:, i, None], step, fore[:, i - 1])
            whole = lse(fore[:, -1], 1)
            for i in range(t - 2, -1, -1):
                step = lse(self.move + (e[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
                aft[:, i] = np.where(inside[:, i + 1, None], step, 0)
            chance = np.exp(fore + aft - whole[:, None, None]) * inside[..., None]
            both = fore[:, :-1, :, None] + self.move + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - whole[:, None, None, None]
            both = np.where(inside[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0).sum((0, 1))
            gap = np.repeat((gold - chance).reshape(-1, k), width, 0)[there]
            emit = np.stack([np.bincount(flat[there], gap[:, j], BUCKETS) for j in range(k)], 1)
            for w, s, g in zip((self.emit, self.move, self.first), sums, (emit - decay * self.emit, (gold_move - both) * self.free, (gold_first - chance[:, 0].sum(0)) * self.free_first), strict=True):
                s += g * g
                w += rate * g / np.sqrt(s)
