"""Small numpy models over sparse rows, fitted on bounded samples inside one task."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: slot numbers of each row end to end (32 bits), their values, and where each row starts.

    Products run over CHUNK entries at a time, so that they need little memory besides the rows."""

    CHUNK = 1 << 18

    def __init__(self, slots: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        sizes = np.array([len(s) for s in slots], dtype=np.int64)
        flat = np.concatenate(slots) if len(slots) else np.zeros(0)
        self._set(flat, sizes, width, None if values is None or not len(slots) else np.concatenate(values))

    @classmethod
    def of(cls, flat: np.ndarray, sizes: np.ndarray, width: int, values: np.ndarray | None = None) -> "Rows":
        """From the slots of all rows end to end; values of one a slot of the width are looked up there."""
        rows = cls.__new__(cls)
        rows._set(flat, sizes, width, values)
        return rows

    def _set(self, flat, sizes, width, values) -> None:
        self.width, self.count = width, len(sizes)
        self.slots = flat.astype(np.int32, copy=False)
        self.values = values
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def _chunks(self):
        """(first row, rows, slots, values, entries of each row)."""
        first = 0
        while first < self.count:
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + self.CHUNK, side="right")) - 1)
            a, b = self.starts[first], self.starts[last]
            yield first, last, self.slots[a:b], None if self.values is None else self.values[a:b], np.diff(self.starts[first : last + 1])
            first = last

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty(self.count)
        for first, last, slots, values, n in self._chunks():
            x = weights[slots] if values is None else values * weights[slots]
            sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            out[first:last] = np.diff(sums[np.concatenate([[0], np.cumsum(n)])])
        return out

    def transposed_times(self, per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for first, last, slots, values, n in self._chunks():
            x = np.repeat(per_row[first:last], n)
            out += np.bincount(slots, weights=x if values is None else values * x, minlength=self.width)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(rows: Rows, labels: np.ndarray, row_weights: np.ndarray | None = None, l2: float = 1.0, steps: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L2 penalty on the weights, by L-BFGS."""
    weight = np.ones(rows.count) if row_weights is None else row_weights

    def loss(w):
        z = rows.times(w[:-1]) + w[-1]
        p = sigmoid(z)
        value = (weight * (np.logaddexp(0, z) - labels * z)).sum() + l2 / 2 * (w[:-1] ** 2).sum()
        pull = weight * (p - labels)
        return value, np.append(rows.transposed_times(pull) + l2 * w[:-1], pull.sum())

    w = np.zeros(rows.width + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y in reversed(past):
            alphas.append(a := (s @ direction) / (s @ y))
            direction = direction - a * y
        if past:
            s, y = past[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(alphas)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        step = 1.0
        for _ in range(20):
            new_value, new_grad = loss(w + step * direction)
            if new_value <= value + 1e-4 * step * (grad @ direction):
                break
            step /= 2
        else:
            break
        s, y = step * direction, new_grad - grad
        w, done = w + s, value - new_value < 1e-6 * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if done:
            break
    return w[:-1], float(w[-1])


def ngram_slots(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The slots, each once, of the text's character n-grams: lower case, with control characters as spaces."""
    return np.unique(np.concatenate([*hashed_ngrams(encode(text), orders, bits), np.zeros(0, dtype=np.uint32)]))


def encode(text: str) -> np.ndarray:
    """Code points of the text in lower case between two spaces."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.maximum(codes, 32)


def hashed_ngrams(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each order, the slot of the n-gram at every place where one starts."""
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append(mixed >> np.uint32(32 - bits))
    return out
