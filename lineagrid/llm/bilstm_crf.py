"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are rows of character classes. Training maximises the CRF likelihood
with Adam; decoding is Viterbi, with posteriors by forward and backward sums. All arrays run over a batch of windows.
"""

from __future__ import annotations

import numpy as np

#: Character classes: printable ASCII, tab, newline, Latin letters, other letters, other; 0 fills windows.
CLASSES = 101


def classes_of(text: str) -> np.ndarray:
    """Class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(points), 100, dtype=np.uint8)
    ascii_ = (points >= 32) & (points < 127)
    out[ascii_] = points[ascii_] - 31  # 1 to 95
    out[points == 9], out[points == 10] = 96, 97
    out[(points >= 0xC0) & (points < 0x250)] = 98
    out[points >= 0x250] = 99
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Parameters and passes; ``tags`` is the number of labels, 0 the outside one."""

    def __init__(self, tags: int, hidden: int = 20, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)

        self.p: dict[str, np.ndarray] = {"embed": init(CLASSES, embed) * 2}
        for way in "fb":
            self.p[f"w{way}"] = init(embed + hidden, 4 * hidden)
            self.p[f"b{way}"] = np.zeros(4 * hidden, dtype=np.float32)
            self.p[f"b{way}"][hidden : 2 * hidden] = 1.0  # forget gate
        self.p["out"] = init(2 * hidden, tags)
        self.p["out_b"] = np.zeros(tags, dtype=np.float32)
        self.p["move"] = np.zeros((tags, tags), dtype=np.float32)

    def _run(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states, time first; ``keep`` gathers what the backward pass needs."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
        out = np.empty((steps, n, self.hidden), np.float32)
        w, b, k = self.p[f"w{way}"], self.p[f"b{way}"], self.hidden
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            joined = np.concatenate([x[t], h], axis=1)
            z = joined @ w + b
            i, f, o = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k])
            g, before = np.tanh(z[:, 3 * k :]), c
            c = f * before + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((t, joined, i, f, o, g, before, squashed))
        return out

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores (time, window, tag) of windows (window, time)."""
        x = self.p["embed"][chars.T]
        both = np.concatenate([self._run(x, "f", None), self._run(x, "b", None)], axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each window, and the posterior of each tag's kind (1 where all tags are outside)."""
        scores = self.emissions(chars)
        tags = self._best(scores)
        sure = np.ones(tags.shape, dtype=np.float32)
        found = np.flatnonzero(tags.any(axis=1))
        if len(found):
            shares = self._marginals(scores[:, found])
            kinds = (np.arange(self.tags) + 1) // 2  # a tag that begins a span and the one that continues it
            same = kinds[tags[found].T][:, :, None] == kinds[None, None, :]
            sure[found] = (shares * same).sum(axis=2).T
        return tags, sure

    def _sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums, and the total, in logarithms."""
        steps, move = len(scores), self.p["move"]
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + move[None], 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _logsum(move[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind, _logsum(ahead[-1], 1)

    def _marginals(self, scores: np.ndarray) -> np.ndarray:
        ahead, behind, total = self._sums(scores)
        return np.exp(ahead + behind - total[None, :, None])

    def _best(self, scores: np.ndarray) -> np.ndarray:
        steps, n, _ = scores.shape
        best = scores[0]
        back = np.zeros((steps, n, self.tags), dtype=np.uint8)
        for t in range(1, steps):
            total = best[:, :, None] + self.p["move"][None]
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[t]
        tag = best.argmax(axis=1)
        out = np.empty((n, steps), dtype=np.uint8)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[:, t] = tag
            tag = back[t][rows, tag]
        return out

    def _gradients(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, steps = chars.shape
        k, move = self.hidden, self.p["move"]
        x = self.p["embed"][chars.T]
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, way, kept[way]) for way in "fb"], axis=2)
        scores = both @ self.p["out"] + self.p["out_b"]
        ahead, behind, total = self._sums(scores)
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        rows = np.arange(n)
        d_scores = np.exp(ahead + behind - total[None, :, None])
        gold_t = gold.T
        score = scores[np.arange(steps)[:, None], rows[None], gold_t].sum(axis=0)
        for t in range(steps - 1):
            pair = ahead[t][:, :, None] + move[None] + (scores[t + 1] + behind[t + 1])[:, None, :] - total[:, None, None]
            g["move"] += np.exp(pair).sum(axis=0)
            np.add.at(g["move"], (gold_t[t], gold_t[t + 1]), -1.0)
            score += move[gold_t[t], gold_t[t + 1]]
        d_scores[np.arange(steps)[:, None], rows[None], gold_t] -= 1.0
        flat = both.reshape(-1, 2 * k)
        g["out"] = flat.T @ d_scores.reshape(-1, self.tags)
        g["out_b"] = d_scores.sum(axis=(0, 1))
        d_both = d_scores @ self.p["out"].T
        d_x = np.zeros_like(x)
        for way, part in (("f", d_both[:, :, :k]), ("b", d_both[:, :, k:])):
            d_h, d_c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            w = self.p[f"w{way}"]
            for t, joined, i, f, o, cand, before, squashed in reversed(kept[way]):
                d_h = d_h + part[t]
                d_c = d_c + d_h * o * (1 - squashed**2)
                d_z = np.concatenate(
                    [d_c * cand * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - cand**2)],
                    axis=1,
                )
                g[f"w{way}"] += joined.T @ d_z
                g[f"b{way}"] += d_z.sum(axis=0)
                d_joined = d_z @ w.T
                d_x[t] += d_joined[:, :-k]
                d_h, d_c = d_joined[:, -k:], d_c * f
        np.add.at(g["embed"], chars.T, d_x)
        return float((total - score).sum()), {name: v / n for name, v in g.items()}

    def fit(self, chars: np.ndarray, gold: np.ndarray, epochs: int = 16, batch: int = 48, rate: float = 0.012, seed: int = 11) -> float:
        """Adam with a falling rate; returns the last epoch's loss a window."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn, loss = 0, 0.0
        for epoch in range(epochs):
            order, loss = rng.permutation(len(chars)), 0.0
            step = rate * (1 - epoch / epochs) + rate * 0.1
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                lost, grads = self._gradients(chars[own], gold[own])
                loss += lost
                turn += 1
                size = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
                for k, v in grads.items():
                    v = v * min(1.0, 5.0 / (size + 1e-8))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (step * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        return loss / max(1, len(chars))
