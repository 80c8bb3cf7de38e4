"""Character tagger: a bidirectional LSTM whose scores feed a CRF, trained and run in numpy.

A window of characters becomes scores per character and tag; the CRF adds scores for tag transitions. Training maximises
the likelihood of the labelled tag sequences: forward and backward sums through the CRF, back-propagation through both
LSTMs, Adam steps. Everything is a function of the labelled windows and the seed.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 132  # ASCII, then: other letter, other digit, other space, anything else


def symbol_codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(codes) and codes.max() > 127:
        for i in np.flatnonzero(codes > 127):
            c = text[i]
            codes[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return codes


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, hidden: int = 20, embed: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"E": draw(SYMBOLS, embed) * 3, "O": draw(2 * hidden, tags), "c": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0  # forget gates start open
            self.p |= {"W" + d: draw(embed, 4 * hidden), "U" + d: draw(hidden, 4 * hidden), "B" + d: bias}

    def _lstm(self, x, mask, d: str, keep: bool):
        """x: (time, batch, 4 hidden) inputs; states (time, batch, hidden); masked steps leave the state as it is."""
        n, batch, h = x.shape[0], x.shape[1], self.hidden
        u = self.p["U" + d]
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        out, trail = np.empty((n, batch, h), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = x[t] + state @ u
            gates = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            after = f * cell + i * new
            squashed = np.tanh(after)
            m = mask[t][:, None]
            if keep:
                trail.append((t, state, cell, gates, new, squashed, m))
            state, cell = m * (o * squashed) + (1 - m) * state, m * after + (1 - m) * cell
            out[t] = state
        return out, trail

    def emissions(self, codes, mask, keep: bool = False):
        """Scores (time, batch, tags) for codes (time, batch)."""
        e = self.p["E"][codes]
        hidden, trails = [], []
        for d in "fb":
            out, trail = self._lstm(e @ self.p["W" + d] + self.p["B" + d], mask, d, keep)
            hidden.append(out)
            trails.append(trail)
        both = np.concatenate(hidden, axis=2)
        return both @ self.p["O"] + self.p["c"], (e, both, trails)

    def _crf(self, scores, mask, gold):
        """Negative log-likelihood and its gradients."""
        trans, start = self.p["T"], self.p["S"]
        n, batch, k = scores.shape
        alpha = np.empty_like(scores)
        alpha[0] = start + scores[0]
        for t in range(1, n):
            step = _log_sum(alpha[t - 1][:, :, None] + trans[None], 1) + scores[t]
            alpha[t] = np.where(mask[t][:, None] > 0, step, alpha[t - 1])
        total = _log_sum(alpha[n - 1], 1)
        beta = np.zeros_like(scores)
        for t in range(n - 2, -1, -1):
            step = _log_sum(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, step, beta[t + 1])
        node = np.exp(alpha + beta - total[None, :, None]) * mask[:, :, None]
        d_scores, d_trans = node.copy(), np.zeros_like(trans)
        cols = np.arange(batch)
        path = np.zeros(batch, np.float32)
        for t in range(n):
            m = mask[t]
            d_scores[t, cols, gold[t]] -= m
            path += m * scores[t, cols, gold[t]]
            if t == 0:
                path += start[gold[0]]
                d_start = node[0].sum(axis=0) - np.bincount(gold[0], minlength=k)
            else:
                edge = alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
                d_trans += (np.exp(edge) * m[:, None, None]).sum(axis=0)
                np.add.at(d_trans, (gold[t - 1], gold[t]), -m)
                path += m * trans[gold[t - 1], gold[t]]
        return float((total - path).sum()), d_scores, d_trans, d_start.astype(np.float32)

    def _back_lstm(self, d_out, trail, d: str, e, grads):
        h = self.hidden
        d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        dx = np.zeros((*d_out.shape[:2], 4 * h), np.float32)
        for t, state, cell, gates, new, squashed, m in reversed(trail):
            d_state = d_state + d_out[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            now, held = m * d_state, (1 - m) * d_state
            d_after = m * d_cell + now * o * (1 - squashed**2)
            dz = np.concatenate([d_after * new * i * (1 - i), d_after * cell * f * (1 - f), now * squashed * o * (1 - o), d_after * i * (1 - new**2)], axis=1)
            dx[t] = dz
            grads["U" + d] += state.T @ dz
            d_state = held + dz @ self.p["U" + d].T
            d_cell = (1 - m) * d_cell + d_after * f
        grads["B" + d] += dx.sum(axis=(0, 1))
        grads["W" + d] += np.einsum("tbe,tbg->eg", e, dx, optimize=True)
        return dx @ self.p["W" + d].T

    def gradients(self, codes, mask, gold):
        scores, (e, both, trails) = self.emissions(codes, mask, keep=True)
        loss, d_scores, d_trans, d_start = self._crf(scores, mask, gold)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["T"], g["S"], g["c"] = d_trans, d_start, d_scores.sum(axis=(0, 1))
        g["O"] = np.einsum("tbh,tbk->hk", both, d_scores, optimize=True)
        d_both = d_scores @ self.p["O"].T
        d_e = self._back_lstm(d_both[:, :, : self.hidden], trails[0], "f", e, g) + self._back_lstm(d_both[:, :, self.hidden :], trails[1], "b", e, g)
        np.add.at(g["E"], codes, d_e)
        return loss, g

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam over (codes, tags) pairs; returns the mean loss per character of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            total, chars = 0.0, 0
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                some = [windows[i] for i in order[at : at + batch]]
                codes, mask = self.stack([c for c, _ in some])
                gold, _ = self.stack([g for _, g in some])
                loss, g = self.gradients(codes, mask, gold)
                total, chars, step = total + loss, chars + int(mask.sum()), step + 1
                lr = rate * (0.5 ** max(0, epoch - epochs // 2))
                scale = 1.0 / len(some)
                norm = np.sqrt(sum(float(((x * scale) ** 2).sum()) for x in g.values()))
                scale *= min(1.0, 5.0 / (norm + 1e-9))
                for k, x in g.items():
                    x = x * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, chars))
        return losses

    @staticmethod
    def stack(rows: list[np.ndarray]):
        """(time, batch) of rows padded at the end, and the mask."""
        n = max(len(r) for r in rows)
        out, mask = np.zeros((n, len(rows)), np.int64), np.zeros((n, len(rows)), np.float32)
        for i, r in enumerate(rows):
            out[: len(r), i], mask[: len(r), i] = r, 1
        return out, mask

    def decode(self, windows: list[np.ndarray], batch: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tags, margins) of each window by Viterbi; a margin is the tag's score above the best other one."""
        out: list = [None] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        trans, start = self.p["T"], self.p["S"]
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            codes, mask = self.stack([windows[i] for i in ids])
            scores, _ = self.emissions(codes, mask)
            n, size, _ = scores.shape
            back = np.zeros((n, size, self.tags), np.int64)
            best = start + scores[0]
            for t in range(1, n):
                all_ways = best[:, :, None] + trans[None]
                back[t] = all_ways.argmax(axis=1)
                live = mask[t][:, None] > 0
                best = np.where(live, all_ways.max(axis=1) + scores[t], best)
                back[t] = np.where(live, back[t], np.arange(self.tags)[None])
            tag = best.argmax(axis=1)
            path = np.empty((n, size), np.int64)
            for t in range(n - 1, -1, -1):
                path[t] = tag
                tag = back[t][np.arange(size), tag]
            chosen = np.take_along_axis(scores, path[:, :, None], 2)[:, :, 0]
            others = scores.copy()
            np.put_along_axis(others, path[:, :, None], -1e9, 2)
            margin = chosen - others.max(axis=2)
            for j, i in enumerate(ids):
                out[i] = (path[: len(windows[i]), j], margin[: len(windows[i]), j])
        return out
