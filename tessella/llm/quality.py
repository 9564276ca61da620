"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``width`` bytes slide over the whole document.  Their responses are
max-pooled within overlapping chunks (two neighbouring blocks each), a hidden
layer describes every chunk, and the maximum and mean over all chunks combine
into one probability.  Filters over one-hot bytes are table lookups, so the
forward pass is a few gathers a position; no part of a text is left out.

Null and empty texts are one chunk of padding and get that chunk's score.
Without training rows of both labels the score is the label share (0.5 with none).
Every row, also one that repeats another or has no id, has a row of its own; equal
texts score alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tessella.llm.labelled import score_documents, training_sample


@dataclass(frozen=True)
class ConvParams:
    """``rows`` and ``most_bytes`` bound the training sample."""

    width: int = 8
    stride: int = 1
    block: int = 128
    filters: int = 24
    hidden: int = 16
    rows: int = 3000
    most_bytes: int = 32_768
    epochs: int = 8
    least_steps: int = 700
    batch: int = 32
    rate: float = 0.004
    seed: int = 5


class ConvNet:
    def __init__(self, p: ConvParams):
        rng = np.random.default_rng(p.seed)
        self.p = p
        scale = lambda n, *shape: (rng.standard_normal(shape) / np.sqrt(n)).astype(np.float32)
        self.w = {
            "table": scale(p.width, p.width, 256, p.filters), "bias": np.zeros(p.filters, np.float32),
            "h": scale(p.filters, p.filters, p.hidden), "hb": np.zeros(p.hidden, np.float32),
            "o": scale(2 * p.hidden, 2 * p.hidden), "ob": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def _layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one buffer, each padded to whole blocks; the first block of each."""
        p = self.p
        sizes = np.array([-(-(len(t) + p.width) // p.block) for t in texts])
        buffer = b"".join(t.ljust(n * p.block, b"\0") for t, n in zip(texts, sizes.tolist()))
        return np.frombuffer(buffer + b"\0" * p.width, np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def _blocks(self, data: np.ndarray, blocks: int) -> np.ndarray:
        """Responses of all positions, by block."""
        p = self.p
        n = blocks * p.block // p.stride
        out = np.empty((n, p.filters), np.float32)
        out[:] = self.w["bias"]
        part = np.empty_like(out)
        for k in range(p.width):
            np.take(self.w["table"][k], data[k : k + n * p.stride : p.stride], axis=0, out=part, mode="clip")
            out += part
        return out.reshape(blocks, p.block // p.stride, p.filters)

    def forward(self, texts: list[bytes]) -> tuple[np.ndarray, tuple]:
        data, first = self._layout(texts)
        responses = self._blocks(data, int(first[-1]))
        responses[first[1:] - 1, -self.p.width // self.p.stride + 1 :] = -np.inf  # these windows would reach into the next text
        pooled = responses.max(axis=1)
        after = np.arange(1, len(pooled) + 1)
        after[first[1:] - 1] -= 1  # the last chunk of a text is its last block alone
        chunk = np.maximum(pooled, pooled[after])
        active = np.maximum(chunk, 0)
        hidden = np.tanh(active.astype(float) @ self.w["h"] + self.w["hb"])
        starts, counts = first[:-1], np.diff(first)
        top = np.maximum.reduceat(hidden, starts)
        mean = np.add.reduceat(hidden, starts) / counts[:, None]
        doc = np.concatenate([top, mean], axis=1)
        z = doc @ self.w["o"] + self.w["ob"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (data, first, responses, pooled, after, chunk, active, hidden, top, doc)

    def gradients(self, error: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        p, w = self.p, self.w
        data, first, responses, pooled, after, chunk, active, hidden, top, doc = state
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(counts)), counts)
        d_doc = error[:, None] * w["o"]
        at_top = hidden == top[owner]
        d_hidden = d_doc[owner, : p.hidden] * at_top + d_doc[owner, p.hidden :] / counts[owner, None]
        d_pre = d_hidden * (1 - hidden**2)
        d_chunk = (d_pre @ w["h"].T) * (chunk > 0)
        own = pooled >= pooled[after]
        d_pooled = d_chunk * own
        np.add.at(d_pooled, after, d_chunk * ~own)
        place = responses.argmax(axis=1) + np.arange(len(pooled))[:, None] * (p.block // p.stride)
        block, f = np.nonzero(d_pooled)
        position, value = place[block, f] * p.stride, d_pooled[block, f]
        table = np.zeros_like(w["table"])
        for k in range(p.width):
            cell = data[position + k].astype(np.int64) * p.filters + f
            table[k] = np.bincount(cell, value, 256 * p.filters).reshape(256, p.filters)
        return {
            "table": table, "bias": d_pooled.sum(0), "h": active.T @ d_pre, "hb": d_pre.sum(0),
            "o": doc.T @ error, "ob": np.array([error.sum()]),
        }

    def fit(self, sample: list[tuple[bytes, int]]) -> "ConvNet":
        """Adam on the log loss, in seeded mini-batches with a falling rate."""
        p = self.p
        labels = np.array([y for _, y in sample], np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(p.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        each = -(-len(sample) // p.batch)
        epochs = max(p.epochs, -(-p.least_steps // each))  # small samples are seen more often
        steps, total = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(sample))
            for at in range(0, len(order), p.batch):
                own = order[at : at + p.batch]
                score, state = self.forward([sample[i][0] for i in own])
                g = self.gradients(((score - labels[own]) / len(own)).astype(np.float32), state)
                steps += 1
                rate = p.rate * (1 - steps / (total + 1))
                for k in self.w:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.01 * (g[k] ** 2 - second[k])
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
        return self

    def score(self, texts: list[bytes], most: int = 1 << 18) -> np.ndarray:
        """Probabilities of label 1, in groups of about ``most`` bytes to bound memory."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, group, size = [], [], 0
        for t in texts:
            if len(t) > most:
                out += [self.forward(group)[0]] if group else []
                out.append(self._score_long(t, most))
                group, size = [], 0
                continue
            group.append(t)
            size += len(t)
            if size >= most:
                out.append(self.forward(group)[0])
                group, size = [], 0
        if group:
            out.append(self.forward(group)[0])
        # Sums depend on a group's size in their last bits; rounded, equal texts get equal scores.
        return np.concatenate(out).astype(float).round(9) if out else np.zeros(0)

    def _score_long(self, text: bytes, most: int) -> np.ndarray:
        """One long text in pieces that share a block, which gives the same chunks as the whole."""
        p = self.p
        blocks = -(-(len(text) + p.width) // p.block)
        step = max(2, most // p.block)
        top, total = np.full(p.hidden, -np.inf), np.zeros(p.hidden)
        for at in range(0, blocks, step):
            n = min(step, blocks - at)
            more = int(at + n < blocks)
            piece = text[at * p.block : (at + n + more) * p.block + p.width]
            data = np.frombuffer(piece.ljust((n + more) * p.block + p.width, b"\0"), np.uint8)
            responses = self._blocks(data, n + more)
            if not more:
                responses[-1, -p.width // p.stride + 1 :] = -np.inf
            pooled = responses.max(axis=1)
            chunk = np.maximum(pooled[:n], pooled[np.minimum(np.arange(n) + 1, n + more - 1)])
            hidden = np.tanh(np.maximum(chunk, 0).astype(float) @ self.w["h"] + self.w["hb"])
            top, total = np.maximum(top, hidden.max(0)), total + hidden.sum(0)
        z = np.concatenate([top, total / blocks]) @ self.w["o"] + self.w["ob"][0]
        return np.array([1 / (1 + np.exp(-np.clip(z, -30, 30)))])


def quality_scores(docs: DataFrame, labels: DataFrame, p: ConvParams = ConvParams(), threshold: float = 0.3) -> DataFrame:
    net = ConvNet(p).fit(training_sample(docs, labels, "quality", p.rows, p.most_bytes, p.seed))
    return score_documents(docs, net.score, threshold)
