"""Toxicity: a linear-chain conditional random field over tokens.

Training tokens are labelled from document labels: in toxic documents, tokens
whose normal form is far more frequent in toxic than in clean ones are toxic;
all others are clean.  The field has two tags.  A token's potentials are sums
of hashed features of itself and its neighbours (word, prefix, suffix, shape);
tag pairs have transition potentials.  Weights maximise the penalised
likelihood by gradient steps whose expectations come from forward-backward; the
chains it learns from are the segments of ``segment`` tokens of the training texts.
A scored document is one chain, however long: the messages of its two tags are
one ratio, whose steps compose as 2x2 matrices, so segments of many documents are
walked side by side and then tied together, exactly.

Marginals aggregate to a document score by a logistic function of the largest
marginal and the expected number of toxic tokens; tokens whose marginal is at
least one half give the offending spans, as character offsets.

Null and empty texts have no tokens and get the score of no evidence.  Without
labels of both classes, or without a word that tells them apart, no field is
learned: every document gets the share of toxic labels (one tenth without
labels) and no spans.  Repeated rows get equal scores, an empty table gives an empty
result, and no other columns are read (``without_toxic`` passes them on, whatever
their names).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.labelled import HOLD_OUT, fitted
from tessella.llm.text import encode, held_out

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
EDGE = b".,;:!?\"'()[]{}<>*_-#$%&|/\\"


@dataclass(frozen=True)
class CrfParams:
    """``rows`` and ``most_bytes`` bound the training sample; ``ratio`` and ``least`` pick toxic training tokens."""

    rows: int = 4000
    most_bytes: int = 32_768
    buckets: int = 1 << 18
    segment: int = 64
    ratio: float = 12.0
    least: int = 4
    steps: int = 60
    rate: float = 0.2
    penalty: float = 0.5
    seed: int = 7


def normal(word: bytes) -> bytes:
    return word.lower().strip(EDGE) or word


def _shape(word: bytes) -> bytes:
    return b"U" if word.isupper() else b"d" if any(48 <= c < 58 for c in word) else b"l"


def own_features(word: bytes, buckets: int) -> list[int]:
    n = normal(word)
    parts = [b"w=" + n, b"p=" + n[:4], b"s=" + n[-4:], b"c=" + _shape(word)]
    return [zlib.crc32(f) % buckets for f in parts]


def neighbour_features(word: bytes, buckets: int) -> tuple[int, int]:
    n = normal(word)
    return zlib.crc32(b"b=" + n) % buckets, zlib.crc32(b"a=" + n) % buckets


def forward_backward(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag marginals [chain, time, 2], summed pair marginals [2, 2] and log partition functions.

    ``emit`` is [chain, time, 2]; tokens past a chain's end have potentials 0
    and -inf, which pins them to the clean tag; pairs with them are left out.
    """
    chains, length, _ = emit.shape
    peak = emit.max(axis=2)
    potential = np.exp(emit - peak[:, :, None])
    t = np.exp(trans)
    alpha, beta, norm = np.empty_like(potential), np.ones_like(potential), np.empty((chains, length))
    state = potential[:, 0]
    for k in range(length):
        if k:
            state = (alpha[:, k - 1] @ t) * potential[:, k]
        norm[:, k] = state.sum(axis=1)
        alpha[:, k] = state / norm[:, k, None]
    for k in range(length - 2, -1, -1):
        beta[:, k] = ((potential[:, k + 1] * beta[:, k + 1]) @ t.T) / norm[:, k + 1, None]
    marginal = alpha * beta
    live = np.isfinite(emit[:, 1:, 1])
    right = np.where(live[:, :, None], potential[:, 1:] * beta[:, 1:] / norm[:, 1:, None], 0)
    pairs = np.einsum("ctp,ctq->pq", alpha[:, :-1], right) * t
    return marginal, pairs, (np.log(norm) + peak).sum(axis=1)


def message_ratios(e: np.ndarray, first: np.ndarray, trans: np.ndarray, segment: int = 64) -> np.ndarray:
    """Forward messages' ratio toxic : clean at every token of chains that begin where ``first`` holds.

    ``e`` is the toxic tag's log potential.  A step maps the ratio r to
    E (t01 + t11 r) / (t00 + t10 r), a 2x2 matrix; segments compose theirs side by
    side, one walk over the segments gives what each starts from, and a second pass fills them.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    (t00, t01), (t10, t11) = np.exp(trans)
    lines = -(-n // segment)
    shaped = lambda x: np.concatenate([x, np.zeros(lines * segment - n, x.dtype)]).reshape(lines, segment).T.copy()
    E, cut = shaped(np.exp(np.clip(e, -60, 60))), shaped(first)
    # A chain's first token forgets what was before.
    a, b, c, d = np.where(cut, 0, E * t11), np.where(cut, E, E * t01), np.where(cut, 0, t10), np.where(cut, 1, t00)
    p, q, r, s = (np.full(lines, x) for x in (1.0, 0.0, 0.0, 1.0))
    for k in range(segment):
        p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    start, state = np.ones(lines), 1.0
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        start[k] = state
        state = (w * state + x) / max(y * state + z, 1e-300)
    out = np.empty_like(E)
    for k in range(segment):
        start = (a[k] * start + b[k]) / (c[k] * start + d[k])
        out[k] = start
    return out.T.ravel()[:n]


def chain_marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The toxic tag's marginal of every token of the chains that begin where ``first`` holds."""
    if not len(e):
        return np.zeros(0)
    last = np.r_[first[1:], True]
    x = message_ratios(e, first, trans) * message_ratios(e[::-1], last[::-1], trans.T)[::-1] / np.exp(np.clip(e, -60, 60))
    return x / (1 + x)


class Crf:
    def __init__(self, p: CrfParams):
        self.p = p
        self.weights = np.zeros(p.buckets)
        self.learned = False
        self.trans = np.zeros((2, 2))
        self.combine = np.array([-2.2, 4.0, 1.0])
        self._forget()

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._values = np.zeros((0, 3))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    # -- potentials

    def _ids(self, tokens: list[bytes]) -> np.ndarray:
        """Word numbers of the process's cache of potentials, which is emptied when full."""
        if len(self._index) > 1 << 17:
            self._forget()
        index, b = self._index, self.p.buckets
        new = list(set(tokens).difference(index))
        if new:
            own = self.weights[np.array([own_features(w, b) for w in new])].sum(axis=1)
            near = self.weights[np.array([neighbour_features(w, b) for w in new])]
            self._values = np.concatenate([self._values, np.column_stack([own, near])])
            index.update(zip(new, range(len(index), len(index) + len(new))))
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))

    def potentials(self, tokens: list[bytes], first: np.ndarray) -> np.ndarray:
        """The toxic tag's potential of each token of chains that begin where ``first`` holds; the clean tag's is 0."""
        ids = self._ids(tokens)  # may replace the values
        v = self._values[ids] if tokens else np.zeros((0, 3))
        out = v[:, 0].copy()
        out[1:] += np.where(first[1:], 0, v[:-1, 1])
        out[:-1] += np.where(first[1:], 0, v[1:, 2])
        return out

    def marginals(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens of some documents, and where each document's begin; none are toxic where no field was learned."""
        begin = np.cumsum([0, *map(len, docs)])
        tokens = [w for d in docs for w in d]
        if not self.learned:
            return np.zeros(len(tokens)), begin
        first = np.zeros(len(tokens) + 1, bool)
        first[begin] = True
        first = first[:-1]
        return chain_marginals(self.potentials(tokens, first), first, self.trans), begin

    # -- training

    def fit(self, sample: list[tuple[bytes, int]]) -> "Crf":
        p, s = self.p, self.p.segment
        labels = np.array([y for _, y in sample])
        share = float(np.clip(labels.mean() if len(labels) else 0.1, 0.01, 0.99))
        self.combine = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        if not len(labels) or labels.min() == labels.max():
            return self
        number: dict[bytes, int] = {}
        docs = [np.fromiter((number.setdefault(w, len(number)) for w in TOKEN.findall(t)), np.int32) for t, _ in sample]
        words, forms = list(number), {}
        form = np.array([forms.setdefault(normal(w), len(forms)) for w in words], np.int32)
        learn = len(docs) * 3 // 4
        if len(docs) < 40 or labels[:learn].min() == labels[:learn].max() or labels[learn:].min() == labels[learn:].max():
            learn = 0  # too few to set some aside
        seen = docs[:learn] or docs
        counts = np.zeros((2, len(forms)))
        for ids, y in zip(seen, labels):
            counts[y, np.unique(form[ids])] += 1
        n_good, n_bad = (np.bincount(labels[: len(seen)], minlength=2) + 1).tolist()
        # A count of one in clean documents is smoothed in.
        lexicon = (counts[1] >= max(p.least, 0.01 * n_bad)) & (counts[1] / n_bad >= p.ratio * (counts[0] + 1) / n_good)
        rng = np.random.default_rng(p.seed)
        hot, cold = [], []  # segments with and without toxic tokens
        for ids, y in zip(seen, labels):
            tags = lexicon[form[ids]] & bool(y)
            for at in range(0, len(ids), s):
                (hot if tags[at : at + s].any() else cold).append((ids[at : at + s], tags[at : at + s]))
        # All of the former and up to four times as many of the latter.
        keep = rng.permutation(len(cold))[: 4 * len(hot) + 1000]
        if not hot:
            return self
        self._train(hot + [cold[i] for i in keep], words)
        # The document score is fitted on the documents that the field hasn't learned from, where it errs as on new ones.
        self.learned = True
        self._calibrate([[words[i] for i in d] for d in docs[learn:]], labels[learn:])
        return self

    def _train(self, chains: list[tuple[np.ndarray, np.ndarray]], words: list[bytes]) -> None:
        p, s = self.p, self.p.segment
        own = np.array([own_features(w, p.buckets) for w in words], np.int32)
        near = np.array([neighbour_features(w, p.buckets) for w in words], np.int32)
        where, which = [], []
        y = np.zeros((len(chains), s), bool)
        live = np.zeros((len(chains), s), bool)
        for c, (ids, tag) in enumerate(chains):
            y[c, : len(tag)], live[c, : len(tag)] = tag, True
            at = c * s + np.arange(len(ids), dtype=np.int32)
            where += [np.repeat(at, own.shape[1]), at[1:], at[:-1]]
            which += [own[ids].ravel(), near[ids[:-1], 0], near[ids[1:], 1]]
        where, which = np.concatenate(where).astype(np.int32), np.concatenate(which)
        seen_pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
        squares, squares_t = np.full(p.buckets, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(p.steps):  # full-batch steps with per-weight rates
            e = np.bincount(where, self.weights[which], len(chains) * s).reshape(len(chains), s)
            emit = np.stack([np.zeros_like(e), np.where(live, e, -np.inf)], axis=2)
            marginal, pairs, _ = forward_backward(emit, self.trans)
            miss = np.where(live, y - marginal[:, :, 1], 0).ravel()
            g = np.bincount(which, miss[where], p.buckets) - p.penalty * self.weights
            gt = seen_pairs - pairs
            squares, squares_t = 0.9 * squares + 0.1 * g**2, 0.9 * squares_t + 0.1 * gt**2
            self.weights += p.rate * g / (np.sqrt(squares) + 1)  # features seen once move slowly
            self.trans += 0.5 * p.rate * gt / (np.sqrt(squares_t) + 1)
        self._forget()

    @staticmethod
    def evidence(marginal: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of each document: 1, the largest marginal and the log of the expected number of toxic tokens, of those above the noise of one in twenty."""
        some = np.diff(begin) > 0
        out = np.zeros((len(begin) - 1, 3))
        out[:, 0] = 1
        if some.any():
            out[some, 1] = np.maximum.reduceat(marginal, begin[:-1][some])
            out[some, 2] = np.log1p(np.add.reduceat(np.where(marginal > 0.05, marginal, 0), begin[:-1][some]))
        return out

    def _calibrate(self, docs: list[list[bytes]], labels: np.ndarray) -> None:
        x = self.evidence(*self.marginals(docs))
        w = np.zeros(3)
        for _ in range(30):  # Newton steps of a penalised logistic regression
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
            w += np.linalg.solve(h, x.T @ (labels - q) - 0.1 * w)
        self.combine = w

    # -- use

    def scores(self, marginal: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(marginal, begin) @ self.combine, -30, 30)))


def _spans(text: bytes, marginal: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of runs of toxic tokens, punctuation at the edges left out."""
    out: list[dict[str, int]] = []
    if not (marginal >= 0.5).any():
        return out
    at = start = 0  # bytes and characters read so far: each byte is decoded once
    for m, p in zip(TOKEN.finditer(text), marginal):
        if p >= 0.5:
            word = m.group()
            lead = len(word) - len(word.lstrip(EDGE))
            core = word.strip(EDGE) or word
            here = m.start() + (lead if core != word else 0)
            start, at = start + len(text[at:here].decode("utf-8", "replace")), here
            out.append({"start": start, "end": start + len(core.decode("utf-8", "replace"))})
    return out


SCHEMA = "doc_id string, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: CrfParams = CrfParams(), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans for every row of docs(doc_id, text)."""
    crf = fitted(Crf(p).fit, docs, labels, "toxic", p.rows, p.most_bytes, p.seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, texts, marginal, begin in _grouped(crf, batch["text"]):
                scores = crf.scores(marginal, begin)
                spans = [_spans(t, marginal[a:b]) for t, a, b in zip(texts, begin, begin[1:])]
                own = batch.iloc[part]
                yield pd.DataFrame({"doc_id": own["doc_id"].array, "held_out": own["held_out"].array, "score": scores, "predicted": (scores >= threshold).astype(np.int32), "spans": spans})

    # An id beside a null one would pass through pandas as a float: text keeps it whole.
    ready = docs.select(F.col("doc_id").cast("string"), "text", held_out(F.col("doc_id"), *HOLD_OUT).alias("held_out"))
    return ready.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_toxic(docs: DataFrame, labels: DataFrame, p: CrfParams = CrfParams(), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score under the threshold."""
    crf = fitted(Crf(p).fit, docs, labels, "toxic", p.rows, p.most_bytes, p.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, marginal, begin in _grouped(crf, batch.column(batch.schema.get_field_index("text"))):
                own = batch.slice(part.start, part.stop - part.start)
                yield own.filter(pa.array(crf.scores(marginal, begin) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _grouped(crf: Crf, column, most: int = 1 << 20, rows: int = 2048) -> Iterator[tuple[slice, list[bytes], np.ndarray, np.ndarray]]:
    """Rows of about ``most`` bytes with their texts, their tokens' marginals and where each document's begin."""
    at, texts, size = 0, [], 0
    values = column.tolist() if hasattr(column, "tolist") and not isinstance(column, pa.Array) else (x.as_py() for x in column)
    for k, text in enumerate(values):
        texts.append(encode(text))
        size += len(texts[-1])
        if size >= most or len(texts) == rows:
            yield slice(at, k + 1), texts, *crf.marginals([t.split() for t in texts])
            at, texts, size = k + 1, [], 0
    if texts:
        yield slice(at, at + len(texts)), texts, *crf.marginals([t.split() for t in texts])
