"""LM scoring with a probabilistic suffix tree over tokens.

Tokens are words (A-Z lower-cased) and one end per document.  The root state
is the add-one unigram distribution; words of fewer than 1/``frequent`` of all
tokens (none before ``frequent`` tokens are reached) and words never seen are one
class there, whose members are alike.  A position's state is the longest suffix
of the tokens before it that the tree retains, up to ``depth`` tokens, of which
the document's start may be one.  Every context of every position is counted and
tested: it is retained when its next-token distribution diverges from its
parent's by a leave-one-out test, which a context without a repeated continuation
never passes, nor does any longer one.  A retained state's distribution is
smoothed with its parent's, the weight being the number of distinct continuations
(Witten-Bell), so every state's probabilities sum to one over the training words
and one unknown word.

Each position is shuffled once, to the partition of its nearest word, where all
its contexts lie together.  Positions travel as compressed byte planes of word
numbers, a block for each group of documents and partition, or of all groups from one partition to another.  Words of at least
``hot`` occurrences would fill a partition: contexts of hot words alone are summed
per batch and settled level by level, and positions behind them start from the
distributions found, in the partition of the context up to the nearest word that
isn't hot.  Where that line runs changes the plan, never the result.  Only words
of the root's own (at most ``frequent``) are broadcast; the base score's other
counts are joined.

Null and empty texts have one token, the end.  Repeated rows get equal scores,
other columns aren't read, ties play no part, an empty table gives an empty result,
a null id is a training row.  An empty training set leaves every token unknown.
Words are told apart by 47 bits of a hash beyond the broadcast ones, which have
numbers of their own.  Very long texts are read whole; a group of documents has
``group_tokens`` tokens or one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import Scratch
from tessella.llm.text import encode, held_out, mix

END = xxhash.xxh3_64_intdigest(b"\n")  # white space, so no word's
#: Word numbers: none, the document's start, then the broadcast words by falling count, then hashes.
NONE, START, FIRST = 0, 1, 2
#: Bytes of a document's place in its group, and about those of a token with what ends it.
DOC_BYTES, TOKEN = 4, 6
#: Words that are numbered, if the root has no more of its own.
LISTED = 1 << 21


@dataclass(frozen=True)
class PstParams:
    """Held out: crc32 of the id as text mod ``modulus`` is ``remainder``."""

    modulus: int = 7
    remainder: int = 2
    frequent: int = 1 << 21
    depth: int = 4
    hot: int = 1 << 20
    gain_bits: float = 4.0
    group_tokens: int = 400_000


def _groups(batch: pd.DataFrame, most: int) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` tokens, with what ``_tokens`` finds."""
    start, texts, size = 0, [], 0
    for k, text in enumerate(batch["text"]):
        texts.append(encode(text))
        size += len(texts[-1])
        if size >= TOKEN * most or k + 1 == len(batch):
            yield batch.iloc[start : k + 1], *_tokens(texts)
            start, texts, size = k + 1, [], 0


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the place there of every text's words and end, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    owner, words = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), lists.flatten()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # beside white space at the ends, empty words
    if not there.all():
        owner, words = owner[there], words.filter(pa.array(there))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)) + 1)]
    places = np.full(first[-1], len(distinct))
    places[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
    return [*distinct, b"\n"], places, first


def _hash(word: bytes) -> int:
    return END if word == b"\n" else xxhash.xxh3_64_intdigest(word)


class Vocabulary:
    """The broadcast words, by falling count: their numbers, counts and root probabilities; the first ``own`` are the root's own."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int, total: int, distinct: int, frequent: int, hot: int, complete: bool, keep: bool = True):
        self.args = (hashes, counts, own, total, distinct, frequent, hot, complete, False) if keep else None
        self.complete = complete  # no other word repeats
        self.order = np.argsort(hashes).astype(np.int32)
        self.sorted = hashes[self.order]
        norm = total + distinct + 1
        self.rare, self.hashed = FIRST + own, FIRST + max(frequent, LISTED)
        p = np.r_[1.0, 1.0, (counts + 1) / norm]  # by number
        self.p, self.base = p[: self.rare].copy(), np.log10(p)
        # The other words and the unknown one share what is left in equal parts.
        others = distinct - own
        self.p_rare = (total - int(counts[:own].sum()) + others + 1) / norm / (others + 1)
        end = np.flatnonzero(hashes == np.uint64(END))
        self.start_hot = bool(len(end) and counts[end[0]] >= hot)  # as many starts as ends
        self.hot_below = FIRST + int((counts >= hot).sum())

    def __reduce__(self):
        return Vocabulary, self.args

    def lookup(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and numbers of the tokens; unknown words get one."""
        h = np.fromiter(map(_hash, tokens), np.uint64, len(tokens))
        at = np.minimum(np.searchsorted(self.sorted, h), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == h if len(self.sorted) else np.zeros(len(h), bool)
        number = np.uint64(self.hashed) + (h >> np.uint64(17))
        number[known] = self.order[at[known]] + FIRST
        return h, number

    def root(self, number: np.ndarray) -> np.ndarray:
        """Root probabilities."""
        own = number < self.rare
        out = np.full(len(number), self.p_rare)
        out[own] = self.p[number[own].astype(np.int64)]
        return out

    def is_hot(self, number: np.ndarray) -> np.ndarray:
        return ((number >= FIRST) & (number < self.hot_below)) | ((number == START) & self.start_hot)


def count_tokens(docs: DataFrame, p: PstParams) -> DataFrame:
    """(h, c): counts of training tokens, ends included; added up per group before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, tokens, places, _ in _groups(batch[~batch["held_out"].astype(bool)], 4 * p.group_tokens):
                yield pd.DataFrame({"h": np.fromiter(map(_hash, tokens), np.uint64, len(tokens)).view(np.int64), "c": np.bincount(places)})

    return docs.select("text", "held_out").mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# -- blocks of positions: byte planes, compressed


def _pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of numbers, each with the low bytes that it needs."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1)[:, :width].T).tobytes() for c, width in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _groups_of(data: bytes) -> np.ndarray:
    """The groups that a block has positions of."""
    return np.frombuffer(data, np.int64, int.from_bytes(data[4:8], "little"), 8)


def _unpack(v: Vocabulary, data: bytes, n: int, words: int, far: bool) -> list[np.ndarray]:
    """The columns of a block of n positions: words, the document, the group and, if far, what hot contexts gave."""
    listed, groups = int.from_bytes(data[:4], "little"), _groups_of(data)
    columns = words + 1 + (len(groups) > 1)
    size = 4 * columns * n
    raw = pa.decompress(data[8 + 8 * len(groups) :], size + 8 * n * far + 8 * listed, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, size).reshape(columns, 4, n)
    out = [np.ascontiguousarray(x.T).view(np.uint32).ravel().astype(np.uint64) for x in planes]
    if listed:
        others = np.frombuffer(raw, np.uint64, listed, len(raw) - 8 * listed)
        for x in out[:words]:
            at = np.flatnonzero(x >= v.hashed)
            x[at] = others[x[at] - np.uint64(v.hashed)]
    out[words + 1 :] = [groups[out[-1].astype(np.int64)] if len(groups) > 1 else np.full(n, groups[0])]
    if far:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, size).reshape(8, n).T).view(np.uint64).ravel())
    return out


def _block(v: Vocabulary, words: np.ndarray, doc: np.ndarray, grp: np.ndarray, q: list[np.ndarray]) -> bytes:
    """Positions as planes of four bytes; words known by their hashes are numbered in the block, and so are its groups."""
    high = words >= v.hashed
    others, place = np.unique(words[high], return_inverse=True)
    words[high] = np.uint64(v.hashed) + place.astype(np.uint64)
    groups, group = np.unique(grp, return_inverse=True) if grp[0] != grp[-1] else (grp[:1], None)
    columns = [*words, doc, group] if len(groups) > 1 else [*words, doc]
    planes = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in columns]
    planes += [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in q]
    head = b"".join([len(others).to_bytes(4, "little"), len(groups).to_bytes(4, "little"), groups.tobytes()])
    return head + pa.compress(b"".join([*planes, others.tobytes()]), codec="zstd", asbytes=True)


def _blocks(v: Vocabulary, part: np.ndarray, columns: list[np.ndarray], depth: int) -> Iterator[tuple[int, int, bytes]]:
    """(partition, positions, data) of the positions of each partition, in their order; those of one group, or in the order of groups."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part, words, (doc, grp, *q) = part[order], np.stack([c[order] for c in columns[: depth + 1]]), [c[order] for c in columns[depth + 1 :]]
    ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    lo = 0
    for hi in ends.tolist() if len(part) else ():
        yield int(part[lo]), hi - lo, _block(v, words[:, lo:hi], doc[lo:hi], grp[lo:hi], [x[lo:hi] for x in q])
        lo = hi


def _longer(key: np.ndarray, d: int, word: np.ndarray) -> np.ndarray:
    """The key of the context one word longer, of d words."""
    return mix((key + np.uint64(d)) ^ mix(word + np.uint64(1)))


def _pair(key: np.ndarray, nx: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(nx + np.uint64(1)))


def _contexts(v: Vocabulary, words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of positions with the words before them (nearest first): the distance of the nearest word that isn't hot
    (one beyond the depth where there is none), the keys of contexts of 0, 1.. words, and how many words there are."""
    depth, n = len(words), len(words[0])
    anchor, reach = np.full(n, depth + 1), np.zeros(n, np.int64)
    keys = [np.zeros(n, np.uint64)]
    for d, w in enumerate(words, 1):
        there = w != NONE
        reach += there
        anchor[there & (anchor > depth) & ~v.is_hot(w)] = d
        keys.append(_longer(keys[-1], d, w))
    return anchor, keys, reach


class _Group:
    """The positions of a group of documents: next tokens and the words before them."""

    def __init__(self, v: Vocabulary, rows: pd.DataFrame, tokens: list[bytes], places: np.ndarray, first: np.ndarray, depth: int):
        h, number = v.lookup(tokens)
        self.nx, self.others = number[places], lambda own: h[places[own]].view(np.int64)
        sizes = np.diff(first)
        at = np.arange(len(places)) - np.repeat(first[:-1], sizes)
        self.words = []
        for d in range(1, depth + 1):
            w = np.zeros(len(places), np.uint64)
            w[d:] = self.nx[:-d]
            w[at < d] = NONE
            w[at == d - 1] = START
            self.words.append(w)
        if v.complete:  # a context with a word that doesn't repeat is never retained, nor any longer one
            gone = np.zeros(len(places), bool)
            for w in self.words:
                gone |= w >= v.hashed
                w[gone] = NONE
        self.held = rows["held_out"].to_numpy(bool)
        # The place in the group, and whether the document is held out.
        self.doc = np.repeat(np.arange(len(rows), dtype=np.uint64) * np.uint64(2) + self.held, sizes)

    def columns(self, own: np.ndarray, grp: int) -> list[np.ndarray]:
        return [*(c[own] for c in (self.nx, *self.words, self.doc)), np.full(len(own), grp)]


DOC = "grp long, at int, doc_id string, held_out boolean, n_tokens long, n_known long, base double, root double, others array<long>"
BLOCK = "part int, grp long, n int, data binary"


def _run_groups(make, vocabulary, p: PstParams):
    """mapInPandas code that gives ``make``'s frames for each group, numbered alike in every pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, tokens, places, first in _groups(batch, p.group_tokens):
                yield from make(vocabulary.value, grp, rows, first, _Group(vocabulary.value, rows, tokens, places, first, p.depth))
                grp += 1

    return run


def _near(docs: DataFrame, vocabulary, parts: int, p: PstParams) -> DataFrame:
    """Rows of documents, and blocks of the positions whose nearest word isn't hot."""

    def make(v: Vocabulary, grp: int, rows: pd.DataFrame, first: np.ndarray, x: _Group) -> Iterator[pd.DataFrame]:
        rare, far = x.nx >= v.rare, x.nx >= v.hashed
        add = lambda y: np.add.reduceat(y, first[:-1])
        known = np.where(far, 0.0, v.base[np.where(far, 0, x.nx).astype(np.int64)])
        few = add(far.astype(np.int64))
        others = np.split(x.others(far), np.cumsum(few)[:-1])
        root = add(np.where(rare, np.log10(v.p_rare), known))
        yield pd.DataFrame({
            "part": grp % parts, "grp": grp, "at": np.arange(len(rows)), "doc_id": rows["doc_id"], "held_out": x.held, "n_tokens": np.diff(first),
            "n_known": np.diff(first) - few, "base": add(known), "root": root, "others": others, "n": 0, "data": None,
        })
        near = np.flatnonzero((x.words[0] != NONE) & ~v.is_hot(x.words[0]))
        key = _longer(np.zeros(len(near), np.uint64), 1, x.words[0][near])
        yield _as_rows(grp, _blocks(v, (key % np.uint64(parts)).astype(np.int64), x.columns(near, grp), p.depth))

    schema = f"part int, {DOC}, n int, data binary"
    return docs.mapInPandas(_in_order(_run_groups(make, vocabulary, p), schema), schema)


def _in_order(run, schema: str):
    """Frames with all columns of the schema, in its order."""
    names = [c.split()[0] for c in re.sub(r"<.*?>", "", schema).split(", ")]

    def ordered(batches):
        for frame in run(batches):
            yield frame.assign(**{c: None for c in names if c not in frame})[names]

    return ordered


def _as_rows(grp: int, blocks: Iterator[tuple[int, int, bytes]]) -> pd.DataFrame:
    part, n, data = zip(*blocks) if (blocks := list(blocks)) else ((), (), ())
    return pd.DataFrame({"part": np.array(part, np.int64), "grp": grp, "n": np.array(n, np.int64), "data": data})


def _far(docs: DataFrame, vocabulary, parts: int, p: PstParams, blocks: bool) -> DataFrame:
    """Pairs of contexts of hot words and next tokens with training counts, added up per group, or blocks of the positions behind hot words."""

    def make(v: Vocabulary, grp: int, rows: pd.DataFrame, first: np.ndarray, x: _Group) -> Iterator[pd.DataFrame]:
        own = np.flatnonzero(v.is_hot(x.words[0]))
        if not len(own):
            return
        words, nx, live = [w[own] for w in x.words], x.nx[own], ~x.held[(x.doc[own] >> np.uint64(1)).astype(np.int64)]
        anchor, keys, reach = _contexts(v, words)
        for d in range(1, 1 if blocks else p.depth + 1):
            at = np.flatnonzero((anchor > d) & (reach >= d))
            _, head, pair = np.unique(_pair(keys[d][at], nx[at]), return_index=True, return_inverse=True)
            i = at[head]
            yield pd.DataFrame({"d": d, "k": keys[d][i].view(np.int64), "up": keys[d - 1][i].view(np.int64), "nx": nx[i].view(np.int64), "c": np.bincount(pair, live[at], len(head)).astype(np.int64)})
        if not blocks:
            return
        up = np.take_along_axis(np.stack(keys), np.minimum(anchor - 1, reach)[None], 0)[0]
        yield _as_rows(grp, _blocks(v, (_pair(up, nx) % np.uint64(parts)).astype(np.int64), x.columns(own, grp), p.depth))

    schema = BLOCK if blocks else "d int, k long, up long, nx long, c long"
    return docs.mapInPandas(_in_order(_run_groups(make, vocabulary, p), schema), schema)


# -- counting, testing and smoothing


def _order(key: np.ndarray, below: int = 1 << 64) -> tuple[np.ndarray, np.ndarray]:
    """An order that has equal keys side by side, and the number of each place's key there; keys are below a bound, or hashes."""
    bits = len(key).bit_length()
    low = np.uint64((1 << bits) - 1)
    head = key << np.uint64(bits) if below << bits <= 1 << 64 else key & ~low
    packed = np.sort(head | np.arange(len(key), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    there = key[order]
    fresh = there[1:] != there[:-1]
    if (fresh & ((packed[1:] ^ packed[:-1]) <= low)).any():  # alike in the leading bits only
        order = np.argsort(key)
        there = key[order]
        fresh = there[1:] != there[:-1]
    return order, np.cumsum(np.r_[False, fresh][: len(key)], dtype=np.uint64)


class _Rows:
    """Positions (or pairs of a context and a next token): training weight, probability so far and whether any state was retained."""

    def __init__(self, nx: np.ndarray, weight: np.ndarray, p: np.ndarray, used: np.ndarray):
        order, name = _order(mix(nx))
        self.nx = np.empty(len(nx), np.uint64)
        self.nx[order] = name
        self.names, self.weight, self.p, self.used = int(name[-1]) + 1, weight, p, used

    def settle(self, key: np.ndarray, at: np.ndarray, gain_bits: float) -> tuple[np.ndarray, np.ndarray]:
        """Tests the contexts ``key`` of the rows ``at`` and applies those retained; gives the rows that may have longer ones and their contexts."""
        if not len(at):
            return at, key
        order, state = _order(key)
        at = at[order]
        order, pair = _order(state * np.uint64(self.names) + self.nx[at], int(state[-1] + np.uint64(1)) * self.names)
        state, at = state[order], at[order]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        rows = np.diff(np.r_[start, len(pair)])
        c, state, parent = np.add.reduceat(self.weight[at], start), state[start], self.p[at[start]]
        begin = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        pairs = np.diff(np.r_[begin, len(state)])
        n, t, most = np.add.reduceat(c, begin), np.add.reduceat((c > 0).astype(float), begin), np.maximum.reduceat(c, begin)
        n_, t_ = np.repeat(n, pairs), np.repeat(t, pairs)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log2((np.maximum(c - 1, 0) + t_ * parent) / (np.maximum(n_ - 1, 0) + t_) / parent)
            kept = (np.add.reduceat(np.where(c > 0, c * ratio, 0), begin) >= gain_bits) & (n >= 2)
            kept_ = np.repeat(kept, pairs)
            self.p[at] = np.repeat(np.where(kept_, (c + t_ * parent) / (n_ + t_), parent), rows)
        self.used[at] |= np.repeat(kept_, rows)
        on = np.repeat(np.repeat(most >= 2, pairs), rows)
        return at[on], np.repeat(state, rows)[on].astype(np.uint64)


def _as_long(p: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A probability as a float, and a flag, in one number."""
    return p.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | used.astype(np.uint64)


def _from_long(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (q >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(float), (q & np.uint64(1)) > 0


def _hot_states(pairs: DataFrame, vocabulary, parts: int, scratch: Scratch, p: PstParams) -> DataFrame:
    """(part, k, nx, q) of all contexts of hot words alone, level by level."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        x = pd.concat(frames) if frames else pd.DataFrame()
        if not len(x):
            return
        nx, k = x["nx"].to_numpy().view(np.uint64), x["k"].to_numpy().view(np.uint64)
        before, used = _from_long(x["q"].to_numpy().view(np.uint64))
        rows = _Rows(nx, x["c"].to_numpy(float), np.where(before > 0, before, vocabulary.value.root(nx)), used)
        rows.settle(k, np.arange(len(x)), p.gain_bits)
        q = _as_long(rows.p, rows.used).view(np.int64)
        yield pd.DataFrame({"part": (_pair(k, nx) % np.uint64(parts)).astype(np.int32), "k": k.view(np.int64), "nx": nx.view(np.int64), "q": q})

    levels: list[DataFrame] = []
    summed = scratch.write(pairs.groupBy("d", "k", "nx").agg(F.first("up").alias("up"), F.sum("c").alias("c")), "pairs")
    for d in range(1, p.depth + 1):
        own = summed.where(F.col("d") == d)
        if levels:
            own = own.join(levels[-1].select(F.col("k").alias("up"), "nx", "q"), ["up", "nx"])
        else:
            own = own.withColumn("q", F.lit(0).cast("long"))
        own = own.select("k", "nx", "c", "q").repartition("k")
        levels.append(scratch.write(own.mapInPandas(settle, "part int, k long, nx long, q long"), f"level{d}"))
    scratch.drop("pairs")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _start_far(blocks: DataFrame, states: DataFrame, vocabulary, parts: int, p: PstParams) -> DataFrame:
    """Blocks of positions behind hot words with what the hot contexts gave them, for the partitions of their further contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, keys, values, held = vocabulary.value, [], [], []
        for b in batches:
            state = b["data"].isna().to_numpy()
            k, nx, q = (b[c].to_numpy()[state].view(np.uint64) for c in ("k", "nx", "q"))
            keys.append(_pair(k, nx))
            values.append(q)
            held += [(int(g), int(n), d) for g, n, d in zip(b["grp"][~state], b["n"][~state], b["data"][~state])]
        if not held:
            return
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        # All groups together: else each block of a group and partition would be dealt to as many blocks as there are partitions.
        held.sort(key=lambda h: h[0])
        columns = [np.concatenate(c) for c in zip(*(_unpack(v, data, n, p.depth + 1, False) for _, n, data in held))]
        del held
        anchor, own, reach = _contexts(v, columns[1 : p.depth + 1])
        own = np.stack(own)
        up = np.take_along_axis(own, np.minimum(anchor - 1, reach)[None], 0)[0]
        q = values[np.searchsorted(keys, _pair(up, columns[0]))]
        place = np.take_along_axis(own, np.minimum(anchor, reach)[None], 0)[0] % np.uint64(parts)
        del own, up
        yield _as_rows(0, _blocks(v, place.astype(np.int64), [*columns, q], p.depth))

    # Zeros, not nulls, for pandas would turn numbers beside nulls into floats.
    none = [F.lit(0).cast("long").alias(c) for c in ("k", "nx", "q")]
    block = [F.lit(0).cast("long").alias("grp"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data")]
    rows = blocks.select("part", "grp", "n", "data", *none).unionByName(states.select("part", *block, "k", "nx", "q"))
    return rows.repartitionById(parts, F.col("part")).mapInPandas(_in_order(run, BLOCK), BLOCK)


def _score(rows: DataFrame, vocabulary, p: PstParams) -> DataFrame:
    """Counts, tests and scores of the contexts of each partition, one word longer at a time.

    The rows of documents pass by; blocks of positions become blocks of their
    documents' gains over the root.
    """
    schema = f"part int, {DOC}, n int, data binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = [], 0
        for b in batches:
            doc = b["data"].isna()
            if doc.any():
                yield b[doc]
            if not doc.all():
                part = int(b["part"].iloc[0])
                held += [(int(n), d, bool(f)) for n, d, f in zip(b["n"][~doc], b["data"][~doc], b["far"][~doc])]
        if held:
            del b
            gains = _as_rows(part, _gains(vocabulary.value, held, p))
            yield gains.rename(columns={"part": "grp", "grp": "part"})

    return rows.mapInPandas(_in_order(run, schema), schema)


def _gains(v: Vocabulary, held: list[tuple[int, bytes, bool]], p: PstParams) -> Iterator[tuple[int, int, bytes]]:
    """(group, documents, data) of the documents of each group whose score differs from the root's."""
    held.sort(key=lambda h: (_groups_of(h[1])[0], h[2], h[1]))
    ends = np.cumsum([h[0] for h in held])
    groups = np.unique(np.concatenate([_groups_of(h[1]) for h in held]))
    number = np.empty(ends[-1], np.uint32)
    columns = [np.empty(ends[-1], np.uint64) for _ in range(p.depth + 2)]
    q = np.zeros(ends[-1], np.uint64)
    for k, (n, data, far) in enumerate(held):
        lo, hi = ends[k] - n, ends[k]
        own = _unpack(v, data, n, p.depth + 1, far)
        number[lo:hi] = np.searchsorted(groups, own.pop(p.depth + 2))
        for c, x in zip([*columns, q], own):
            c[lo:hi] = x
    del held
    nx, words, doc = columns[0], columns[1:-1], columns[-1]
    root = v.root(nx)
    before, used = _from_long(q)
    rows = _Rows(nx, (doc & np.uint64(1) == 0).astype(float), np.where(before > 0, before, root), used)
    far = np.flatnonzero(before > 0)
    key, at, offset = _longer(np.zeros(len(nx), np.uint64), 1, words[0]), np.arange(len(nx)), np.zeros(len(nx), np.int8)
    del q, nx, before, columns
    if len(far):
        anchor, keys, _ = _contexts(v, [w[far] for w in words])
        key[far] = np.take_along_axis(np.stack(keys), np.minimum(anchor, p.depth)[None], 0)[0]
        offset[far] = anchor - 1
        at = np.flatnonzero(offset < p.depth)
        key = key[at]
        del anchor, keys
    for d in range(1, p.depth + 1):
        at, state = rows.settle(key, at, p.gain_bits)
        if d == p.depth:
            break
        w, place = np.full(len(at), NONE, np.uint64), offset[at] + d
        for k in range(d, p.depth):
            own = np.flatnonzero(place == k)
            w[own] = words[k][at[own]]
        there = w != NONE
        at = at[there]
        key = _longer(state[there], d, w[there])
    use = np.flatnonzero(rows.used)
    if not len(use):
        for g in groups.tolist():
            yield g, 0, b""
        return
    value = np.log10(rows.p[use]) - np.log10(root[use])
    place = number[use].astype(np.uint64) << np.uint64(32) | doc[use] >> np.uint64(1)
    docs, where = np.unique(place, return_inverse=True)
    value = np.bincount(where, value)
    owner = (docs >> np.uint64(32)).astype(np.int64)
    for i, g in enumerate(groups.tolist()):
        lo, hi = np.searchsorted(owner, [i, i + 1])
        yield g, hi - lo, _pack([(docs[lo:hi], DOC_BYTES), (value[lo:hi].astype(np.float32), 4)]) if hi > lo else b""


def _add_up(gains: DataFrame) -> DataFrame:
    """(grp, at, gain): the gains of all partitions, added in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(0)
        for b in batches:
            for grp, n, data in zip(b["grp"], b["n"], b["data"]):
                if grp != now:
                    if now is not None:
                        yield pd.DataFrame({"grp": now, "at": np.arange(len(total)), "gain": total})
                    now, total = grp, np.zeros(0)
                planes = np.frombuffer(pa.decompress(data, n * (DOC_BYTES + 4), codec="zstd"), np.uint8).reshape(-1, n)
                docs = np.ascontiguousarray(planes[:DOC_BYTES].T).view(np.uint32).ravel()
                value = np.ascontiguousarray(planes[DOC_BYTES:].T).view(np.float32).ravel()
                if docs[-1] >= len(total):
                    total = np.r_[total, np.zeros(int(docs[-1]) + 1 - len(total))]
                total[docs] += value
        if now is not None:
            yield pd.DataFrame({"grp": now, "at": np.arange(len(total)), "gain": total})

    return gains.select("grp", "part", "n", "data").repartition("grp").sortWithinPartitions("grp", "part").mapInPandas(run, "grp long, at int, gain double")


def suffix_tree_scores(docs: DataFrame, scratch: Scratch, p: PstParams = PstParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("string"), "text", held_out(F.col("doc_id"), p.modulus, p.remainder).alias("held_out"))
    if "Exchange" in base._jdf.queryExecution().executedPlan().toString():
        base = scratch.write(base, "documents")  # groups are numbered by the order of the rows, which a shuffle doesn't keep
    counts = scratch.write(count_tokens(base, p), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most ``frequent`` words can have this count: the broadcast is bounded whatever the corpus.
    least = total / p.frequent
    # Words below it, if they repeat, are numbered too while there are few enough; the root doesn't know them.
    sizes = counts.where("c > 1").groupBy(F.least("c", F.ceil(F.lit(least))).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    cut, listed = least, 0
    for c, n in sorted(((r.c, r.n) for r in sizes), reverse=True):
        listed += n
        if listed > LISTED:
            break
        cut = min(cut, c)
    common = counts.where(F.col("c") >= cut).select("h", "c").toArrow()  # as rows, each would take hundreds of bytes of the driver
    hot = int(max(np.ceil(least), p.hot))
    h, c = common["h"].to_numpy(), common["c"].to_numpy()
    order = np.lexsort((h, -c))
    hashes, c = h[order].view(np.uint64), c[order]
    del common, h, order
    vocabulary = spark.sparkContext.broadcast(Vocabulary(hashes, c, int((c >= least).sum()), total, distinct, p.frequent, hot, cut <= 2))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task holds its positions, several numbers each
    rows = _near(base, vocabulary, parts, p).withColumn("far", F.lit(False))
    if (c >= hot).any():
        # The positions are found again when their states are known: written, they would be on disk beside two shuffles of them.
        states = _hot_states(_far(base, vocabulary, parts, p, False), vocabulary, parts, scratch, p)
        started = _start_far(_far(base, vocabulary, parts, p, True), states, vocabulary, parts, p).withColumn("far", F.lit(True))
        rows = rows.unionByName(started, allowMissingColumns=True)
    scored = scratch.write(_score(rows.repartitionById(parts, F.col("part")), vocabulary, p), "scored")
    gains = _add_up(scored.where("data is not null and n > 0"))
    rows = scored.where("data is null")
    # The counts of words that aren't broadcast, for the base score alone.
    norm = float(np.log10(total + distinct + 1))
    found = (
        rows.select("grp", "at", F.explode("others").alias("h")).join(counts.where(F.col("c") < cut), "h", "left")
        .groupBy("grp", "at").agg(F.count("c").alias("known2"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1) - norm).alias("base2"))
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.drop("others").join(found, ["grp", "at"], "left").join(gains, ["grp", "at"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + zero("known2")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"), (F.col("root") + zero("gain")).alias("score"),
    )
