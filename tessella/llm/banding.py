"""Banded candidates whose links are complete without writing all pairs of a bucket.

Rows are (bucket, id).  Each batch names one leader per bucket and pairs the
bucket's other members with it; only leaders meet in the shuffle, where each
bucket again names one leader.  That gives as many pairs as members, and no
task gets more than one row per batch of a bucket, however large it is.  What
meets travels as blocks of numbers, one for each batch and partition.

After exact verification and union-find, a bucket whose members lie in one
component needs nothing more.  In the others, members of different components
whose sketches are near are joined into families, in blocks of bounded size
that write a spanning forest, not pairs.  Every pair of a family across
components is then verified on full sets, again in blocks, bounded in members and
bytes, that write a forest of the true links.  In both steps one side lies outside
the group's leading component, so a group that has already come together costs
next to nothing.  Blocks are read one after the other, their visitors a slice at a
time, so a task holds one block's residents and no more.
A link can only be missed where no band (or no sketch, at six deviations) has
both texts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components, forest
from tessella.scratch import Scratch
from tessella.llm.text import mix

#: Members and bytes of texts that live in one block, and members where only sketches are compared.
BLOCK, BYTES, SKETCHES = 1024, 1 << 22, 1 << 14
#: Bytes of texts whose sets are made together.
SLICE = 1 << 20
#: Members of groups that are settled together, and their pairs.
SMALL, PAIRS = 64, 1 << 18
MET = "part int, own binary, stars binary"
LED = "bucket long, id long, leader long"


def _shared(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets are alone in their leading bits, and where the others are; places are sorted along with the bits."""
    low = np.uint64((1 << len(bucket).bit_length()) - 1)
    packed = np.sort(bucket.view(np.uint64) & ~low | np.arange(len(bucket), dtype=np.uint64))
    same = (packed[1:] ^ packed[:-1]) <= low
    many = (np.r_[same, False] | np.r_[False, same])[: len(bucket)]
    at = (packed & low).astype(np.int64)
    return at[~many], at[many]


def lead(bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (bucket, id) that are alone in their bucket, and (bucket, id, leader) of the others, once each, with the member of least hash as leader."""
    alone, shared = _shared(bucket)
    lone = np.stack([bucket[alone], ids[alone]])
    bucket, ids = bucket[shared], ids[shared]
    order = np.argsort(bucket)
    bucket, ids = bucket[order], ids[order]
    same = bucket[1:] == bucket[:-1]
    many = (np.r_[same, False] | np.r_[False, same])[: len(bucket)]
    single = np.concatenate([lone, np.stack([bucket[~many], ids[~many]])], axis=1)
    bucket, ids = bucket[many], ids[many]
    if not len(ids):
        return single, np.zeros((3, 0), np.int64)
    rank = mix(ids.view(np.uint64))  # alike in all buckets, so that a group has few leaders and few distinct pairs
    order = np.lexsort((rank, bucket))
    bucket, ids, rank = bucket[order], ids[order], rank[order]
    fresh = np.r_[True, (bucket[1:] != bucket[:-1]) | (rank[1:] != rank[:-1])]
    bucket, ids = bucket[fresh], ids[fresh]
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return single, np.stack([bucket, ids, np.repeat(ids[head], np.diff(np.r_[head, len(ids)]))])


def meeting(buckets: list[np.ndarray], ids: np.ndarray, parts: int) -> pd.DataFrame:
    """A batch's rows of ``MET``: its leaders for the partitions of their buckets, and the members that they lead."""
    own, stars = [], []
    for bucket in buckets:  # one band after the other
        single, led = lead(bucket, ids)
        head = led[1] == led[2]
        own.append(np.concatenate([single, led[:2, head]], axis=1))
        stars.append(led[:, ~head])
    own = np.concatenate(own, axis=1) if own else np.zeros((2, 0), np.int64)
    part = (mix(own[0].view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    own, part = np.stack([x[order] for x in own]), part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    data = [own[:, lo:hi].tobytes() for lo, hi in zip(starts, np.r_[starts[1:], len(part)])]
    out = pd.DataFrame({"part": part[starts].astype(np.int32), "own": data, "stars": None})
    stars = np.concatenate(stars, axis=1) if stars else np.zeros((3, 0), np.int64)
    if stars.shape[1]:
        home = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(parts))
        out = pd.concat([out, pd.DataFrame({"part": [home], "own": [None], "stars": [stars.tobytes()]})])
    return out


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaders of one shuffle partition get their bucket's leader; the others pass by."""
    met = []
    for b in batches:
        for own, stars in zip(b["own"], b["stars"]):
            if stars is not None:
                yield pd.DataFrame(np.frombuffer(stars, np.int64).reshape(3, -1).T, columns=["bucket", "id", "leader"])
            else:
                met.append(np.frombuffer(own, np.int64).reshape(2, -1))
    if met:
        bucket, ids = np.concatenate(met, axis=1)
        del met
        shared = _shared(bucket)[1]
        led = lead(bucket[shared], ids[shared])[1]
        yield pd.DataFrame(led[:, led[1] != led[2]].T, columns=["bucket", "id", "leader"])


#: Slots of the bitmap of wanted ids, and of a page of it: its size, and so the broadcast's, is fixed.
SLOTS, PAGE = 1 << 23, 1 << 16


def wanted_ids(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that holds for all of ids(id) and for few others, from a bitmap of fixed size.

    It spares shuffles most of what they would drop; a join decides.
    """


    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            slot, page = b["slot"].to_numpy(), b["page"].to_numpy()
            for k in np.unique(page).tolist():
                pages.setdefault(k, np.zeros(PAGE, bool))[slot[page == k] % PAGE] = True
        yield pd.DataFrame({"page": list(pages), "bits": [np.packbits(x).tobytes() for x in pages.values()]})

    slot = F.pmod("id", F.lit(SLOTS)).cast("int")
    slots = ids.select(slot.alias("slot"), F.shiftright(slot, PAGE.bit_length() - 1).alias("page"))
    bitmap = np.zeros(SLOTS // 8, np.uint8)  # the driver gets pages of bits, not ids
    for row in slots.repartition("page").mapInPandas(run, "page int, bits binary").collect():
        bitmap[row.page * PAGE // 8 :][: PAGE // 8] |= np.frombuffer(row.bits, np.uint8)
    packed = ids.sparkSession.sparkContext.broadcast(bitmap)

    def test(x: np.ndarray) -> np.ndarray:
        at = x % SLOTS
        return (packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return test


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def link_components(
    rows: DataFrame, near: Callable[[DataFrame], DataFrame] | None, sketches: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame],
    as_sets: Callable[[list], list[np.ndarray]], most_differ: int, percent: int, scratch: Scratch,
) -> DataFrame:
    """Components (id, comp) of the ids in ``rows``, which are ``meeting``'s over ``partitions`` partitions.

    ``near`` leaves out pairs(a, b) that cannot be links.  ``sketches`` gives
    (id, sketch) of some ids at least, with equally long binaries; pairs of which more than
    ``most_differ`` bits differ are no links.  ``payload`` gives (id, s) of some
    ids and ``as_sets`` the sorted sets of several s; a link has 100 * intersection >=
    percent * union.
    """
    stars = scratch.write(rows.repartitionById(partitions(rows), F.col("part")).mapInPandas(_meet, LED), "stars")
    met = scratch.write(stars.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "met")
    pairs = scratch.write(near(met), "pairs") if near else met
    texts = scratch.write(payload(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "texts")
    links = scratch.write(_led_links(pairs, texts, as_sets, percent), "links-1")
    comps = scratch.write(connected_components(links, scratch, "comps-1"), "first-comps")
    # Buckets are trees of (leader, member); only those with an edge across components can be open.
    side = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}")).hint("merge")
    across = met.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_ = stars.join(across.select(F.col("a").alias("leader"), F.col("b").alias("id")).hint("merge"), ["leader", "id"], "left_semi").select("bucket").distinct()
    hidden = scratch.write(stars.join(open_.hint("merge"), "bucket", "left_semi"), "open-buckets")
    if hidden.isEmpty():
        return comps
    members = hidden.select("bucket", "id").union(hidden.select("bucket", "leader")).distinct()
    own = members.join(comps.hint("merge"), "id", "left").select(F.col("bucket").alias("g"), "id", F.coalesce("comp", "id").alias("comp"), F.lit(0).alias("bytes"))
    own = scratch.write(own, "open-members")
    # Two members are a pair that was verified; more may hide pairs that were not.
    todo = scratch.write(_blocks(own, 2, SKETCHES), "open")
    if todo.isEmpty():
        return comps
    edges = _in_blocks(todo.join(sketches(todo.select("id")).withColumnRenamed("sketch", "s"), "id"), _NearPairs(most_differ), True)
    families = connected_components(edges, scratch, "families").select("id", F.col("comp").alias("g"))
    own = scratch.write(families.join(comps.hint("merge"), "id", "left").select("g", "id", F.coalesce("comp", "id").alias("comp")), "family-members")
    if own.isEmpty():
        return comps
    texts = scratch.write(payload(own.select("id")), "family-texts")
    sized = own.join(texts.groupBy("id").agg(F.sum(F.octet_length("s")).alias("bytes")), "id")
    more = scratch.write(_in_blocks(_blocks(sized, 1, BLOCK).join(texts, "id"), _TrueLinks(percent, as_sets), False), "links-2")
    return scratch.write(connected_components(links.unionByName(more), scratch, "comps-2"), "comps")


# -- pairs of leaders and members


def _led_links(pairs: DataFrame, texts: DataFrame, as_sets: Callable[[list], list[np.ndarray]], percent: int) -> DataFrame:
    """The true links among pairs(a: leader, b); a leader's members are dealt to chunks, and it goes to each."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    members = pairs.join(n, "a").select(F.col("a").alias("g"), F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    heads = n.select(F.col("a").alias("g"), F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heads = None, []  # an id may have several texts
        for rows in batches:
            a, b = [], []
            for part in _slices(rows):
                for g, chunk, i, s in zip(part["g"].tolist(), part["chunk"].tolist(), part["id"].tolist(), as_sets(list(part["s"]))):
                    if (g, chunk) != now:
                        now, heads = (g, chunk), []
                    if i == g:
                        heads.append(s)
                    elif any(_linked(s, t, percent) for t in heads):
                        a.append(g)
                        b.append(i)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    placed = members.union(heads).join(texts, "id").select("g", "chunk", "id", "s").repartition("g", "chunk")
    return placed.sortWithinPartitions("g", "chunk", F.col("id") != F.col("g")).mapInPandas(run, "a long, b long")


def _slices(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of the rows whose texts have about ``SLICE`` bytes."""
    size = np.cumsum([len(s) for s in rows["s"]])
    ends = np.r_[np.flatnonzero(np.diff(size // SLICE)) + 1, len(rows)] if len(rows) else ()
    lo = 0
    for hi in ends:
        yield rows.iloc[lo:hi]
        lo = hi


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    few, many = sorted((len(s), len(t)))
    return 100 * few >= percent * many and 100 * (c := _common(s, t)) >= percent * (few + many - c)


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(s) or not len(t):
        return 0
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


# -- groups with several components


def _blocks(own: DataFrame, least: int, most: int) -> DataFrame:
    """(g, id, comp, visits, chunk) of groups of more than ``least`` members that have several components.

    A group's members are dealt to chunks of about ``most`` members and ``BYTES``; those outside its leading component, which has the most members, also visit every chunk.
    """
    parts = own.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    state = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("lead"))
    chunks = F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / BYTES, F.lit(1))).cast("int")
    open_ = state.where((F.col("n") > least) & (F.col("comps") > 1)).select("g", chunks.alias("chunks"), "lead")
    tagged = own.join(open_, "g")
    home = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    visits = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return tagged.select("g", "id", "comp", F.lit(False).alias("visits"), home.alias("chunk")).union(
        tagged.where("comp <> lead").select("g", "id", "comp", F.lit(True), visits)
    )


def _in_blocks(blocks: DataFrame, related, each: bool) -> DataFrame:
    """A spanning forest (a, b), in each block, of the ``related`` pairs of visitors and residents of different components.

    ``each``: the forest spans the members that have such a pair; else the components.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block = None, None
        for rows in batches:
            a, b = [], []
            g, chunk = rows["g"].to_numpy(), rows["chunk"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (chunk[1:] != chunk[:-1])]) if len(rows) else []
            ends = [*starts[1:], len(rows)]
            # Small groups that lie whole in the batch are settled together; the first and the last may go on elsewhere.
            whole = [(lo, hi) for lo, hi in zip(starts[1:-1], ends[1:-1]) if hi - lo <= SMALL]
            yield from forest(_small(rows, whole, related))
            for lo, hi in sorted({*zip(starts, ends)}.difference(whole)):
                if (g[lo], chunk[lo]) != now:
                    now, block = (g[lo], chunk[lo]), _Block(related, each)
                block.add(rows.iloc[lo:hi], a, b)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    columns = blocks.select("g", "chunk", "visits", "id", "comp", "s").repartition("g", "chunk")
    return columns.sortWithinPartitions("g", "chunk", "visits").mapInPandas(run, "a long, b long")


def _small(rows: pd.DataFrame, groups: list[tuple[int, int]], related) -> Iterator[pd.DataFrame]:
    """The related pairs (a, b) of the groups in the rows between each two places."""
    visits, ids, comp, texts = (rows[c].to_numpy() for c in ("visits", "id", "comp", "s"))
    come = np.r_[0, np.cumsum(visits)]
    lo, hi = np.array(groups, np.int64).reshape(-1, 2).T
    guests = come[hi] - come[lo]
    pairs = (hi - lo - guests) * guests
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS)) + 1):
        n = pairs[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(guests[part], n)
        x, y = np.repeat(lo[part], n) + k // np.maximum(width, 1), np.repeat(hi[part], n) - 1 - k % np.maximum(width, 1)
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        ok = related.pairs(texts, ids, comp, np.repeat(part, n)[apart], x, y)
        yield pd.DataFrame({"a": ids[x[ok]], "b": ids[y[ok]]})


class _Block:
    """The residents of a block, which come first, and the forest that visitors' pairs with them make."""

    def __init__(self, related, each: bool):
        self.related, self.each, self.rows, self.residents = related, each, [], None
        self.parent: dict[int, int] = {}

    def _root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def add(self, rows: pd.DataFrame, a: list[int], b: list[int]) -> None:
        visits = rows["visits"].to_numpy()
        if not visits.all():
            self.rows.append(rows[~visits])
        if not visits.any():
            return
        if self.residents is None:
            stay = pd.concat(self.rows)
            self.rows, self.residents = [], self.related.residents(list(stay["s"]))
            self.ids, self.comp = stay["id"].to_numpy(), stay["comp"].to_numpy()
            self.label = (self.ids if self.each else self.comp).copy()
        for part in _slices(rows[visits]):
            for at in range(0, len(part), 64):
                some = part.iloc[at : at + 64]
                self._join(some, self.related(list(some["s"]), self.residents), a, b)

    def _join(self, come: pd.DataFrame, lines: np.ndarray, a: list[int], b: list[int]) -> None:
        for i, comp, line in zip(come["id"].tolist(), come["comp"].tolist(), lines):
            root = self._root(i if self.each else comp)
            other = np.flatnonzero(line & (self.label != root) & (self.comp != comp))
            if not len(other):
                continue
            joined, first = np.unique(self.label[other], return_index=True)
            a += [i] * len(joined)
            b += self.ids[other[first]].tolist()
            for x in joined.tolist():
                self.parent[x] = root
            self.label[np.isin(self.label, joined)] = root


class _NearPairs:
    """Pairs of sketches of which at most so many bits differ."""

    def __init__(self, most_differ: int):
        self.most_differ = most_differ

    def residents(self, sketches: list[bytes]) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1).T)

    def __call__(self, come: list[bytes], stay: np.ndarray) -> np.ndarray:
        left = self.residents(come)
        differ = np.zeros((left.shape[1], stay.shape[1]), np.uint16)
        for x, y in zip(left, stay):
            differ += np.bitwise_count(x[:, None] ^ y)
        return differ <= self.most_differ

    def pairs(self, sketches: np.ndarray, ids: np.ndarray, comp: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        words = self.residents(list(sketches))
        differ = np.zeros(len(x), np.uint16)
        for w in words:
            differ += np.bitwise_count(w[x] ^ w[y])
        return differ <= self.most_differ


class _TrueLinks:
    """Exact intersections of full sets: each visitor's elements are looked up among the residents' sorted elements."""

    def __init__(self, percent: int, as_sets: Callable[[list], list[np.ndarray]]):
        self.percent, self.as_sets = percent, as_sets

    def residents(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = self.as_sets(texts)
        size = np.array([len(s) for s in sets])
        element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(element, kind="stable")
        return element[order], owner[order], size

    def __call__(self, come: list, stay: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        element, owner, size = stay
        out = np.zeros((len(come), len(size)), bool)
        for k, s in enumerate(self.as_sets(come)):
            lo, hi = np.searchsorted(element, s, "left"), np.searchsorted(element, s, "right")
            count = hi - lo
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            common = np.bincount(owner[at], minlength=len(size))
            out[k] = 100 * common >= self.percent * (len(s) + size - common)
        return out

    def pairs(self, texts: np.ndarray, ids: np.ndarray, comp: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of components that others of the group have joined are left out."""
        out, need = np.zeros(len(x), bool), np.unique(np.r_[x, y])
        sets: dict[int, np.ndarray] = {}
        for part in _slices(pd.DataFrame({"at": need, "s": texts[need]})):
            sets |= zip(part["at"].tolist(), self.as_sets(list(part["s"])))
        up: dict[tuple[int, int], int] = {}
        seen = set()

        def root(now: int, c: int) -> int:
            while (above := up.get((now, c), c)) != c:
                c = above
            return c

        a, b = comp[x].tolist(), comp[y].tolist()
        for k, (now, i, j) in enumerate(zip(g.tolist(), x.tolist(), y.tolist())):
            one, other = root(now, a[k]), root(now, b[k])
            pair = now, *sorted((ids[i], ids[j]))
            if one == other or pair in seen:
                continue
            seen.add(pair)
            if _linked(sets[i], sets[j], self.percent):
                out[k] = True
                up[now, one] = other
        return out
