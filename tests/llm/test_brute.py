"""Operators against brute force on small inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import prose
from tessella.llm import decontam, linededup, mixing, neardup, ogg, pst, quality, sharding, toxicity
from tessella.llm.labelled import HOLD_OUT
from tessella.scratch import Scratch


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [prose(i, 60) for i in range(30)]
    for g in range(6):
        base = prose(1000 + g, 120)
        texts += [edited(base, 50 * g + k, k % 7) for k in range(12)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, k, percent):
    texts, docs = corpus
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = components(len(sets), links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, Scratch(spark, "t"), neardup.NearDupParams(shingle=k, percent=percent)).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("n", [5, 9])
def test_line_dedup(spark, corpus, n):
    texts, docs = corpus
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(linededup.line_keys(t)) if x]
    sets = [{x[j : j + n] for j in range(max(1, len(x) - n + 1))} for *_, x in lines]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    first = {}
    for c, (i, k, _) in zip(components(len(sets), links), lines):
        first[c] = min(first.get(c, (i, k)), (i, k))
    got = {(r.doc_id, k) for r in linededup.line_plan(docs, Scratch(spark, "t"), linededup.LineParams(shingle=n)).collect() for k in r.kept}
    assert got == set(first.values())


def test_line_dedup_query(spark, tmp_path):
    """The query links lines that differ in one character, accented or not, or in one short word, however short the lines are."""
    from tessella.llm.queries import QUERIES

    rng = random.Random(6)
    lines = []
    for g in range(40):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ漢字 ") for _ in range(56 + g))
        at = rng.randrange(10, 40)
        lines += [base, base[:at] + "é" + base[at + 1 :], "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(1, 60)))]
    lines = [x.strip() or "x" for x in lines]
    sets = [{x[j : j + 5] for j in range(max(1, len(x) - 4))} for x in lines]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) >= 40
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in QUERIES["op9_minhash_line_dedup"](spark, str(tmp_path)).collect() if r.n_kept}
    assert got == set(components(len(sets), links))


def test_edit_distance():
    rng = random.Random(3)

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (12, 30))
        want, got = slow(p, t), decontam.edit_distance_within(p, t, 5)
        assert (got[0] if got else None) == (want if want <= 5 else None)


def test_leaks_with_edits(spark):
    rng = random.Random(5)
    items = [(i, prose(500 + i, 60)[:300]) for i in range(5)]
    docs, want = [], set()
    for i in range(60):
        text = prose(i, 80)
        if i % 3 == 0:
            part = list(items[i % 5][1][40:240])
            for _ in range(i % 4):
                part[rng.randrange(len(part))] = "#"
            text = text[:100] + " " + "".join(part) + " " + text[100:]
            want.add((i, i % 5))
        docs.append((i, text))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_short_runs_of_long_items_leak():
    """A verbatim run of a window's length or more is found wherever in the item it begins, also by the second text of a band."""
    item = prose(77, 80)[:300]
    m = len(decontam.normal(item))
    index = decontam.LeakIndex([(1, item)], decontam.LeakParams())
    runs = [(o, n) for n in (80, 81, 97, 118) for o in range(0, m - n + 1)]
    part = decontam.normal(item).decode()
    texts = [f"{prose(900 + k % 7, 12)}|{part[o : o + n]}|{prose(800 + k % 5, 12)}" for k, (o, n) in enumerate(runs)]
    assert {row for row, *_ in index.find(texts)} == set(range(len(texts)))
    short = [f"x|{part[o : o + 70]}|y" for o in range(0, m - 70, 9)]
    assert index.find(short) == []
    assert {row for row, *_ in index.find([part[:90], part[:90], part[100:190]])} == {0, 1, 2}


def test_edited_runs_leak():
    """A window's length with as many edits as allowed is found at every offset."""
    item = decontam.normal(prose(78, 80)[:260]).decode()
    index, rng = decontam.LeakIndex([(1, item)], decontam.LeakParams()), random.Random(3)
    texts = []
    for o in range(len(item) - 80 + 1):
        part = list(item[o : o + 80])
        for at in rng.sample(range(80), 4):
            part[at] = "#"
        texts.append("before it | " + "".join(part) + " | after it")
    assert {row for row, *_ in index.find(texts)} == set(range(len(texts)))


def test_repetitive_texts_and_short_items():
    """Equal q-grams neither multiply nor hide a leak; items shorter than a q-gram match exactly, as words."""
    items = [(1, "a" * 2000), (2, "ab cd " * 100), (3, "Tiny  one"), (4, ""), (5, None)]
    index = decontam.LeakIndex(items, decontam.LeakParams(pairs=50_000))
    texts = ["a" * 200_000, "ab cd " * 5000, "a tiny one is here", "tiny ones", "atiny one", "", None, "b" * 5000]
    assert [(r, i) for r, i, *_ in index.find(texts)] == [(0, 1), (1, 2), (2, 3)]
    text, item = "xy " * 4000 + prose(5, 60) + " xy" * 4000, decontam.normal(prose(5, 60)).decode()
    whole = decontam.LeakIndex([(7, item), (8, "xy " * 90)], decontam.LeakParams(pairs=10_000)).find([text])
    assert [(i, e) for _, i, _, _, e in whole] == [(7, 0), (8, 0)]


def test_ogg_pages():
    def crc(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        return c

    rng = random.Random(1)
    for n in (1, 255, 256, 4096, 70_000):
        data = rng.randbytes(n)
        assert ogg.page_crc(data) == crc(data)
        payload = ogg.pad(data)
        media = ogg.store(payload)
        back, streams = ogg.load(media)
        assert back == payload and sum(s.granules[-1] for s in streams.values()) == len(payload)
        broken = bytearray(media)
        broken[-1] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.load(bytes(broken))


def test_hypergeometric():
    rng = random.Random(2)
    draws = Counter(sharding.hypergeometric(rng, 6, 10, 5) for _ in range(20_000))
    for k in range(6):
        p = math.comb(6, k) * math.comb(10, 5 - k) / math.comb(16, 5)
        assert abs(draws[k] / 20_000 - p) < 0.02
    m = sharding.communication_matrix([50, 0, 7, 43], [25, 25, 25, 25], 9)
    assert [sum(r) for r in m] == [50, 0, 7, 43] and [sum(c) for c in zip(*m)] == [25] * 4


def test_fit_lengths():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 400, 40))
        counts = rng.integers(1, 50, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixing.fit_lengths(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all() and 0 <= budget - int((take * lengths).sum()) <= 1


def test_water_filling(spark):
    sizes = {"0a": 100, "0b": 1000, "0c": 400, "1": 50}
    got = {r.skey: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size long"), [5, 2, 1], 1.5, 2.0).collect()}
    weights, cap = dict(zip(sorted(sizes), [5, 2, 1, 5])), {k: 2 * v for k, v in sizes.items()}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if weights[k] * level > cap[k]}
        if not over:
            want |= {k: weights[k] * level for k in open_}
            break
        want |= {k: cap[k] for k in over}
        left -= sum(cap[k] for k in over)
        open_ -= over
    assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


def test_forward_backward():
    rng = np.random.default_rng(1)
    emit = np.stack([np.zeros((3, 5)), rng.normal(size=(3, 5))], axis=2)
    trans = rng.normal(size=(2, 2))
    marginal, pairs, norm = toxicity.forward_backward(emit, trans)
    for c in range(3):
        total, on = 0.0, np.zeros(5)
        for path in range(32):
            tags = [path >> t & 1 for t in range(5)]
            w = math.exp(sum(emit[c, t, y] for t, y in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            on += w * np.array(tags)
        assert np.allclose(on / total, marginal[c, :, 1]) and abs(math.log(total) - norm[c]) < 1e-9
    assert abs(pairs.sum() - 12) < 1e-9


def test_chains_are_whole_documents():
    """Segments tied together give the marginals of each document as one chain."""
    rng = np.random.default_rng(2)
    lengths = [1, 63, 64, 65, 200, 3, 1000]
    e, trans = rng.normal(size=sum(lengths)) * 3, rng.normal(size=(2, 2)) * 2
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got = toxicity.chain_marginals(e, first, trans)
    for lo, n in zip(np.cumsum([0, *lengths]), lengths):
        own = e[lo : lo + n]
        want = toxicity.forward_backward(np.stack([np.zeros(n), own], axis=1)[None], trans)[0][0, :, 1]
        assert np.allclose(got[lo : lo + n], want, atol=1e-9)


@pytest.mark.parametrize("toxic", [lambda i: 1, lambda i: 0, lambda i: i % 2])
def test_labels_that_teach_nothing_give_no_spans(spark, toxic):
    docs = spark.createDataFrame([(i, f"word{i} is here and there") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic(i)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels, toxicity.CrfParams(steps=5)).collect()
    assert len({r.score for r in got}) == 1 and not any(r.spans for r in got)


def test_filters_see_every_offset():
    """A text's score does not depend on the offset of a pattern, and a pattern learned at some offsets is known at others."""
    net = quality.ConvNet(quality.ConvParams())
    scores = net.score([(b" " * k + b"pattern!").ljust(100) for k in range(10, 30)])
    assert np.ptp(scores) < 1e-6

    def sample(offsets, seed):
        rng, out = random.Random(seed), []
        for k in range(120):
            text = bytearray(rng.choice(b"abcdefgh ") for _ in range(400))
            at = 4 * rng.randrange(90) + rng.choice(offsets)
            text[at : at + 8] = b"zqxzqxzq" if k % 2 else b"qzxqzxqz"
            out.append((bytes(text), k % 2))
        return out

    held = sample([1, 2, 3], 2)
    fitted = quality.ConvNet(quality.ConvParams(least_steps=150)).fit(sample([0], 1))
    assert np.mean((fitted.score([t for t, _ in held]) >= 0.5) == [y == 1 for _, y in held]) >= 0.9


def test_unigram_base(spark, corpus):
    texts, docs = corpus
    counts = Counter()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in enumerate(texts):
        if not held(i):
            counts.update([*t.encode().lower().split(), b"\n"])
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    for p in (pst.PstParams(), pst.PstParams(frequent=50)):  # also with most counts looked up by the join
        rows = pst.suffix_tree_scores(docs, Scratch(spark, "t"), p).collect()
        for r in rows:
            tokens = [*texts[r.doc_id].encode().lower().split(), b"\n"]
            assert abs(r.base_score - sum(math.log10(counts[w] + 1) - norm for w in tokens)) < 1e-6 * len(tokens)
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), total, held(r.doc_id))
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    bad = ["vile", "scum", "rotten"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(i, 60).split(" "), int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.CrfParams(steps=40)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % HOLD_OUT[0] == HOLD_OUT[1]]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    text = dict(rows)
    found = [text[r.doc_id][s.start : s.end] for r in got for s in r.spans]
    assert found and sum(w in bad for w in found) > 0.95 * len(found)


@pytest.mark.parametrize("frequent", [1 << 21, 30])
def test_suffix_tree_states(spark, frequent):
    """Scores by every context of up to four tokens, whichever words are hot; most contexts here are of frequent words alone."""
    rng = random.Random(8)
    phrases = ["a b c d a", "b a c a b d", "a a b", "c d a b"]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.8 else f"r{rng.randrange(9)}" for _ in range(30)) for _ in range(30)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = [[*t.encode().split(), b"\n"] for t in texts]
    start, counts = b"<", Counter(w for d, h in zip(docs, held) if not h for w in d)
    total = sum(counts.values())
    norm = total + len(counts) + 1
    rare = [w for w in counts if counts[w] * frequent < total]
    assert bool(rare) == (frequent == 30)
    follow = {}
    for d, h in zip(docs, held):
        for i, w in enumerate(d):
            before = [start, *d[:i]]
            for k in range(1, min(4, len(before)) + 1):
                follow.setdefault(tuple(before[-k:]), Counter())[w] += not h

    def p(context, w):
        if not context:
            if counts[w] * frequent >= total:
                return (counts[w] + 1) / norm
            return (sum(counts[x] for x in rare) + len(rare) + 1) / norm / (len(rare) + 1)
        c, lower = follow[context], p(context[1:], w)
        if not retained(context):
            return lower
        n, t = sum(c.values()), sum(v > 0 for v in c.values())
        return (c[w] + t * lower) / (n + t)

    known = {}

    def retained(context):
        if context not in known:
            c = follow[context]
            n, t = sum(c.values()), sum(v > 0 for v in c.values())
            gain = sum(v * math.log2((v - 1 + t * p(context[1:], w)) / (n - 1 + t) / p(context[1:], w)) for w, v in c.items() if v)
            known[context] = n >= 2 and gain >= 4
        return known[context]

    want = [sum(math.log10(p(tuple([start, *d[:i]][-4:]), w)) for i, w in enumerate(d)) for d in docs]
    states = [(), *(c for c in follow if retained(c))]
    assert any(len(c) == 4 for c in states)
    assert all(abs(sum(p(c, w) for w in [*counts, b"never seen"]) - 1) < 1e-9 for c in states)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, 30, 1 << 19):
        got = {r.doc_id: r.score for r in pst.suffix_tree_scores(table, Scratch(spark, "t"), pst.PstParams(hot=hot, frequent=frequent, group_tokens=500)).collect()}
        assert all(abs(got[i] - w) < 1e-5 * len(docs[i]) for i, w in enumerate(want))


def test_repeated_phrase_scores_above_the_root(spark):
    """Contexts of frequent words alone are states too."""
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 10) for i in range(100)], "doc_id long, text string").repartition(3)
    rows = pst.suffix_tree_scores(docs, Scratch(spark, "t")).collect()
    assert len(rows) == 100 and all(r.score > 0.3 * r.base_score for r in rows)
    assert len({round(r.score, 6) for r in rows}) == 1


def test_far_blocks_do_not_grow_with_groups(spark, monkeypatch):
    """Positions behind hot words go from partition to partition in one block; before, in one for each group of documents."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") if rng.random() < 0.7 else f"r{rng.randrange(99)}" for _ in range(60))) for i in range(120)], "doc_id long, text string").repartition(2)
    made, old = [], pst._start_far

    def start_far(blocks, states, vocabulary, parts, p):
        out = old(blocks, states, vocabulary, parts, p)
        made.append((blocks.count(), out.count(), parts, out.agg({"n": "sum"}).first()[0] == blocks.agg({"n": "sum"}).first()[0]))
        return out

    monkeypatch.setattr(pst, "_start_far", start_far)
    few = {r.doc_id: r.score for r in pst.suffix_tree_scores(docs, Scratch(spark, "t"), pst.PstParams(hot=60, group_tokens=60)).collect()}
    (blocks, out, parts, whole), *_ = made
    assert blocks > 3 * parts and out <= parts * parts < blocks * parts and whole
    many = {r.doc_id: r.score for r in pst.suffix_tree_scores(docs, Scratch(spark, "t"), pst.PstParams()).collect()}
    assert all(abs(few[i] - many[i]) < 1e-3 for i in many)


def test_words_that_do_not_repeat_end_contexts():
    """They are in no retained context: positions behind them aren't sent, and none carries words beyond them; blocks give back what they got."""
    tokens = [[b"a", b"b", b"once", b"a", b"b", b"a"]]
    texts = [b" ".join(t) for t in tokens]
    found, places, first = pst._tokens(texts)
    h = {w: pst._hash(w) for w in (b"a", b"b", b"\n")}
    for complete in (True, False):
        v = pst.Vocabulary(np.array(list(h.values()), np.uint64), np.array([3, 2, 2]), 3, 8, 4, 1 << 21, 1 << 20, complete)
        x = pst._Group(v, pd.DataFrame({"held_out": [False]}), found, places, first, 4)
        assert x.words[0].tolist()[:3] == [pst.START, 2, 3] and (x.words[0][3] == pst.NONE) == complete
        assert [(w[5] != pst.NONE).item() for w in x.words] == [True, True, not complete, not complete]
        columns = x.columns(np.arange(7), 5)
        (part, n, data), = pst._blocks(v, np.zeros(7, np.int64), columns, 4)
        assert (part, n) == (0, 7) and all((a == b).all() for a, b in zip(pst._unpack(v, data, n, 5, False), columns))
