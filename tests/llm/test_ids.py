"""Ids that a double can't hold, beside null ids, through every operator and stage; and columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import banding, decontam, licenses, linededup, mixing, neardup, ogg, pst, quality, sharding, toxicity
from tessella.scratch import Scratch
from tests.llm.conftest import prose
from tests.llm.test_edges import SMALL_CRF, SMALL_NET, bench

BIG = 2**60 + 1
IDS = [BIG, BIG + 2, None, BIG + 4, 7]


@pytest.fixture(scope="module")
def few(spark):
    rows = [(i, prose(300 + k, 60), "en", "s", 1, 5, 6, 7, 8) for k, i in enumerate(IDS)]
    names = "doc_id long, text string, lang string, source string, n_chars long, _first int, _kept_id int, _own_k int, _shard_k int"
    return spark.createDataFrame(rows, names).coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_operators_keep_ids(spark, few, labels):
    want, scratch = sorted(IDS, key=str), lambda: Scratch(spark, "ids")
    assert ids(quality.quality_scores(few, labels, SMALL_NET)) == want
    assert ids(toxicity.toxicity_scores(few, labels, SMALL_CRF)) == want
    assert ids(ogg.media_columns(few)) == want
    assert ids(mixing.mix_sources(few, scratch())) == want
    assert ids(neardup.near_duplicates(few, scratch())) == want
    assert set(ids(decontam.find_leaks(few, bench(spark)))) <= set(want)
    assert ids(sharding.shard_rows(few, scratch())) == want
    assert ids(linededup.line_plan(few, scratch())) == want
    assert ids(pst.suffix_tree_scores(few, scratch())) == want
    assert ids(licenses.scan_licenses(few)) == want


def test_stages_keep_rows_and_columns(spark, few, labels):
    rows = sorted(map(tuple, few.collect()), key=str)
    same = lambda df: sorted((tuple(r)[: len(few.columns)] for r in df.collect()), key=str)
    assert same(neardup.keep_one_each(few, Scratch(spark, "k"), neardup.NearDupParams())) == rows
    assert same(sharding.with_shards(few, Scratch(spark, "s"))) == rows
    assert same(decontam.without_leaks(few, bench(spark))) == rows
    assert same(linededup.dedup_lines(few, Scratch(spark, "l"))) == rows
    assert set(same(toxicity.without_toxic(few, labels, SMALL_CRF))) <= set(rows)
    assert set(same(mixing.repeat_documents(few, Scratch(spark, "m")))) <= set(rows)


def test_the_first_line_of_large_ids_stays(spark):
    line = prose(3, 30).replace("\n", " ")
    df = spark.createDataFrame([(BIG + 2, line), (None, "other words that stand alone here"), (BIG, line), (BIG + 1, line)], "doc_id long, text string").coalesce(1)
    kept = {r.doc_id: list(r.kept) for r in linededup.line_plan(df, Scratch(spark, "big")).collect()}
    assert kept == {BIG: [0], BIG + 1: [], BIG + 2: [], None: [0]}


def test_spans_are_characters_of_long_texts():
    import numpy as np

    text = ("é bad, ö " * 30_000).encode()
    spans = toxicity._spans(text, np.tile([0.0, 1.0, 0.0], 30_000))
    assert spans[:2] == [{"start": 2, "end": 5}, {"start": 11, "end": 14}] and spans[-1] == {"start": 9 * 29_999 + 2, "end": 9 * 29_999 + 5}


def test_the_largest_component_leads(spark):
    rows = [(1, k, 1000 if k < 40 else k) for k in range(46)] + [(2, 100, 100), (2, 101, 101), (2, 102, 101)] + [(3, 200, 5), (3, 201, 5)]
    own = spark.createDataFrame(rows, "g long, id long, comp long").withColumn("bytes", F.lit(0))
    got = banding._blocks(own, 1, 8).collect()
    assert {r.id for r in got if r.visits and r.g == 1} == set(range(40, 46)) and {r.id for r in got if r.visits and r.g == 2} == {100}
    assert all(r.g != 3 for r in got) and sum(r.visits for r in got if r.g == 1) == 6 * 6


@pytest.mark.parametrize("sizes", [(1024, 1 << 22, 1 << 14), (4, 900, 5)])
def test_groups_of_many_blocks_lose_no_link(spark, monkeypatch, sizes):
    """Chains of near copies whose ends aren't alike, in groups larger than a block, against all pairs."""
    for name, value in zip(("BLOCK", "BYTES", "SKETCHES"), sizes):
        monkeypatch.setattr(banding, name, value)
    rows, p = [], neardup.NearDupParams()
    for g in range(3):
        words = prose(g, 80).split()
        for k in range(25):
            words = list(words)
            words[(k * 7) % 80] = f"w{g}x{k}"
            rows.append((g * 100 + k, " ".join(words)))
    sets = {i: frozenset(tuple(t.lower().split()[j : j + 5]) for j in range(76)) for i, t in rows}
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= p.percent * len(sets[i] | sets[j]):
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "c"), p).collect()}
    assert got == comp and len(set(comp.values())) < 60


def test_wanted_ids_reach_the_driver_as_bits(spark):
    """All of the ids pass the test, and the driver gets bits of pages; before, it got every slot as a row."""
    ids = spark.range(0, 3 << 20, 3).withColumn("id", F.xxhash64("id"))
    sizes, old = [], type(ids).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(ids), "toPandas", lambda self: pytest.fail("rows of slots on the driver"))
        m.setattr(type(ids), "collect", lambda self: sizes.append(out := old(self)) or out)
        test = banding.wanted_ids(ids)
    x = np.array([r.id for r in ids.collect()])
    assert test(x).all() and test(x + 1).mean() < 0.2
    assert sum(len(r.bits) for rows in sizes for r in rows) <= banding.SLOTS // 8


def test_leaders_of_shared_buckets():
    """Buckets alone, shared, and alike in their leading bits only, against a dictionary."""
    rng = np.random.default_rng(3)
    bucket = np.r_[rng.integers(-(1 << 63), 1 << 63, 500), np.repeat(rng.integers(-(1 << 63), 1 << 63, 50), 4), np.arange(40) + (7 << 40)].astype(np.int64)
    ids = np.r_[np.arange(500), np.tile([1, 2, 3, 3], 50), np.arange(40)].astype(np.int64)
    single, led = banding.lead(bucket, ids)
    members = {}
    for b, i in zip(bucket.tolist(), ids.tolist()):
        members.setdefault(b, []).append(i)
    assert {tuple(x) for x in single.T.tolist()} == {(b, m[0]) for b, m in members.items() if len(m) == 1}
    assert {tuple(x) for x in led[:2].T.tolist()} == {(b, i) for b, m in members.items() if len(m) > 1 for i in m}
    assert all(leader in members[b] for b, _, leader in led.T.tolist())


@pytest.mark.parametrize("small", [64, 0])
def test_small_groups_are_settled_together(small, monkeypatch):
    """Near pairs of many small groups, whole or split between batches, join the same members as block by block."""
    import pandas as pd

    monkeypatch.setattr(banding, "SMALL", small)
    rng, rows = np.random.default_rng(4), []
    for g in range(60):
        base = rng.integers(0, 256, 16, dtype=np.uint8)
        members = [(g * 10 + k, k // 2, bytes(base ^ (rng.integers(0, 2) * np.uint8(255)))) for k in range(int(rng.integers(2, 7)))]
        rows += [(g, 0, False, *m) for m in members] + [(g, 0, True, *m) for m in members if m[1]]
    frame = pd.DataFrame(rows, columns=["g", "chunk", "visits", "id", "comp", "s"])
    near = banding._NearPairs(4)
    seen = []

    class Blocks:
        def select(self, *names):
            return self

        repartition = sortWithinPartitions = select

        def mapInPandas(self, run, schema):
            return pd.concat(list(run(iter([frame[:37], frame[37:150], frame[150:]]))))

    seen = banding._in_blocks(Blocks(), near, True)
    of = {i: i for i in frame["id"]}
    for a, b in zip(seen["a"], seen["b"]):
        of = {k: of[b] if v == of[a] else v for k, v in of.items()}
    for g, own in frame[~frame["visits"]].groupby("g"):
        for x in own.itertuples():
            assert all(of[x.id] == of[y.id] for y in own.itertuples() if y.comp != x.comp and x.s == y.s)
    assert all(a // 10 == b // 10 for a, b in zip(seen["a"], seen["b"])) and len(seen) > 30
