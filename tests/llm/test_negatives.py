"""The block product against plain loops, over many small blocks, and on awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import negatives
from tessella.llm.negatives import NegativeParams
from tessella.scratch import Scratch

SMALL = NegativeParams(positives=3, negatives=4, anchor_block=3, row_block=4, chunk=2, groups=2)
SCHEMA = "vec_id long, embedding array<float>, label int, grp int, is_anchor boolean, i int, j int, chunk int, block int, windows int, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, 1, 1, 1, 1, 1, "x", 7) for r in rows], SCHEMA).repartition(5)


def brute(rows, is_anchor, p):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(p.scale * float(np.float32(x))) for x in v]
        kept[i, label] = min(kept.get((i, label), q), q)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    dot = lambda a, b: wrap(sum(x * y for x, y in zip(a, b)))
    out = set()
    for (a, la), q in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-dot(q, w), b, lb) for (b, lb), w in kept.items() if b != a)
        for ps, pos, _ in [s for s in scored if s[2] == la][: p.positives]:
            fits = [s for s in scored if s[2] != la and p.low * -ps <= 100 * -s[0] <= p.high * -ps][: p.negatives]
            out |= {(a, la, pos, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(fits)}
    return out


def got(spark, rows, p=SMALL, every=5):
    df = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, Scratch(spark, "neg"), p)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_equals_loops(spark):
    rng = random.Random(3)
    # Small integers make many ties; a third of the rows are one label, a third one vector.
    rows = [(i, [rng.randint(-2, 6) / 64 for _ in range(5)] if i % 3 else [0.25, 0.5, 0.0, 0.125, 0.0], 0 if i % 3 == 1 else rng.randint(0, 5)) for i in range(120)]
    want = brute(rows, lambda i: i % 5 == 0, SMALL)
    assert len(want) > 100 and got(spark, rows) == want
    wide = NegativeParams(positives=3, negatives=4)
    assert got(spark, rows, wide) == brute(rows, lambda i: i % 5 == 0, wide)


def test_awkward_rows(spark):
    big = 2**60 + 5 - (2**60) % 5
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [0.5, 1.0], 1), (1, [0.25, 0.5], 2), (2, [0.5], 3), (3, [], 2), (4, None, 1), (5, [None, 1.0], 1),
        (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 2), (8, [1.0, 1.0], None), (None, [9.0, 9.0], 1), (None, [0.5, 0.5], 2), (big, [0.5, 1.0, 0.25], 1),
        (big + 1, [0.25, 0.25], 2), (10, [0.25, 0.5], 2), (11, [0.25, 0.5], 2), (-5, [1.0, 0.5], 2), (-4, [0.5, 0.5], -3),
    ]
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0, SMALL) != set()
    assert any(r[0] == big for r in got(spark, rows))
    assert got(spark, []) == set() and got(spark, rows[4:8]) == set()
    assert got(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == set()  # no other label


def test_large_values_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randint(10, 24) for _ in range(4)], i % 2) for i in range(30)]
    assert got(spark, rows) == brute(rows, lambda i: i % 5 == 0, SMALL)
    a = np.array([[2**40, 3]])
    assert negatives.multiply(a, a)[0, 0] == (2**80 + 9 + 2**63) % 2**64 - 2**63


def test_many_blocks_are_used(spark):
    rows = frame(spark, [(i, [1.0, 2.0, 3.0], i % 2) for i in range(50)])
    packed = negatives._packed(negatives.quantised(rows).withColumns({"grp": F.lit(0), "block": F.pmod("vec_id", F.lit(7)).cast("int")}), 3, SMALL)
    assert packed.count() == 14 and {r["kind"] for r in packed.collect()} == {"<i2"}
    with pytest.raises(Exception, match="."):
        negatives.quantised(spark.range(3)).count()
