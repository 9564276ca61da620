"""Recall of the banded operators against all pairs of a given table."""

import os

import numpy as np
import pytest

from tessella.llm import linededup, neardup
from tessella.scratch import Scratch
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def links(sets, percent):
    """All pairs (i, j), i < j, of sorted integer sets with 100 * intersection >= percent * union, by counts over an inverted index."""
    size = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    out = []
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(element, s, "left"), np.searchsorted(element, s, "right")
        at = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((100 * common >= percent * (size[i] + size - common)) & (common > 0))
        out += [(i, int(j)) for j in near if j > i]
    return out


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, shingle, percent):
    """The registered query's and the pipeline's parameters, on all documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, Scratch(spark, "recall"), neardup.NearDupParams(shingle=shingle, percent=percent)).collect()}
    rows = [(r.doc_id, r.text.lower().split()) for r in docs.collect()]
    number, sets = {}, []
    for _, w in rows:
        k = min(shingle, len(w))
        sets.append(np.array(sorted({number.setdefault(tuple(w[i : i + k]), len(number)) for i in range(len(w) - k + 1)}), np.int64))
    pairs = links(sets, percent)
    found = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)
    print(f"\n{shingle} words at {percent}: {found} of {len(pairs)} links")
    assert len(pairs) > 50 and found == len(pairs)


def test_lines(spark):
    """Lines of the documents, each with a copy that has one word changed."""
    p = linededup.LineParams()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()  # a fixture of the brute-force test, not of a query
    lines = sorted({x for r in docs for x in linededup.line_keys(r.text) if x and len(x) < 400})
    changed = [x.replace(x.split()[len(x.split()) // 2], prose(k, 1).encode(), 1) for k, x in enumerate(lines)]
    every = sorted(set(lines) | set(changed) - {b""})
    text = spark.createDataFrame([(k, x.decode("utf-8", "ignore")) for k, x in enumerate(every)], "doc_id long, text string")
    every = sorted({x for r in text.collect() for x in linededup.line_keys(r.text) if x})
    comp = {r.id: r.comp for r in linededup.line_components(text, Scratch(spark, "lines"), p).collect()}
    h, first = linededup.shingle_hashes(every, p.shingle)
    sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first, first[1:])]
    pairs = links([np.sort(s) for s in sets], p.percent)
    of = lambda k: comp.get(linededup.line_id(every[k]), linededup.line_id(every[k]))
    found = sum(of(i) == of(j) for i, j in pairs)
    print(f"\nlines: {found} of {len(pairs)} links of {len(every)} lines")
    assert len(pairs) > 200 and found / len(pairs) > 0.995
