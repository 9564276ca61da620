"""The set-similarity join against all blocks and templates, and on awkward texts."""

import random
import re

import pytest

from tessella.llm import licenses
from tessella.llm.licenses import NOTICES, TEMPLATES, Template
from tests.llm.conftest import prose


def brute(text, templates=TEMPLATES):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(licenses.PATTERN, text)
    places, blocks = set(), []
    for k, t in enumerate(templates):
        want = re.findall(licenses.PATTERN, t.text)
        if t.phrase:
            places |= {(t.label, i, len(want)) for i in range(len(ws)) if ws[i : i + len(want)] == want}
            continue
        width = 16
        while width < 2 * len(want):
            width *= 2
        need = max(1, -(-t.percent * len(set(want)) // 100))
        for start in range(0, len(ws), width // 2):
            part = ws[start : start + width]
            shared = len(set(part) & set(want))
            if shared >= need:
                blocks.append((t.label, k, start, len(part), shared, len(set(want))))
    return len(ws), places, sorted(blocks)


def texts():
    rng = random.Random(5)
    out = [None, "", "   \n", "---", "mit license", "MIT-License. mit license mit LICENSE", "cc by", "CC-BY-NC 4.0", "Éclair gnu general public licensé", "x" * 100_000, "license " * 3000]
    for _ in range(120):
        t = rng.choice(TEMPLATES).text.split()
        noise = prose(rng.randrange(10**6), rng.randrange(60)).split()
        cut = [w for w in t if rng.random() > 0.15]
        rng.shuffle(cut) if rng.random() < 0.3 else None
        at = rng.randrange(len(noise) + 1)
        out.append(" ".join(noise[:at] + cut + noise[at:]).title() if rng.random() < 0.3 else " ".join(noise[:at] + cut + noise[at:]))
    return out + [NOTICES[6].text + " " + prose(4, 20_000) + " " + NOTICES[6].text]


def scan(spark, rows, templates=TEMPLATES):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_words int, places string, blocks string").repartition(4)
    return licenses.scan_licenses(df, templates)


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in scan(spark, rows).collect()}
    assert len(got) == len(rows)
    found = 0
    for i, t in rows:
        n, places, blocks = brute(t)
        r = got[i]
        assert r.n_words == n and {(p.label, p.start, p.n) for p in r.places} == places and len(r.places) == len(places)
        assert sorted((b.label, b.template, b.start, b.n, b.shared, b.of) for b in r.blocks) == blocks
        found += bool(blocks)
    assert found > 40


def test_digest_and_awkward_rows(spark):
    big = 2**60 + 1
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None), (big, ""), (2, "the apache of the license"), (3, "Licensed under the Apache-License, version 2.0")]
    out = sorted(map(tuple, licenses.labelled(scan(spark, rows)).collect()), key=str)
    mit = (1, 5, 1, 3, 3, "mit", "mit,mit-statement", 1.0)
    assert out == sorted([mit, mit, (None, 0, 0, None, None, "", "", 0.0), (big, 0, 0, None, None, "", "", 0.0), (2, 5, 0, None, None, "", "", 0.0), (3, 8, 1, 3, 3, "apache", "apache,apache-2.0", 1.0)], key=str)
    assert licenses.scan_licenses(scan(spark, rows).limit(0).selectExpr("doc_id", "cast(null as string) text")).count() == 0
    assert all(not r.places and not r.blocks for r in scan(spark, rows, ()).collect())
    with pytest.raises(ValueError):
        scan(spark, rows, (Template("empty", "--"),))


def test_prefixes_start_with_the_rarest_words(spark):
    rows = [(i, "common common rare" if i == 0 else "common middle" if i < 4 else "common") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.word_order(df, (Template("t", "common rare middle never"),)) == [b"never", b"rare", b"middle", b"common"]
