"""Every operator and pipeline stage on awkward rows and on empty tables."""

import hashlib
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import prose, rows
from tessella.llm import decontam, linededup, mixing, neardup, ogg, pst, quality, sharding, toxicity, urls
from tessella.llm.queries import RULES
from tessella.scratch import Scratch

N = len(rows())
SMALL_NET = quality.ConvParams(rows=40, least_steps=20, epochs=1)
SMALL_CRF = toxicity.CrfParams(steps=5)


def bench(spark):
    return spark.createDataFrame([(1, prose(1, 200)[200:420]), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")


def test_quality(spark, docs, nothing, labels):
    got = quality.quality_scores(docs, labels, SMALL_NET).collect()
    assert len(got) == N and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 111}) == 1
    assert quality.quality_scores(nothing, labels, SMALL_NET).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), SMALL_NET).collect()} == {0.5}


def test_toxicity(spark, docs, nothing, labels):
    got = toxicity.toxicity_scores(docs, labels, SMALL_CRF).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.held_out for r in got if r.doc_id is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    assert toxicity.toxicity_scores(nothing, labels.limit(0), SMALL_CRF).count() == 0
    kept = toxicity.without_toxic(docs, labels, SMALL_CRF)
    assert kept.columns == docs.columns and kept.count() <= N


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/71?x"), (2, None), (3, "no scheme"), (4, "x://example.net/de/8"), (4, "x://example.net/de/8"), (5, "ftp://co.uk"), (None, "http://1.2.3.4:80/a#b")], "page_id long, url string").withColumn("bad", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    outcomes = spark.createDataFrame([(1, 0), (4, 1), (7, 1)], "page_id long, bad int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, outcomes, RULES).collect()}
    assert (1, "a.example.com", "/en/71", "example.com/en/7", "allow") in got
    assert (4, "example.net", "/de/8", "example.net/de/8", "block") in got
    assert {(r[1], r[2]) for r in got if r[0] in (2, 3)} == {("", "")}
    assert urls.filter_urls(pages, outcomes, RULES).count() == 7
    assert urls.filter_urls(pages.limit(0), outcomes.limit(0), RULES).count() == 0


def test_media(docs, nothing):
    got = ogg.media_columns(docs).collect()
    assert len(got) == N and ogg.media_columns(nothing).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 112)}
    for r in got:
        if r.doc_id in texts:
            payload = ogg.pad((texts[r.doc_id] or "").encode())
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and ogg.load(bytes(r.media))[0] == payload
            assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.n_bytes == len((texts[r.doc_id] or "").encode())


def test_mixing(spark, docs, nothing):
    got = mixing.mix_sources(docs, Scratch(spark, "t")).collect()
    assert len(got) == N and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r["size"] for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 * total
    assert mixing.mix_sources(nothing, Scratch(spark, "t")).count() == 0
    assert mixing.repeat_documents(docs, Scratch(spark, "t")).columns == docs.columns
    same = spark.createDataFrame([(1, "six words are in this row", "a")] * 6 + [(k, f"other words {k}", "b") for k in range(9)], "doc_id long, text string, source string")
    got, out = mixing.mix_sources(same, Scratch(spark, "t")).collect(), mixing.repeat_documents(same, Scratch(spark, "t")).collect()
    assert len(out) == sum(r.copies for r in got)
    assert sum(r.doc_id == 1 and r.source == "a" for r in out) == sum(r.copies for r in got if r["size"] == 6)


def test_near_duplicates(spark, docs, nothing):
    p = neardup.NearDupParams(shingle=3, percent=85)
    got = neardup.near_duplicates(docs, Scratch(spark, "t"), p).collect()
    assert len(got) == N and neardup.near_duplicates(nothing, Scratch(spark, "t"), p).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[i].component_id for i in (100, 101, 102, 103, 112)} == {100}
    assert [by[i].n_shingles for i in (104, 105, 106, 107, 108)] == [0, 0, 0, 1, 1] and all(by[i].kept for i in (104, 105, 106))
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = neardup.keep_one_each(docs, Scratch(spark, "t"), p)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids[100] == 1 and ids[101] == 0 and ids[111] == 1 and ids[None] == 2


def test_decontamination(spark, docs, nothing):
    found = {r.doc_id for r in decontam.find_leaks(docs, bench(spark)).collect()}
    assert found == {100, 101, 102, 103, 112, None}
    clean = decontam.without_leaks(docs, bench(spark))
    assert clean.columns == docs.columns and clean.count() == N - 6
    assert decontam.find_leaks(nothing, bench(spark)).count() == 0
    assert decontam.without_leaks(docs, bench(spark).limit(0)).count() == N
    split = decontam.LeakParams(block=100)
    assert {r.doc_id for r in decontam.find_leaks(docs, bench(spark), split).collect()} == found


def test_sharding(spark, docs, nothing):
    got = sharding.shard_rows(docs, Scratch(spark, "t"), 7).collect()
    assert len(got) == N and sharding.shard_rows(nothing, Scratch(spark, "t"), 7).count() == 0
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    placed = sharding.with_shards(docs, Scratch(spark, "t"), shards=7)
    assert set(placed.columns) == {*docs.columns, "shard_size", "text_crc32", "shard_shard", "slot"}
    assert placed.count() == N and placed.select("shard_shard", "slot").distinct().count() == N
    assert {(r["size"], r["shard"]) for r in placed.collect()} == {(7, 7)}


def test_line_dedup(spark, docs, nothing):
    got = linededup.line_plan(docs, Scratch(spark, "t")).collect()
    assert len(got) == N and linededup.line_plan(nothing, Scratch(spark, "t")).count() == 0
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[104, 0].kept == [] and by[105, 0].kept == [] and by[106, 0].kept == []
    assert any(r.doc_id == 101 and r.kept == [] for r in got)
    out = linededup.dedup_lines(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.count() == N
    # Rows that repeat leave one row with its lines; only line feeds end lines.
    odd = spark.createDataFrame([(1, "a line that is here three times")] * 3 + [(2, "a\rb\x85c\u2028d\n\r\ne")], "doc_id long, text string")
    got = linededup.line_plan(odd, Scratch(spark, "t")).collect()
    assert sorted(len(r.kept) for r in got if r.doc_id == 1) == [0, 0, 1]
    assert [(r.n_lines, r.kept) for r in got if r.doc_id == 2] == [(2, [0, 2])]
    assert sorted(r.text for r in linededup.dedup_lines(odd, Scratch(spark, "t")).collect() if r.doc_id == 1)[1:] == ["", "a line that is here three times"]


def test_suffix_tree(spark, docs, nothing):
    got = pst.suffix_tree_scores(docs, Scratch(spark, "t")).collect()
    assert len(got) == N and pst.suffix_tree_scores(nothing, Scratch(spark, "t")).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[104].n_tokens == by[105].n_tokens == by[106].n_tokens == 1 and by[108].n_tokens == 3
    assert len({r.score for r in got if r.doc_id == 111}) == 1 and all(r.score < 0 for r in got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() > 0 and stage(spark, nothing, str(tmp_path)).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert set(out.columns) == set(docs.columns)
    else:
        assert set(out.columns) > set(docs.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_without_labels_or_benchmark(spark, docs, labels, tmp_path, name, stage):
    """Stages that have nothing to learn from or look for leave all rows."""
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, docs, str(tmp_path)).count() == N or name in ("near_duplicates", "mixing")
