"""The jobs: growing input, reruns, replays, parts of the slides, and the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import common, slide_features, text_intake
from jobs.queries import _settings

ROOT = Path(__file__).parent.parent
TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, name, rows):
    """One more file of a copied table; a file that is there isn't touched."""
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.parquet(f"{folder}/{name}")
    part = next(f for f in os.listdir(f"{folder}/{name}") if f.startswith("part-"))
    os.makedirs(f"{folder}/texts.parquet", exist_ok=True)
    os.rename(f"{folder}/{name}/{part}", f"{folder}/texts.parquet/{name}.parquet")


def text_rows(n, first=0):
    sources = ["a", "b", "a", "", None, "12"]
    return [(first + i, None if i % 11 == 0 else "wörd " * (i % 7) * 60, ["en", "de", None][i % 3], sources[i % 6], 1) for i in range(n)]


def intake(spark, folder, out, **more):
    config = text_intake.DEFAULTS | {"table": "texts.parquet"} | more
    return sorted(map(tuple, text_intake.run(spark, folder, f"{out}/out", f"{out}/mark", config).collect()), key=repr)


def test_text_intake_takes_only_what_is_new(spark, tmp_path):
    folder, out, whole = str(tmp_path / "in"), str(tmp_path / "grown"), str(tmp_path / "whole")
    put(spark, folder, "f1", text_rows(40))
    first = intake(spark, folder, out)
    assert len(first) == 40 and intake(spark, folder, out) == first
    os.rename(f"{folder}/texts.parquet/f1.parquet", f"{folder}/old.parquet")  # what was taken isn't needed again
    put(spark, folder, "f2", text_rows(25, 100))
    grown = intake(spark, folder, out)
    assert len(grown) == 65 and sorted(p.name for p in Path(out, "out/records").glob("batch=*")) == ["batch=0", "batch=1"]
    os.rename(f"{folder}/old.parquet", f"{folder}/texts.parquet/f1.parquet")
    assert intake(spark, folder, whole, files_per_batch=1) == grown  # two batches of one run give the same
    by_source = {}
    for r in grown:
        by_source[r[7], r[2]] = by_source.get((r[7], r[2]), 0) + 1
    assert all(r[8] == by_source[r[7], r[2]] and r[9] + r[10] == r[8] for r in grown)
    assert {r[7] for r in grown} == {"a", "b", "12", None} and all(r[1] is None for r in grown if r[0] % 100 % 11 == 0)


def test_text_intake_replays_a_lost_batch(spark, tmp_path, monkeypatch):
    folder, out, whole = str(tmp_path / "in"), str(tmp_path / "lost"), str(tmp_path / "whole")
    put(spark, folder, "f1", text_rows(30))
    def lost(of):
        raise RuntimeError("an executor is gone")

    monkeypatch.setattr(text_intake, "partial_sums", lost)
    with pytest.raises(Exception, match="gone"):
        intake(spark, folder, out)
    monkeypatch.undo()
    assert Path(out, "out/records/batch=0").exists()
    assert intake(spark, folder, out) == intake(spark, folder, whole)
    put(spark, folder, "f0", [])  # a file without rows is a batch without rows
    assert len(intake(spark, folder, out)) == 30


def objects(spark, folder, n=300, move=0):
    rows = [(i, i % 3, (i * 7919 + move) % 3000, (i * 104729) % 3000, 40 + i % 280, 20 + i % 60, (i % 30) / 10, 9.0 + i % 5, 4.0, i % 256, i % 99, i % 7, (i % 100) / 200) for i in range(n)]
    names = "nid long, slide_no long, x long, y long, area_px long, perimeter_px long, orientation double, major_axis_length double, minor_axis_length double, r long, g long, b long, brown_intensity double"
    spark.createDataFrame(rows, names).write.mode("overwrite").parquet(f"{folder}/objects.parquet")


def test_slide_features_reruns_and_replaces_by_slide(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    objects(spark, folder)
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    first = rows(slide_features.run(spark, folder, out, slide_features.DEFAULTS))
    assert first == rows(slide_features.run(spark, folder, out, slide_features.DEFAULTS)) and 60 < len(first) < 300
    assert len({r[0] for r in first}) == len(first) and all(50 <= r[3] <= 300 for r in first)
    objects(spark, folder, move=500)
    part = rows(slide_features.run(spark, folder, out, slide_features.DEFAULTS | {"slides": [1]}))
    assert [r for r in part if r[-1] != 1] == [r for r in first if r[-1] != 1] and [r for r in part if r[-1] == 1] != [r for r in first if r[-1] == 1]
    assert sorted(p.name for p in Path(out, "features").glob("slide_no=*")) == ["slide_no=0", "slide_no=1", "slide_no=2"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_slide_features_of_no_objects(spark, tmp_path):
    objects(spark, str(tmp_path / "in"), 0)
    assert slide_features.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), slide_features.DEFAULTS).count() == 0


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"low": 5}))
    assert common.load_config(spark, str(path), text_intake.DEFAULTS) == text_intake.DEFAULTS | {"low": 5}
    path.write_text(json.dumps({"lowest": 5}))
    with pytest.raises(ValueError, match="lowest"):
        common.load_config(spark, str(path), text_intake.DEFAULTS)
    assert set(_settings(slide_features)) == set(slide_features.DEFAULTS) and set(_settings(text_intake)) == set(text_intake.DEFAULTS)


def test_command_line(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, "f1", text_rows(20))
    (tmp_path / "c.json").write_text('{"table": "texts.parquet"}')
    line = [sys.executable, "-m", "jobs.text_intake", "--tables", folder, "--out", out, "--checkpoint", f"{out}/mark", "--config", str(tmp_path / "c.json"), "--master", "local[2]"]
    for _ in range(2):
        done = subprocess.run(["timeout", "200", *line], cwd=ROOT, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "took 0 batches" in done.stderr and text_intake.read_back(spark, out).count() == 20
