"""The jobs as queries: each runs twice into a new folder that the cluster shares and returns its whole output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import slide_features, text_intake
from tessella.queries.objects import NMS
from tessella.queries.registry import _WITH
from tessella.scratch import shared_dir

HERE = Path(__file__).parent


def _settings(job) -> dict:
    return job.DEFAULTS | json.loads((HERE / f"{job.__name__.rpartition('.')[2]}.json").read_text())


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_slide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "job1"), _settings(slide_features)
    slide_features.run(spark, sf_dir, out, config)
    return slide_features.run(spark, sf_dir, out, config)


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "job2"), _settings(text_intake)
    text_intake.run(spark, sf_dir, f"{out}/out", f"{out}/mark", config)
    return text_intake.run(spark, sf_dir, f"{out}/out", f"{out}/mark", config)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_slide_features": job1_slide_features, "job2_text_intake": job2_text_intake}

ORACLES: dict[str, str] = {
    "job1_slide_features": _WITH + NMS + """, kept as materialized (select * from once where area_px between 50 and 300),
 p as (select a.nid, b.area_px, b.orientation, b.brown_intensity from kept a join kept b on a.slide_no = b.slide_no and (a.xi-b.xi)*(a.xi-b.xi) + (a.yi-b.yi)*(a.yi-b.yi) <= 250000),
 s as (select nid, count(*) - 1 n_near, round((count(*) - 1) / (pi() * 2500), 9) density_um2,
  round(case when count(*) < 3 then 0 else sqrt(pow(avg(cos(2 * orientation)), 2) + pow(avg(sin(2 * orientation)), 2)) end, 6) coherency,
  round(avg(area_px), 6) area_px_mean, round(var_pop(area_px), 6) area_px_variance, round(median(area_px), 6) area_px_median,
  round(avg(case when brown_intensity > 0.15 then 1 else 0 end), 6) brown_density from p group by nid)
 select nid, slide_no, xi * cast(0.1 as double) x_um, yi * cast(0.1 as double) y_um, area_px, round(case when minor_axis_length > 0 then major_axis_length / minor_axis_length else 0 end, 6) aspect_ratio,
 round(least(greatest(4 * pi() * area_px / greatest(perimeter_px * perimeter_px, 1e-6), 0), 1), 6) circularity, round((r + g + b) / cast(3 as double), 6) gray_mean,
 case when brown_intensity > 0.15 then 1 else 0 end has_brown, n_near, density_um2, coherency, area_px_mean, area_px_variance, area_px_median, brown_density from kept join s using (nid)""",
    "job2_text_intake": r"""with r as (select doc_id, substr(md5(text), 1, 16) record_id, lang, cast(length(coalesce(text, '')) as bigint) n_chars,
 cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) n_words, nullif(source, '') source from documents),
 f as (select *, n_chars between 200 and 20000 in_range, cast(least(n_chars // 1000, 19) as int) size_bin from r),
 s as (select source, lang, count(*) n, count(*) filter (in_range) n_kept, count(*) filter (not in_range) n_removed, round(avg(n_chars), 6) mean_chars, round(stddev_samp(n_chars), 6) std_chars,
  min(n_chars) min_chars, max(n_chars) max_chars from f group by source, lang)
 select f.*, n, n_kept, n_removed, mean_chars, std_chars, min_chars, max_chars from f join s on f.source is not distinct from s.source and f.lang is not distinct from s.lang""",
}
