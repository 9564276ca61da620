"""Queries over the slide registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import slides as S
from tessella.operators import raster
from tessella.queries.registry import query
from tessella.queries.registry import slides as slide_view
from tessella.sources import tables

PARSED = r""", n as (select slide_no, slide_name, case when starts_with(slide_name, 'BIDS') then 'PID-S' || substr(slide_name, 5) else slide_name end nm from slides),
 p as (select *, regexp_extract(nm, '^PID\d+([BS]\d+)', 1, 'i') pid, string_split(nm, '-') parts, len(parts) = 3 and parts[1] = 'PGP9' and parts[2] = '5' three, upper(parts[1]) head from n),
 parsed as (select slide_no, slide_name, case when pid <> '' then 'PID' when three then 'PGP9.5' when len(parts) < 2 then null when head in ('HE', 'H&E', 'HE=') then 'H&E' when head like '%PGP%' then 'PGP9.5'
 when head = 'IBA1' then 'Iba1' when head in ('CD3', 'GFAP', 'NF', 'PID') then head else parts[1] end stain,
 case when pid <> '' then upper(pid) when three then upper(parts[3]) when len(parts) >= 2 then upper(parts[2]) end sample from p)"""


@query("slide_classify", r""" select slide_no, slide_name, case when regexp_matches(upper(slide_name), '\bHE[-=_]') then 'H&E' when regexp_matches(upper(slide_name), '\bCD3[-_]') then 'IHC_CD3'
 when regexp_matches(upper(slide_name), '\bGFAP[-_]') then 'IHC_GFAP' when regexp_matches(upper(slide_name), '\bIBA1[-_]') then 'IHC_IBA1' when regexp_matches(upper(slide_name), '\bNF[-_]') then 'IHC_NF'
 when regexp_matches(upper(slide_name), '\bPGP[-_]') then 'IHC_PGP' when regexp_matches(upper(slide_name), '\bPGP9-5[-_]') then 'IHC_PGP95' else 'H&E' end kind from slides""")
def slide_classify(spark, sf):
    return slide_view(spark, sf).select("slide_no", "slide_name", S.slide_type(F.col("slide_name")).alias("kind"))


@query("slide_parse", PARSED + " select slide_no, slide_name, stain, sample from parsed")
def slide_parse(spark, sf):
    stain, sample = S.parse_name(F.col("slide_name"))
    return slide_view(spark, sf).select("slide_no", "slide_name", stain.alias("stain"), sample.alias("sample"))


@query("sample_groups", PARSED + """ select sample, count(distinct stain) n_stains, max(case when stain = 'H&E' then 1 else 0 end) has_he from parsed where sample is not null
 group by sample having max(case when stain = 'H&E' then 1 else 0 end) = 1 and count(distinct stain) >= 2""")
def sample_groups(spark, sf):
    return S.complete_samples(slide_parse(spark, sf), 2).select("sample", F.size("stains").cast("long").alias("n_stains"), F.lit(1).alias("has_he"))


@query("stain_membership", r""" select slide_no, lower(slide_name) like 'iba1-%' or lower(slide_name) like 'ibal-%' is_iba1, lower(slide_name) like 'pid%' or lower(slide_name) like 'bid%' is_pid from slides""")
def stain_membership(spark, sf):
    n = F.col("slide_name")
    return slide_view(spark, sf).select("slide_no", S.stain_slide(n, "IBA1").alias("is_iba1"), S.stain_slide(n, "PID").alias("is_pid"))


@query("tile_grid", """, im as (select slide_no, 3000 + slide_no % 7 * 500 width, 2500 + slide_no % 5 * 700 height from slides)
 select slide_no, x, y from im, (select unnest(range(0, 8000, 896)) x), (select unnest(range(0, 8000, 896)) y) where x <= width - 1024 and y <= height - 1024""")
def tile_grid(spark, sf):
    n = F.col("slide_no")
    images = slide_view(spark, sf).select("slide_no", (3000 + n % 7 * 500).alias("width"), (2500 + n % 5 * 700).alias("height"))
    return raster.tile_grid(images).select("slide_no", "x", "y")


@query("shell_slide_types", r""", u as (select slide_no, slide_name, upper(slide_name) n from slides)
 select slide_no, slide_name, case when starts_with(n, 'PGP') or starts_with(n, 'PID30') then 'IHC_PGP95' when starts_with(n, 'HCC') or starts_with(n, 'HE') then 'H&E' when starts_with(n, 'CD3') then 'IHC_CD3'
 when starts_with(n, 'GFAP') then 'IHC_GFAP' when starts_with(n, 'IBA1') then 'IHC_IBA1' when starts_with(n, 'NF') then 'IHC_NF' else 'H&E' end kind from u""")
def shell_slide_types(spark, sf):
    return slide_view(spark, sf).select("slide_no", "slide_name", S.slide_type(F.col("slide_name"), "shell").alias("kind"))


@query("sample_stain_paths", PARSED + """, one as (select sample, stain, max(slide_name || '.svs') path from parsed where sample is not null group by sample, stain)
 select sample, string_agg(stain || '=' || path, ';' order by stain) paths from one group by sample""")
def sample_stain_paths(spark, sf):
    paths = S.stain_paths(slide_parse(spark, sf).withColumn("path", F.concat("slide_name", F.lit(".svs"))))
    pairs = F.transform(F.map_entries("paths"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return paths.select("sample", F.array_join(pairs, ";").alias("paths"))


@query("mask_candidates", """, f as (select slide_no % 10 grp, slide_name, case when slide_name like 'CD3-%' then 0 when slide_name like 'HE-%' then 1 end rank from slides)
 select grp, slide_name from (select *, row_number() over (partition by grp order by rank, slide_name) n from f where rank is not null) where n = 1""")
def mask_candidates(spark, sf):
    """Of each group's files the one by the naming rule that comes first."""
    files = slide_view(spark, sf).select((F.col("slide_no") % 10).alias("grp"), F.col("slide_name").alias("name"), F.col("slide_name").alias("path"))
    return tables.first_candidate(files, ["^CD3-", "^HE-"], ["grp"]).select("grp", F.col("name").alias("slide_name"))


@query("slide_resolution", """, m as (select slide_no, case when slide_no % 5 > 0 then (slide_no % 5) / cast(8 as double) end mx, (slide_no % 7) / cast(4 as double) my from slides)
 select slide_no, case when mx > 0 and my > 0 then (mx + my) / 2 else 0.25 end mpp, coalesce(mx > 0 and my > 0, false) mpp_found from m""")
def slide_resolution(spark, sf):
    """Micrometres a pixel, where a slide has them in both directions."""
    n = F.col("slide_no")
    meta = slide_view(spark, sf).select("slide_no", F.when(n % 5 > 0, n % 5 / F.lit(8.0)).alias("mpp_x"), (n % 7 / F.lit(4.0)).alias("mpp_y"))
    return tables.slide_probe(meta).select("slide_no", "mpp", "mpp_found")
