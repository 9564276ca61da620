"""The registry, and the test views over the driver's tables (the same expressions in both engines)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Objects with integer positions in tenths of a micrometre.
NUCLEI = """o_orderkey nid, o_custkey % 4 slide_no,
 (o_orderkey*7919 + o_custkey*104729) % 20000 xi, (o_custkey*6007 + o_orderkey*13007) % 20000 yi,
 cast(floor(o_totalprice) as bigint) % 400 + 20 area_px, (o_orderkey*53) % 60 + 20 perimeter_px,
 ((o_orderkey*37) % 314 - 157) / cast(100 as double) orientation,
 ((o_orderkey*17) % 200 + 100) / cast(10 as double) major_axis_length,
 ((o_orderkey*29) % 90 + 10) / cast(10 as double) minor_axis_length,
 (o_orderkey*31) % 256 r, (o_orderkey*61) % 256 g, (o_orderkey*97) % 256 b,
 ((o_orderkey*41) % 100) / cast(200 as double) brown_intensity,
 o_orderstatus seg, o_orderkey % 20 cluster"""
#: One image, 100 pixels wide.
PIXELS = """event_id % 100 px, cast(floor(event_id / cast(100 as double)) as bigint) py,
 cast(floor(value) as bigint) % 256 r, (event_id*7) % 256 g, (event_id*13) % 256 b"""
SLIDES = """s_suppkey slide_no, concat(case s_suppkey % 8 when 0 then 'HE-' when 1 then 'CD3-' when 2 then 'GFAP-'
  when 3 then 'IBA1-' when 4 then 'NF-' when 5 then 'PGP9-5-' when 6 then 'PID30' else 'BIDS' end,
 case when s_suppkey % 8 = 7 then '' when s_nationkey % 2 = 0 then 'B' else 'S' end,
 cast(cast(floor(s_suppkey / cast(8 as double)) as bigint) % 30 as varchar(9))) slide_name"""
_WITH = f"""with nuclei as (select {NUCLEI} from orders), pixels as (select {PIXELS} from events), slides as (select {SLIDES} from supplier),
mask as (select px, py, case when greatest(r, g, b) > 20 and greatest(r, g, b) > 0
  and floor((greatest(r, g, b) - least(r, g, b)) * cast(255 as double) / greatest(r, g, b) + cast(0.5 as double)) > 10 then 1 else 0 end v from pixels)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` goes on after the views' WITH clause."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _WITH + sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _view(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.sql(f"select {text} from {{source}}", source=df)


def nuclei(spark: SparkSession, sf: str) -> DataFrame:
    return _view(table(spark, sf, "orders"), NUCLEI)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return _view(table(spark, sf, "events"), PIXELS)


def slides(spark: SparkSession, sf: str) -> DataFrame:
    return _view(table(spark, sf, "supplier"), SLIDES)


def r6(*columns: str):
    """Doubles rounded where a query ends."""
    return [F.round(F.col(c), 6).alias(c) for c in columns]
