"""Registered queries of the library and their DuckDB SQL."""

from tessella.queries import images, objects, slides
from tessella.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "images", "objects", "slides"]
