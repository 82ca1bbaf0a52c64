"""Functions of other SQL dialects as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_oracle(value: Column, *pairs: object) -> Column:
    """DECODE(value, search, result, ..., default): searches compare nulls as equal."""
    searches = [F.lit(x) for x in pairs]
    out = searches.pop() if len(searches) % 2 else F.lit(None)
    for search, result in reversed(list(zip(searches[::2], searches[1::2], strict=True))):
        out = F.when(value.eqNullSafe(search), result).otherwise(out)
    return out


def period_diff(a: Column, b: Column) -> Column:
    """PERIOD_DIFF of YYYYMM numbers: months from b to a."""
    months = lambda p: F.floor(p / 100) * 12 + p % 100
    return months(a) - months(b)


def point_x(wkt: Column) -> Column:
    """ST_X of a POINT in well-known text; null for anything else."""
    return F.regexp_extract(wkt, r"^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", 1).try_cast("double")


def point_y(wkt: Column) -> Column:
    """ST_Y of a POINT in well-known text; null for anything else."""
    return F.regexp_extract(wkt, r"^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", 2).try_cast("double")


def json_text(document: Column, *path: str) -> Column:
    """``->>`` along a path of keys."""
    return F.get_json_object(document, "$" + "".join(f".{p}" for p in path))


def safe_offset(array: Column, at: int) -> Column:
    """``[SAFE_OFFSET(at)]``: the element from 0, null outside."""
    return F.get(array, F.lit(at))
