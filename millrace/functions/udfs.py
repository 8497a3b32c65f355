"""The few functions Spark has no built-in for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructType

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


@pandas_udf(StringType())
def normalize_string(text: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normalisation (NFC, NFD, NFKC, NFKD)."""
    return pd.Series([None if t is None else unicodedata.normalize(f or "NFC", t) for t, f in zip(text, form, strict=True)])


@pandas_udf(StringType())
def string_binary(raw: pd.Series) -> pd.Series:
    r"""Printable ASCII as it is, every other byte as \xNN."""
    return raw.map(lambda b: None if b is None else "".join(chr(c) if 32 <= c < 127 else f"\\x{c:02X}" for c in b))


def geohash(lat: float, lon: float, length: int) -> str:
    low, high, bits, out = [-90.0, -180.0], [90.0, 180.0], 0, []
    point, axis, value = (lat, lon), 1, 0
    while len(out) < length:
        mid = (low[axis] + high[axis]) / 2
        above = point[axis] >= mid
        value = value << 1 | above
        (low if above else high)[axis] = mid
        axis ^= 1
        bits += 1
        if bits == 5:
            out.append(BASE32[value])
            bits = value = 0
    return "".join(out)


def geohash_centre(code: str) -> tuple[float, float]:
    low, high, axis = [-90.0, -180.0], [90.0, 180.0], 1
    for c in code.lower():
        value = BASE32.index(c)
        for k in range(4, -1, -1):
            mid = (low[axis] + high[axis]) / 2
            (low if value >> k & 1 else high)[axis] = mid
            axis ^= 1
    return (low[0] + high[0]) / 2, (low[1] + high[1]) / 2


@pandas_udf(StringType())
def st_geohash(lat: pd.Series, lon: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else geohash(a, b, int(n)) for a, b, n in zip(lat, lon, length, strict=True)])


@pandas_udf(StructType().add("latitude", DoubleType()).add("longitude", DoubleType()))
def st_fromgeohash(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if c is None else geohash_centre(c) for c in code], columns=["latitude", "longitude"])


def register(spark: SparkSession) -> None:
    """Make the UDFs callable from SQL."""
    for name, f in (("normalize_string", normalize_string), ("string_binary", string_binary), ("st_geohash", st_geohash), ("st_fromgeohash", st_fromgeohash)):
        spark.udf.register(name, f)
