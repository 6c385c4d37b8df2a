"""Encodings and digests; what Spark lacks is a pandas UDF."""

from __future__ import annotations

import binascii
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_uri(c: Column) -> Column:
    """Percent-encoding with %20 for the space."""
    return F.regexp_replace(F.url_encode(c), r"\+", "%20")


def decode_uri(c: Column) -> Column:
    """The inverse of percent-encoding with + for the space; null where the input is broken."""
    return F.try_url_decode(c)


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def html_decode(c: Column) -> Column:
    """The named entities of the markup characters, the space that does not break, and the quote by number."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def html_encode(c: Column) -> Column:
    for value, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(value), F.lit(name))
    return c


@F.pandas_udf(T.LongType())
def crc16(c: pd.Series) -> pd.Series:
    """CRC-16 of the CCITT polynomial, start value zero."""
    return c.map(lambda s: None if s is None else binascii.crc_hqx(s.encode(), 0))


def hmac_hex(c: Column, key: str, digest: str = "sha256") -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key.encode(), x.encode(), getattr(hashlib, digest)).hexdigest())

    return run(c)


@F.pandas_udf(T.LongType())
def fnv1a(c: pd.Series) -> pd.Series:
    """64-bit FNV-1a, as a signed number."""

    def one(s: str | None) -> int | None:
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return c.map(one)
