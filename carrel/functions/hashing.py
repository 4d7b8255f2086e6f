"""Keyed hashes as Catalyst expressions, so that pseudonyms need no UDF."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _pads(key: str, method: str) -> tuple[bytes, bytes]:
    k = key.encode()
    block = 128 if method == "sha512" else BLOCK
    if len(k) > block:
        k = hashlib.new(method, k).digest()
    k = k.ljust(block, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac(value: Column, key: str, method: str = "md5") -> Column:
    """Hex HMAC of the value's text; null stays null. An integer and its decimal text hash alike."""
    digest = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[method]
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key, method))
    body = value.cast("string").cast("binary")
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, body)))))


def hmac_sql(value: str, key: str, method: str = "md5") -> str:
    """The same in DuckDB's SQL, for md5 and sha256."""
    inner, outer = (f"unhex('{p.hex()}')" for p in _pads(key, method))
    return f"{method}({outer} || unhex({method}({inner} || encode(({value})::VARCHAR))))"


def row_hash(columns: list[Column], key: str) -> Column:
    """A keyed hash of a row's values for change detection; null and the empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return hmac(F.concat(*parts), key)


def row_hash_sql(columns: list[str], key: str) -> str:
    parts = " || ".join(f"coalesce('v' || length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, 'n')" for c in columns)
    return hmac_sql(parts, key)


def hash64(value: Column) -> Column:
    """A 64-bit hash that is not cryptographic, for text primary keys and work splitting."""
    return F.xxhash64(value.cast("string"))
