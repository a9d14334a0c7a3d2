"""Canonical CBOR of records of a known shape, as binary columns: no row leaves the JVM.

Keys of a map are literals, so their canonical order (by length of the encoded key, then by its bytes) is settled when
the plan is built. Records of any shape go through ``functions.canonical`` instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import encode_cbor

NULL = b"\xf6"


def _bytes(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def head(kind: int, n: Column) -> Column:
    """The shortest head of a kind with a number from 0 on."""
    n = n.cast("long")
    out = F.when(n < 24, _bytes(n + kind * 32, 1))
    for code, width in ((24, 1), (25, 2), (26, 4)):
        out = out.when(n < 1 << (8 * width), F.concat(F.lit(bytes([kind << 5 | code])), _bytes(n, width)))
    return out.otherwise(F.concat(F.lit(bytes([kind << 5 | 27])), _bytes(n, 8)))


def _or_null(value: Column, encoded: Column) -> Column:
    return F.when(value.isNull(), F.lit(NULL)).otherwise(encoded)


def integer(value: Column) -> Column:
    return _or_null(value, F.when(value >= 0, head(0, value)).otherwise(head(1, -1 - value)))


def text(value: Column) -> Column:
    raw = value.cast("string").cast("binary")
    return _or_null(value, F.concat(head(3, F.octet_length(raw)), raw))


def boolean(value: Column) -> Column:
    return _or_null(value, F.when(value, F.lit(b"\xf5")).otherwise(F.lit(b"\xf4")))


def array(values: Column, item=text) -> Column:
    """An array column, each item by ``item``."""
    return _or_null(values, F.aggregate(values, head(4, F.size(values)), lambda made, v: F.concat(made, item(v))))


def mapping(entries: Mapping[str, Column]) -> Column:
    """A map of literal keys to encoded values."""
    keys = sorted((encode_cbor(key) for key in entries), key=lambda k: (len(k), k))
    by_key = {encode_cbor(key): value for key, value in entries.items()}
    parts = [part for key in keys for part in (F.lit(key), by_key[key])]
    return F.concat(head(5, F.lit(len(keys))), *parts)


def sha256(encoded: Column) -> Column:
    return F.sha2(encoded, 256)
