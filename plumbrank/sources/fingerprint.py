"""Fingerprints of values, files and DataFrames."""

from __future__ import annotations

import hashlib
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "fp_"


def _tagged(value: Any) -> bytes:
    """A canonical form in which type and length are written out, so no two values share one."""
    if value is None:
        tag, body = b"n", b""
    elif isinstance(value, bool):
        tag, body = b"b", str(int(value)).encode()
    elif isinstance(value, int):
        tag, body = b"i", str(value).encode()
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise TypeError("NaN and infinities have no fingerprint")
        tag, body = b"f", value.hex().encode()
    elif isinstance(value, str):
        tag, body = b"s", value.encode()
    elif isinstance(value, bytes):
        tag, body = b"y", value
    elif isinstance(value, (list, tuple)):
        tag, body = b"l" if isinstance(value, list) else b"t", b"".join(map(_tagged, value))
    elif isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be strings")
        tag, body = b"d", b"".join(_tagged(k) + _tagged(value[k]) for k in sorted(value))
    else:
        raise TypeError(f"{type(value).__name__} has no fingerprint")
    return tag + str(len(body)).encode() + b":" + body


def fingerprint_bytes(data: bytes) -> str:
    return PREFIX + hashlib.blake2b(data, digest_size=16).hexdigest()


def fingerprint(value: Any) -> str:
    return fingerprint_bytes(_tagged(value))


def fingerprint_file(path: str) -> str:
    """Of the content alone, read in parts."""
    h = hashlib.blake2b(digest_size=16)
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return PREFIX + h.hexdigest()


def frame_fingerprint(*frames: DataFrame) -> str:
    """Of columns and rows, whatever their order; repeated rows count.

    Each row is hashed with lengths and nulls written out. Two independent sums over
    128 bits of hash stand for the multiset: they add up in any order, so nothing is
    sorted or gathered.
    """
    parts = []
    for df in frames:
        columns = sorted(df.columns)
        text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
        digest = F.sha2(F.concat_ws("|", *text), 256)
        halves = [F.conv(F.substring(digest, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)") for i in range(4)]
        found = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in halves]).first()
        parts.append([columns, [dict(df.dtypes)[c] for c in columns], [str(x or 0) for x in found]])
    return fingerprint(parts)
