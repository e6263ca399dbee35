"""Digests and keyed pseudonyms."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of a binary column, from two nested built-in digests."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer = F.lit(bytearray(b ^ 0x5C for b in padded))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def keyed_hash(value: Column, key: bytes) -> Column:
    return F.concat(F.lit("hmac-sha256:"), hmac_sha256(F.encode(value, "UTF-8"), key))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted field names and explicit nulls."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})
