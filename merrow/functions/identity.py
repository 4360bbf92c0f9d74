"""Canonical JSON, keyed pseudonyms, digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and explicit nulls; doubles are given through ``finite``."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def finite(number: Column) -> Column:
    """A double that JSON can hold; NaN and the infinities are an error."""
    wild = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(wild, F.raise_error(F.lit("a number is not finite")).cast("double")).otherwise(number)


def pseudonym(identifier: Column, key: bytes, domain: bytes) -> Column:
    """HMAC-SHA-256 of domain and identifier as hex, by native hash functions."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner + domain), F.encode(identifier, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


# Fixed value: what stands before a legacy key in its stand-in's digest.
LEGACY_PREFIX = "legacy-revoked-v1:"


def replacement_digest(key: Column, id_: Column, constant: str = LEGACY_PREFIX) -> Column:
    """A 64-digit stand-in for a legacy key: MD5 of the key, then the id in 32 hex digits."""
    return F.concat(F.md5(F.concat(F.lit(constant), key)), F.lpad(F.lower(F.hex(id_)), 32, "0"))


def state_fingerprint(disliked: Column, played: Column, sources: Column) -> Column:
    """SHA-256 of the canonical JSON of a user's effective feedback."""
    return F.sha2(canonical_json(disliked=F.array_sort(disliked), played=F.array_sort(played), positive_sources=sources), 256)
