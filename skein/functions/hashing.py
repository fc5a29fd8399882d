"""Random streams as functions of keys: free of order and partitions, and the same in any engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of the SHA-256 of the parts joined by |."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def uniform_of(*parts: object) -> float:
    """The same number for plain values, on the driver."""
    return (int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)


def digest(seed: str, *parts: Column) -> Column:
    """Hexadecimal SHA-256 of seed and parts joined by |, for orders that are as good as random."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"), 256)


def laplace(scale: Column, *parts: Column) -> Column:
    u = uniform(*parts) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def sketch_positions(salt: bytes | Column, key: Column, m: int, k: int) -> Column:
    """k positions below m: the first eight bytes of SHA-256(index, salt, key), modulo m."""
    salt = F.lit(salt) if isinstance(salt, bytes) else salt
    found = []
    for i in range(k):
        hashed = F.sha2(F.concat(F.lit(i.to_bytes(4, "big")), salt, key.cast("binary")), 256)
        value = F.conv(F.substring(hashed, 1, 16), 16, 10).cast("decimal(20,0)")
        found.append((value % F.lit(m)).cast("int"))
    return F.array(*found)
