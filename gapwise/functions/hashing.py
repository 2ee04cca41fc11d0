"""Keyed hashes as native expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # block length of SHA-1 and SHA-256 in bytes


def _pads(key: bytes, digest: str) -> tuple[bytearray, bytearray]:
    if len(key) > BLOCK:
        key = hashlib.new(digest, key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column; the key pads become literals."""
    inner, outer = _pads(key, "sha256")
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hmac_sha1(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA1 of a string column."""
    inner, outer = _pads(key, "sha1")
    return F.sha1(F.concat(F.lit(outer), F.unhex(F.sha1(F.concat(F.lit(inner), message.cast("binary"))))))


def unit_rank(hex_digest: Column) -> Column:
    """Leading 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def derive_key(secret: bytes, info: bytes = b"sid", length: int = 32) -> bytes:
    """HKDF-SHA256 with empty salt, done once on the driver."""
    root = hmac.new(b"\0" * 32, secret, hashlib.sha256).digest()
    block, out = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(root, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def session_key(key: bytes, uid: Column, start: Column, version: str) -> Column:
    """Session id from user, start second and algorithm version.

    Two sessions of a user that start in the same second share an id.
    """
    second = F.when(start < 0, F.ceil(start)).otherwise(F.floor(start)).cast("long").cast("string")
    return hmac_sha256(key, F.concat_ws("|", uid, second, F.lit(version)))
