"""Chunk codecs: hash, CRC, zstd with the 95 % rule, AES-GCM, and passphrase keys."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.functions.errors import AuthenticationError, PasswordRequired, WeakPassphrase

#: The compression level and the share of the raw size that a payload must stay under.
LEVEL, KEEP_PERCENT = 3, 95


@F.pandas_udf(T.BinaryType())
def zstd_compress(data: pd.Series) -> pd.Series:
    c = zstandard.ZstdCompressor(level=LEVEL)
    return data.map(lambda x: None if x is None else c.compress(x))


@F.pandas_udf(T.BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    d = zstandard.ZstdDecompressor()
    return data.map(lambda x: None if x is None else d.decompress(x))


def encode_chunk(data: Column) -> Column:
    """struct<codec, payload>: compressed only if that is under 95 % of the raw size, in whole numbers."""
    packed = zstd_compress(data)
    good = F.octet_length(packed) < F.floor(F.octet_length(data) * KEEP_PERCENT / 100)
    return F.struct(F.when(good, "zstd").otherwise("none").alias("codec"), F.when(good, packed).otherwise(data).alias("payload"))


def decode_chunk(codec: Column, payload: Column) -> Column:
    return F.when(codec == "zstd", zstd_decompress(F.when(codec == "zstd", payload))).otherwise(payload)


def crc(data: Column) -> Column:
    """CRC-32 (IEEE) of the stored bytes."""
    return F.crc32(data)


def associated_data(chunk_id: Column, codec: Column, raw_len: Column, payload_len: Column) -> Column:
    return F.concat_ws("|", chunk_id, codec, F.lit("gcm"), raw_len.cast("string"), payload_len.cast("string")).cast("binary")


def encrypt(payload: Column, key: Column, aad: Column) -> Column:
    """AES-256-GCM with a random nonce; nonce, data and tag in one value."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)


def decrypt(payload: Column, key: Column, aad: Column) -> Column:
    """Null where the key, the data or what is bound to them is wrong."""
    return F.try_aes_decrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _kek(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=64)


def check_passphrase(passphrase: str) -> None:
    if len(passphrase.encode()) < 8 or not passphrase.strip():
        raise WeakPassphrase("a passphrase has 8 bytes or more and is not blank")


def create_key(passphrase: str) -> tuple[bytes, dict]:
    """A random master key, and the record from which the passphrase gets it back."""
    check_passphrase(passphrase)
    master, salt = os.urandom(32), os.urandom(16)
    pad = _kek(passphrase, salt)
    wrapped = bytes(a ^ b for a, b in zip(master, pad[:32], strict=True))
    tag = hashlib.blake2b(salt + wrapped, key=pad[32:], digest_size=32).hexdigest()
    return master, {"kdf": "scrypt", "salt": salt.hex(), "wrapped": wrapped.hex(), "tag": tag}


def unlock_key(passphrase: str | None, record: dict) -> bytes:
    if passphrase is None:
        raise PasswordRequired("the store is encrypted")
    salt, wrapped = bytes.fromhex(record["salt"]), bytes.fromhex(record["wrapped"])
    pad = _kek(passphrase, salt)
    if hashlib.blake2b(salt + wrapped, key=pad[32:], digest_size=32).hexdigest() != record["tag"]:
        raise AuthenticationError("wrong passphrase")
    return bytes(a ^ b for a, b in zip(wrapped, pad[:32], strict=True))
