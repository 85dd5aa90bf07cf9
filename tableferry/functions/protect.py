"""Hashes of tokens, column encryption and packed payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of a protected and of a packed payload, and the key derivation.
ENCRYPTED_MARK = "ENC:"
PACKED_MARK = "GZ:"
KEY_BYTES = 32
KEY_ITERATIONS = 100_000


def token_hash(token: Column) -> Column:
    """SHA-256 of a token in hex; tokens are looked up by this."""
    return F.sha2(token.cast("string"), 256)


def token_prefix(token: Column) -> Column:
    """What a list may show of a token."""
    return F.substring(token, 1, 8)


def find_tokens(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """Presented tokens (``token``) with the stored row of the same hash (``hash``); the token itself goes no further."""
    hashed = presented.select(token_hash(F.col("token")).alias("hash"), token_prefix(F.col("token")).alias("shown"))
    return hashed.join(tokens, "hash")


def derive_key(secret: str, salt: bytes) -> bytes:
    """The column key, computed once on the driver."""
    return hashlib.pbkdf2_hmac("sha256", secret.encode(), salt, KEY_ITERATIONS, KEY_BYTES)


def _held(key: bytes) -> Column:
    """The key as the one value of a one-row table: a literal would stand in clear in every plan, the UI and the event log."""
    return SparkSession.active().createDataFrame([(bytearray(key),)], "key binary").scalar()


def encrypt(col: Column, key: bytes) -> Column:
    """AES-256-GCM as ``ENC:`` + base64(nonce, ciphertext, tag)."""
    sealed = F.aes_encrypt(col.cast("binary"), _held(key), F.lit("GCM"))
    # Spark breaks base64 into lines; a protected value is one line.
    return F.concat(F.lit(ENCRYPTED_MARK), F.translate(F.base64(sealed), "\r\n", ""))


def decrypt(col: Column, key: bytes) -> Column:
    """The clear text; a value without the mark passes through, a broken one becomes NULL."""
    payload = F.try_to_binary(F.substr(col, F.lit(len(ENCRYPTED_MARK) + 1)), F.lit("base64"))
    opened = F.try_aes_decrypt(payload, _held(key), F.lit("GCM"))
    return F.when(col.startswith(ENCRYPTED_MARK), F.decode(opened, "UTF-8")).otherwise(col)


# Payloads may be long: plain functions get 100 rows at once, Arrow batches 10,000 whatever their length.
@F.udf(T.StringType(), useArrow=False)
def gunzip_base64(packed: str | None) -> str | None:
    """Base64 + gzip to text; Spark has no built-in for gzip. Broken values become NULL."""
    if packed is None:
        return None
    try:
        return gzip.decompress(base64.b64decode(packed, validate=True)).decode("utf-8")
    except (ValueError, OSError, EOFError, zlib.error):
        return None


@F.udf(T.StringType(), useArrow=False)
def gzip_base64(text: str | None) -> str | None:
    """Text to gzip + base64, the packed form of a payload."""
    return None if text is None else base64.b64encode(gzip.compress(text.encode(), 1)).decode()


def unpack(col: Column) -> Column:
    """A payload without its packing; a value without the mark passes through."""
    marked = col.startswith(PACKED_MARK)
    body = F.when(marked, F.substr(col, F.lit(len(PACKED_MARK) + 1)))
    return F.when(marked, gunzip_base64(body)).otherwise(col)
