"""AES-256-GCM for credentials on the driver and for columns in the cluster. The key is always given; none is built in."""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TAG, IV = 16, 16


def key_bytes(key: str) -> bytes:
    """32 bytes: a shorter key is filled up with 0, a longer one cut."""
    return key.encode().ljust(32, b"0")[:32]


def cipher(spark: SparkSession, mode: int, key: str, iv: bytes):
    crypto = spark._jvm.javax.crypto
    out = crypto.Cipher.getInstance("AES/GCM/NoPadding")
    out.init(mode, crypto.spec.SecretKeySpec(bytearray(key_bytes(key)), "AES"), crypto.spec.GCMParameterSpec(8 * TAG, bytearray(iv)))
    return out


def encrypt(spark: SparkSession, text: str, key: str) -> str:
    """iv:tag:ciphertext in hexadecimal digits, with a fresh iv each time."""
    iv = os.urandom(IV)
    made = bytes(cipher(spark, 1, key, iv).doFinal(bytearray(text.encode())))
    return ":".join(x.hex() for x in (iv, made[-TAG:], made[:-TAG]))


def decrypt(spark: SparkSession, text: str, key: str) -> str:
    """Raises where the key is another or the text was changed."""
    iv, tag, data = (bytes.fromhex(x) for x in text.split(":"))
    return bytes(cipher(spark, 2, key, iv).doFinal(bytearray(data + tag))).decode()


def encrypted(value: Column, key: str) -> Column:
    """A column's values as hexadecimal digits; null stays null."""
    return F.lower(F.hex(F.aes_encrypt(value.cast("binary"), F.lit(bytearray(key_bytes(key))), F.lit("GCM"))))


def decrypted(value: Column, key: str) -> Column:
    return F.aes_decrypt(F.unhex(value), F.lit(bytearray(key_bytes(key))), F.lit("GCM")).cast("string")
