"""Content protection expressions (AES-256, authenticated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt_column(content: Column, key: Column, mode: str = "GCM") -> Column:
    """Encrypt text or bytes with a 32-byte key; a fresh nonce per value."""
    return F.aes_encrypt(content, key, F.lit(mode))


def decrypt_column(content: Column, key: Column, mode: str = "GCM") -> Column:
    """Decrypt to text. A wrong key gives NULL, never garbage."""
    return F.try_aes_decrypt(content, key, F.lit(mode)).cast("string")
