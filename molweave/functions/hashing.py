"""Token hashes: a portable one inside the JVM and one over Python literals for exchange with Python systems."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_hash(text: Column) -> Column:
    """60-bit non-negative BIGINT from the first 15 hexadecimal digits of MD5; ``2 * t + 1`` still fits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_hash(tag: str, seed: int, value: Column) -> Column:
    return token_hash(F.concat(F.lit(f"{tag}|{seed}|"), value.cast("string")))


def exchange_hash(text: str, seed: int = 0, person: bytes = b"") -> int:
    """Unsigned 64-bit BLAKE2b of a Python literal as text; a seed other than 0 goes first as 8 bytes.

    ``person`` separates the tokens of different systems: give the one whose tokens must be met."""
    salt = seed.to_bytes(8, "little") if seed else b""
    return int.from_bytes(hashlib.blake2b(salt + text.encode(), digest_size=8, person=person).digest(), "little")


def exchange_hashes(text: Column, seed: int = 0, person: bytes = b"") -> Column:
    """The same for a column of literals, batch by batch, as DECIMAL(20, 0); null for null."""

    @F.pandas_udf("decimal(20,0)")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else Decimal(exchange_hash(t, seed, person)))

    return run(text)
