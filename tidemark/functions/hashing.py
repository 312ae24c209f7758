"""Keys, fingerprints and seeded orders from SHA-256."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(salt: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, by built-in functions; null for null and empty messages."""
    import hashlib

    key = (salt if len(salt) <= 64 else hashlib.sha256(salt).digest()).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    outer = F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)
    return F.when(F.coalesce(message, F.lit("")) != "", outer)


def duplicate_key(user: Column, product: Column, ms: Column, rating: Column, text: Column) -> Column:
    """One key for a review, whatever its domain: injective, as lengths go before the parts."""
    parts = [F.coalesce(user.cast("string"), F.lit("<missing-user>")), *(F.coalesce(c.cast("string"), F.lit("")) for c in (product, ms, rating, text))]
    return F.sha2(F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def seeded_order(seed: int | str, *values: Column, separator: str = "\0") -> Column:
    """A pseudo-random but repeatable order: SHA-256 of the seed and values."""
    return F.sha2(F.concat_ws(separator, F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256)


def rows_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies a set of rows whatever their order: count, sum and exclusive-or of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
