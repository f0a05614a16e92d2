"""Seeded, engine-independent hashing: every random choice is an md5 of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int | str, *parts: Column | str) -> Column:
    """md5 of seed and parts joined with '|'; a total order for shuffles and prefixes."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_int(seed: int | str, *parts: Column | str) -> Column:
    """The first 32 bits of ``key_hash`` as BIGINT, 0 .. 2**32 - 1."""
    return F.conv(F.substring(key_hash(seed, *parts), 1, 8), 16, 10).cast("bigint")


def sql_key_hash(seed: int | str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def sql_hash_int(seed: int | str, *parts: str) -> str:
    return f"cast('0x' || substr({sql_key_hash(seed, *parts)}, 1, 8) as bigint)"
