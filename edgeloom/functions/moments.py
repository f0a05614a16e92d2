"""Moments: now as epoch seconds, hashed dates in a range, the day in a file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int


def epoch_now() -> Column:
    """The query's start as whole epoch seconds, as text."""
    return F.unix_timestamp().cast("string")


def random_moment(start: str, end: str, seed: int, *keys: str) -> Column:
    """A hashed moment in [start, end), to the second, that depends on the seed and the keys only."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    span = F.timestamp_diff("SECOND", a, b)
    return F.timestamp_add("SECOND", F.pmod(hash_int(seed, *keys), span), a)


def day_of_path(path: Column) -> Column:
    """MM-DD of a path such as .../2008-07-28.txt.gz; '' without one."""
    return F.regexp_extract(path, r"(?:^|\D)(\d{2}-\d{2})(?:\D[^/]*)?$", 1)
