"""Loop helper: cut the lineage each round, stop when a small signature no longer changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import cut_counted, discard


def signature(df: DataFrame) -> Column:
    """An order-free hash sum of all rows; with the row count two numbers, however many rows."""
    return F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)"))


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """Apply ``step`` until the rows stay the same; raises RuntimeError after ``max_rounds``.

    The signature is taken while a round is written, so a round is read by the next one only.
    """
    now, sig = cut_counted(start, signature(start))
    for _ in range(max_rounds):
        got = step(now)
        new, new_sig = cut_counted(got, signature(got))
        discard(now)
        if new_sig == sig:
            return new
        now, sig = new, new_sig
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
