"""Node ids and amounts as they really arrive: one number written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other scripts' decimal digits start at these code points; each block has ten in order.
_DIGIT_BLOCKS = (0xFF10, 0x0660, 0x06F0, 0x0966)
_FOREIGN = "".join(chr(b + i) for b in _DIGIT_BLOCKS for i in range(10))
_ASCII = "0123456789" * len(_DIGIT_BLOCKS)

_LOW, _HIGH = 10**14, 10**15 - 1


def id_number(c: Column | str) -> Column:
    """The number an id stands for, as BIGINT.

    Grouping marks, quotes, prefixes such as ``tel:`` or ``+``, zero padding, digits of other scripts, invisible
    characters and a decimal part of zeros do not count. Null when there is no digit, only zeros, or more than 18
    digits. The plain 15-digit form, nearly all rows, takes no regular expression.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = c.try_cast("bigint")
    digits = F.regexp_replace(
        F.regexp_replace(F.translate(c, _FOREIGN, _ASCII), r"^([^.]*)\.0+[^0-9]*$", "$1"), r"[^0-9]", ""
    )
    bare = F.regexp_replace(digits, r"^0+", "")
    slow = F.when(F.length(bare).between(1, 18), bare.try_cast("bigint"))
    return F.when((F.length(c) == 15) & plain.between(_LOW, _HIGH), plain).otherwise(slow)


def id_text(c: Column | str) -> Column:
    """``id_number`` as a string of digits."""
    return id_number(c).cast("string")


def amount(c: Column | str) -> Column:
    """A decimal amount as DOUBLE; null for null, blank, or anything that is no plain number (``NA``, ``\\N``, ``inf``)."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), c.try_cast("double"))


def sql_id_number(c: str) -> str:
    """``id_number`` in DuckDB's dialect."""
    bare = (
        rf"regexp_replace(regexp_replace(regexp_replace(translate({c}, '{_FOREIGN}', '{_ASCII}'), "
        rf"'^([^.]*)\.0+[^0-9]*$', '\1'), '[^0-9]', '', 'g'), '^0+', '')"
    )
    return f"(case when length({bare}) between 1 and 18 then cast({bare} as bigint) end)"


def sql_id_text(c: str) -> str:
    return f"cast({sql_id_number(c)} as varchar)"


def sql_amount(c: str) -> str:
    """``amount`` in DuckDB's dialect."""
    return rf"(case when regexp_matches(trim({c}), '^[+-]?[0-9]+(\.[0-9]*)?$') then try_cast(trim({c}) as double) end)"
