"""Repeatable per-id draws that stand in for ``rand(seed)``.

``rand`` gives other values when the partitioning changes (ledger L4), so a
re-run after a lost executor, or on a wider cluster, would fill other
numbers.  A draw here is a pure function of (salt, id): the first 8 hex
digits of md5 over ``salt:id`` as a bigint in [0, 2**32).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ID


def draw(salt: str, key: Column | str = ID) -> Column:
    """Integer draw in [0, 2**32) from md5(``salt:key``); a null key hashes as ''
    so that every row, like with ``rand``, gets a value."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(k.cast("string"), F.lit("")))
    hexed = F.substring(F.md5(text), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint")


def uniform(salt: str, key: Column | str = ID, steps: int = 1000) -> Column:
    """Draw on the grid {0, 1/steps, ..., 1}, both ends included."""
    return (draw(salt, key) % (steps + 1)) / F.lit(float(steps))


def coin(salt: str, key: Column | str = ID, p: float = 0.5, steps: int = 1000) -> Column:
    """True with probability ``p`` (on a grid of ``steps``)."""
    return (draw(salt, key) % steps) < int(round(p * steps))
