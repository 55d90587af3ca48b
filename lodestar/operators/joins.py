"""Filtering a large table by a small key set without shuffling it.

The key side is counted first (a proven size bound) and broadcast when it is
under ``KEY_BROADCAST_CAP`` rows, so the large side is filtered in place by a
broadcast hash join; past the cap Spark's shuffle join is used.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BROADCAST_CAP = 4 << 20      # rows of keys (ids) we allow to broadcast


def small(keys: DataFrame, cap: int = KEY_BROADCAST_CAP) -> DataFrame:
    """``keys`` with a broadcast hint when its row count is under ``cap``."""
    return F.broadcast(keys) if keys.count() <= cap else keys


def keep_keys(big: DataFrame, keys: DataFrame, on) -> DataFrame:
    """big ⋉ keys (distinct keys), the big side filtered in place."""
    on = [on] if isinstance(on, str) else list(on)
    return big.join(small(keys.select(*on).distinct()), on, "left_semi")


def drop_keys(big: DataFrame, keys: DataFrame, on) -> DataFrame:
    """big ▷ keys, the big side filtered in place."""
    on = [on] if isinstance(on, str) else list(on)
    return big.join(small(keys.select(*on).distinct()), on, "left_anti")


def missing_keys(keys: DataFrame, big: DataFrame, on) -> DataFrame:
    """Distinct keys absent from ``big``: find the present ones by filtering
    ``big`` in place, then anti-join the two small sides."""
    on = [on] if isinstance(on, str) else list(on)
    k = keys.select(*on).distinct()
    found = big.select(*on).join(small(k), on, "left_semi").distinct()
    return k.join(found, on, "left_anti")
