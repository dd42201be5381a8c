"""Seeded deterministic draws: ``md5(seed:key...)`` -> integer in [0, m).

The same integer comes out of Spark and DuckDB (first 8 hex digits of the md5), so
generated data and simulated replies are reproducible at any partitioning, on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_hex(seed: str, *parts) -> Column:
    """Hex digest of ``'seed:part1:part2...'``."""
    cols = [F.lit(seed)] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def md5_int(seed: str, *parts) -> Column:
    """32-bit integer from ``md5('seed:part1:part2...')``."""
    return F.conv(F.substring(md5_hex(seed, *parts), 1, 8), 16, 10).cast("bigint")


def draw(seed: str, m: int, *parts) -> Column:
    """Integer in ``[0, m)``."""
    return md5_int(seed, *parts) % F.lit(m)


def pick(seed: str, options: list[str], *parts) -> Column:
    """One of ``options`` (a literal list) chosen by a draw."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (draw(seed, len(options), *parts) + 1).cast("int"))


def md5_hex_sql(seed: str, *parts: str) -> str:
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"


def draw_sql(seed: str, m: int, *parts: str) -> str:
    """DuckDB twin of ``draw``; ``parts`` are SQL expressions."""
    return f"(CAST(('0x' || substr({md5_hex_sql(seed, *parts)}, 1, 8)) AS BIGINT) % {m})"
