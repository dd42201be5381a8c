"""Row helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_if(df: DataFrame, cond: Callable[[Column], Column]) -> DataFrame:
    """Keep rows where ``cond(row_struct)`` holds, evaluated AFTER the projection feeding it.

    A plain ``filter`` on a column computed by an expensive projection (regex detection) is
    rewritten by Catalyst into the underlying expression and pushed below the projection —
    down to the scan — so the expensive work runs twice. Packing the row into a 0/1-element
    array and exploding it is a generator, which the optimizer does not push predicates
    through, so the work is done once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row), cond)))


def generator_input(arr) -> Column:
    """Wrap an array column before ``inline``/``explode``.

    For a generator over a bare column Catalyst infers ``size(col) > 0`` and pushes it down
    with the column's defining expression substituted — re-running e.g. the whole regex
    detection in the scan stage. The inference only applies to bare attributes, so pass the
    array through an identity ``filter``.
    """
    col = F.col(arr) if isinstance(arr, str) else arr
    return F.filter(col, lambda x: F.lit(True))


def sealed(df: DataFrame) -> DataFrame:
    """``df`` behind a one-element generator, which filters and explodes are not pushed through.

    Pushed below a chain of projections, a filter is rewritten in terms of the first inputs,
    and its expression grows with every level that names an earlier column twice.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
