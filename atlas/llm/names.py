"""Column names for intermediate results that no input column has."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def unused(columns: Iterable[str], n: int) -> list[str]:
    """``n`` names that differ from ``columns`` and from each other, in any case."""
    taken = {c.lower() for c in columns}
    out: list[str] = []
    i = 0
    while len(out) < n:
        if (name := f"_x{i}") not in taken:
            out.append(name)
        i += 1
    return out


def shielded(rows: DataFrame, needed: Iterable[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(rows)``, which returns the columns it is given, with all but the ``needed`` ones under other names
    meanwhile: no column of the caller's can clash with one that ``run`` adds for itself."""
    keep = set(needed)
    inner = [c if c in keep else f"other{i}_of_caller" for i, c in enumerate(rows.columns)]
    return run(rows.toDF(*inner)).toDF(*rows.columns)
