"""Arrow-batch functions the optimizer evaluates exactly once per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

PIECE_ITEMS = 1 << 20  # bytes or samples that a piece of a batch holds, unless one row has more
PIECE_ROWS = 1024


def batch_udf(return_type: str):
    """A pandas UDF that is opaque to the optimizer.

    A filter on the result of an ordinary UDF is pushed below the projection that computes it, and a
    column used twice is inlined twice; either way the function runs again for every row. The mark
    below keeps projection and filter where they are written. Results stay reproducible: every
    function passed here depends on its arguments only.
    """

    def wrap(fn):
        return F.pandas_udf(fn, return_type).asNondeterministic()

    return wrap


def pieces(columns: tuple[pd.Series, ...], rows: int = PIECE_ROWS) -> Iterator[tuple[int, int]]:
    """Where to cut a batch so that a piece holds few rows and a bounded number of bytes or samples."""
    size = np.ones(len(columns[0]), np.int64)
    for column in columns:
        if column.dtype == object:
            size += np.fromiter((0 if v is None else len(v) for v in column), np.int64, len(column))
    start, held = 0, 0
    for at, one in enumerate(size):
        if at > start and (held + one > PIECE_ITEMS or at - start >= rows):
            yield start, at
            start, held = at, 0
        held += one
    if len(size):
        yield start, len(size)


def piece_udf(return_type: str, rows: int = PIECE_ROWS):
    """:func:`batch_udf` for functions whose result may be far larger than a batch, such as waveforms.

    A batch is passed on piece by piece and every piece's result leaves before the next one is computed, so a
    worker holds a batch and one piece's results, however long the table is.
    """

    def wrap(fn):
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)
                for start, stop in pieces(columns, rows):
                    yield fn(*[c.iloc[start:stop] for c in columns])

        return F.pandas_udf(run, return_type).asNondeterministic()

    return wrap


def _lists(column: pd.Series) -> pa.Array:
    """Arrays, or None, as one Arrow array of 32-bit floats."""
    missing = np.fromiter((v is None for v in column), bool, len(column))
    sizes = np.fromiter((0 if v is None else len(v) for v in column), np.int32, len(column))
    values = [np.asarray(v, dtype=np.float32) for v in column if v is not None]
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(0, np.float32), *values])), mask=pa.array(missing))


def wave_udf(return_type: str, rows: int = PIECE_ROWS):
    """:func:`piece_udf` for ``array<float>``, or a struct of such, which leave as whole Arrow arrays. Of arrays that a pandas
    function returns, each value becomes a Python object on the way, which takes longer than decoding it."""

    def wrap(fn):
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                columns = tuple(c.to_pandas() for c in (batch if isinstance(batch, tuple) else (batch,)))
                for start, stop in pieces(columns, rows):
                    found = fn(*[c.iloc[start:stop] for c in columns])
                    if isinstance(found, pd.DataFrame):
                        yield pa.StructArray.from_arrays([_lists(found[c]) for c in found], list(found))
                    else:
                        yield _lists(found)

        return F.arrow_udf(run, return_type).asNondeterministic()

    return wrap
