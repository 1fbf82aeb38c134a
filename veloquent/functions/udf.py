"""Functions of one row's values as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x):
    """A value as the function wants it: missing values as None, arrays as lists."""
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    return [_plain(v) for v in x] if isinstance(x, list) else x


def per_row(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function of ``f``; built when called, since types are parsed by a session."""

    if kind.startswith("struct"):  # a batch of structs would have to be a data frame; a list of one struct is a value
        as_list = per_row(lambda *xs: [f(*xs)], f"array<{kind}>")
        return lambda *cols: F.get(as_list(*cols), 0)

    def build(*cols) -> Column:
        def run(*batch: pd.Series) -> pd.Series:
            return pd.Series([f(*map(_plain, row)) for row in zip(*batch)], dtype=object)

        return F.pandas_udf(run, kind)(*cols)

    return build


def per_batch(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function of ``f``, which takes and gives whole Arrow arrays and so calls Python once a batch."""

    def run(*arrays: pa.Array) -> pa.Array:
        return f(*[x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays])

    return lambda *cols: F.arrow_udf(run, kind)(*cols)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, where it is used inside a function of an array's elements."""
    return F.get(F.transform(F.array(value), body), 0)
