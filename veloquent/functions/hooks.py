"""Models from outside as columns: speech recognition, phone recognition, grammar feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def model_column(load: Callable[[], Callable[[list], list]], kind: str) -> Callable[[str | Column], Column]:
    """A column function of a model that takes and gives lists of values.

    ``load`` runs once per task, on the executor, so that weights are read there and never travel with the plan;
    the model then sees whole Arrow batches. Null inputs are not shown to it and stay null.
    """

    def build(c: str | Column) -> Column:
        def run(batches):
            model = load()
            for b in batches:
                some = b.notna()
                out = pd.Series([None] * len(b), b.index, object)
                if some.any():
                    out.loc[some] = pd.Series(model(b[some].tolist()), b.index[some], object)
                yield out

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, kind)(c)

    return build
