"""Sequential rules over the rows of a key: rows are dealt and sorted by Spark, and a task carries one key's state from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame

#: (state, row) -> (state, rows out)
Step = Callable[[Any, Any], tuple[Any, list[tuple]]]


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], start: Callable[[], Any], step: Step, schema: str, end: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Rows that `step` gives for each row of a key in order, and those that `end` (key, state) gives after its last one.

    Whatever the number of a key's rows, a task holds one batch and one state.
    """
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in pdfs:
            out: list[tuple] = []
            for mine, row in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf.itertuples(index=False), strict=True):
                if mine != key:
                    if end is not None and key is not None:
                        out += end(key, state)
                    key, state = mine, start()
                state, some = step(state, row)
                out += some
            yield pd.DataFrame(out, columns=names)
        if end is not None and key is not None:
            yield pd.DataFrame(end(key, state), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
