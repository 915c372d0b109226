"""Folding ordered groups in Python without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_groups(df: DataFrame, key: str, order: list[str], fold: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """`fold` gets the rows of a key (named tuples, ordered) and gives result rows.

    Rows are hashed by the key and sorted inside the partitions, then read as one stream per task: thousands of small
    groups cost one pass, and only one group is held at a time. Null keys are a group.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for part in batches:
            out: list[tuple] = []
            for row in part.itertuples(index=False):
                k = getattr(row, key)
                if held and getattr(held[0], key) != k and not (k != k or (k is None and getattr(held[0], key) is None)):
                    out += fold(held)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held and (out := fold(held)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
