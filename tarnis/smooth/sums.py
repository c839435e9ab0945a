"""Sums of vectors over a distributed frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT_PARTS = 64


def sum_over_rows(frame: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray], parts: int) -> np.ndarray:
    """Add up `partial(batch)` over all batches. Each task adds its own batches and sends one vector;
    with many tasks the vectors are first added in about sqrt(tasks) groups, so neither one task
    nor the driver ever receives more than that many."""

    def one_per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                v = partial(batch)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "v": [total]})

    vectors = frame.mapInPandas(one_per_task, "part int, v array<double>")
    if parts > DIRECT_PARTS:
        groups = math.ceil(math.sqrt(parts))

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"v": [np.sum(np.vstack(pdf["v"].to_list()), axis=0)]})

        vectors = vectors.groupBy(F.pmod("part", F.lit(groups))).applyInPandas(add, "v array<double>")
    rows = vectors.select("v").toArrow().column("v")
    if len(rows) == 0:
        raise ValueError("no rows to fit")
    flat = rows.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
