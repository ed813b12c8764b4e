"""Ranges that lie in other ranges, joined by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bin; an outer range is put into each bin that it touches, an inner one into the bin of its start.
BIN = 1024


def contained(outer: DataFrame, inner: DataFrame, by: list[str], out: tuple[str, str], inn: tuple[str, str], width: int = BIN) -> DataFrame:
    """Pairs of rows with equal `by` whose inner range (columns inn) lies in the outer one (columns out).

    Columns other than `by` must differ.  What starts in another bin is never paired, so that the ranges of a long file meet only
    those near them.
    """
    touched = F.sequence(F.floor(F.col(out[0]) / width), F.floor(F.greatest(F.col(out[0]), F.col(out[1])) / width))
    placed = outer.filter(F.col(out[0]) <= F.col(out[1])).withColumn("_bin", F.explode(touched))
    started = inner.withColumn("_bin", F.floor(F.col(inn[0]) / width))
    return placed.join(started, [*by, "_bin"]).filter((F.col(inn[0]) >= F.col(out[0])) & (F.col(inn[1]) <= F.col(out[1]))).drop("_bin")
