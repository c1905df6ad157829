"""Equi-joins onto a keyed dimension when one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanthorn.session import BROADCAST_ROWS, checkpoint

#: Rows of one key that one salt takes. The list of hot keys has at most (all rows / HOT_ROWS) entries.
HOT_ROWS = 200_000


def skew_join(
    rows: DataFrame, dim: DataFrame, key: str, weight: str, spread: Column, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join ``rows`` to ``dim`` (one row per ``key``), salting the keys that hold many rows.

    ``weight`` is a column of ``dim`` with the number of ``rows`` rows of the key; a key of more than ``hot_rows``
    gets ceil(weight / hot_rows) salts, the dimension row being repeated for each, so that no task takes more than
    about ``hot_rows`` rows of one key. ``spread`` (an integer expression over ``rows``) picks the salt. Salts of the
    cold keys are 0. The list of hot keys is always broadcast: where it has more than BROADCAST_ROWS keys, ``hot_rows``
    doubles until it has not, which all rows bound. ``dim`` is written once. ``weight`` is dropped. Null keys match
    nothing.
    """
    dim = checkpoint(dim)
    while dim.where(F.col(weight) > hot_rows).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        hot_rows *= 2
    salts = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(hot_rows))).cast("int")
    hot = F.broadcast(dim.where(F.col(weight) > hot_rows).select(F.col(key), salts.alias("_n")))
    salted = (
        rows.join(hot, key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_n")), F.lit(0)).cast("int"))
        .drop("_n")
    )
    dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(weight)
    return salted.join(dim, [key, "_salt"], how).drop("_salt")
