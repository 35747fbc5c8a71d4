"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. Here each key is cut into
blocks of an integer order column that is unique inside the key, so a block
never holds more than ``block`` rows. Block totals are aggregated map-side,
folded per key over the (few) blocks, joined back, and finished inside the
block. The rows themselves are shuffled once, by key and block.

Where the order is sparse or clustered (hashes, time stamps), blocks lie between measured splitters instead of
having an equal width: quantiles of the order over all keys, so that a key with most of the rows is cut evenly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.shipping import by_value

BLOCK_ROWS = 1 << 16
#: Most splitters that are measured: a list of so many numbers goes to the tasks, whatever the number of rows.
SPLITTERS = 4096
_BLOCK = "__block"


def _same_keys(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right["__k_" + n]) for n in names])


def _number(df: DataFrame, order: str) -> Column:
    """The order as a whole number; time stamps in microseconds."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(order)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.unix_date(order).cast("long") if isinstance(kind, T.DateType) else F.col(order).cast("long")


def splitters(df: DataFrame, order: str, rows: int = BLOCK_ROWS, most: int = SPLITTERS) -> list[int]:
    """Quantiles of the order that leave about `rows` rows between them, at most `most`; measured in two scans of that column."""
    number = df.select(_number(df, order).alias("o"))
    blocks = min(most, -(-number.count() // rows))
    if blocks < 2:
        return []
    ranks = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
    return sorted(set(number.agg(F.percentile_approx("o", ranks, F.lit(max(10_000, 20 * blocks)))).first()[0] or []))


def measured_block(df: DataFrame, order: str, rows: int = BLOCK_ROWS) -> Column:
    """Number of the block between splitters that a row is in. Rows of equal order are in one."""
    cuts = np.array(splitters(df, order, rows), dtype=np.int64)
    if not len(cuts):
        return F.lit(0).cast("long")

    @F.pandas_udf(T.LongType())
    def block(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy(dtype=np.float64, na_value=-np.inf) if values.hasnans else values.to_numpy(), side="right"))

    return block(_number(df, order))


def running(
    df: DataFrame, keys: list[str], order: str, outputs: dict[str, tuple[str, Column]],
    inclusive: bool = True, block: int | None = BLOCK_ROWS, ties: list[str] | None = None, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running totals per key in the order of a column.

    outputs: name -> (kind, column); kind is 'sum', 'max' or 'last' (last
    non-null value). With inclusive=False a row does not see itself.
    block: width of a block where the order is a dense whole number; None: blocks of about `rows` rows are measured first.
    ties: columns that order rows of a key with the same order; without them it has to be unique in a key.
    """
    ties = ties or []
    place = F.struct(order, *ties)
    prepared = df.withColumns({f"__v_{n}": c for n, (_, c) in outputs.items()})
    prepared = prepared.withColumn(_BLOCK, measured_block(df, order, rows) if block is None else F.floor(F.col(order) / block))
    totals = []
    for name, (kind, _) in outputs.items():
        value = F.col(f"__v_{name}")
        if kind == "sum":
            totals.append(F.sum(value).alias(f"__t_{name}"))
        elif kind == "max":
            totals.append(F.max(value).alias(f"__t_{name}"))
        else:
            totals.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(f"__t_{name}"))
    names = [*keys, _BLOCK]
    blocks = prepared.groupBy(*names).agg(*totals)
    before = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        *[F.col(n).alias("__k_" + n) for n in names],
        *[_fold(kind, F.col(f"__t_{n}"), before).alias(f"__o_{n}") for n, (kind, _) in outputs.items()])
    joined = prepared.join(offsets, _same_keys(prepared, offsets, names), "left")
    inside = W.partitionBy(*names).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    results = {}
    for name, (kind, _) in outputs.items():
        local, offset = _fold(kind, F.col(f"__v_{name}"), inside), F.col(f"__o_{name}")
        if kind == "sum":
            results[name] = F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0))
        elif kind == "max":
            results[name] = F.greatest(local, offset)
        else:
            results[name] = F.coalesce(local, offset)
    kept = [c for c in df.columns if c not in outputs]
    return joined.withColumns({f"__r_{n}": c for n, c in results.items()}).select(
        *kept, *[F.col(f"__r_{n}").alias(n) for n in outputs])


def _fold(kind: str, value: Column, window: object) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def carry_last(
    df: DataFrame, keys: list[str], order: str, columns: list[str], block: int | None = None, ties: list[str] | None = None,
) -> DataFrame:
    """Fill nulls of the columns from the last row above that has a value. The order may be sparse; see running."""
    return running(df, keys, order, {c: ("last", F.col(c)) for c in columns}, block=block, ties=ties).select(*df.columns)


def row_numbers(
    df: DataFrame, keys: list[str], order: str, name: str = "row_number", block: int = BLOCK_ROWS,
) -> DataFrame:
    """1, 2, 3 ... per key in the order of a unique integer column."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, block=block)


def first_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per key, the first in the given order; combined before the shuffle."""
    picked = F.min_by(F.struct(*columns), order).alias("__first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("__first")[c].alias(c) for c in columns])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; every task keeps n rows per key before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


by_value(__name__)
