"""W1 — carry the last non-null value forward along an order.

Two plans with identical results:

* ``carry_forward_window``: one window per key. Simple, but one key (a hot
  session, one huge keyless log) lands in a single task.
* ``carry_forward`` (default): bucketed, in two passes over the input. Rows are cut
  into fixed-size buckets of the order column; each bucket's last non-null value is
  found with a partial aggregate, a window over the *bucket table* (one row per bucket,
  thousands of times smaller than the data) hands each bucket the value
  carried in from earlier buckets, and the final window is partitioned by
  ``(key, bucket)``. No task ever holds more than one bucket of one key, nothing is
  stored in between, and the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_ROWS = 1 << 20


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def carry_forward_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                         out: str) -> DataFrame:
    w = (Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  bucket_of: str | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Bucketed carry-forward; ``bucket_of`` is the (numeric) order column
    that is cut into buckets of ``bucket_rows`` values (default: first order column).

    Two passes, nothing stored: the first reduces every bucket to its last value by a
    partial ``max_by`` (one row per task and bucket is shuffled) and windows that bucket
    table by key; the second shuffles the rows once, by (key, bucket), meets the carried-in
    values on that partitioning and fills inside the bucket. Rows whose key is null
    count as one key."""
    bucket_of = bucket_of or order[0]
    b, v, k = "__carry_bucket", "__carry_value", "__carry_key"
    # One struct as key: it is never null, so rows with null keys meet in the join too.
    base = (df.withColumn(b, F.floor(F.col(bucket_of) / F.lit(bucket_rows)).cast("long"))
              .withColumn(v, value).withColumn(k, F.struct(*_cols(keys))))
    last = base.groupBy(k, b).agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*_cols(order)))).alias("__bucket_last"))
    before = Window.partitionBy(k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried_in = last.select(k, b, F.last("__bucket_last", ignorenulls=True).over(before).alias("__carried_in"))
    inside = Window.partitionBy(k, b).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (base.join(carried_in, [k, b])
                .withColumn(out, F.coalesce(F.last(v, ignorenulls=True).over(inside), "__carried_in"))
                .drop(k, b, v, "__carried_in"))
